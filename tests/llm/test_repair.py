import hashlib
import random
import re
import zlib
from functools import lru_cache, reduce
from itertools import product as tuples

import pytest
from dispatchlake.llm import repair
from dispatchlake.llm.repair import cheapest, product, repair_damaged, times

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text, fault = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))


def best_edits(letters):
    """(cost, audit) by trying each edit at each place, with what is left remembered."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(text):
        best = None
        for slots in tuples(range(3), repeat=len(text) + 1):  # at most two inserts at a place help
            marked = "".join("i" * n + c for n, c in zip(slots, [*text, ""], strict=True))
            best = min(filter(None, (best, run(marked))), default=None)
        return best

    def run(marked):
        @lru_cache(None)
        def step(i, last):
            if i == len(marked):
                return (0, "") if last in ("", "a") else None
            c, ways = marked[i], []
            if c == "i":
                opts = [(2, "I", r) for r in after[last] if r in "ua"]
            else:
                opts = [(3, "D", last)]
                if c != "d":
                    opts += [(c.isupper(), "K", r) for r in after[last] if r == c.lower()] + [(2 + c.isupper(), "R", r) for r in after[last] if r in "ua"]
            for cost, edit, to in opts:
                rest = step(i + 1, to)
                if rest:
                    ways.append((cost + rest[0], edit + rest[1]))
            return min(ways, default=None)

        return step(0, "")

    return with_inserts(letters)


def plain(rows):
    convs = {}
    for r in damaged(rows):
        convs.setdefault(r[0], []).append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(convs.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, letters, count = set(), "", [0, 0, 0]
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            if not bare:
                fault = 0
            elif (role, text) in seen:
                fault = 1
            else:
                fault = 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "d" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        told = {r[1] for r in own} - {None}
        gaps = max(told) - min(told) + 1 - len(told) if told else 0
        cost, audit = cheapest(product(letters))
        lines, at, final = [], 0, len(audit) - audit.count("D")
        want = "s" * (final % 2) + "ua" * (final // 2)
        for e in audit:
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[want[len(lines)]] + ":")
                continue
            _, _, role, text = own[at]
            at += 1
            if e != "D":
                now = want[len(lines)]
                assert e == "R" or role[0] == now
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[now]) + ":" + text)
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_products_against_every_edit():
    rng = random.Random(1)
    words = [""] + ["".join(p) for n in (1, 2) for p in tuples("suaxdSUAX", repeat=n)] + ["".join(rng.choice("suaxdSUAXua") for _ in range(rng.choice([3, 4, 5, 6]))) for _ in range(150)]
    for letters in words:
        cost, audit = cheapest(product(letters))
        assert (cost, audit) == best_edits(letters), letters


def test_products_in_any_grouping():
    rng = random.Random(2)
    for _ in range(60):
        letters = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randrange(1, 60)))
        a, b = sorted(rng.randrange(len(letters) + 1) for _ in range(2))
        assert product(letters) == times(product(letters[:a]), times(product(letters[a:b]), product(letters[b:]))) == reduce(times, map(product, letters))


def talk(rng):
    texts = ["Yes.", "No!", "Really?", "cut off", " ", "", "\t\n", "Ends here. \n", "dot. in", "é?", "…", None, "end.\u2028", "end.\x85"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "ape"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(12)):
            at = rng.choice([turn, turn, turn, turn + rng.randrange(4), None])
            rows.append((conv, at, rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.4 else f"say {rng.randrange(9)}."))
    rows += [(77, i, ("user", "assistant")[i % 2] if rng.random() < 0.8 else "system", f"turn {i}." if rng.random() < 0.7 else "again") for i in range(900)]
    rows += [(78, None, "user", "the same")] * 40 + [(79, i, None, None) for i in range(30)]
    return rows + rows[3:9] + rows[3:5]


@pytest.mark.parametrize("part", [50_000, 20])
def test_against_plain_python(spark, monkeypatch, part):
    monkeypatch.setattr(repair, "PART", part)
    monkeypatch.setattr(repair, "FAN", 3)
    monkeypatch.setattr(repair, "PIECE", 200)
    rows = talk(random.Random(3))
    table = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "'x' as audit", "1 as part", "2 as k", "3 as times")
    got = sorted((tuple(r) for r in repair_damaged(table).collect()), key=repr)
    assert got == plain(rows)


def test_a_very_long_conversation_and_text(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART", 2000)
    rng = random.Random(4)
    rows = [(5, i, rng.choice(["user", "assistant"]), f"{i}." if i % 7 else "same.") for i in range(20_000)] + [(6, 0, "user", "a" * 3_000_000 + "."), (6, 1, "assistant", "b.")]
    got = sorted((tuple(r) for r in repair_damaged(spark.createDataFrame(rows, ROWS)).collect()), key=repr)
    assert got == plain(rows)


def test_patterns_hold(spark):
    rows = talk(random.Random(9))
    done = repair.repair(repair.damage(spark.createDataFrame(rows, ROWS))).turns.where("pos is not null").collect()
    convs = {}
    for r in sorted(done, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.pos)):
        convs[r.conv_id] = convs.get(r.conv_id, "") + r.role[0]
    assert convs and all(GOOD.fullmatch(c) for c in convs.values())


def test_nothing(spark):
    assert repair_damaged(spark.createDataFrame([], ROWS)).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hello.")], ROWS)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
