import random

import pytest
from dispatchlake.llm import linedup
from dispatchlake.llm.linedup import Shape, drop_shared_lines

SPACE = " \t\n\v\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    least = -(2**63)
    holders = {}
    for did, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(least if did is None else did)
    out = []
    for did, text in rows:
        lines, own = (text or "").split("\n"), least if did is None else did
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == own]
        out.append((did, len(lines), len(lines) - len(kept), "\n".join(kept).encode()))
    return sorted(out, key=repr)


def corpus(rng):
    words = ["alpha", "Beta", "gamma", "délta", "Épsilon", "zeta", "ETA"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool = [phrase(rng.choice([5, 6, 7, 8, 9])) for _ in range(60)] + ["é" * 39, "é" * 40, "x" * 39, "x" * 40, "漢字" * 20, "Ä" * 45]
    rows = []
    for i in range(300):
        lines = [rng.choice(["", " ", "\t\v"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "\r", " \f"]) for _ in range(rng.randrange(6))]
        lines += [phrase(12) for _ in range(rng.randrange(3))] + ["shared by a third of all documents, a hot line"] * (i % 3 == 0)
        rng.shuffle(lines)
        rows.append((i * 7 % 401, "\n".join(lines)))
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, None), (900, None), (901, ""), (902, "\n\n"), (903, "a" * 100_000 + "\n" + pool[0])]


@pytest.mark.parametrize(("bits", "keys"), [(1 << 28, 1_000_000), (0, 0)])
def test_against_plain_counting(spark, monkeypatch, bits, keys):
    monkeypatch.setattr(linedup, "FILTER_BITS", bits)
    monkeypatch.setattr(linedup, "BROADCAST", keys)
    rows = corpus(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).selectExpr("*", "'x' as row", "1 as did", "2 as hi", "3 as kept")
    got = drop_shared_lines(docs, carry=("hi", "did"))
    assert sorted((tuple(r) for r in got.drop("row").collect()), key=repr) == plain(rows)
    assert got.select("row.hi").distinct().collect() == [(2,)]


def test_more_segments_than_one(spark, monkeypatch):
    monkeypatch.setattr(linedup, "SEGMENT", 1 << 12)
    monkeypatch.setattr(linedup, "CHUNK", 64)
    rows = corpus(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for bits in (1 << 28, 0):
        monkeypatch.setattr(linedup, "FILTER_BITS", bits)
        assert sorted((tuple(r) for r in drop_shared_lines(docs, min_docs=2).collect()), key=repr) == plain(rows, min_docs=2)


def test_few_once_seen_keys_are_suspected(spark):
    rows = [(i, f"a line of its own, which no other document has: number {i}") for i in range(20_000)]
    rows += [(i, "a line that two documents have between them, neither more nor less") for i in (30_000, 30_001)]
    texts = linedup.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    shape = Shape(len(rows))
    twice = linedup._seen_twice(linedup._filter_parts(texts, shape, 40), shape).cache()
    found = linedup._suspects(texts, twice, shape, 40, 5).collect()
    assert {30_000, 30_001} <= {r.did for r in found} and len(found) < 400


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_shared_lines(empty).count() == 0
    assert [tuple(r) for r in drop_shared_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 1, 0, b"")]
