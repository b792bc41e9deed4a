"""Repair of conversations to an optional system turn and alternating user and assistant turns.

Each turn is kept, given another role, or deleted, and empty turns may be inserted; the cheapest
edits win, ties by their initials. A turn is a 4x4 matrix over the states of the wanted pattern
(start, after system, after user, after assistant). Its elements are (cost, audit), added by
taking the least and multiplied by adding costs and joining audits, with the cheapest inserts
closed in. Products are associative: equal (cost, audit) orders are kept by what is joined on
either side, since of two audits over the same turns with the same cost none begins the other.

Turns travel as keys without texts and are dealt by ranges of (conversation, turn, role, text
hash), so a conversation may lie in many parts. Each part multiplies its matrices in a balanced
tree, and parts of a conversation are multiplied sixteen at a time until one is left. The winning
audit is cut up again and meets the texts, which are dealt by the same ranges, once. Only the
SHA-256 of a conversation is computed in one go: it reads the pieces of text in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.llm.common import cut

RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES, START, SYSTEM, USER, ASSISTANT = range(4), 0, 1, 2, 3
#: state after a role's turn, for each state before
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: different turns of one part, about
PART = 50_000
#: parts of a conversation that one task multiplies
FAN = 16
#: turns whose product is remembered as a whole
BLOCK = 8
#: characters of repaired text in one piece, about
PIECE = 1 << 22

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product; None stands for what can't be reached."""
    rows = []
    for row in a:
        reached = [(k, x) for k, x in enumerate(row) if x is not None]
        rows.append(tuple(min(((x[0] + b[k][j][0], x[1] + b[k][j][1]) for k, x in reached if b[k][j] is not None), default=None) for j in STATES))
    return tuple(rows)


def _inserts() -> Matrix:
    """The cheapest inserts from each state to each."""
    one = [[(0, "") if i == j else None for j in STATES] for i in STATES]
    for role in "ua":
        for i, j in NEXT[role].items():
            one[i][j] = (INSERT, "I")
    once = tuple(map(tuple, one))
    return times(once, times(once, once))


INSERTS = _inserts()
ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in STATES) for i in STATES)


def turn_matrix(letter: str) -> Matrix:
    """Of a turn: d must go; s, u, a, x (another role) may stay, in upper case if truncated. Inserts after it are closed in."""
    best = [[(DELETE, "D") if i == j else None for j in STATES] for i in STATES]

    def offer(i: int, j: int, edit: tuple[int, str]) -> None:
        best[i][j] = edit if best[i][j] is None else min(best[i][j], edit)

    if letter != "d":
        extra = TRUNCATED * letter.isupper()
        for role in "ua":
            for i, j in NEXT[role].items():
                offer(i, j, (RETYPE + extra, "R"))
        for i, j in NEXT.get(letter.lower(), {}).items():
            offer(i, j, (extra, "K"))
    return times(tuple(map(tuple, best)), INSERTS)


@lru_cache(maxsize=20_000)
def _block(letters: str) -> Matrix:
    if len(letters) < 2:
        return turn_matrix(letters) if letters else ONE
    half = len(letters) // 2
    return times(_block(letters[:half]), _block(letters[half:]))


def product(letters: str) -> Matrix:
    """The product over a stretch of turns, as a balanced tree."""
    level = [_block(letters[i : i + BLOCK]) for i in range(0, len(letters), BLOCK)] or [ONE]
    while len(level) > 1:
        level = [reduce(times, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of the best way from the start to an end that the pattern allows."""
    return min(e for e in (times(INSERTS[:1], matrix)[0][s] for s in (START, ASSISTANT)) if e is not None)


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults set by crc32 of `conv_id:turn`: (conv_id, turn, role, text, times). Nulls become one space, but for conv_id and turn themselves."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", c("conv_id"), c("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(c("text"), "[.!?]", "")).otherwise(c("text"))
    role = F.when(fault == 4, "user").otherwise(c("role"))
    return conversations.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("times"))


KEY = ["conv_id", "turn", "role", "k"]


def _marked(turns: DataFrame) -> DataFrame:
    """With a hash of the text and whether it is blank or truncated."""
    rest = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return turns.withColumns({"k": F.unhex(F.sha2("text", 256)), "blank": rest == "", "cut_off": ~rest.isin("", ".", "!", "?")})


def _distinct(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, k, blank, cut_off, n, again): different turns, how often they stand, and whether role and text stand earlier."""
    keys = cut(_marked(turns).groupBy(*KEY, "blank", "cut_off").agg(F.sum("times").alias("n")), "turns")
    first = keys.groupBy("conv_id", "role", "k").agg(F.min(F.struct("turn")).alias("f")).alias("f")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "k")] + [F.col("t.turn").eqNullSafe(F.col("f.f.turn"))]
    return keys.alias("t").join(first, same, "left").select("t.*", F.col("f.f").isNull().alias("again"))


def _element(part: int, edge: bool, rows: list[tuple]) -> dict:
    """What a part of a conversation comes to; rows: turn, role, k, blank, cut_off, n, again."""
    letters, count, illegal, before = [], {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
    for _, role, _, blank, cut_off, n, again in rows:
        if blank or again:
            count["blank" if blank else "duplicate"] += n
            letters.append("d" * n)
        else:
            letter = role[:1] if role[:1] in NEXT else "x"
            count["truncated"] += cut_off
            count["duplicate"] += n - 1
            letters.append((letter.upper() if cut_off else letter) + "d" * (n - 1))
        illegal += (before is not None and before + role[:1] not in LEGAL) + n - 1
        before = role[:1]
    told = [r[0] for r in rows if r[0] is not None]
    copies = [r[5] for r in rows]
    return {
        "part": part, "edge": edge, "rows": sum(copies), "copies": copies if max(copies) > 1 else None, **count, "illegal": illegal, "first_role": rows[0][1], "last_role": rows[-1][1][:1],
        "first_turn": rows[0][0], "first_k": rows[0][2], "last_turn": rows[-1][0], "least": told[0] if told else None, "most": told[-1] if told else None, "turns": len(set(told)),
        **_columns(product("".join(letters))),
    }


def _columns(m: Matrix) -> dict:
    flat = [e for row in m for e in row]
    return {"costs": [e and e[0] for e in flat], "audits": [e and e[1] for e in flat]}


def _matrix(e: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(e["costs"], e["audits"], strict=True)]
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES)


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring parts as one."""
    both = {c: a[c] + b[c] for c in ("rows", "blank", "duplicate", "truncated")}
    both["illegal"] = a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"][:1] not in LEGAL)
    both["turns"] = a["turns"] + b["turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
    both["least"] = a["least"] if a["least"] is not None else b["least"]
    both["most"] = b["most"] if b["most"] is not None else a["most"]
    return a | both | {"last_role": b["last_role"], "last_turn": b["last_turn"]} | _columns(times(_matrix(a), _matrix(b)))


def _arrow(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds.get(t.typeName())
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kind(f.dataType)) for f in schema], schema.names)


def _schema(turns: DataFrame, fields: str) -> T.StructType:
    """Fields, of which conv_id and those of kind `turn` have the types of the table."""
    of = {c: turns.schema[c].dataType for c in ("conv_id", "turn")}
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType())} | of
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


COUNTS = "rows long, copies longs, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn turn, first_k binary, last_turn turn, least turn, most turn, turns long, costs longs, audits strings"


def _elements(turns: DataFrame) -> DataFrame:
    """One row per part and conversation; `edge` if the conversation may go on in a neighbouring part."""
    keys = cut(_distinct(turns), "marked-turns")
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // PART))
    schema = _schema(turns, f"conv_id conv_id, part int, edge boolean, {COUNTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, own in groupby(rows, key=lambda r: r[0]):
            if held:
                yield _arrow([{"conv_id": held[0]} | _element(part, first, held[1])], schema)
                first = False
            held = conv, [r[1:] for r in own]
        if held:
            yield _arrow([{"conv_id": held[0]} | _element(part, True, held[1])], schema)

    dealt = keys.select(*KEY, "blank", "cut_off", "n", "again").repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    return cut(dealt.mapInArrow(run, schema), "parts")


def _whole(edges: DataFrame) -> DataFrame:
    """The edges' elements multiplied until each conversation is one."""
    schema = T.StructType([*edges.schema.fields, T.StructField("idx", T.LongType())])
    order = Window.partitionBy("conv_id").orderBy("part")  # at most one row per part
    now = cut(edges.withColumn("idx", F.row_number().over(order).cast("long") - 1), "edges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _arrow([reduce(_joined, sorted(own, key=lambda e: e["part"])) | {"idx": to} for own, to in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema)

    while now.agg(F.max("idx")).first()[0]:
        to = F.floor(F.col("idx") / FAN)
        near = now.groupBy("conv_id", to.alias("to")).agg(F.collect_list(F.struct(*now.columns)).alias("own")).select("own", "to")
        now = cut(near.mapInArrow(run, schema), "edges")
    return now.drop("idx")


def _scripts(audit: str, parts: list[dict]) -> Iterator[dict]:
    """The audit cut up: for each part the edits of its different turns, and how many repaired turns stand before it."""
    at = start = 0
    odd = (len(audit) - audit.count("D")) % 2 == 1
    for i, p in enumerate(parts):
        script = []
        for n in p["copies"] or (1 for _ in range(p["rows"])):
            for copy in range(n):
                while audit[at] == "I":
                    script.append("I")
                    at += 1
                if not copy:
                    script.append(audit[at])  # further copies are always deleted
                at += 1
        if i == len(parts) - 1:
            script.append(audit[at:])
        text = "".join(script)
        yield {"part": p["part"], "script": text, "start": start, "odd": odd, "whole": len(parts) == 1}
        start += len(text) - text.count("D")


@dataclass(frozen=True)
class Repair:
    """summary: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit); turns: (part, conv_id, whole, pos, role, text).

    Rows of `turns` stand in order in their partition; pos counts from 0, and is null in a row that
    only tells that a conversation (`whole`: in this part alone) has been seen.
    """

    summary: DataFrame
    turns: DataFrame


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text, times).

    A conversation's turns stand by turn, nulls first, then by role and text; `times` of them in a row. Turns without a
    character other than white space are blank; those whose role and text stand earlier are duplicates; those whose last
    such character isn't one of .!? are truncated. Blank and duplicate turns are deleted. role and text must not be null; a null
    conv_id is a conversation of its own. Roles other than those that begin with s, u or a must be changed or deleted.
    An audit, and 16 of them while it is sought, are held whole in a task: as many characters as the conversation has
    turns and inserts. A text is one value in a task. An empty table gives empty results.
    """
    elements = _elements(turns)
    edges = elements.where("edge")
    parts = edges.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "rows", "copies"))).alias("parts")).alias("p")
    ends = _whole(edges).alias("e").join(parts, F.col("e.conv_id").eqNullSafe(F.col("p.conv_id"))).select("e.*", "parts")
    ends = ends.union(elements.where("not edge").select("*", F.array(F.struct("part", "rows", "copies")).alias("parts")))
    told = _schema(turns, "conv_id conv_id, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    planned = _schema(turns, "part int, conv_id conv_id, script string, start long, odd boolean, whole boolean")
    schema = T.StructType([*told.fields, T.StructField("plans", T.ArrayType(T.StructType([f for f in planned.fields if f.name != "conv_id"])))])
    plan_type = pa.list_(pa.struct([("part", pa.int32()), ("script", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("whole", pa.bool_())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plans = [], []
            for e in batch.to_pylist():
                cost, audit = cheapest(_matrix(e))
                gaps = 0 if e["least"] is None else e["most"] - e["least"] + 1 - e["turns"]
                rows.append(e | {"gaps": gaps, "cost": cost, "audit": audit})
                plans.append(list(_scripts(audit, e["parts"])))
            flat = _arrow(rows, told)
            yield pa.RecordBatch.from_arrays([*flat.columns, pa.array(plans, plan_type)], schema.names)

    done = cut(ends.mapInArrow(finish, schema), "repairs")
    bounds = elements.groupBy("part").agg(F.min_by(F.struct("conv_id", "first_turn", "first_role", "first_k"), F.struct("conv_id")).alias("b"))
    bounds = bounds.orderBy("part").collect()  # one row per part, as for any range partitioning
    return Repair(done.drop("plans"), _edited(turns, done.select("conv_id", F.explode("plans").alias("p")).select("conv_id", "p.*"), [(r.part, tuple(r.b)) for r in bounds]))


def _edited(turns: DataFrame, plans: DataFrame, bounds: list[tuple]) -> DataFrame:
    """The repaired turns, by plans (conv_id, part, script, start, odd, whole)."""
    rank = lambda v: (v is not None, 0 if v is None else v)
    firsts, ids = [(rank(c), rank(t), r, bytes(k)) for _, (c, t, r, k) in bounds], [p for p, _ in bounds]
    sent = _schema(turns, "part int, conv_id conv_id, turn turn, role string, k binary, text string")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            part, rows = [], []
            for i, (conv, turn, role, k) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                key = rank(conv), rank(turn), role, k
                if key not in seen:  # copies are sent once by a task
                    seen = seen if len(seen) < 100_000 else set()
                    seen.add(key)
                    part.append(ids[bisect_right(firsts, key) - 1])
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], sent.names)

    texts = _marked(turns).select(*KEY, F.when(~F.col("blank"), F.col("text")).otherwise("").alias("text")).mapInArrow(deal, sent)
    none = lambda *kinds: [F.lit(None).cast(k) for k in kinds]
    turn_type = turns.schema["turn"].dataType
    both = texts.select("part", "conv_id", F.lit(1).alias("kind"), "turn", "role", "k", "text", *[x.alias(n) for x, n in zip(none("string", "long", "boolean", "boolean"), ("script", "start", "odd", "whole"), strict=True)])
    both = both.union(plans.select("part", "conv_id", F.lit(0), *none(turn_type, "string", "binary", "string"), "script", "start", "odd", "whole"))
    schema = _schema(turns, "part int, conv_id conv_id, whole boolean, pos long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, pos, odd, whole, before = "", 0, False, True, None
        for batch in batches:
            rows = []

            def put(role: str | None, text: str) -> None:
                nonlocal pos
                role = role or ("user", "assistant")[(pos - odd) % 2]
                rows.append({"part": part, "conv_id": conv, "whole": whole, "pos": pos, "role": role, "text": text})  # noqa: B023
                pos += 1

            for part, conv, kind, turn, role, k, text, *plan in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    (script, pos, odd, whole), at, before = plan, 0, None
                    rows.append({"part": part, "conv_id": conv, "whole": whole, "pos": None, "role": None, "text": None})
                    edits = iter(script)
                    left = sum(1 for e in script if e != "I")
                elif (turn, role, k) != before:
                    before = (turn, role, k)
                    for edit in edits:
                        if edit != "I":
                            break
                        put(None, "")
                    if edit != "D":
                        put(role if edit == "K" else None, text)
                    left -= 1
                    if not left:
                        for _ in edits:
                            put(None, "")
            yield _arrow(rows, schema)

    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ids))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "conv_id", "kind", "turn", "role", "k")
    return dealt.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha): the SHA-256 of each conversation's `role:text` lines joined by line feeds, from `Repair.turns`.

    A conversation of one part is hashed where it is; of others, pieces of text go to one task, which hashes them one by one.
    """
    schema = T.StructType([turns.schema["conv_id"], *(T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("seq", T.LongType()), ("sha", T.StringType()), ("piece", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, sha, held, size, seq = [], None, None, [], 0, 0

        def end() -> None:
            if now is not None and now[2]:
                rows.append({"conv_id": now[1], "part": now[0], "seq": 0, "sha": sha.hexdigest(), "piece": None})
            elif held:
                rows.append({"conv_id": now[1], "part": now[0], "seq": seq, "sha": None, "piece": b"".join(held)})

        for batch in batches:
            for part, conv, whole, pos, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos is None:
                    end()
                    now, sha, held, size, seq = (part, conv, whole), hashlib.sha256(), [], 0, 0
                    continue
                line = (("\n" if pos else "") + f"{role}:{text}").encode()
                if whole:
                    sha.update(line)
                    continue
                held.append(line)
                size += len(line)
                if size >= PIECE:
                    end()
                    held, size, seq = [], 0, seq + 1
            if rows:
                yield _arrow(rows, schema)
                rows = []
        end()
        if rows:
            yield _arrow(rows, schema)

    done = cut(turns.mapInArrow(run, schema), "digests")
    final = T.StructType([turns.schema["conv_id"], T.StructField("sha", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = (), None
        for batch in batches:
            for conv, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now:
                        yield _arrow([{"conv_id": now[0], "sha": sha.hexdigest()}], final)
                    now, sha = (conv,), hashlib.sha256()
                sha.update(piece)
        if now:
            yield _arrow([{"conv_id": now[0], "sha": sha.hexdigest()}], final)

    pieces = done.where("piece is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return done.where("sha is not null").select("conv_id", "sha").union(pieces.select("conv_id", "piece").mapInArrow(hashed, final))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after `damage`.

    One without turns after the damage has zeros, an empty audit and the hash of nothing. Columns other than conv_id, turn,
    role and text are left out; conversations may repeat rows and turns.
    """
    done = repair(damage(conversations.select("conv_id", "turn", "role", "text")))
    every, summary, shas = conversations.select("conv_id").distinct().alias("c"), done.summary.alias("s"), digests(done.turns).alias("d")
    both = every.join(summary, F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")), "left").join(shas, F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(F.col(f"s.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("c.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
