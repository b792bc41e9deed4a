"""Where a passage of a text stands elsewhere too: the joins that the two substring operators share.

A text is a row of symbols (bytes or words). Every window of `window` symbols is put into a
bucket by the least hash of the grams of `gram` symbols in it, so equal windows share a bucket
wherever they stand. Neighbouring windows with the same bucket form a run; a run and its symbols
up to the end of its last window are one piece. Runs whose bucket nothing else shares are left
out by a count. Runs with equal pieces form a class. A class goes on as one piece with two
places, that of its first run and that of its last, however many it has: what is found at the
last place holds for all but the first. The pieces of a bucket are compared in shards of whole
buckets by an index that the caller gives; it alone decides which windows stand elsewhere.

A bucket of more than `HOT` classes would be too much for one shard. Its pieces become texts of
their own and are dealt to buckets anew by longer grams, in the end by whole windows, where only
equal windows share a bucket.

A document is a row: (did, tk) is its doc_id and a hash of its text. Rows that repeat both are
documents of their own that stand for each other. A null doc_id counts as smaller than any.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import WordIds, batches_of, cut

#: classes of a bucket that one shard takes, at most; those of a larger bucket are dealt to buckets anew
HOT = 2000
#: windows of a run, at most; a longer run is several
LONGEST = 1000
#: bytes of a text that are held as symbols at once
SEGMENT = 1 << 20
#: bytes of pieces for one task of the comparison, about
TASK_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[ \t-\r]")
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.array([1] + [base] * (size - 1), dtype=np.uint64), dtype=np.uint64) for base in (_ODD, pow(_ODD, -1, 2**64))]
    return _powers


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k neighbouring values."""
    n = len(values)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * power[:n], out=sums[1:])
    out = (sums[k:] - sums[:-k]) * inverse[: n - k + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def stretch_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash that `gram_hashes` gives of each stretch of `sizes` values from `starts`."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    out = (sums[starts + sizes] - sums[starts]) * inverse[starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    out, k = values, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(out) - (width - k)], out[width - k :]) if k < width else out


_BYTE_CODES = np.random.default_rng(200).integers(1, 2**63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Symbols:
    """How texts become rows of 64-bit codes, and how a stretch of one is kept for comparison."""

    name: str
    window: int
    gram: int

    @property
    def grams(self) -> tuple[int, ...]:
        """Lengths of the grams by which windows are dealt to buckets, then those of hot buckets again."""
        return self.gram, (self.gram + self.window) // 2, self.window

    def codes(self, rows: list, number: WordIds) -> list[np.ndarray]:
        """Of texts that `split` has made symbols."""
        if self.name == "bytes":
            return [_BYTE_CODES[np.frombuffer(t, dtype=np.uint8)] for t in rows]
        return [number(t) for t in rows]

    def split(self, text: bytes):
        return text if self.name == "bytes" else text.split()

    def join(self, symbols) -> bytes:
        return bytes(symbols) if self.name == "bytes" else b" ".join(symbols)

    def segments(self, text: bytes, size: int) -> Iterator[tuple[int, bytes | list[bytes]]]:
        """(place of the first symbol, symbols) of stretches of about `size` bytes: each window is in one of them."""
        if self.name == "bytes":
            for at in range(0, max(1, len(text) - self.window + 1), size):
                yield at, text[at : at + size + self.window - 1]
            return
        at, place, held = 0, 0, []
        while place < len(text):
            gap = _GAP.search(text, place + size)
            end = gap.start() if gap else len(text)
            words = held + text[place:end].split()
            yield at, words
            keep = min(len(words), self.window - 1)
            at, place, held = at + len(words) - keep, end, words[len(words) - keep :]


def word_code(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def runs_of(codes: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, bucket) of each run, the place of each text, and all codes in one row."""
    sizes = np.array([len(c) for c in codes])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    line = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
    if len(line) < window:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), offsets, line
    least = sliding_least(gram_hashes(line, gram), window - gram + 1)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[offsets[:-1][offsets[:-1] < len(least)]] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(least)])) - 1
    text = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(last, offsets[text + 1] - window)
    full = last >= first
    first, last, text = first[full], last[full], text[full]
    # periodic text has runs of any length; cut, so that the pieces of a bucket stay within memory
    parts = (last - first) // LONGEST + 1
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last, text = (np.repeat(x, parts) for x in (first, last, text))
    first = first + nth * LONGEST
    last = np.minimum(first + LONGEST - 1, last)
    return text, first - offsets[text], last - offsets[text], least[first], offsets, line


def twins_of(line: np.ndarray, offsets: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, bucket: np.ndarray, window: int, gram: int) -> np.ndarray:
    """1 for each run in which the least hash stands at several places, so that its own windows may be equal."""
    grams, width = gram_hashes(line, gram), window - gram + 1
    if not len(text):
        return np.empty(0, dtype=np.int64)
    least = sliding_least(grams, width)
    edge = np.zeros(width - 1, dtype=np.uint64)
    most = ~sliding_least(~np.concatenate((edge, least, edge)), width)
    place = np.flatnonzero(grams == most)
    hashes, rank = np.unique(grams[place], return_inverse=True)
    keys = np.sort(rank * len(line) + place)
    own, at = np.searchsorted(hashes, bucket) * len(line), offsets[text]
    count = np.searchsorted(keys, own + at + last + width - 1, side="right") - np.searchsorted(keys, own + at + first)
    return (count > 1).astype(np.int64)


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents by (did, tk): see the module's note; with the columns of `carry` in a struct, row."""
    text = F.coalesce("text", F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(did.alias("did"), F.xxhash64(text, F.col("doc_id").isNull()).alias("tk"), text.alias("text"), *([F.struct(*carry).alias("row")] if carry else []))


def _runs(texts: DataFrame, symbols: Symbols, gram: int, twins: bool, segment: int) -> DataFrame:
    """(bucket, cls, did, tk, base, span, twin) of the runs of texts (did, tk, base, text); span is (first window << 32) | last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, window = WordIds(word_code), 8 if symbols.name == "words" else 1, symbols.window
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            did, tk, base = (np.asarray(c) for c in batch.columns[:3])
            for at, raw in batches_of(batch, 3, segment):
                whole = len(raw) > 1 or len(raw[0]) <= segment
                for shift, rows in [(0, [symbols.split(t) for t in raw])] if whole else ((k, [part]) for k, part in symbols.segments(raw[0], segment)):
                    text, first, last, bucket, offsets, line = runs_of(symbols.codes(rows, number), window, gram)
                    twin = twins_of(line, offsets, text, first, last, bucket, window, gram) if twins else np.zeros(len(text), dtype=np.int64)
                    flat = memoryview(b"".join(rows)) if size == 1 else memoryview(line.view(np.uint8))
                    starts = offsets[text]
                    pieces = [digest(flat[a:b]) for a, b in zip(((starts + first) * size).tolist(), ((starts + last + window) * size).tolist(), strict=True)]
                    span = (first + shift << 32) | (last + shift)
                    columns = [bucket.view(np.int64), np.array(pieces, dtype=np.uint64).view(np.int64), did[at + text], tk[at + text], base[at + text], span, twin]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)

    names = ["bucket", "cls", "did", "tk", "base", "span", "twin"]
    return texts.select("did", "tk", "base", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


#: a class: its first place, and the document and place of its last run, null for one run (or one document) only
_CLASS = "bucket long, cls long, c long, did long, place long, tk long, span long, hi long, hi_place long"


def _pieces(wanted: DataFrame, texts: DataFrame, symbols: Symbols) -> DataFrame:
    """The classes of `wanted` with their symbols, cut from their first texts."""
    names = [c.split()[0] for c in _CLASS.split(", ")]
    own = [n for n in names if n not in ("did", "tk")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                did, tk, text, rows = (c[i].as_py() for c in batch.columns)
                whole = symbols.split(text)
                held = [r | {"did": did, "tk": tk, "piece": symbols.join(whole[r["span"] >> 32 : (r["span"] & 0xFFFFFFFF) + symbols.window])} for r in rows]
                yield pa.RecordBatch.from_pylist(held, schema=pa.schema([*((n, pa.int64()) for n in names), ("piece", pa.binary())]))

    by_text = wanted.groupBy("did", "tk").agg(F.collect_list(F.struct(*own)).alias("wanted"))
    found = by_text.join(texts, ["did", "tk"]).select("did", "tk", "text", "wanted").mapInArrow(run, f"{_CLASS}, piece binary")
    return found.dropDuplicates(["bucket", "cls"])  # rows that repeat a document repeat its classes


#: pieces; of each place, in the order of places, its piece and its did: to the (place, first, last) window ranges that are found
Index = Callable[[list[bytes], np.ndarray, np.ndarray], list[tuple[int, int, int]]]


def _in_shards(pieces: DataFrame, index: Index, budget: int, tasks: int) -> DataFrame:
    """(bucket, cls, nth, a, b) of what is found at the first (nth 0) and last (1) place of each piece.

    Buckets are gathered until they have `budget` bytes.
    """

    def solve(held: list[tuple]) -> pa.RecordBatch:
        places = [(r[2], r[3], 0, k) for k, r in enumerate(held)] + [(r[4], r[5], 1, k) for k, r in enumerate(held) if r[4] is not None]
        places.sort()
        found = index([r[6] for r in held], np.array([p[3] for p in places]), np.array([p[0] for p in places], dtype=np.int64))
        rows = [(*held[places[i][3]][:2], places[i][2], a, b) for i, a, b in found]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and size > budget:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    names = ["bucket", "cls", "nth", "a", "b"]
    dealt = pieces.select("bucket", "cls", "did", "place", "hi", "hi_place", "piece").repartition(tasks, "bucket").sortWithinPartitions("bucket", "cls")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _found(texts: DataFrame, symbols: Symbols, earlier: bool, first: bool, index: Index, budget: int, hot: int, segment: int, level: int = 0) -> DataFrame:
    """(did, tk, a, b): ranges of windows, first to last, of the texts that the index finds."""
    runs = cut(_runs(texts, symbols, symbols.grams[level], not earlier, segment), "runs")
    shared = runs.groupBy("bucket")
    shared = shared.agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi") if earlier else shared.agg(F.sum(F.col("twin") + 1).alias("k")).where("k > 1")
    runs = cut(runs.join(cut(shared.select("bucket"), "shared"), "bucket"), "shared-runs")
    at = F.struct("did", (F.col("base") + F.shiftright("span", 32)).alias("place"), "tk", "span")
    classes = runs.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.max("twin").alias("twin"))
    classes = cut(classes.withColumn("more", F.col("last.did") > F.col("first.did") if earlier else F.col("n") > 1), "classes")
    joint = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.min("first.did").alias("lo"), F.max("last.did").alias("top"), F.max("twin").alias("twin"))
    joint = cut(joint.where("lo < top" if earlier else "n > 1 or twin > 0").select("bucket", "c"), "joint")
    hi = [F.when(F.col("more"), F.col(f"last.{c}")).alias(n) for c, n in (("did", "hi"), ("place", "hi_place"))]
    wanted = cut(classes.join(joint, "bucket").select("bucket", "cls", "c", "first.*", *hi), "wanted")
    pieces = cut(_pieces(wanted, texts, symbols), "pieces")
    deepest = level == len(symbols.grams) - 1
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    found = _in_shards(pieces if deepest else pieces.where(F.col("c") <= hot), index, budget, tasks)
    crowd = pieces.where(F.col("c") > hot)
    if not deepest and not crowd.isEmpty():
        place = lambda nth, did, base: F.struct(F.lit(nth).cast("long").alias("nth"), F.col(did).alias("did"), F.col(base).alias("base"))
        each = F.explode(F.array_compact(F.array(place(0, "did", "place"), F.when(F.col("hi").isNotNull(), place(1, "hi", "hi_place")))))
        inner = crowd.select("bucket", "cls", "piece", each.alias("p")).select("bucket", "cls", "p.*", F.col("piece").alias("text"))
        inner = cut(inner.withColumn("tk", F.xxhash64("bucket", "cls", "nth")), "crowd")
        deeper = _found(inner.drop("bucket", "cls", "nth"), symbols, earlier, first, index, budget, hot, segment, level + 1)
        found = found.unionByName(deeper.join(inner.select("did", "tk", "bucket", "cls", "nth"), ["did", "tk"]).select("bucket", "cls", "nth", "a", "b"))
    # each place of a class has what was found at its first, or at its last one
    firsts = classes.select("bucket", "cls", F.col("first").alias("f"))
    found = cut(found.join(firsts, ["bucket", "cls"]), "found")
    own = F.struct("did", (F.col("base") + F.shiftright("span", 32)).alias("place"), "tk", "span")
    later = F.col("did") > F.col("f.did") if earlier else own != F.col("f") if first else F.lit(False)
    hits = runs.join(found, ["bucket", "cls"]).where(F.col("nth") == later.cast("long"))
    return hits.select("did", "tk", *((F.shiftright("span", 32) + F.col(c)).alias(c) for c in ("a", "b")))


def repeated(docs: DataFrame, symbols: Symbols, earlier: bool, index: Index, budget: int, hot: int = HOT, first: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(did, tk, a, b): stretches [a, b) of the documents covered by windows that stand elsewhere too.

    earlier: only windows that stand in a document with a smaller id count. first: what the index
    finds at the first place of a class holds for that place alone.
    """
    texts = keyed(docs).withColumns({"text": F.col("text").cast("binary"), "base": F.lit(0).cast("long")})
    hits = _found(texts, symbols, earlier, first, index, budget, hot, segment)
    return cut(hits.select("did", "tk", "a", (F.col("b") + symbols.window).alias("b")), "covered")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches covered by the given ones; adjacent ones are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(docs: DataFrame, covered: DataFrame, symbols: Symbols, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (maximal removed stretches), kept (binary), n (symbols).

    With columns named in `carry`, those come along in a struct, row, and the text ("" for null)
    in text.
    """
    names, span = ["did", "spans", "kept", "n", *(["text", "row"] if carry else [])], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, all_kept, counts = [], [], []
            for text, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole = symbols.split(text.encode())
                spans = merged([(c["a"], c["b"]) for c in cover or ()])
                kept, at = [], 0
                for a, b in [*spans, (len(whole), 0)]:
                    kept.append(whole[at:a])
                    at = b
                all_kept.append(b"".join(kept) if symbols.name == "bytes" else b" ".join([w for part in kept for w in part]))
                all_spans.append([{"start": a, "stop": b} for a, b in spans])
                counts.append(len(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_spans, span), pa.array(all_kept, pa.binary()), pa.array(counts, pa.int64()), *([batch.column(1), batch.column(3)] if carry else [])], names)

    by_text = covered.groupBy("did", "tk").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    rows = keyed(docs, carry).join(by_text, ["did", "tk"], "left").select("did", "text", "cover", *(["row"] if carry else []))
    more = f", text string, row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    out = rows.mapInArrow(run, "did long, spans array<struct<start: long, stop: long>>, kept binary, n long" + more)
    return out.select(F.nullif("did", F.lit(-(2**63))).alias("doc_id"), *names[1:])
