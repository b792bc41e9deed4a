"""Lines that many documents share, found by two Bloom filters: hashes seen once, and seen twice.

A line's key is the line without white space at its ends, A-Z in lower case. Every task puts the
hashes of its documents' long keys, once per document, into parts of two filters: those seen and
those seen again. Parts are merged by segments of the hash range: a bit is in the second filter
if it is in any part's second, or in the first of two parts. So a key of two documents is surely
in the second filter, and few others are. Only keys found there go on: each task sends their
128-bit hashes with the largest doc_ids it saw, as many as decide, and these are counted exactly.

The filters grow with the number of lines. The second is broadcast while it has at most
`FILTER_BITS` bits; beyond that, hashes are sent to its segments instead. Likewise the keys to be
dropped are broadcast up to `BROADCAST`, else joined by a shuffle. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.llm.common import batches_of, cut
from dispatchlake.llm.passages import keyed

MIN_CHARS, MIN_DOCS = 40, 5
#: bits of a filter for each line, and of one segment of it
BITS_PER_LINE, SEGMENT = 16, 1 << 23
#: bits of a filter that is broadcast, at most (32 MB)
FILTER_BITS = 1 << 28
#: keys to be dropped that are broadcast, at most (24 bytes each)
BROADCAST = 1_000_000
#: lines of a task that are put together before they are sent on
CHUNK = 1 << 19
MIX = np.uint64(0x9E3779B1)


def keys_of(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for one of fewer than `min_chars` code points."""
    found = []
    for line in lines:
        key = line.strip()
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars)
        found.append(None if short else xxhash.xxh3_128_digest(key.lower()))
    return found


def _hashes(digests: list[bytes]) -> np.ndarray:
    """Two columns, hi and lo."""
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _chunks(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, did, tk) of long keys, each once per document, for some documents at a time; columns did, tk, text."""
    digests, dids, tks, counts = [], [], [], []
    for batch in batches:
        did, tk = (c.to_pylist() for c in batch.columns[:2])
        for at, texts in batches_of(batch, 2):
            for i, text in enumerate(texts, at):
                own = dict.fromkeys(k for k in keys_of(text.split(b"\n"), min_chars) if k)
                if own:
                    digests.extend(own)
                    dids.append(did[i])
                    tks.append(tk[i])
                    counts.append(len(own))
                if len(digests) >= CHUNK:
                    yield _hashes(digests), np.repeat(np.array(dids), counts), np.repeat(np.array(tks), counts)
                    digests, dids, tks, counts = [], [], [], []
    if digests:
        yield _hashes(digests), np.repeat(np.array(dids), counts), np.repeat(np.array(tks), counts)


class Shape:
    """Where a hash has its bits: the segment by its leading bits, two places in it by the 32 bits after them."""

    def __init__(self, lines: int) -> None:
        bits = max(16, int(BITS_PER_LINE * max(lines, 1) - 1).bit_length())
        self.within = min(bits, SEGMENT.bit_length() - 1)
        self.segments = 1 << (bits - self.within)
        self.bits = 1 << bits

    def split(self, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, the 32 bits that decide within it)."""
        lead = np.uint64(self.segments.bit_length() - 1)
        segment = hi >> (np.uint64(64) - lead) if lead else np.zeros_like(hi)
        return segment.astype(np.int64), ((hi << lead) >> np.uint64(32)).astype(np.uint32)

    def places(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, wide = np.uint64((1 << self.within) - 1), rest.astype(np.uint64)
        return (wide & mask).astype(np.int64), (((wide * MIX) >> np.uint64(5)) & mask).astype(np.int64)


def _by_segment(segment: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal values of a sorted array."""
    edges = np.flatnonzero(np.diff(segment)) + 1
    for a, b in zip([0, *edges], [*edges, len(segment)], strict=True):
        if a < b:
            yield int(segment[a]), slice(a, b)


def _filter_parts(texts: DataFrame, shape: Shape, min_chars: int) -> DataFrame:
    """(seg, once, twice) of each task: the deciding bits of hashes seen, and of those seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in _chunks(batches, min_chars):
            hi, n = np.unique(hashes[:, 0], return_counts=True)
            segment, rest = shape.split(hi)
            rows = [(s, rest[at].tobytes(), rest[at][n[at] > 1].tobytes()) for s, at in _by_segment(segment)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["seg", "once", "twice"])

    return texts.mapInArrow(run, "seg long, once binary, twice binary")


def _seen_twice(parts: DataFrame, shape: Shape) -> DataFrame:
    """(seg, bits): the second filter, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["seg", "bits"])

        for batch in batches:
            for seg, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seg != at:
                    if at is not None:
                        yield done()
                    at, once, twice = seg, np.zeros(1 << shape.within, dtype=bool), np.zeros(1 << shape.within, dtype=bool)
                mine = np.concatenate(shape.places(np.frombuffer(o, np.uint32)))
                twice[mine[once[mine]]] = True
                for places in shape.places(np.frombuffer(t, np.uint32)):
                    twice[places] = True
                once[mine] = True
        if at is not None:
            yield done()

    return parts.repartition("seg").sortWithinPartitions("seg").mapInArrow(run, "seg long, bits binary")


def _held(bits: np.ndarray, places: tuple[np.ndarray, np.ndarray], base: np.ndarray | int = 0) -> np.ndarray:
    """Whether both places of each hash are set in packed bits."""
    a, b = (base + p for p in places)
    return ((bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)


def _largest(hashes: np.ndarray, did: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its `most` largest doc_ids."""
    order = np.lexsort((-1 - did, hashes[:, 1], hashes[:, 0]))
    hashes, did = hashes[order], did[order]
    same = np.zeros(len(did), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]).all(axis=1)
    fresh = ~same | np.concatenate(([True], did[1:] != did[:-1]))
    hashes, did, same = hashes[fresh], did[fresh], same[fresh]
    start = np.maximum.accumulate(np.where(~same, np.arange(len(did)), 0))
    kept = np.arange(len(did)) - start < most
    return hashes[kept], did[kept]


def _rows(hashes: np.ndarray, *rest: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(hashes[:, i].view(np.int64) if hashes[:, i].flags.c_contiguous else np.ascontiguousarray(hashes[:, i]).view(np.int64)) for i in (0, 1)), *map(pa.array, rest)], names)


def _suspects(texts: DataFrame, twice: DataFrame, shape: Shape, min_chars: int, min_docs: int) -> DataFrame:
    """(hi, lo, did) of the keys in the second filter, with each task's `min_docs` largest doc_ids."""
    schema, names = "hi long, lo long, did long", ["hi", "lo", "did"]
    if shape.bits <= FILTER_BITS:
        packed = np.zeros(shape.bits >> 3, dtype=np.uint8)
        width = (1 << shape.within) >> 3
        for r in twice.toLocalIterator():
            packed[r.seg * width : (r.seg + 1) * width] = np.frombuffer(r.bits, np.uint8)
        shared = texts.sparkSession.sparkContext.broadcast(packed)

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for hashes, did, _ in _chunks(batches, min_chars):
                segment, rest = shape.split(hashes[:, 0])
                held = _held(shared.value, shape.places(rest), segment << shape.within)
                yield _rows(*_largest(hashes[held], did[held], min_docs), names=names)

        return texts.mapInArrow(here, schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, did, _ in _chunks(batches, min_chars):
            hashes, did = _largest(hashes, did, min_docs)
            segment, _ = shape.split(hashes[:, 0])
            rows = [(s, None, hashes[at].tobytes(), did[at].tobytes()) for s, at in _by_segment(segment)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), *[pa.binary()] * 3))], ["seg", "bits", "hashes", "dids"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = None
        for batch in batches:
            for bits, raw, dids in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if bits is not None:
                    packed = np.frombuffer(bits, np.uint8)
                    continue
                hashes, did = np.frombuffer(raw, np.uint64).reshape(-1, 2), np.frombuffer(dids, np.int64)
                held = _held(packed, shape.places(shape.split(hashes[:, 0])[1]))
                yield _rows(hashes[held], did[held], names=names)

    sent = texts.mapInArrow(send, "seg long, bits binary, hashes binary, dids binary")
    both = sent.union(twice.select("seg", "bits", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    return both.repartition("seg").sortWithinPartitions("seg", F.col("bits").isNull()).mapInArrow(meet, schema)


def shared_keys(texts: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hi, lo, did): keys of at least `min_docs` documents, and the largest doc_id of each; texts is (did, tk, text)."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = texts.agg(F.sum(F.least(breaks + 1, F.floor(F.octet_length("text") / min_chars)))).first()[0] or 0
    shape = Shape(int(lines))
    twice = cut(_seen_twice(_filter_parts(texts, shape, min_chars), shape), "seen-twice")
    counted = _suspects(texts, twice, shape, min_chars, min_docs).distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("did").alias("did"))
    return cut(counted.where(F.col("n") >= min_docs).drop("n"), "shared-lines")


def _cutter(schema: T.StructType, min_chars: int, gone: Callable[[pa.RecordBatch, int, list[bytes | None]], np.ndarray]) -> Callable:
    """A function over batches (did, tk, text, row, ...) that leaves out lines; gone(batch, row, hashes) tells which of the long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch, 2):
                n, dropped, kept = [], [], []
                for i, text in enumerate(texts, at):
                    lines = text.split(b"\n")
                    keys = keys_of(lines, min_chars)
                    long = [j for j, k in enumerate(keys) if k]
                    out = set(np.array(long)[gone(batch, i, [keys[j] for j in long])].tolist()) if long else ()
                    n.append(len(lines))
                    dropped.append(len(out))
                    kept.append(b"\n".join(x for j, x in enumerate(lines) if j not in out) if out else text)
                done = [batch.column("row").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(done, schema.names)

    return run


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), and the columns of `carry` in a struct, row.

    Texts are split at line feeds. Keys of at least `min_chars` code points in at least `min_docs` documents lose all
    their lines but those of the largest doc_id that holds them, where each stays as often as it stands. `kept` has the
    other lines, joined by line feeds, as bytes. A null or empty text is one empty line. A null doc_id counts as smaller
    than any; rows that repeat a doc_id are one document when documents are counted, and each keeps or loses its own
    lines. A text is one value in a task, at any length. Keys are equal if their 128-bit hashes are. No rows give none.
    """
    texts = keyed(docs, ("doc_id", *carry))
    shared = shared_keys(texts.drop("row"), min_chars, min_docs)
    schema = T.StructType([texts.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")), T.StructField("kept", T.BinaryType())])
    if shared.count() <= BROADCAST:
        rows = shared.orderBy(F.col("hi").bitwiseXOR(F.lit(-(2**63))), "lo").toArrow()
        hi, lo, last = (rows.column(c).to_numpy() for c in ("hi", "lo", "did"))
        _, runs = np.unique(hi, return_counts=True)
        table = texts.sparkSession.sparkContext.broadcast((hi.view(np.uint64), lo.view(np.uint64), last, int(runs.max()) if len(runs) else 0))

        def gone(batch: pa.RecordBatch, i: int, keys: list[bytes]) -> np.ndarray:
            his, los, lasts, most = table.value
            own, did = _hashes(keys), batch.column(0)[i].as_py()
            out, at = np.zeros(len(keys), dtype=bool), np.searchsorted(his, own[:, 0])
            for step in range(most):  # keys of equal hi stand together
                p = np.minimum(at + step, len(his) - 1)
                out |= (his[p] == own[:, 0]) & (los[p] == own[:, 1]) & (lasts[p] > did)
            return out

        done = texts.mapInArrow(_cutter(schema, min_chars, gone), schema)
    else:

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for hashes, did, tk in _chunks(batches, min_chars):
                yield _rows(hashes, did, tk, names=["hi", "lo", "did", "tk"])

        lines = texts.drop("row").mapInArrow(send, "hi long, lo long, did long, tk long").alias("l")
        met = lines.join(shared.alias("s"), ["hi", "lo"]).where(F.col("l.did") < F.col("s.did"))
        own = met.groupBy("l.did", "l.tk").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))

        def listed(batch: pa.RecordBatch, i: int, keys: list[bytes]) -> np.ndarray:
            out = {(k["hi"], k["lo"]) for k in batch.column("gone")[i].as_py() or ()}
            return np.array([tuple(k) in out for k in _hashes(keys).view(np.int64).tolist()], dtype=bool)

        joined = texts.join(own, ["did", "tk"], "left").select("did", "tk", "text", "row", "gone")
        done = joined.mapInArrow(_cutter(schema, min_chars, listed), schema)
    return done.select("row.doc_id", "n_lines", "n_dropped", "kept", *(["row"] if carry else []))
