"""SimHash near-duplicates found by covering locality-sensitive hashing.

A text's 64-bit fingerprint has a bit set where more than half of its shingle hashes have it.
Each bit position gets a nonzero vector of radius + 1 bits; each nonzero vector v gives a mask
that keeps the positions whose vector has an odd product with v. Whichever `radius` positions
two fingerprints differ in, some v is orthogonal to all their vectors, so that its mask hides
every difference: the pair shares that table's key. No pair within the radius is missed.

A bucket of more than `BUCKET` distinct fingerprints is dealt out anew by covering masks over
the positions that its own mask hides. After three levels at most 7 positions are still hidden,
so a bucket has at most 128 distinct fingerprints, however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import byte_values, cut
from dispatchlake.llm.graph import components

RADIUS = 3
BUCKET = 512
LEVELS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def simhash(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text: 0 for one without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    octets = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in byte_values(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions: any `radius` of them are all hidden by one mask at least."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if (((k % vectors) + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def table_mask(table: int, radius: int = RADIUS) -> int:
    """The kept positions of a table; its number lists the choice of each level in base 2^(radius+1)."""
    kept, base = 0, 2 ** (radius + 1)
    path = []
    while table:
        path.append(table % base)
        table //= base
    for v in reversed(path):
        kept |= covering_masks([p for p in range(64) if not kept >> p & 1], radius)[v - 1]
    return kept


def _keys(rows: DataFrame, radius: int) -> DataFrame:
    """(t, key, fp): the keys of each (t, fp) row in all tables one level below table t; 0 is the root."""
    base = 2 ** (radius + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            t, fp = (np.asarray(c, dtype=np.int64) for c in batch.columns)
            for table in np.unique(t):
                below = [int(table) * base + v for v in range(1, base)]
                if table not in masks:
                    masks[table] = np.array([table_mask(b, radius) for b in below], dtype=np.uint64).view(np.int64)
                own = fp[t == table]
                keys = own[:, None] & masks[table][None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.array(below), len(own))), pa.array(keys.ravel()), pa.array(np.repeat(own, base - 1))],
                    ["t", "key", "fp"],
                )

    return rows.select(F.col("t").cast("long"), "fp").mapInArrow(run, "t long, key long, fp long")


def _stars(groups: DataFrame, radius: int) -> DataFrame:
    """For each bucket (an array of fingerprints) edges that join what its links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.empty((0, 2), dtype=np.int64)]
            column = batch.column(0)
            values, offsets = np.asarray(column.flatten(), dtype=np.int64), np.asarray(column.offsets) - column.offsets[0].as_py()
            for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                own = np.unique(values[i:j])
                bits = own.view(np.uint64)
                near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
                if near.sum() == len(own):
                    continue
                root = np.arange(len(own))
                while True:  # the smallest root among a node's neighbours, until nothing changes
                    now = np.where(near, root[None, :], len(own)).min(axis=1)
                    now = now[now]
                    if (now == root).all():
                        break
                    root = now
                linked = root != np.arange(len(own))
                out.append(np.stack([own[linked], own[root[linked]]], axis=1))
            edges = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["x", "y"])

    return groups.select("fps").mapInArrow(run, "x long, y long")


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """(x, y) edges that connect exactly the distinct fingerprints linked within the radius."""
    rows, edges = distinct.select(F.lit(0).alias("t"), "fp"), None
    for level in range(levels):
        keys = _keys(rows, radius)
        shared = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = cut(keys.join(shared, ["t", "key"]), "buckets")
        last = level == levels - 1
        small = shared if last else shared.where(F.col("n") <= bucket)
        found = _stars(small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")), radius)
        edges = found if edges is None else edges.union(found)
        rows = shared.where(F.col("n") > bucket)
        if last or rows.isEmpty():
            break
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, copies.

    component_id is the smallest doc_id reachable over links of at most `radius` differing
    bits; copies counts the rows with the same fingerprint. Other columns of `docs` are not
    read. Null texts and texts without words have fingerprint zero and are linked like any
    other; repeated rows give repeated results; a null doc_id takes part, and is returned as
    component_id only where no other id is reachable. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, shingle), "simhash")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = components(near_links(distinct, radius, bucket))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(rooted.join(smallest, "root").select("fp", "component_id", "copies"), "classes")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")
