"""Codes of vectors by product quantisation, trained by Lloyd rounds with Yinyang bounds.

Components become integers, so every distance, sum and tie is exact. A vector is cut into parts,
and each part position has a codebook. The entries of a codebook are clustered into a few groups
once. A part keeps its entry and, for each group, a whole number below its distance to every
other entry of that group. When entries move, the bound falls by the group's largest drift
(rounded up). A group is scanned only if its bound squared isn't above the squared distance to
the part's own entry; a tie is therefore always scanned and decided by integers, lower index
first. A round is one pass over the vectors, which writes entries and bounds beside them and one
row of sums per task; only those sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.llm.common import cut
from dispatchlake.scratch import folder, remove

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: groups of the entries of one codebook
GROUPS = 4
#: rounds that cluster entries into groups
GROUPING_ROUNDS = 5
FAR = np.iinfo(np.int64).max
#: labels up to this number are broadcast with their sums; more are joined by a shuffle
BROADCAST = 100_000


def floor_root(squares: np.ndarray) -> np.ndarray:
    """The whole part of square roots, exact for all of int64."""
    root = np.minimum(np.sqrt(squares.astype(np.float64)).astype(np.int64), 3_037_000_499)
    root -= root * root > squares
    return root + ((root < 3_037_000_499) & ((root + 1) * (root + 1) <= squares))


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    gap = x - y
    return np.einsum("...i,...i->...", gap, gap)


def group_entries(codebook: np.ndarray, groups: int = GROUPS, rounds: int = GROUPING_ROUNDS) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries, from entries spread evenly over the codebook."""
    k = len(codebook)
    centres = codebook[np.linspace(0, k - 1, min(groups, k)).astype(int)].astype(np.float64)
    of = np.zeros(k, dtype=np.int64)
    for _ in range(rounds):
        of = squared(codebook[:, None, :].astype(np.float64), centres[None]).argmin(axis=1)
        for g in np.unique(of):
            centres[g] = codebook[of == g].mean(axis=0)
    return of


@dataclass(frozen=True)
class Codebooks:
    """entries: (part, entry, position within part); group: (part, entry); drift: (part, group), of the last move."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @staticmethod
    def start(first: np.ndarray, parts: int) -> Codebooks:
        """From the first vectors, one row each."""
        entries = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
        return Codebooks(entries, np.array([group_entries(c) for c in entries]), np.zeros((parts, GROUPS), dtype=np.int64))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry becomes the floor of the mean of its parts; unused ones stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = sums[used] // counts[used][:, None]
        far = ceil_root(squared(entries, self.entries))
        drift = np.zeros_like(self.drift)
        for p, of in enumerate(self.group):
            np.maximum.at(drift[p], of, far[p])
        return Codebooks(entries, self.group, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, part: int, x: np.ndarray, own: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, squared distance, bounds, distances computed) of parts, given their entries and bounds before the last move."""
        entries, of = self.entries[part], self.group[part]
        n, k = len(x), len(entries)
        if own is None:
            own, bound = np.zeros(n, dtype=np.int64), np.zeros((n, GROUPS), dtype=np.int64)
            d_own, open_ = squared(x, entries[own]), np.ones((n, GROUPS), dtype=bool)
        else:
            d_own, bound = squared(x, entries[own]), np.maximum(bound - self.drift[part], 0)
            open_ = bound * bound <= d_own[:, None]
        best, d_best, computed = own.copy(), d_own.copy(), n
        seen = np.full((n, k), FAR)
        for g in np.unique(of):
            rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(of == g)
            d = squared(x[rows][:, None, :], entries[members][None])
            computed += d.size
            seen[np.ix_(rows, members)] = d
            at = d.argmin(axis=1)  # members ascend, so a tie takes the lower index
            d_at, at = d[np.arange(len(rows)), at], members[at]
            better = (d_at < d_best[rows]) | ((d_at == d_best[rows]) & (at < best[rows]))
            best[rows[better]], d_best[rows[better]] = at[better], d_at[better]
        seen[np.arange(n), best] = FAR
        for g in np.unique(of):
            low = floor_root(seen[:, of == g].min(axis=1))
            bound[:, g] = np.where(open_[:, g], low, bound[:, g])
        left = np.flatnonzero(best != own)  # an entry left behind is one of the others of its group now
        bound[left, of[own[left]]] = np.minimum(bound[left, of[own[left]]], floor_root(d_own[left]))
        return best, d_best, np.minimum(bound, np.iinfo(np.int32).max), computed


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """The vector's components times `scale`, rounded down; null for a null vector or one with a null or non-finite component."""
    real = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(real, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False)))
    return F.when(finite, F.transform(real, lambda v: F.floor(v * scale).cast("int")))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _blob(rows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    data, width = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(data)])


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(x, codes, errors, bounds, distances computed) of a batch with columns x, code, bound."""
    parts, k, width = books.entries.shape
    x = _numbers(batch.column("x"), parts * width).reshape(-1, parts, width)
    if len(x) and 4 * parts * width * int(np.abs(x).max()) ** 2 >= 2**63:
        raise ArithmeticError("squared distances of these components don't fit a long")
    first = batch.column("code").null_count > 0
    codes, bounds = None, None
    if not first:
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
        bounds = np.frombuffer(b"".join(batch.column("bound").to_pylist()), np.int32).reshape(-1, parts, GROUPS).astype(np.int64)
    found = [books.assign(p, x[:, p], None if first else codes[:, p], None if first else bounds[:, p]) for p in range(parts)]
    code, error, bound, computed = zip(*found, strict=True)
    return x, np.stack(code, 1), np.sum(error, axis=0), np.stack(bound, 1), sum(computed)


def _round(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state with new entries and bounds; a last row per task holds sums, counts and the number of distances."""
    parts, k, width = books.entries.shape
    schema = T.StructType([*state.schema.fields, T.StructField("sums", T.ArrayType(T.LongType()))])
    arrow = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, computed, kinds = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), 0, None
        for batch in batches:
            kinds = batch.schema
            x, code, _, bound, n = _assigned(batch, books)
            computed += n
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=k)
            done = [batch.column("vec_id"), batch.column("label"), batch.column("x"), _blob(code.astype(np.uint8)), _blob(bound.astype(np.int32).reshape(len(x), -1)), pa.nulls(len(x), arrow)]
            yield pa.RecordBatch.from_arrays(done, schema.names)
        if kinds is not None:
            flat = np.concatenate([sums.ravel(), counts.ravel(), [computed]])
            empty = [pa.nulls(1, kinds.field(c).type) for c in ("vec_id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*empty, *[pa.nulls(1, pa.binary())] * 2, pa.array([flat], arrow)], schema.names)

    return state.mapInArrow(run, schema)


def first_vectors(vectors: DataFrame, parts: int, entries: int) -> tuple[DataFrame, np.ndarray]:
    """The rows (vec_id, label, x) that count, and the first `entries` of them by vec_id, nulls last, then by components."""
    rows = vectors.select("vec_id", "label", whole_components(F.col("embedding")).alias("x")).where((F.size("x") > 0) & (F.size("x") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    one = rows.orderBy(*order).select(F.size("x").alias("n")).first()
    rows = rows.where(F.size("x") == (one.n if one else 0))
    return rows, np.array([r.x for r in rows.orderBy(*order).select("x").limit(entries).collect()], dtype=np.int64)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, DataFrame, list[int]]:
    """The codebooks after `rounds` rounds, the vectors with entries and bounds, and how many distances each round computed.

    Rows count whose vector (`embedding`) is neither null nor holds a null or non-finite component. Codebooks start with
    the parts of the first `entries` vectors by vec_id (nulls last, then by components; fewer vectors give fewer entries).
    The dimension is that of the first vector; rows of another one, or that `parts` doesn't divide, don't count.
    No vectors: no codebooks. Repeated rows count as often as they occur. Components of more than about 30 bits raise.
    """
    rows, first = first_vectors(vectors, parts, entries)
    state = rows.select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("bound"))
    if not len(first):
        return None, state, []
    books, spark, before, computed = Codebooks.start(first, parts), vectors.sparkSession, None, []
    for _ in range(rounds):
        path = folder(spark, "vector-codes")
        done = _round(state, books)
        done.write.parquet(path)
        done = spark.read.schema(done.schema).parquet(path)
        sums = done.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).toArrow()
        flat = np.zeros(books.entries.size + books.group.size + 1, dtype=np.int64)
        flat[sums.column("pos").to_numpy()] = sums.column("n").to_numpy()
        size = books.entries.size
        books = books.moved(flat[:size].reshape(books.entries.shape), flat[size:-1].reshape(books.group.shape))
        computed.append(int(flat[-1]))
        if before:
            remove(spark, before)
        state, before = done.where("sums is null").drop("sums"), path
    return books, state, computed


def encode(state: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): the entry of each part as a binary value, and the squared distances summed."""
    schema = T.StructType([*state.select("vec_id", "label", "code").schema.fields, T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, error, _, _ = _assigned(batch, books)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _blob(code.astype(np.uint8)), pa.array(error)], schema.names)

    return state.mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors that count (see `train`).

    `code` has two hex digits per part. `label_error` sums `error` over rows of equal label, null labels together. No
    vectors give an empty result; columns other than vec_id, embedding and label are left out.
    """
    books, state, _ = train(vectors, parts, entries, rounds)
    if books is None:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = cut(encode(state, books), "coded")
    sums = cut(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST else sums
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
