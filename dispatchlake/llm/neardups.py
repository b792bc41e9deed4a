"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links first, then what they can't reach.

A text is the set of its shingles of `SHINGLE` words. The covering LSH of simhash.py links texts
whose fingerprints differ in a few bits; each link is compared by the whole sets. That joins large
groups of almost equal copies. But at a similarity of 0.8 fingerprints differ in 9 bits on
average, more than covering masks can be made for, so a prefix join finds the rest: shingles are put in one order for all
texts, by how often those with the same leading hash bits occur, then by hash. Two sets that
share at least 0.8 of their union share a shingle among the first n - ceil(0.8 n) + 1 of each,
so no pair is missed, whatever the order; the order keeps lines that many
texts have out of the prefixes. A sketch of each set, 32 times smaller, bounds what two sets share:
it rules out most pairs, and those that are left are compared by their whole sets.

Texts with equal sets are one. Of the texts under a shingle, those not yet in one component are first compared with
one of them: the one with the fewest shingles of its own in its prefix, for of a large group of near copies that
lies between the others, and is near to those that are far from each other. So the group is linked without all of its pairs; then all pairs
that are still not in one component are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.llm.common import WordIds, batches_of, cut, drop
from dispatchlake.llm.graph import components
from dispatchlake.llm.passages import gram_hashes, keyed, word_code
from dispatchlake.llm import simhash

SHINGLE = 5
#: a link has this share of the union in common, at least: a fraction, so that no rounding decides
SHARE = (4, 5)
#: leading hash bits by which occurrences are counted; they only order shingles
BITS = 16
#: rounds in which the texts under a shingle are compared with one of them only
ROUNDS = 1
#: sets that a task remembers, so that copies of a text are listed once by it
REMEMBERED = 500_000
#: keys up to this number are broadcast; more are joined by a shuffle
BROADCAST = 500_000


def shingles(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of k neighbouring words, ascending; of a shorter text, the one of all its words."""
    if not len(codes):
        return np.zeros(1, dtype=np.uint64)
    return np.unique(gram_hashes(codes, min(k, len(codes))))


def _sets(batch: pa.RecordBatch, text: int, number: WordIds, k: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, sets, hashes of the sets) of slices of a batch. Null text counts as empty."""
    for at, texts in batches_of(batch, text):
        sets = [shingles(number(t.lower().split()), k) for t in texts]
        yield at, sets, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Whether each cell has an odd number of the hashes, as bits of 64-bit words; a power of two of cells, two for each hash or more.

    Two sets differ in as many hashes as their sketches do in bits, at least. The halves of a
    sketch, one xor the other, are that of half as many cells.
    """
    cells = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _marks(texts: DataFrame, k: int = SHINGLE, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """(did, tk, node, fp, n, cells) of each row, its set's hash, fingerprint, size and sketch; and how often shingles with each leading bits occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = WordIds(word_code), np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for at, sets, nodes in _sets(batch, 2, number, k):
                counts += np.bincount(np.concatenate(sets) >> np.uint64(64 - bits), minlength=1 << bits)
                fps = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
                keys = [c.slice(at, len(sets)) for c in batch.columns[:2]]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(nodes), pa.array(fps), sizes, pa.array([sketch(s) for s in sets], longs), pa.nulls(len(sets), longs)], names)
        yield pa.RecordBatch.from_arrays([*(pa.array([0], pa.int64()) for _ in range(5)), pa.nulls(1, longs), pa.array([counts], longs)], names)

    names, longs = ["did", "tk", "node", "fp", "n", "cells", "counts"], pa.list_(pa.int64())
    rows = cut(texts.mapInArrow(run, "did long, tk long, node long, fp long, n long, cells array<long>, counts array<long>"), "marks")
    each = rows.where("counts is not null").select(F.posexplode("counts").alias("cell", "n")).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(1 << bits, dtype=np.int64)
    seen[each.column("cell").to_numpy()] = each.column("n").to_numpy()
    return rows.where("counts is null").drop("counts"), seen


def _prefixes(texts: DataFrame, seen: np.ndarray, k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(h, node, n, pos): the first shingles of each set, as many as a near-duplicate must share one of; equal rows may repeat."""
    p, q = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = WordIds(word_code), set()
        for batch in batches:
            for _, sets, nodes in _sets(batch, 2, number, k):
                known = known if len(known) < REMEMBERED else set()
                new = [i for i, x in enumerate(nodes.tolist()) if x not in known and not known.add(x)]
                if not new:
                    continue
                n = np.array([len(sets[i]) for i in new], dtype=np.int32)
                flat, row = np.concatenate([sets[i] for i in new]), np.repeat(np.arange(len(new)), n)
                order = np.lexsort((flat, seen[flat >> np.uint64(64 - bits)], row))
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                first = pos < np.repeat(n - (p * n + q - 1) // q + 1, n)
                columns = [flat[order][first].view(np.int64), nodes[new][row[first]], n[row[first]], pos[first].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h", "node", "n", "pos"])

    return texts.mapInArrow(run, "h long, node long, n int, pos int")


def _again(marks: DataFrame) -> DataFrame | None:
    """(did, tk) of rows that stand more than once; None if there are none."""
    again = cut(marks.groupBy("did", "tk").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "again")
    return None if again.isEmpty() else again


def _few(keys: DataFrame) -> DataFrame:
    """Keys to join with, broadcast if they are no more than `BROADCAST`."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def _sets_of(nodes: DataFrame, marks: DataFrame, texts: DataFrame, once: bool, k: int = SHINGLE) -> DataFrame:
    """(node, hashes) of some nodes, each from the text of one of its rows; once: no row repeats another's did and tk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordIds(word_code)
        for batch in batches:
            for _, sets, nodes in _sets(batch, 2, number, k):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), lists], ["node", "hashes"])

    rows = marks.join(nodes, "node").groupBy("node").agg(F.min(F.struct("did", "tk")).alias("r")).select("r.*")
    held = texts.join(_few(cut(rows, "wanted")), ["did", "tk"], "left_semi").mapInArrow(run, "node long, hashes array<long>")
    return cut(held if once else held.dropDuplicates(["node"]), "sets")


def _may_link(a: str, b: str):
    """Whether the sizes, and the places of a first common shingle, leave room for enough in common."""
    (p, q), n, m = SHARE, F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    room = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (p * n <= q * m) & (p * m <= q * n) & ((p + q) * room >= p * (n + m))


def _not_apart(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The (x, y) pairs whose sketches leave room for enough in common: a bound, so none that is near goes."""
    (p, q), c = SHARE, F.col
    nodes = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "node")
    told = marks.select("node", "n", "cells").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    side = lambda s: told.select(c("node").alias(s), c("n").alias(f"{s}_n"), c("cells").alias(f"{s}_cells"))
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(mine: str, other: str):
        # sizes that may link are within a factor of two, so one folding makes the sketches equally long
        half = (F.size(mine) / 2).cast("int")
        return F.when(F.size(mine) > F.size(other), F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), xor)).otherwise(c(mine))

    both = pairs.join(side("x"), "x").join(side("y"), "y").where((p * c("x_n") <= q * c("y_n")) & (p * c("y_n") <= q * c("x_n")))
    bits = F.zip_with(folded("x_cells", "y_cells"), folded("y_cells", "x_cells"), lambda a, b: F.bit_count(xor(a, b)))
    apart = F.aggregate(bits, F.lit(0), lambda s, v: s + v)
    return both.where((p + q) * apart <= (q - p) * (c("x_n") + c("y_n"))).select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (x, y) pairs whose whole sets are near enough."""
    p, q = SHARE
    side = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    common = F.size(F.array_intersect("x_set", "y_set")).cast("long")
    return both.where((p + q) * common >= p * (F.size("x_set") + F.size("y_set"))).select("x", "y")


def _alike(marks: DataFrame, radius: int) -> DataFrame:
    """(x, y): nodes that SimHash links, as pairs that connect them."""
    nodes = marks.groupBy("fp", "node").agg(F.count(F.lit(1)))
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    links = simhash.near_links(firsts.select("fp"), radius)
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = links.join(side("x"), "x").join(side("y"), "y").select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))
    return equal.union(near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_links(texts: DataFrame, marks: DataFrame, seen: np.ndarray, radius: int = simhash.RADIUS, once: bool = False) -> DataFrame:
    """(node, root): the components of the distinct sets linked by a Jaccard similarity of at least `SHARE`; once: see `_sets_of`.

    Whole sets are made, shuffled and dropped again for the nodes of one turn's pairs only, and
    only for pairs that their sketches don't tell apart.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(_not_apart(pairs, marks), "pairs")
        sets = _sets_of(pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "node"), marks, texts, once)
        near = cut(_verified(pairs, sets), "near")
        drop(sets, pairs)
        return near

    alike = cut(_alike(marks, radius), "alike")
    # of each shingle the sets that have it in their prefix, if they are two or more
    by = Window.partitionBy("h").orderBy("n", "node")
    rows = _prefixes(texts, seen).withColumn("again", F.lag("node").over(by) == F.col("node")).where("again is null or not again")
    members = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("k > 1").select("h", "node", "n", "pos")
    # how many of a set's prefix no other has: least in the middle of a group of near copies
    (p, q), shared = SHARE, F.count(F.lit(1)).over(Window.partitionBy("node"))
    members = cut(members.withColumn("alone", F.floor(F.col("n") * (q - p) / q) + 1 - shared), "shared")
    edges = verified(alike)
    roots = cut(components(edges), "roots")
    for turn in range(ROUNDS + 1):
        rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = rooted.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("h")
        rooted = cut(rooted.join(open_, "h"), "open")
        if turn < ROUNDS:
            one = rooted.groupBy("h").agg(F.min(F.struct(F.col("alone") / F.col("n"), F.xxhash64("node", F.lit(turn)), "node", "n", "pos", "root")).alias("m")).select("h", "m.*")
        else:
            one = rooted
        pairs = rooted.alias("a").join(one.alias("b"), "h").where(F.col("a.root") != F.col("b.root")).where(_may_link("a", "b"))
        pairs = pairs.select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
        edges, old = cut(edges.union(verified(pairs)), "links"), (edges, roots, rooted)
        roots = cut(components(edges), "roots")
        drop(*old)
    return roots


def first_copies(docs: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    Groups are the components over pairs with a Jaccard similarity of at least `SHARE` between
    their sets of `SHINGLE`-word shingles (words in lower case, as in op3). Null texts and texts
    without words are one group. Of rows that repeat both doc_id and text one stays; a null
    doc_id counts as smaller than any. All columns of `docs` are kept, whatever their names. A
    text of any length is one row in a task, at about 100 bytes a word. An empty table gives an
    empty result.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text, docs["doc_id"].isNull()).alias("tk"), F.struct("*").alias("row"))
    texts = keyed(docs)
    marks, seen = _marks(texts)
    again = _again(marks)
    roots = near_links(texts, marks, seen, radius, again is None)
    rows = marks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = cut(rows.groupBy("root").agg(F.min(F.struct("did", "tk")).alias("f")).select("f.*"), "first")
    kept = own.join(_few(first), ["did", "tk"], "left_semi")
    if again is None:
        return kept.select("row.*")
    again = _few(again)  # whole rows are shuffled only where some repeat
    single, repeated = kept.join(again, ["did", "tk"], "left_anti"), kept.join(again, ["did", "tk"], "left_semi")
    return single.union(repeated.dropDuplicates(["did", "tk"])).select("row.*")
