"""Repeated byte strings by longest-previous-factor arrays over suffix-sorted shards.

Each shard holds whole buckets of pieces (see passages.py). Its suffixes are sorted up to the
window's length by ranks of ever longer prefixes, which also tell what neighbours share. A piece
that stands at two places has two entries for each suffix. In suffix order, the nearest entries with a
smaller place on either side share most with a suffix among all earlier ones: what they share is
its longest previous factor. One as long as the window is an earlier copy. The nearest entries
with a larger place give the longest later factor in the same way. Removing what has an earlier
copy keeps the first; removing what has either leaves none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.passages import HOT, SEGMENT, Symbols, repeated, without

WINDOW = 200
GRAM = 64
SHARD_BYTES = 1 << 20


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order = np.argsort(keys)
    along = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate(([0], along[1:] != along[:-1])))
    return out


def longer_keys(rank: np.ndarray, h: int, depth: int) -> tuple[np.ndarray, int]:
    """Keys that order suffixes by more than the first h symbols, of which `rank` tells the order; and by how many, `depth` at most.

    A key is made of as many ranks, of stretches one after the other, as its 63 bits hold.
    """
    top = int(rank.max()) + 2
    parts = min(max(2, 63 // top.bit_length()), -(-depth // h))
    reach, key = min(depth, parts * h), rank
    for part in range(1, parts):
        at = min(part * h, reach - h)  # the last stretch may overlap
        key = key * top
        key[: len(key) - at] += rank[at:] + 1
    return key, reach


def suffix_keys(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """A number for each place that orders suffixes by their first `depth` (8 or more) bytes; and (h, ranks by the first h bytes)."""
    key = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    for shift in (1, 2, 4):
        key = (key[:-shift] << np.uint64(8 * shift)) | key[shift:]
    key, h, ranks = key[: len(data)], 8, [(1, data.astype(np.int32))]
    while h < depth:
        rank = _ranks(key)
        ranks.append((h, rank.astype(np.int32)))
        key, h = longer_keys(rank, h, depth)
    return key, ranks


def common_prefixes(keys: np.ndarray, a: np.ndarray, b: np.ndarray, ranks: list[tuple[int, np.ndarray]], depth: int, least: int = 1) -> np.ndarray:
    """How many bytes, `depth` at most, the suffixes at places a and b share; 0 where that is less than `least`."""
    n, out = len(ranks[0][1]), np.where(keys[a] == keys[b], depth, 0)
    if least >= depth:
        return out
    rest = np.flatnonzero(out == 0)
    i, j, upper = a[rest], b[rest], depth
    for h, rank in reversed(ranks):
        for _ in range(-(-upper // h)):
            fits = np.maximum(i, j) + h <= n
            step = h * (fits & (rank[np.where(fits, i, 0)] == rank[np.where(fits, j, 0)]))
            i, j = i + step, j + step
        upper = h
    share = np.minimum(i - a[rest], depth)
    out[rest] = np.where(share >= least, share, 0)
    return out


def _shared_with_smaller(values: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """What each entry shares with the nearest entry before it that has a smaller value; 0 if that is below `least`.

    common: what an entry shares with the one before it, 0 for the first.
    """
    at, low = np.arange(len(values)) - 1, np.where(common >= least, common, 0)
    open_ = np.flatnonzero(low)
    while len(open_):
        open_ = open_[values[at[open_]] > values[open_]]
        before = at[open_]
        at[open_], low[open_] = at[before], np.minimum(low[open_], low[before])
        open_ = open_[low[open_] > 0]
    return low


def longest_factors(places: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each place, in suffix order; 0 for those shorter than `least`.

    common: what a suffix shares with the one before it. With negated places: the longest later factor.
    """
    back = np.concatenate(([0], common[:0:-1]))
    return np.maximum(_shared_with_smaller(places, common, least), _shared_with_smaller(places[::-1], back, least)[::-1])


def _ranges(hit: np.ndarray, piece: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, first, last) of neighbouring hits."""
    k, p = piece[hit], at[hit]
    if not len(k):
        return []
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(k)])) - 1
    return list(zip(k[first].tolist(), p[first].tolist(), p[last].tolist(), strict=True))


def shard_repeats(window: int, keep: str):
    """An index for passages.repeated: windows of a shard's pieces that stand elsewhere in it, or before in it."""

    def index(pieces: list[bytes], place: np.ndarray, _: np.ndarray) -> list[tuple[int, int, int]]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces])
        keys, ranks = suffix_keys(data, window)
        # an entry for each window of each place, numbered in the order of the corpus
        counts = (sizes - window + 1)[place]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.repeat(np.arange(len(place)), counts)
        suffix = (np.cumsum(sizes) - sizes)[place][own] + at
        order = np.argsort(keys[suffix], kind="stable")
        along = suffix[order]
        common = np.concatenate(([0], common_prefixes(keys, along[:-1], along[1:], ranks, window, window)))
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = longest_factors(order, common, window) >= window
        if keep == "none":
            hit[order] |= longest_factors(-order, common, window) >= window
        return _ranges(hit, own, at)

    return index


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT, keep: str = "none", segment: int = SEGMENT) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts anywhere else.

    One row per row of `docs`: doc_id, spans (array of start and stop, the maximal removed
    runs), kept (the remaining bytes), n (bytes of the text). keep="first": of equal strings the
    one at the smallest (doc_id, place) doesn't count. Strings are judged on the input
    and never cross documents; the same document counts as elsewhere. A null text is empty, and
    texts shorter than the window stay whole. Rows that repeat a document stand for each other,
    so they lose all that the window reaches, or keep it all where they are the first. Rows with a null doc_id are documents too, before all
    others. Long texts are held as symbols `segment` bytes at a time. An empty table gives an
    empty result. Other columns are not read.
    """
    symbols = Symbols("bytes", window, gram)
    covered = repeated(docs, symbols, False, shard_repeats(window, keep), shard_bytes, hot, keep == "first", segment)
    return without(docs, covered, symbols)


def digests(removed: DataFrame, count: str) -> DataFrame:
    """What a removal did, in numbers: from the rows of remove_repeats or its like."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return removed.select("doc_id", F.col("n").alias(count), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
