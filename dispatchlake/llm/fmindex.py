"""Passages that stand in an earlier document, by a compressed FM-index per shard.

Each shard holds whole buckets of pieces (see passages.py). Its words are numbered, the suffixes
sorted up to the length of the longest pattern, a window and a stride, and the Burrows-Wheeler transform kept in a wavelet tree
of bit vectors with block counts. The pieces are streamed through it by backward search, many
at a time: a window is extended to the left while the interval of its suffixes still holds one
from a document with a smaller id, which a range minimum over the suffixes' documents tells. The
length reached is its matching statistic; a stretch of `window` words and more reports all windows
in it. Where it is less, the search goes on with the first window that lacks the word at which it failed.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from dispatchlake.llm.passages import HOT, SEGMENT, Symbols, repeated, without
from dispatchlake.llm.suffix import _ranges, _ranks, longer_keys

WINDOW = 50
GRAM = 16
SHARD_BYTES = 1 << 20
#: windows that one cursor goes through, so that a long piece is searched from many places at once
STRIDE = 32


#: for each bit of a word the bits below it
_BELOW = np.array([(1 << k) - 1 for k in range(64)], dtype=np.uint64)


class BitVector:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[i & 63])


class FmIndex:
    """Backward search over a row of numbers 0..top, valid for patterns up to `depth` long.

    It keeps the Burrows-Wheeler transform as a wavelet tree, where each number starts, and, to
    tell the least document of an interval, the document of each suffix. Texts and the order of
    suffixes are needed to build it only: matches are counted and judged, never located.
    """

    def __init__(self, line: np.ndarray, depth: int, document: np.ndarray | None = None) -> None:
        n, top = len(line), int(line.max())
        rank, h = _ranks(line), 1
        while h < depth and int(rank.max()) < n - 1:
            key, h = longer_keys(rank, h, depth)
            rank = _ranks(key) if h < depth else key
        order = np.argsort(rank)
        self.size = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=top + 1))))
        self.levels: list[tuple[BitVector, int]] = []
        symbols = line[order - 1]
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (symbols >> bit & 1).astype(bool)
            self.levels.append((BitVector(bits), len(bits) - int(bits.sum())))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        every = np.arange(top + 1)
        self.shift = self.before[:-1] - self._down(every, np.zeros(top + 1, dtype=np.int64))
        self.least = None if document is None else RangeLeast(document[order])

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        bits = (symbol >> np.arange(len(self.levels))[::-1, None] & 1).astype(bool)
        for (vector, zeros), bit in zip(self.levels, bits, strict=True):
            ones = vector.ones(i)
            i = np.where(bit, ones + zeros, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        both = self._down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        shift = self.shift[symbol]
        return both[: len(lo)] + shift, both[len(lo) :] + shift


class RangeLeast:
    """The least of any stretch of an array: by the least up to and from each place in its block, and of runs of whole blocks.

    With blocks of 16 the tables take a small multiple of the array's own size.
    """

    BLOCK = 16

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.full(-(-len(values) // self.BLOCK) * self.BLOCK, values.max(), dtype=values.dtype)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, self.BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows, k = [blocks.min(axis=1)], 1
        while 2 * k <= len(blocks):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of stretches from lo to before hi, none of them empty."""
        first, last = lo // self.BLOCK, (hi - 1) // self.BLOCK
        out = np.where(first < last, np.minimum(self.since[lo], self.upto[hi - 1]), self.values[lo])
        gap = last - first - 1
        level = np.frexp(np.maximum(gap, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[gap > 0]).tolist():
            i = np.flatnonzero((level == k) & (gap > 0))
            row = self.rows[k]
            out[i] = np.minimum(out[i], np.minimum(row[first[i] + 1], row[last[i] - (1 << k)]))
        near = np.flatnonzero((gap < 0) & (hi - lo > 1))
        for k in range(1, self.BLOCK):
            near = near[lo[near] + k < hi[near]]
            if not len(near):
                break
            out[near] = np.minimum(out[near], self.values[lo[near] + k])
        return out


def shard_matches(window: int):
    """An index for passages.repeated: windows of a shard's pieces that stand in a smaller document of it."""

    def index(pieces: list[bytes], place: np.ndarray, dids: np.ndarray) -> list[tuple[int, int, int]]:
        rows = [p.split() for p in pieces]
        sizes = np.array([len(r) for r in rows])
        starts = np.cumsum(sizes + 1) - sizes - 1
        words = list(chain.from_iterable(rows))
        number = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
        line = np.zeros(len(words) + len(rows), dtype=np.int64)  # a zero ends each piece
        line[np.arange(len(words)) + np.repeat(np.arange(len(rows)), sizes)] = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        document = np.unique(dids, return_inverse=True)[1]
        document = document.astype(np.min_scalar_type(int(document.max())))
        first = np.full(len(pieces), document.max())  # of a piece at two places, the smaller document
        np.minimum.at(first, place, document)
        # patterns are as long as all windows of a cursor together: a smaller depth mixes up what follows the first window
        fm = FmIndex(line, min(window + STRIDE - 1, int(sizes.max())), np.repeat(first, sizes + 1))
        counts, starts = (sizes - window + 1)[place], starts[place]
        cursors = -(-counts // STRIDE)
        own = np.repeat(np.arange(len(place)), cursors)
        at = (np.arange(cursors.sum()) - np.repeat(np.cumsum(cursors) - cursors, cursors)) * STRIDE
        stop = np.minimum(at + STRIDE, counts[own])
        windows = np.cumsum(counts) - counts
        edges = np.zeros(counts.sum() + 1, dtype=np.int64)  # where found ranges begin and end
        # a cursor's search: all its windows as one pattern, or, where that failed, its first window. All searches
        # go on together, each cursor's next as soon as its last has ended, so that few steps have few cursors;
        # those with the same interval and the same next symbol are one `state`, and the last state is that of no symbol
        whole, size = np.ones(len(at), dtype=bool), stop - 1 - at + window
        reached, below, tail = np.zeros(len(at), dtype=np.int64), document[own], starts[own] + at + size
        lo, hi, state, base = np.zeros(1, dtype=np.int64), np.full(1, fm.size), np.zeros(len(at), dtype=np.int64), len(number) + 1
        while len(at):
            each, state = np.unique(state * base + line[tail - reached - 1], return_inverse=True)
            was, symbol = np.divmod(each, base)
            lo, hi = fm.extend(symbol, lo[was], hi[was])
            on = fm.least(lo, hi)[state] < below
            lo, hi = np.append(lo, 0), np.append(hi, fm.size)
            reached += on
            ended = np.flatnonzero(~on | (reached == size))
            if len(ended):
                r, z, x, w, u = reached[ended], size[ended], at[ended], whole[ended], own[ended]
                end = x + z
                full = r >= window
                np.add.at(edges, windows[u[full]] + (end - r)[full], 1)
                np.add.at(edges, windows[u[full]] + end[full] - window + 1, -1)
                left = end - r
                at[ended], stop[ended] = np.where(w, x, np.where(full, x + 1, left)), np.where(w, np.minimum(left, stop[ended] - 1), stop[ended])
                whole[ended] = ~w & full
                size[ended] = np.where(whole[ended], stop[ended] - 1 - at[ended], 0) + window
                reached[ended], state[ended] = 0, len(each)
                tail[ended] = starts[u] + at[ended] + size[ended]
                more = at < stop
                if not more.all():
                    own, at, stop, whole, size, reached, below, tail, state = (v[more] for v in (own, at, stop, whole, size, reached, below, tail, state))
        hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        of = np.searchsorted(windows, hit, side="right") - 1
        return _ranges(np.ones(len(hit), dtype=bool), of, hit - windows[of])

    return index


def remove_earlier_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT, carry: tuple[str, ...] = (), segment: int = SEGMENT) -> DataFrame:
    """Remove every word covered by a `window`-word passage that also starts in a document with a smaller id.

    One row per row of `docs`: doc_id, spans (array of start and stop in words, the maximal
    removed runs), kept (the remaining words joined by a space), n (words of the text).
    Passages are judged on the input. Words are runs of characters other than space and U+0009
    to U+000D, unchanged; a null text has none. Rows with one doc_id never count as smaller than
    each other, so a repeated row stays whole; a null doc_id counts as smaller than any other.
    Long texts are held as symbols `segment` bytes at a time. An empty table gives an empty
    result. Other columns are not read, but for those in `carry`, which come along in the struct row.
    """
    symbols = Symbols("words", window, gram)
    covered = repeated(docs, symbols, True, shard_matches(window), shard_bytes, hot, segment=segment)
    return without(docs, covered, symbols, carry)
