"""Benchmark decontamination over templates: numbers, names and units become typed placeholders.

A text becomes a row of tokens: lower-case words, and placeholders for numbers, for units after a
number and for names (capitalised words not at the start of a sentence; neighbouring ones are
one). Windows of `WINDOW` tokens of the benchmark are hashed and joined with the documents'
windows. The windows that a document shares with an item are laid along the item; those whose
placeholders stand for other values than before, or one value for two, break the template. An
item whose tokens are covered well enough by consistent windows contaminates the document, be it
word for word or with other numbers and names.

Whole items are looked for word for word too, whatever their length: as rows of lower-case words
without placeholders, by the hash of all their words. An item of at most `WINDOW` tokens has a
second window in which its first word is read as within a sentence, where it may be a name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import batches_of, cut
from dispatchlake.llm.passages import gram_hashes, keyed, stretch_hashes

WINDOW = 8
LITERALS = 4
#: share of an item's tokens, or number of tokens, that consistent windows must cover
COVER, COVER_TOKENS = 0.5, 20
#: benchmark windows up to this number travel to the tasks; more are joined by a shuffle
INLINE = 1_000_000
#: benchmark windows up to this number, of a few hundred bytes each, are broadcast to the join
BROADCAST = 50_000
#: leading bits by which most hashes are told apart before they are searched for
SEEN = 20
#: a window may stand this many tokens off the place that its neighbours tell
DRIFT = 3

NUMBER, UNIT, NAME = np.uint64(1), np.uint64(2), np.uint64(3)
# fixed values: number words and units of measure
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % usd eur dollar dollars cent cents euro euros mph kmh hz khz mhz ghz w kw v volts kb mb gb tb".split()
_PLAIN = re.compile(rb"^[^\w\x80-\xff$%]+|[^\w\x80-\xff%]+$")
_AROUND = re.compile(rb"^(?:[\"'(\[{]|\xe2\x80[\x98\x99\x9c\x9d])+|(?:[.,!?:;\"')\]}]|\xe2\x80[\x98\x99\x9c\x9d])+$")
_NUMBER = re.compile(r"^[+\-$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-z]{1,3})?$")


def _traits(word: bytes) -> tuple[int, int]:
    """(code of the lower-case word, flags): 1 number, 2 unit, 4 capitalised, 8 ends a sentence, 16 empty."""
    bare = word if word.isalnum() else _PLAIN.sub(b"", word)
    text = bare.decode("utf-8", "replace")
    low = text.lower()
    flags = 1 * (bool(_NUMBER.match(low)) or low in _NUMBER_WORDS) + 2 * (low in _UNITS) + 4 * (text[:1].isupper() and text[1:].islower())
    flags += 8 * (word.rstrip(b"\"')]")[-1:] in b".!?:;" and len(word) > 0) + 16 * (not bare)
    return max(4, xxhash.xxh3_64_intdigest(low.encode())), flags


def _literal(word: bytes) -> int:
    """The code of the lower-case word without quotes, brackets and stops around it; 0 if nothing is left."""
    bare = _AROUND.sub(b"", word)
    return max(4, xxhash.xxh3_64_intdigest(bare.decode("utf-8", "replace").lower().encode())) if bare else 0


_NUMBER_WORDS, _UNITS = set(NUMBER_WORDS), set(UNITS)


def _among(known: np.ndarray, seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are in `known` (ascending); `seen` tells which leading bits occur there."""
    i = np.flatnonzero(seen[hashes >> np.uint64(64 - SEEN)])
    return i[known[np.minimum(np.searchsorted(known, hashes[i]), len(known) - 1)] == hashes[i]]


def _leading(known: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << SEEN, dtype=bool)
    seen[known >> np.uint64(64 - SEEN)] = True
    return seen


class Canon:
    """Canonical tokens of texts; remembers the traits of the latest words."""

    def __init__(self, bound: int = 100_000) -> None:
        self.bound, self.known = bound, {}
        self.codes, self.flags, self.plain = array("Q"), array("B"), array("Q")

    def __call__(self, texts: list[bytes]):
        """All texts' tokens in one row: codes, literal or not, first word of each, words, places of the texts."""
        if len(self.known) > self.bound:
            self.__init__(self.bound)
        split = [t.split() for t in texts]
        words = [w for ws in split for w in ws]
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = len(known)
                code, flag = _traits(w)
                self.codes.append(code)
                self.flags.append(flag)
                self.plain.append(code if w.isalnum() else _literal(w))
        at = np.array([known[w] for w in words], dtype=np.int64)
        codes, flags = np.frombuffer(self.codes, dtype=np.uint64)[at], np.frombuffer(self.flags, dtype=np.uint8)[at]
        text = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        self.last = at, text, len(texts)
        first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.empty(0, dtype=bool)
        before = np.concatenate(([8], flags[:-1])) if len(text) else flags
        start = first | ((before & 8) > 0)
        number = (flags & 1) > 0
        unit = ((flags & 2) > 0) & ~first & np.concatenate(([False], number[:-1])) if len(text) else number
        name = ((flags & 4) > 0) & ~start & ~number & ~unit
        codes = np.select([number, unit, name], [NUMBER, UNIT, NAME], codes)
        again = name & ~first & np.concatenate(([False], name[:-1])) if len(text) else name
        kept = np.flatnonzero(~again & ((flags & 16) == 0))
        places = np.concatenate(([0], np.cumsum(np.bincount(text[kept], minlength=len(texts)))))
        return codes[kept], ~(number | unit | name)[kept], kept, words, places

    def literals(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts of the last call the words without placeholders: codes, places of the texts."""
        at, text, n = self.last
        codes = np.frombuffer(self.plain, dtype=np.uint64)[at]
        kept = codes > 0
        return codes[kept], np.concatenate(([0], np.cumsum(np.bincount(text[kept], minlength=n))))


def _values(codes: np.ndarray, kept: np.ndarray, words: list[bytes], i: int, n: int) -> list[str]:
    """What stands in the placeholders of the window at token i; a name's first word stands for it."""
    return [_PLAIN.sub(b"", words[kept[j]]).decode("utf-8", "replace").lower() for j in range(i, i + n) if codes[j] < 4]


@dataclass(frozen=True)
class Literals:
    """Whole items as rows of plain words: their lengths and, if few enough, (first words, length, all words) by hash."""

    lengths: list[int]
    first: np.ndarray | None = None
    sizes: np.ndarray | None = None
    whole: np.ndarray | None = None

    @staticmethod
    def head(n: int) -> int:
        """Words at the start of an item of n words by which documents are searched for it."""
        return min(WINDOW, 1 << (n.bit_length() - 1))

    @staticmethod
    def of(items: pa.Table) -> Literals:
        """Of a table of (head, n, hash)."""
        first, sizes, whole = (items.column(c).to_numpy() for c in ("head", "n", "hash"))
        order = np.argsort(first.view(np.uint64), kind="stable")
        return Literals(sorted({-int(n) for n in sizes}), first.view(np.uint64)[order], -sizes[order], np.sort(whole.view(np.uint64)))

    def find(self, codes: np.ndarray, places: np.ndarray, seen: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(text, place, words, hash) of what may be an item; each text's equal finds once. `seen`: the leading bits of `first`."""
        starts, sizes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        if self.first is None:
            for n in self.lengths:
                starts.append(np.arange(max(0, len(codes) - n + 1)))
                sizes.append(np.full(len(starts[-1]), n))
        else:
            for k in sorted({self.head(n) for n in self.lengths}):
                hashes = gram_hashes(codes, k)
                i = _among(self.first, seen, hashes)
                low, high = (np.searchsorted(self.first, hashes[i], side=s) for s in ("left", "right"))
                count = high - low
                own = np.repeat(np.arange(len(i)), count)
                starts.append(i[own])
                sizes.append(self.sizes[low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)])
        start, size = np.concatenate(starts), np.concatenate(sizes)
        text = np.searchsorted(places, start, side="right") - 1
        inside = start + size <= places[text + 1]
        text, start, size = text[inside], start[inside], size[inside]
        hashes = stretch_hashes(codes, start, size) if len(start) else np.empty(0, dtype=np.uint64)
        if self.whole is not None and len(hashes):
            good = self.whole[np.minimum(np.searchsorted(self.whole, hashes), len(self.whole) - 1)] == hashes
            text, start, size, hashes = text[good], start[good], size[good], hashes[good]
        once = np.unique(np.stack([text.astype(np.uint64), size.astype(np.uint64), hashes]), axis=1, return_index=True)[1]
        return text[once], (start - places[text])[once], size[once], hashes[once]


def _literal_items(rows: DataFrame) -> DataFrame:
    """(item_id, at, n, hash, tokens, theirs, head) of the items that have words: n is less than 0, head hashes the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for at, texts in batches_of(batch, 2):
                tokens = np.maximum(1, np.diff(canon(texts)[4]))
                codes, places = canon.literals()
                size = np.diff(places)
                own = np.flatnonzero(size)
                heads = np.array([Literals.head(int(n)) for n in size[own]], dtype=np.int64)
                hashes = [stretch_hashes(codes, places[own], n).view(np.int64) for n in (size[own], heads)]
                columns = [np.asarray(batch.column(0))[at + own], np.zeros(len(own), dtype=np.int64), -size[own], hashes[0], tokens[own]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([[]] * len(own), pa.list_(pa.string())), pa.array(hashes[1])], names)

    names = ["item_id", "at", "n", "hash", "tokens", "theirs", "head"]
    return rows.mapInArrow(run, "item_id long, at long, n long, hash long, tokens long, theirs array<string>, head long")


def _windows(rows: DataFrame, sizes: list[int], only: np.ndarray | None, values: bool = True, literals: Literals | None = None) -> DataFrame:
    """(did, tk, pos, n, hash, vals) of the windows of the given sizes; of hashes in `only`, if given.

    Of a text with fewer tokens than `WINDOW`, only the window of all its tokens counts for
    benchmark items; documents have windows of every size in `sizes`. Where whole items are
    looked for too, rows with n less than 0 are what may be one, of -n plain words.
    """
    item = only is None and not sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        seen = None if only is None else _leading(only)
        seen_first = _leading(literals.first) if literals and literals.first is not None else None
        for batch in batches:
            did, tk = (np.asarray(c) for c in batch.columns[:2])
            for at, texts in batches_of(batch, 2):
                codes, literal, kept, words, places = canon(texts)
                known = np.concatenate(([0], np.cumsum(literal)))
                plain = canon.literals() if literals else None
                lengths = np.diff(places)
                if item:  # short items again, the first word read as within a sentence
                    short = np.flatnonzero((lengths > 0) & (lengths <= WINDOW))
                    yield from inner([texts[j] for j in short], did[at + short], tk[at + short], lengths[short], canon)
                own = np.repeat(np.arange(len(texts)), lengths)
                out = []
                for n in sorted({min(WINDOW, int(x)) for x in lengths if x}) if item else sizes:
                    hashes = gram_hashes(codes, n)
                    i = np.arange(len(hashes)) if only is None else _among(only, seen, hashes)
                    good = (places[own[i] + 1] - i >= n) & (known[i + n] - known[i] >= LITERALS)
                    if item:
                        good &= np.minimum(lengths[own[i]], WINDOW) == n
                    i = i[good]
                    text = own[i]
                    vals = [_values(codes, kept, words, int(j), n) for j in i] if values else [[]] * len(i)
                    columns = [did[at + text], tk[at + text], i - places[text], np.full(len(i), n), hashes[i].view(np.int64), lengths[text]]
                    out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(vals, pa.list_(pa.string()))], names))
                if plain is not None:
                    text, pos, n, hashes = literals.find(*plain, seen_first)
                    columns = [did[at + text], tk[at + text], pos, -n, hashes.view(np.int64), lengths[text]]
                    out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([[]] * len(text), pa.list_(pa.string()))], names))
                yield from out

    def inner(texts: list[bytes], did: np.ndarray, tk: np.ndarray, tokens: np.ndarray, canon: Canon) -> Iterator[pa.RecordBatch]:
        codes, literal, kept, words, places = canon([b"a " + t for t in texts])
        for j in range(len(texts)):
            i, n = int(places[j]) + 1, int(places[j + 1] - places[j]) - 1
            if n and literal[i : i + n].sum() >= LITERALS and codes[i] == NAME:
                row = [did[j], tk[j], 0, n, gram_hashes(codes[i : i + n], n).view(np.int64)[0], tokens[j]]
                yield pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in row), pa.array([_values(codes, kept, words, i, n)], pa.list_(pa.string()))], names)

    names = ["did", "tk", "pos", "n", "hash", "tokens", "vals"]
    return rows.mapInArrow(run, "did long, tk long, pos long, n long, hash long, tokens long, vals array<string>")


def consistent(pairs: list[tuple[list[str], list[str]]]) -> list[bool]:
    """Which windows keep one value for one value, both ways, as told by those before them."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    out = []
    for ours, theirs in pairs:
        fits = len(ours) == len(theirs) and all(there.get(b, a) == a and back.get(a, b) == b for a, b in zip(ours, theirs, strict=True))
        fits = fits and len(set(ours)) == len(set(theirs))
        if fits:
            there.update(zip(theirs, ours, strict=True))
            back.update(zip(ours, theirs, strict=True))
        out.append(fits)
    return out


def cover(hits: list[dict], tokens: int) -> tuple[int, bool]:
    """(tokens of the item covered at one place of the document, at best; word for word or not).

    A hit with n less than 0 is the whole item.
    """
    if any(h["n"] < 0 for h in hits):
        return tokens, True
    hits = sorted(hits, key=lambda h: (h["pos"], h["at"]))
    places: list[list[dict]] = []
    near: list[list[dict]] = []
    for h in hits:  # a place: hits whose offset from the item stays about the same
        near = [p for p in near if h["pos"] - p[-1]["pos"] <= tokens]
        for place in reversed(near):
            if abs((h["pos"] - h["at"]) - (place[-1]["pos"] - place[-1]["at"])) <= DRIFT:
                place.append(h)
                break
        else:
            places.append([h])
            near.append(places[-1])
    best = (0, True)
    for place in places:
        fits = consistent([(h["vals"], h["theirs"]) for h in place])
        covered = {t for h, fit in zip(place, fits, strict=True) if fit for t in range(h["at"], h["at"] + h["n"])}
        exact = all(h["vals"] == h["theirs"] for h, fit in zip(place, fits, strict=True) if fit)
        best = max(best, (len(covered), exact))
    return best


def matches(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE, whole: bool = False) -> DataFrame:
    """(did, tk, item_id, tokens, covered, exact): items that share a window with a document; with `whole`, or stand in it word for word."""
    rows = keyed(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    items = _windows(rows, [], None).select(F.col("did").alias("item_id"), F.col("pos").alias("at"), "n", "hash", "tokens", F.col("vals").alias("theirs")).distinct()
    items = cut(items, "items")
    sizes = sorted(r.n for r in items.select("n").distinct().collect())
    if not sizes:
        sizes = [WINDOW]
    only = None
    count = items.count()
    if count <= inline:
        column = items.select("hash").distinct().toArrow().column("hash").to_numpy().view(np.uint64)
        only = np.sort(column) if len(column) else np.zeros(1, dtype=np.uint64)
    literals = None
    if whole:
        plain = cut(_literal_items(rows).distinct(), "whole-items")
        more = plain.count()
        if more:
            literals = Literals.of(plain.select("head", "n", "hash").distinct().toArrow()) if more <= inline else Literals(sorted(-r.n for r in plain.select("n").distinct().collect()))
            items, count = items.unionByName(plain.drop("head")), count + more
    hits = _windows(keyed(docs), sizes, only, literals=literals).drop("tokens").join(F.broadcast(items) if count <= BROADCAST else items, ["hash", "n"])
    shared = hits.groupBy("did", "tk", "item_id", "tokens").agg(F.collect_list(F.struct("pos", "at", "n", "vals", "theirs")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cover(h, t) for h, t in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())], ["did", "tk", "item_id", "tokens", "covered", "exact"])

    return shared.mapInArrow(run, "did long, tk long, item_id long, tokens long, covered long, exact boolean")


def judge(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE) -> DataFrame:
    """(row, contaminated, items) of every row of `docs`: row has all its columns, for the others see `decontaminate`."""
    found = matches(docs, benchmark, inline, whole=True).where((F.col("covered") >= COVER * F.col("tokens")) | (F.col("covered") >= COVER_TOKENS))
    items = found.groupBy("did", "tk").agg(F.sort_array(F.collect_set(F.struct("item_id", "tokens", "covered", "exact"))).alias("items"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text, docs["doc_id"].isNull()).alias("tk"), F.struct("*").alias("row"))
    rows = rows.join(items, ["did", "tk"], "left")
    return rows.select("row", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE) -> DataFrame:
    """Every row of `docs` with contaminated (boolean) and items (what contaminates it).

    Columns of `docs` with those two names give way to the result; `judge` keeps them, in a
    struct. items is an array of structs item_id, tokens, covered, exact, ascending; exact is false where
    numbers, names or units differ. Items with fewer than `LITERALS` tokens that are no
    placeholders can't be told from chance with other numbers and names, so they match word for
    word only; a null or empty text matches nothing. Rows that repeat a document are judged
    alike. A text of any length is one row in a task, at about 100 bytes a word. Without
    benchmark items nothing is contaminated; an empty table gives an empty result.
    """
    kept = [f"row.`{c}`" for c in docs.columns if c not in ("contaminated", "items")]
    return judge(docs, benchmark, inline).select(*kept, "contaminated", "items")
