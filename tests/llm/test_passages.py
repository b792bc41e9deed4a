import hashlib
import random

import numpy as np
from dispatchlake.llm import fmindex, passages, suffix
from pyspark.sql import functions as F


def brute_bytes(texts, w, keep="none"):
    seen = {}
    for d, t in sorted(texts, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            seen.setdefault(b[i : i + w], []).append((d, t, i))
    out = []
    for d, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            at = seen[b[i : i + w]]
            if len(at) > 1 and (keep == "none" or at[0] != (d, t, i)):
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(texts, w):
    first = {}
    key = lambda d: -1 if d is None else d
    for d, t in texts:
        words = tuple((t or "").encode().split())
        for i in range(len(words) - w + 1):
            p = words[i : i + w]
            first[p] = min(first.get(p, 1 << 60), key(d))
    out = []
    for d, t in texts:
        words = tuple((t or "").encode().split())
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if first[words[i : i + w]] < key(d):
                gone[i : i + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed_texts(rng):
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "ru") for b in range(40)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passages_ = [say(rng.randrange(40, 130)) for _ in range(6)]
    texts = []
    for i in range(90):
        parts = [say(rng.randrange(5, 150))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages_)
            if rng.random() < 0.5:
                words = p.split(" ")
                words[rng.randrange(len(words))] = "edit" + str(i)
                p = " ".join(words)
            parts += [p, say(rng.randrange(30))]
        texts.append((i, " ".join(parts)))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, ""), (104, " \n"), (105, "a" * 700), (106, ("same line\n" * 90)), (107, "x" + texts[5][1])]
    texts += [(108, "ab" * 1600), (109, "u v " * 1300), (110, "w " + "u v " * 1250)]
    return texts + [(3, texts[3][1]), (None, texts[7][1]), (None, None), (55, texts[8][1])]


def test_bytes_match_brute_force(spark, make_docs):
    texts = mixed_texts(random.Random(1))
    want = brute_bytes(texts, 200)
    docs = make_docs(texts).withColumns({c: F.lit("clash") for c in ("did", "tk", "span", "spans", "kept", "n", "base")})
    for hot, shard, segment in ((2000, 1 << 20, 1 << 20), (1, 1 << 20, 1 << 20), (2000, 1, 300)):
        got = suffix.digests(suffix.remove_repeats(docs, hot=hot, shard_bytes=shard, segment=segment), "n_bytes").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_words_match_brute_force(spark, make_docs):
    texts = mixed_texts(random.Random(2))
    want = brute_words(texts, 50)
    docs = make_docs(texts).withColumns({c: F.lit("clash") for c in ("did", "tk", "span", "spans", "kept", "n", "base")})
    for hot, shard, segment in ((2000, 1 << 20, 1 << 20), (1, 1 << 20, 1 << 20), (2000, 1, 300)):
        got = suffix.digests(fmindex.remove_earlier_passages(docs, hot=hot, shard_bytes=shard, segment=segment), "n_words").drop("n_spans").collect()
        assert sorted(map(tuple, got), key=str) == want


def variants(seed):
    """Pieces longer than a window that differ just beyond it, in the order of their documents; and the windows that stand in a smaller one."""
    rng = random.Random(seed)
    n = rng.randrange(90, 200)
    base = [f"w{i}" if rng.random() < 0.9 else "c" for i in range(n)]
    rng.shuffle(base)
    spots = [s for s in range(rng.randrange(3, 30), n) if rng.random() < 0.04]
    pieces = []
    for _ in range(40):
        row = list(base)
        for s in spots:
            row[s] = rng.choice("azq") + str(rng.randrange(3))
        a = rng.randrange(30)
        pieces.append(" ".join(row[a : rng.randrange(a + 50, n + 1)]).encode())
    pieces = list(dict.fromkeys(pieces))
    rows, place = [(rng.randrange(30), p.split()) for p in pieces], sorted(range(len(pieces)), key=lambda _: rng.random())
    place = sorted(place, key=lambda k: rows[k][0])
    first = {}
    for d, row in [rows[k] for k in place]:
        for i in range(len(row) - 49):
            first.setdefault(tuple(row[i : i + 50]), d)
    want = {(j, i) for j, k in enumerate(place) for i in range(len(rows[k][1]) - 49) if first[tuple(rows[k][1][i : i + 50])] < rows[k][0]}
    return pieces, np.array(place), np.array([rows[k][0] for k in place]), want


def test_shards_of_variants_a_window_apart():
    """A search that goes on beyond a window must not mix up what differs there."""
    for seed in (0, 1, 2, 4):
        pieces, place, dids, want = variants(seed)
        got = fmindex.shard_matches(50)(pieces, place, dids)
        assert {(k, i) for k, a, b in got for i in range(a, b + 1)} == want


def test_equal_searches_go_through_the_index_once(monkeypatch):
    """Copies with a word of their own in front: what they have in common is searched for once, not for each."""
    common, steps = [f"w{i}" for i in range(120)], []
    pieces = [" ".join([f"own{k}", *common]).encode() for k in range(100)]
    extend = fmindex.FmIndex.extend
    monkeypatch.setattr(fmindex.FmIndex, "extend", lambda fm, symbol, lo, hi: steps.append(len(lo)) or extend(fm, symbol, lo, hi))
    got = fmindex.shard_matches(50)(pieces, np.arange(100), np.arange(100))
    assert got == [(k, 1, 71) for k in range(1, 100)]
    assert sum(steps) < 100 * len(pieces)


def test_empty_tables(spark, make_docs):
    assert suffix.remove_repeats(make_docs([])).count() == 0
    assert fmindex.remove_earlier_passages(make_docs([])).count() == 0


def test_first_copies_stay(spark, make_docs):
    texts = mixed_texts(random.Random(3))
    want = brute_bytes(texts, 200, "first")
    for hot in (2000, 1):
        got = suffix.digests(suffix.remove_repeats(make_docs(texts), hot=hot, keep="first"), "n_bytes").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_very_long_texts(spark, make_docs):
    rng = random.Random(5)
    words = rng.choices([f"w{i}" for i in range(5000)], k=400_000)
    part = " ".join(words[200_000:220_000])
    texts = [(1, " ".join(words)), (2, f"x {part} y"), (3, "ab " * 30_000)]
    got = {r.doc_id: r for r in suffix.digests(suffix.remove_repeats(make_docs(texts)), "n_bytes").collect()}
    assert got[1].n_removed == got[2].n_removed == len(part) + 2 and got[3].n_removed == 90_000
    got = {r.doc_id: r for r in suffix.digests(fmindex.remove_earlier_passages(make_docs(texts)), "n_words").collect()}
    assert [got[d].n_removed for d in (1, 2, 3)] == [0, 20_000, 0]


def test_backward_search_counts(spark):
    rng = np.random.default_rng(3)
    line = np.concatenate([np.concatenate((rng.integers(1, 6, 40), [0])) for _ in range(8)])
    fm = fmindex.FmIndex(line, 16)
    for _ in range(200):
        k = int(rng.integers(1, 9))
        pattern = rng.integers(1, 6, k)
        lo, hi = np.array([0]), np.array([len(line)])
        for x in pattern[::-1]:
            lo, hi = fm.extend(np.array([x]), lo, hi)
        assert hi[0] - lo[0] == sum((line[i : i + k] == pattern).all() for i in range(len(line) - k + 1))


def test_range_least():
    rng = np.random.default_rng(6)
    for n in (1, 5, 16, 17, 300):
        values = rng.integers(0, 50, n).astype(np.uint8)
        least = fmindex.RangeLeast(values)
        lo = rng.integers(0, n, 500)
        hi = rng.integers(lo, n) + 1
        assert (least(lo, hi) == [values[a:b].min() for a, b in zip(lo, hi, strict=True)]).all()


def test_longest_previous_factors():
    rng = np.random.default_rng(7)
    for data in (rng.integers(1, 4, 300), rng.integers(1, 3, 80), np.tile(rng.integers(1, 5, 37), 6), np.full(60, 9)):
        data = data.astype(np.uint8)
        text, depth, every = data.tobytes(), 40, np.arange(len(data))
        keys, ranks = suffix.suffix_keys(data, depth)
        order = np.argsort(keys, kind="stable")
        common = np.concatenate(([0], suffix.common_prefixes(keys, order[:-1], order[1:], ranks, depth)))

        def match(i, j, text=text):
            k = 0
            while max(i, j) + k < len(text) and k < 40 and text[i + k] == text[j + k]:
                k += 1
            return k

        for sign, others in ((1, lambda i: range(i)), (-1, lambda i, n=len(text): range(i + 1, n))):
            for least in (1, 12):
                got = np.zeros(len(data), dtype=int)
                got[order] = suffix.longest_factors(sign * order, common, least)
                want = [max((match(i, j) for j in others(i)), default=0) for i in every]
                assert got.tolist() == [k if k >= least else 0 for k in want]


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(4)
    codes = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (0, 10, 49, 50, 51, 400)] + [np.full(300, 7, dtype=np.uint64)]
    text, first, last, _, _, _ = passages.runs_of(codes, 50, 16)
    held = sorted((int(t), i) for t, a, b in zip(text, first, last, strict=True) for i in range(a, b + 1))
    assert held == [(t, i) for t, c in enumerate(codes) for i in range(len(c) - 49)]
