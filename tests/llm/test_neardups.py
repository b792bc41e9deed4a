"""The near-duplicate stage against brute-force Jaccard over all pairs."""

import random

import corpus_pipeline
import numpy as np
from dispatchlake.llm import neardups

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "po") for b in ("ne", "ru", "sa") for c in ("t", "n", "x", "l")]


def plain_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def plain_firsts(rows):
    """The smallest id of each component of pairs with Jaccard >= 0.8."""
    sets = {d: plain_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += 1
                a_, b_ = top(a), top(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d for d in sets if top(d) == d}, links


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def test_stage_matches_brute_force_jaccard(spark, make_docs):
    rng = random.Random(5)
    line = rng.choices(WORDS, k=30)
    texts = []
    for i in range(60):
        base = rng.choices(WORDS, k=rng.choice([3, 5, 8, 20, 60, 200])) + (line if i % 2 else [])
        texts.append(base)
        for _ in range(rng.randrange(4)):
            base = changed(rng, base, rng.randrange(1, max(2, len(base) // 25)))
            texts.append(base)
    big = rng.choices(WORDS, k=150)
    texts += [changed(rng, big, 2) for _ in range(60)] + [big] * 10
    rng.shuffle(texts)
    rows = [(i, " ".join(w.upper() if i % 3 else w for w in t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    want, links = plain_firsts(rows)
    assert links > 200 and len(want) < len(rows) - 60
    got = corpus_pipeline.keep_first_copies(spark, make_docs(rows + rows[:3]), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert {r.doc_id: r.text for r in got} == {d: t for d, t in rows if d in want}


def test_near_copies_beyond_three_bits_go(spark, make_docs):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        base = rng.choices(WORDS, k=100)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:50], "other", *base[51:]]))]
    got = corpus_pipeline.keep_first_copies(spark, make_docs(rows), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 80, 2))


def test_empty_and_null_ids(spark, make_docs):
    assert corpus_pipeline.keep_first_copies(spark, make_docs([]), "").count() == 0
    got = corpus_pipeline.keep_first_copies(spark, make_docs([(7, "same text here"), (7, "same text here"), (None, "same text here"), (8, "other")]), "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["8", "None"]


def test_sketches_rule_out_only_pairs_that_are_apart(spark):
    """No pair at the threshold goes, whatever the sizes; those well below it go before whole sets are made."""
    rng = np.random.default_rng(9)
    rows, near, far = [], set(), set()
    for i in range(150):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        lost = int(rng.integers(0, n + 1)) if i % 2 else n // 5
        more = rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)) if i % 3 else 0, dtype=np.uint64)
        b = np.concatenate((a[lost:], more)) if lost < n or len(more) else a
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        (near if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) else far if share < 0.6 and n > 50 else set()).add((2 * i, 2 * i + 1))
        rows += [(2 * i + j, len(s), neardups.sketch(s).tolist()) for j, s in enumerate((a, b))]
    marks = spark.createDataFrame(rows, "node long, n long, cells array<long>")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(150)], "x long, y long")
    kept = set(map(tuple, neardups._not_apart(pairs, marks).collect()))
    assert len(near) > 30 and near <= kept
    assert len(far) > 20 and not far & kept


def test_copies_near_to_one_text_only_are_linked_without_all_their_pairs(spark, make_docs, monkeypatch):
    """Copies that are far from each other but near to the text between them: pairs grow with the copies, not with their square."""
    rng, pairs = random.Random(12), []
    base = [f"w{i}" for i in range(150)]
    texts = [base]
    for i in range(300):
        copy = list(base)
        for k, at in enumerate(rng.sample(range(5, 145, 10), 3)):
            copy[at] = f"own{i}x{k}"
        texts.append(copy)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    bound = neardups._not_apart
    monkeypatch.setattr(neardups, "_not_apart", lambda found, marks: pairs.append(found.count()) or bound(found, marks))
    got = corpus_pipeline.keep_first_copies(spark, make_docs(rows), "").collect()
    want, links = plain_firsts(rows)
    assert {r.doc_id for r in got} == want == {0}
    assert links >= 300 and sum(pairs) < 10 * len(rows)
