import itertools
import random
import re

import xxhash
from dispatchlake.llm import simhash
from dispatchlake.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in fps}


def test_masks_hide_any_three_positions():
    masks = simhash.covering_masks(list(range(64)))
    for trio in itertools.combinations(range(64), 3):
        differing = sum(1 << p for p in trio)
        assert any(not m & differing for m in masks)
    free = [p for p in range(64) if not simhash.table_mask(16 * 3 + 7) >> p & 1]
    inner = simhash.covering_masks(free)
    for trio in itertools.combinations(free, 3):
        assert any(not m & sum(1 << p for p in trio) for m in inner)
    assert max(64 - simhash.table_mask((a * 16 + b) * 16 + c).bit_count() for a in range(1, 16) for b in range(1, 16, 3) for c in range(1, 16, 4)) <= 7


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Émile", "A B"]
    rows, base = [], [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 2, 3, 5, 60, 400, 900)]
    for i in range(160):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 200_000)]
    want = {d: plain_fingerprint(t) for d, t in rows}
    roots = plain_components(want)
    for bucket in (512, 2):  # the second sends most buckets to deeper tables
        got = simhash.near_duplicates(make_docs(rows), bucket=bucket).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {d: f"{v:016x}" for d, v in want.items()}
        assert {r.doc_id: r.component_id for r in got} == roots


def test_edge_tables(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    got = simhash.near_duplicates(make_docs([(7, "same text here"), (7, "same text here"), (None, "same text here")])).collect()
    assert [r.component_id for r in got] == [7, 7, 7] and {r.copies for r in got} == {3}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "x long, y long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
