import hashlib
import random

import xxhash
from dispatchlake.llm import fingerprints as fp
from pyspark.sql import functions as F


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed


def plain_sketch(text):
    words = (text or "").encode().split()
    hashes = sorted({chained(words[i : i + 5]) >> 33 for i in range(max(1, len(words) - 4) if words else 0)})
    return chained([h.to_bytes(4, "little") for h in hashes]), [h for h in hashes if h < 2**31 // 4]


def plain_likeness(a, b):
    x, y = set(a[1]), set(b[1])
    return len(x & y) / len(x | y) if x | y else float(a[0] == b[0])


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(2000)]
    rows = [(i * 7 - 30, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 50, 300, 6000])))) for i in range(60)]
    rows += [(1000, None), (1001, rows[5][1])]
    rng.shuffle(rows)
    want = {}
    ordered = sorted(rows)
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = map(plain_sketch, (t, edited, after))
        text = lambda s: f"{s[0]:016x}" + "".join(f"{x:08x}" for x in s[1])
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), plain_likeness(a, b), plain_likeness(a, c))
    docs = make_docs(rows).withColumns({c: F.lit("clash") for c in ("own", "at", "copy", "next", "part", "place", "edited")})
    for parts in (1, 7, 200, None):
        got = fp.fingerprint_edits(docs, parts).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert abs(r.near_edited - want[r.doc_id][4]) < 1e-12 and abs(r.near_next - want[r.doc_id][5]) < 1e-12


def test_estimates_are_near(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    long_ = rng.choices(words, k=9000)
    rows = [(" ".join(long_), " ".join(long_[: len(long_) // 20])), (" ".join(long_), " ".join(long_[:4500] + rng.choices(words, k=4500)))]
    df = fp.with_sketch(fp.with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    one, two = df.select(fp.containment(F.col("y"), F.col("x")).alias("c"), fp.likeness(F.col("x"), F.col("y")).alias("j"), fp.merged(F.col("x"), F.col("y")).alias("m"), "x", "y").collect()
    assert one.c == 1 and abs(two.j - 1 / 3) < 0.06 and abs(one.j - 0.05) < 0.03
    assert one.m.hashes == one.x.hashes and two.m.hashes == sorted({*two.x.hashes, *two.y.hashes})
    assert abs(len(two.x.hashes) - 9000 / 4) < 150 and abs(len(one.y.hashes) - 450 / 4) < 35


def test_texts_without_a_kept_hash(spark):
    words = [(f"word{i}",) for i in range(60)]
    df = fp.with_sketch(spark.createDataFrame(words, "t string"), "t", "s")
    bare = [r for r in df.collect() if not r.s.hashes]
    assert 30 < len(bare) < 58
    a, b = bare[0].t, bare[1].t
    pairs = spark.createDataFrame([(a, a), (a, b), ("", None), ("", a), (None, None)], "x string, y string")
    near = fp.with_sketch(fp.with_sketch(pairs, "x", "p"), "y", "q").select(fp.likeness(F.col("p"), F.col("q")).alias("n"), fp.containment(F.col("p"), F.col("q")).alias("c")).collect()
    assert [(r.n, r.c) for r in near] == [(1, 1), (0, 0), (1, 1), (0, 0), (1, 1)]


def test_very_long_text(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(rng.choices(words, k=400_000))), (2, "a b c")]
    got = {r.doc_id: r for r in fp.fingerprint_edits(make_docs(rows)).collect()}
    assert got[1].n_chars == len(rows[0][1]) and got[1].fingerprint[16:] == "".join(f"{h:08x}" for h in plain_sketch(rows[0][1])[1])


def test_odd_rows(spark, make_docs):
    assert fp.fingerprint_edits(make_docs([])).count() == 0
    got = fp.fingerprint_edits(make_docs([(1, "one two three four"), (1, "one two three four"), (None, "a b")])).collect()
    assert {(r.doc_id, r.near_next) for r in got} == {(1, 1.0), (None, None)}
    assert fp.fingerprint_edits(make_docs([(5, "abcdefgh")])).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_ids_beyond_double_precision(spark, make_docs):
    top = 2**63 - 1
    rows = [(top - i, f"text {i} " * 5) for i in range(40)] + [(-(2**63), "least")]
    texts = [t for _, t in sorted(rows)]
    for parts in (1, 8, 64):
        got = sorted(fp.fingerprint_edits(make_docs(rows), parts).collect())
        for k, r in enumerate(got):
            q, after = len(texts[k]) // 4, texts[(k + 1) % len(texts)]
            assert r.edited_sha256 == hashlib.sha256((texts[k][: len(texts[k]) - q] + after[:q]).encode()).hexdigest()
