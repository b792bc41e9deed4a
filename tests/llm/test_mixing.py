import random
from collections import defaultdict

from dispatchlake.llm import mixing
from pyspark.sql import functions as F


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        all_ = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / all_ > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / all_ for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over


def test_mix(spark, make_docs):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "b", "b", "b", "b", "b", "b", "é", "Z", None, "tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "b"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 100, 400, 3000])), source))
    rows += [(3, None, "a"), (None, "x y", "b"), (rows[7][0], rows[7][1], rows[7][2]), (9000, "", "nothing")]
    docs = make_docs(rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs, block_words=32, shard_blocks=100).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert (r.first_shard is None) == (r.taken == 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water_fill(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 200, (s, taken[s], want[s])
    again = mixing.mix(docs, block_words=32, shard_blocks=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_empty(spark, make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    got = mixing.mix(make_docs([(1, None), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_shards_draw_multinomial_counts(spark):
    """Each source's counts over the shards spread as draws without replacement do, and add up to its total."""
    due = {1: 60_000, 2: 25_000, 3: 15_000, 4: 300}
    sources = spark.createDataFrame([(k, n * 8, float(n * 8)) for k, n in due.items()], "sid int, source_size long, target double")
    rows = mixing.draw_slots(sources, 8, 500, 3, 1).groupBy("sid", "shard").count().collect()
    total = sum(due.values())
    shards = -(-total // 500)
    counts = defaultdict(lambda: [0] * shards)
    for r in rows:
        counts[r.sid][r.shard] = r["count"]
    for k, n in due.items():
        assert sum(counts[k]) == n
        mean = 500 * n / total
        spread = sum((c - mean) ** 2 for c in counts[k][:-1]) / (shards - 1)
        assert 0.7 < spread / (mean * (1 - n / total)) < 1.4, (k, spread)
    assert all(sum(counts[k][s] for k in due) == min(500, total - 500 * s) for s in range(shards))


def test_every_block_is_taken_as_often_as_any_other(spark):
    sources = spark.createDataFrame([(1, 1000, 2500.0), (2, 700, 350.0)], "sid int, source_size long, target double")
    rows = mixing.draw_slots(sources, 10, 64, 3, 5).groupBy("sid", "block").count().collect()
    one = [r["count"] for r in rows if r.sid == 1]
    assert len(one) == 100 and set(one) == {2, 3} and sum(one) == 250
    assert [r["count"] for r in rows if r.sid == 2] == [1] * 35


def test_repeated_rows_split_no_bucket(spark, make_docs):
    rows = [(1, "a b c d", "s")] * 500 + [(2, "e " * 50, "s"), (3, "f " * 900, "t")]
    got = mixing.mix(make_docs(rows), block_words=8, shard_blocks=10).collect()
    assert len(got) == 502 and all(r.taken <= 3 * r["size"] for r in got)
    for s in ("s", "t"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
