"""Windows by stretches against windows over whole keys, and how evenly one hot key is dealt."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchlake.operators import relational, stretches


@pytest.fixture(scope="module")
def rows(spark):
    rng, zero = random.Random(4), datetime(2024, 1, 1)
    made = [(i, rng.choice(["a", "a", "a", "b", None]), zero + timedelta(seconds=rng.randrange(500_000)), rng.random() < 0.7, f"said {i} by me") for i in range(1500)]
    made += [(2000 + i, "c", zero + timedelta(days=i), True, None) for i in range(40)] + [(3000, "a", None, True, "when"), (3001, "d", zero, None, "x")]
    return spark.createDataFrame(made, "i long, k string, ts timestamp, bad boolean, said string").cache()


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("width", [600, 86_400, 10**9])
def test_against_windows_over_whole_keys(rows, width):
    order = Window.partitionBy("k").orderBy("ts", "i")
    cut = stretches.cut_up(rows, "ts", width)
    same(stretches.before(cut, "k", ["ts", "i"], ["i", "said"]).select("i", "_before.said"), rows.withColumn("said", F.lag("said").over(order)))
    same(stretches.running_sum(cut, "k", ["ts", "i"], F.col("i"), "sum").select("i", "sum"), rows.withColumn("sum", F.sum("i").over(order)))
    groups = rows.withColumn("hit", F.coalesce("bad", F.lit(False))).withColumn("g", F.sum((~F.col("hit")).cast("long")).over(order))
    runs = groups.withColumn("run", F.sum(F.col("hit").cast("long")).over(Window.partitionBy("k", "g").orderBy("ts", "i")))
    same(stretches.run_lengths(cut, "k", ["ts", "i"], F.col("bad"), "run").select("i", "run"), runs)


def test_sessions_and_numbers(spark, rows):
    order = Window.partitionBy("k").orderBy("ts", "i")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    want = rows.withColumn("session", F.sum(F.when(gap < 900_000_000, 0).otherwise(1)).over(order))
    same(relational.sessions(rows, "k", "ts", 900, "i", 3600).select("i", "session"), want)
    turns = spark.range(5000).selectExpr("id % 3 as k", "id as n", "concat('w', id, ' x') as said")
    tails = {r.n: r.tail for r in relational.context_tail(turns, "k", "n", "said", words=1, width=64).collect()}
    assert len(tails) == 5000 and all(t == ("x" if n > 2 else None) for n, t in tails.items())


def test_one_hot_key_is_dealt_evenly(spark):
    hot = spark.range(200_000).selectExpr("'hot' as k", "timestamp_seconds(id * 60) as ts", "id % 5 > 0 as bad")
    done = relational.failure_backoff(hot, "k", "ts", F.col("bad"), width=36_000)
    sizes = sorted(r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert done.where("run > 4 or run < 0").count() == 0
