"""Counts of training examples where shares meet whole numbers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import text
from dispatchlake.operators import curate
from dispatchlake.plans.registry import ORACLE, QUERIES
from dispatchlake.plans import curation  # noqa: F401


@pytest.mark.parametrize("name, many", [("q_oversample", 39), ("q_oversample", 78), ("q_oversample", 3531), ("q_cap_majority", 39)])
def test_shares_of_whole_numbers(spark, tmp_path, name, many):
    labels = spark.range(many + 5).selectExpr("id AS doc_id", "CAST(0 AS INT) AS quality", "CAST(id < 5 AS INT) AS toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    want = sorted(tuple(map(int, r)) for r in duck.execute(ORACLE[name]).fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_each_pair_of_streets_is_compared_once(spark, monkeypatch):
    same = [("17 Fenkell Street", "17 Fenkel Street, Detroit, MI")] * 200
    odd = [(None, "5 Oak"), ("5 Oak", None), (None, None), ("NO_LOCATION", "5 Oak"), ("NO_LOCATION", "NO_LOCATION"), ("5 Oak", "6 Oak"), ("Oak Road", "6 Oak Road"), ("", ""), ("Elm", "Willow")]
    rows = spark.createDataFrame(same + odd, "said string, label string")
    said, label = F.col("said"), F.col("label")
    got = curate.with_street_match(rows, said, label, "match")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, rows.withColumn("match", text.street_match(said, label)).collect()))
    monkeypatch.setattr(text, "similar", lambda a, b: F.rand() < 0.5)
    told = curate.with_street_match(rows, said, label, "match").where("said like '17%'")
    assert told.count() == 200 and told.select("match").distinct().count() == 1
    share = [curate.accuracy(rows.where("said like '17%'"), said, label).first().street for _ in range(2)]
    assert set(share) <= {0.0, 1.0}
