"""Decisions that are applied are made once, however many changes follow from them."""

from datetime import datetime

from pyspark.sql import functions as F

from dispatchlake.operators import admin

KEPT = "incident_id string, feed_id string, status string, opened_at timestamp, last_updated timestamp, resolved_at timestamp, incident_type string, priority string, address string, lat double, lng double, is_location_inferred boolean, units array<string>, units_cleared array<string>, summary string, chunk_ids array<bigint>"


def test_each_decision_is_made_once(spark):
    at, made = datetime(2024, 1, 2), spark.sparkContext.accumulator(0)

    def decide(chunk):
        made.add(1)
        return ["NEW", "UPDATE", "RESOLVE"][chunk % 3]

    first = spark.createDataFrame([(str(i), "elsewhere", "ACTIVE", at, at, None, "MEDICAL", "UNKNOWN", "9 Elm Street", 42.0, -83.0, False, ["E-1"], [], "", []) for i in range(30)], KEPT)
    chunks = spark.createDataFrame([(i, "elsewhere", at, "MEDICAL", "9 Elm Street", 42.0, -83.0, ["E-2"], []) for i in range(30)], "chunk_id long, feed_id string, ts timestamp, incident_type string, address string, lat double, lng double, units array<string>, units_cleared array<string>")
    decided = chunks.select("chunk_id", F.udf(decide)("chunk_id").alias("action"), F.col("chunk_id").cast("string").alias("incident_id"))
    got = admin.applied(first, chunks, decided).collect()
    assert len(got) == 40 and sum(r.status == "RESOLVED" for r in got) == 10 and sum(len(r.units) == 2 for r in got) == 20
    assert made.value == 30
