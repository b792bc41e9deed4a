"""Decisions in micro-batches: later ones see what earlier ones opened, restarts and replays count nothing twice."""

from datetime import datetime

from dispatchlake.operators import admin, correlate
from dispatchlake.streaming import live

CHUNK = "chunk_id long, feed_id string, ts timestamp, incident_type string, address string, lat double, lng double, units array<string>, units_cleared array<string>"
KEPT = "incident_id string, feed_id string, status string, opened_at timestamp, last_updated timestamp, resolved_at timestamp, incident_type string, priority string, address string, lat double, lng double, is_location_inferred boolean, units array<string>, units_cleared array<string>, summary string, chunk_ids array<bigint>"


def call(i, feed, minute, address, lat, day=2):
    return (i, feed, datetime(2024, 1, day, 12, minute), "MEDICAL", address, lat, -83.0, ["E-1"], [])


def test_batches(spark, tmp_path):
    old = [(name, "wayneco_dearborn", "ACTIVE", at, at, None, "MEDICAL", "UNKNOWN", address, 42.9, -83.9, False, [], [], "", []) for name, at, address in (("idle", datetime(2023, 12, 1), "9 Elm Street"), ("far", datetime(2024, 1, 2, 11), "8 Oak Street"))]
    first = spark.createDataFrame(old, KEPT)
    one, two = [call(1, "wayneco_dearborn", 0, "12 Main Street", 42.0), call(2, "elsewhere", 1, "77 Lake Road", 42.5)], [call(3, "elsewhere", 5, "12 Main Street", 42.0)]
    files, path = str(tmp_path / "chunks"), str(tmp_path / "live")
    seen = lambda rows: {r.incident_id: (r.status, sorted(r.chunk_ids), r.resolved_at) for r in rows.collect()}
    for rows in (one, two):  # each run is a new one, from the checkpoint
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(files)
        job = live.LiveIncidents(first, path)
        job.run(spark.readStream.schema(CHUNK).parquet(files), availableNow=True).awaitTermination()
    told = {r.chunk_id: (r.action, r.incident_id) for r in job.decisions().collect()}
    got = seen(job.now())
    names = {r.chunk_ids[0]: r.incident_id for r in job.now().collect() if r.chunk_ids}
    # the other feed's chunk goes to the incident that the first batch opened
    assert {k: v[0] for k, v in told.items()} == {1: "NEW", 2: "NEW", 3: "UPDATE"} and told[3][1] == names[1]
    assert got == {"idle": ("RESOLVED", [], datetime(2024, 1, 2, 12, 0)), "far": ("ACTIVE", [], None), names[1]: ("ACTIVE", [1, 3], None), names[2]: ("ACTIVE", [2], None)}
    second = spark.createDataFrame(two, CHUNK)
    by_hand = correlate.decide(second, job.incidents(1).withColumnsRenamed(live._SIDE))
    assert seen(admin.applied(job.incidents(1), second, by_hand)) == got
    job.take(second, 1)  # as after a failure
    assert seen(job.now()) == got and job.decisions().count() == 3
