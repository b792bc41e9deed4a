"""Keyed streams against plain Python over the same events."""

from collections import Counter, defaultdict

import pandas as pd

from dispatchlake.plans.curation import q_stream_incidents, q_stream_retry
from dispatchlake.streaming import jobs, regions
from dispatchlake.views import table

DIR = "/root/testdata/sf0.001"


def by_key(spark, key):
    out = defaultdict(list)
    for r in table(spark, DIR, "events").orderBy("ts", "event_id").collect():
        out[key(r)].append((r.ts.timestamp(), r.event_id, r.event_type))
    return out


def test_retries(spark):
    want = []
    for feed, rows in by_key(spark, lambda r: f"feed_{r.user_id % 17}").items():
        queue = []
        for now, chunk, kind in rows:
            again, failed = [], kind == "error"
            for c, tries, at in queue:
                if now - at > 600 or tries >= 3:
                    want.append((feed, c, tries, "expired" if now - at > 600 else "exhausted"))
                    continue
                want.append((feed, c, tries + 1, "retried"))
                if failed:
                    again.append((c, tries + 1, at))
            queue = again + ([(chunk, 0, now)] if failed else [])
            while len(queue) > 10:
                want.append((feed, *queue.pop(0)[:2], "dropped"))
    assert sorted(tuple(r) for r in q_stream_retry(spark, DIR).collect()) == sorted(want)


def test_open_incidents(spark):
    want = []
    for region, rows in by_key(spark, lambda r: str(r.user_id % 4)).items():
        known = {}
        for now, chunk, kind in rows:
            for k in [k for k, v in known.items() if now - v[1] > 7200]:
                incident, _, n = known.pop(k)
                want.append((region, incident, chunk, "RESOLVE", n))
            if kind in known and now - known[kind][1] <= 1800:
                known[kind] = (known[kind][0], now, known[kind][2] + 1)
                want.append((region, known[kind][0], chunk, "UPDATE", known[kind][2]))
            else:
                known[kind] = (chunk, now, 1)
                want.append((region, chunk, chunk, "NEW", 1))
    assert sorted(tuple(r) for r in q_stream_incidents(spark, DIR).collect()) == sorted(want)


def test_open_incidents_go_on_from_batch_to_batch(spark, tmp_path):
    events = table(spark, DIR, "events").selectExpr("cast(user_id % 4 as string) as region", "event_id as chunk_id", "ts", "event_type as incident_type")
    want = sorted(tuple(r) for r in q_stream_incidents(spark, DIR).collect())
    cuts = ["2023-01-01", "2024-01-03 10:20:00", "2024-01-03 10:50:00", "2024-01-19", "2025-01-01"]
    one = regions.OpenIncidents(spark, str(tmp_path / "one"), idle_s=7200, join_s=1800)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + (n == 2)):  # a batch that comes again counts once
            one.take(events.where(f"ts >= '{a}' and ts < '{b}'"), n)
    assert sorted(tuple(r) for r in one.rows().collect()) == want


def test_a_region_is_dealt_to_several_tasks(spark):
    rows = spark.range(400).selectExpr("'r' as region", "'t' as incident_type", "id * 1200000000 as at", "id as chunk_id", "id as start", "1L as n", "cast(null as timestamp) as held")
    rows = rows.withColumn("stretch", regions._stretch(rows["at"]))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = regions._in_runs(rows, 1_800_000_000).selectExpr("*", "spark_partition_id() as task").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert {r.incident_id for r in told} == {0} and sorted(r.n for r in told) == list(range(1, 401))
    assert max(Counter(r.task for r in told).values()) < 200


def test_lives_end_by_themselves_in_batches_of_any_size_and_after_a_restart(spark, tmp_path):
    schema = "feed_id string, incident_type string, chunk_id long, ts timestamp"
    rows = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("concat('f', user_id % 3) as feed_id", "event_type as incident_type", "event_id as chunk_id", "cast(ts as timestamp) as ts").toPandas().sort_values("ts").reset_index(drop=True)
    rows.loc[5, "feed_id"] = "silent"  # a key that is never heard of again
    last = rows.ts.max()

    def run(name, parts, times):
        """The parts one file each; so many files before each start."""
        place = tmp_path / name
        (place / "in").mkdir(parents=True)
        cuts = [len(rows) * i // parts for i in range(parts + 1)]
        for started, n in enumerate(times):
            for i in range(sum(times[:started]), sum(times[: started + 1])):
                spark.createDataFrame(rows[cuts[i] : cuts[i + 1]], schema).coalesce(1).write.mode("append").parquet(str(place / "in"))
            stream = jobs.lives(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(place / "in")), idle_s=7200)
            writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(place / "state")).option("path", str(place / "out"))
            writer.format("parquet").outputMode("append").start().awaitTermination()
        got = spark.read.parquet(str(place / "out")).toPandas()
        return sorted(tuple(map(str, r)) for r in got.itertuples(index=False)), got

    one, frame = run("one", 1, [1])
    several, _ = run("several", 5, [2, 3])
    assert one == several
    assert ((frame.feed_id == "silent") & (frame.action == "RESOLVE")).sum() == 1
    ends = frame[frame.action == "RESOLVE"]
    assert len(ends) and (ends["at"] <= last).all() and ends.chunk_id.isna().all()
    # what isn't resolved was heard of too late for its end to have passed
    opened, ended = set(frame.incident_id), set(ends.incident_id)
    latest = frame[frame.action != "RESOLVE"].groupby("incident_id")["at"].max()
    assert all(latest[i] > last - pd.Timedelta(seconds=7200 + 600) for i in opened - ended)
