"""Queries on incidents, chunks, units and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchlake.operators import admin, curate
from dispatchlake.operators import relational as rel
from dispatchlake.plans.registry import query
from dispatchlake.scratch import folder
from dispatchlake.sources import feeds, sinks
from dispatchlake.views import EVENTS_AS_OF, ORDERS_AS_OF, table, view

C = F.col


def _newest():
    return [C("opened_at").desc(), C("incident_id")]


@query("""SELECT i.incident_id, feed_id, county, priority, incident_type, opened_at, last_updated, coalesce(n, 0) AS chunk_count FROM v_incidents i
LEFT JOIN (SELECT incident_id, count(*) AS n FROM v_chunks GROUP BY 1) c ON i.incident_id = c.incident_id WHERE status = 'ACTIVE'""")
def q_active_incidents_with_chunk_count(spark, d):
    active = rel.where_equal(view(spark, d, "v_incidents"), status="active")
    return rel.with_chunk_counts(active, view(spark, d, "v_chunks")).drop("status").orderBy(*_newest())


@query("SELECT incident_id, feed_id, priority, opened_at FROM v_incidents WHERE status = 'ACTIVE' AND county = 'wayne' ORDER BY opened_at DESC, incident_id LIMIT 50 OFFSET 50")
def q_incident_page(spark, d):
    rows = rel.where_equal(view(spark, d, "v_incidents"), status="active", county="Wayne")
    return rel.page(rows, *_newest(), offset=50).select("incident_id", "feed_id", "priority", "opened_at")


@query("""SELECT incident_id, ts, l_partkey, l_suppkey, l_linenumber, rn FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM v_chunks) WHERE rn <= 3""")
def q_incident_timeline(spark, d):
    rows = rel.latest(view(spark, d, "v_chunks"), ["incident_id"], [C("ts").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 3, rank="rn")
    return rows.select("incident_id", "ts", "l_partkey", "l_suppkey", "l_linenumber", C("rn").cast("long").alias("rn"))


@query("SELECT incident_id, status, opened_at FROM v_incidents WHERE feed_id = 'feed_3' ORDER BY opened_at DESC, incident_id LIMIT 20")
def q_recent_by_feed(spark, d):
    return rel.page(rel.where_equal(view(spark, d, "v_incidents"), feed_id="feed_3"), *_newest(), limit=20).select("incident_id", "status", "opened_at")


@query("SELECT incident_id, status, incident_type FROM v_incidents WHERE incident_id = 7")
def q_incident_by_id(spark, d):
    return view(spark, d, "v_incidents").where(C("incident_id") == 7).select("incident_id", "status", "incident_type")


@query(f"SELECT incident_type, count(*) AS n FROM v_incidents WHERE opened_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL '24' HOUR GROUP BY 1")
def q_stats_by_type_24h(spark, d):
    return rel.counted(rel.since(view(spark, d, "v_incidents"), "opened_at", ORDERS_AS_OF, "'24' HOUR"), "incident_type").orderBy(C("n").desc())


@query("SELECT county, count(*) AS n FROM v_incidents WHERE status = 'ACTIVE' GROUP BY 1")
def q_stats_by_county(spark, d):
    return rel.counted(view(spark, d, "v_incidents").where("status = 'ACTIVE'"), "county").orderBy(C("n").desc())


@query(f"""SELECT 'active' AS section, 'all' AS key, count(*) AS n FROM v_incidents WHERE status = 'ACTIVE'
UNION ALL SELECT 'last_month', 'all', count(*) FROM v_incidents WHERE opened_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL '30' DAY
UNION ALL SELECT 'type', incident_type, count(*) FROM v_incidents WHERE opened_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL '30' DAY GROUP BY 2
UNION ALL SELECT 'county', county, count(*) FROM v_incidents WHERE status = 'ACTIVE' GROUP BY 2""")
def q_stats_bundle(spark, d):
    rows = view(spark, d, "v_incidents")
    recent = C("opened_at").cast("timestamp_ntz") >= F.expr(f"TIMESTAMP_NTZ '{ORDERS_AS_OF}' - INTERVAL '30' DAY")
    active = C("status") == "ACTIVE"
    cell = lambda test, section, key: F.when(test, F.struct(F.lit(section).alias("section"), key.alias("key"))).otherwise(F.lit(None).cast("struct<section: string, key: string>"))
    cells = F.array(cell(active, "active", F.lit("all")), cell(recent, "last_month", F.lit("all")), cell(recent, "type", C("incident_type")), cell(active, "county", C("county")))
    return rel.counted(rows.select(F.explode(F.array_compact(cells)).alias("c")).select("c.*"), "section", "key")  # one scan


@query("SELECT feed_id, count(*) AS n, count(*) FILTER (WHERE reviewed) AS reviewed, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE label = 'NO_LOCATION') AS no_location FROM v_text GROUP BY 1")
def q_review_stats_filter(spark, d):
    is_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return view(spark, d, "v_text").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), is_(C("reviewed")).alias("reviewed"), is_(C("toxic") == 1).alias("toxic"), is_(C("label") == "NO_LOCATION").alias("no_location"))


_queue = "SELECT chunk_id, feed_id FROM v_radio WHERE NOT reviewed AND {} ORDER BY md5(concat(CAST(chunk_id AS STRING), '7')), chunk_id LIMIT 50"


def _queued(spark, d, name):
    return curate.sampled(curate.label_queues(view(spark, d, "v_radio"))[name], "chunk_id", "7", 50).select("chunk_id", "feed_id")


@query(_queue.format("regexp_matches(raw_transcript, '[0-9]+ Mile') AND length(raw_transcript) > 20"))
def q_label_queue_mile(spark, d):
    return _queued(spark, d, "mile")


@query(_queue.format("confidence = 'MEDIUM' AND length(raw_transcript) > 20"))
def q_label_queue_medium(spark, d):
    return _queued(spark, d, "medium")


@query(_queue.format("label = 'NO_LOCATION' AND length(raw_transcript) > 20 AND length(raw_transcript) < 600"))
def q_label_queue_noloc(spark, d):
    return _queued(spark, d, "noloc")


@query(_queue.format("confidence = 'HIGH' AND length(raw_transcript) > 20"))
def q_label_queue_high(spark, d):
    return _queued(spark, d, "high")


@query("SELECT chunk_id, feed_id, ts FROM v_stream WHERE incident_id IS NULL ORDER BY ts DESC, chunk_id LIMIT 100")
def q_unassociated(spark, d):
    return view(spark, d, "v_stream").where(C("incident_id").isNull()).orderBy(C("ts").desc(), "chunk_id").limit(100).select("chunk_id", "feed_id", "ts")


@query("""WITH v AS (SELECT l_orderkey AS chunk_id, s_nationkey AS incident_id, count(DISTINCT l_suppkey) AS votes FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT chunk_id, incident_id, votes FROM v QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY votes DESC, incident_id) = 1""")
def q_unit_vote(spark, d):
    mentions = table(spark, d, "lineitem").select(C("l_orderkey").alias("chunk_id"), C("l_suppkey").alias("unit"))
    return rel.unit_votes(mentions, table(spark, d, "supplier").select(C("s_suppkey").alias("unit"), C("s_nationkey").alias("incident_id")))


@query("""WITH log AS (SELECT concat(feed_id, ':', CAST(unit AS STRING)) AS unit, CASE WHEN action = 'RESOLVE' THEN NULL ELSE incident_id END AS live, ts AS assigned_at, ts + INTERVAL '28800' SECOND AS expires_at FROM v_stream WHERE action <> 'UNASSOCIATED'),
asked AS (SELECT chunk_id, concat(feed_id, ':', CAST(unit AS STRING)) AS unit, ts FROM v_stream WHERE action = 'UNASSOCIATED')
SELECT chunk_id, a.unit, ts, CASE WHEN expires_at > ts THEN live END AS live_incident FROM asked a ASOF LEFT JOIN log l ON a.unit = l.unit AND a.ts >= l.assigned_at""")
def q_unit_asof_ttl(spark, d):
    rows = view(spark, d, "v_stream").withColumn("unit", F.concat("feed_id", F.lit(":"), C("unit").cast("string")))
    said = rows.where("action <> 'UNASSOCIATED'")
    log = said.select("unit", F.when(C("action") != "RESOLVE", C("incident_id")).alias("incident_id"), C("ts").alias("assigned_at"), F.expr("ts + INTERVAL '28800' SECOND").alias("expires_at"))
    return rel.live_assignment(rows.where("action = 'UNASSOCIATED'").select("chunk_id", "unit", "ts"), log)


@query("""WITH a AS (SELECT incident_id, feed_id, last_updated FROM v_incidents WHERE status = 'ACTIVE'), f AS (SELECT DISTINCT feed_id AS for_feed FROM a)
SELECT for_feed, incident_id, for_feed = feed_id AS same_feed, rn FROM (SELECT *, row_number() OVER (PARTITION BY for_feed, for_feed = feed_id ORDER BY last_updated DESC, incident_id) AS rn FROM a, f) WHERE rn <= CASE WHEN for_feed = feed_id THEN 20 ELSE 5 END""")
def q_context_cap(spark, d):
    active = view(spark, d, "v_incidents").where("status = 'ACTIVE'").select("incident_id", "feed_id", "last_updated")
    order = [C("last_updated").desc(), C("incident_id")]
    same = rel.latest(active, ["feed_id"], order, 20, rank="rn").select(C("feed_id").alias("for_feed"), "incident_id", F.lit(True).alias("same_feed"), "rn")
    # the newest five of other feeds are among the newest five of each feed: a handful of rows
    few = rel.latest(active, ["feed_id"], order, 5)
    feeds = few.agg(F.collect_set("feed_id").alias("feeds"))
    pairs = few.join(F.broadcast(feeds.withColumn("on", F.lit(1))), F.col("on") == F.lit(1)).select("*", F.explode("feeds").alias("for_feed")).where("for_feed <> feed_id")
    other = rel.latest(pairs, ["for_feed"], order, 5, rank="rn").select("for_feed", "incident_id", F.lit(False).alias("same_feed"), "rn")
    return same.union(other).withColumn("rn", C("rn").cast("long"))


@query("""SELECT incident_id, opened_at FROM v_incidents WHERE status = 'ACTIVE' AND incident_id NOT IN (SELECT incident_id FROM v_incidents WHERE status = 'ACTIVE' AND feed_id = 'feed_3') ORDER BY opened_at DESC, incident_id LIMIT 5""")
def q_cross_feed_anti(spark, d):
    active = view(spark, d, "v_incidents").where("status = 'ACTIVE'")
    others = rel.missing_from(active, rel.where_equal(active, feed_id="feed_3"), "incident_id")
    return others.orderBy(*_newest()).limit(5).select("incident_id", "opened_at")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, chunk_id) < INTERVAL '300' SECOND THEN 0 ELSE 1 END AS fresh FROM v_stream),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY ts, chunk_id) AS session FROM g)
SELECT entity, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started FROM s GROUP BY 1, 2""")
def q_burst_sessions(spark, d):
    return rel.sessions(view(spark, d, "v_stream"), "entity", "ts", 300, "chunk_id").groupBy("entity", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))


@query("""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), w AS (SELECT *, list_filter(string_split(before, ' '), lambda x: x <> '') AS l FROM p)
SELECT conv_id, turn, CASE WHEN before IS NOT NULL THEN array_to_string(list_slice(l, greatest(len(l) - 29, 1), len(l)), ' ') END AS tail FROM w""")
def q_context_tail(spark, d):
    return rel.context_tail(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "tail")


@query("""WITH r AS (SELECT *, sum(CASE WHEN action <> 'UNASSOCIATED' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY ts) AS g FROM v_stream),
s AS (SELECT *, sum(CASE WHEN action = 'UNASSOCIATED' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, g ORDER BY ts) AS run FROM r)
SELECT chunk_id, feed_id, CAST(run AS BIGINT) AS run, CAST(CASE WHEN run > 0 THEN least(120, 5 * 2 ** least(run - 1, 20)) ELSE 0 END AS BIGINT) AS wait_s FROM s""")
def q_failure_backoff(spark, d):
    rows = rel.failure_backoff(view(spark, d, "v_stream"), "feed_id", "ts", C("action") == "UNASSOCIATED")
    return rows.select("chunk_id", "feed_id", C("run").cast("long").alias("run"), C("wait_s").cast("long").alias("wait_s"))


@query("SELECT bucket, model_version, CAST(sum(normalize_total) AS BIGINT) AS normalize_total, CAST(sum(geocode_high) AS BIGINT) AS geocode_high FROM v_metrics GROUP BY 1, 2")
def q_hourly_metrics(spark, d):
    rows = view(spark, d, "v_metrics").groupBy("bucket", "model_version").agg(F.sum("normalize_total").alias("normalize_total"), F.sum("geocode_high").alias("geocode_high"))
    return rows.withColumn("bucket", C("bucket").cast("timestamp_ntz"))


@query("SELECT bucket, model_version, CASE WHEN sum(normalize_total) > 0 THEN round(sum(geocode_high) / sum(normalize_total), 4) ELSE 0.0 END AS high_rate FROM v_metrics GROUP BY 1, 2")
def q_metric_rates(spark, d):
    rate = F.when(C("normalize_total") > 0, F.round(C("geocode_high") / C("normalize_total"), 4)).otherwise(F.lit(0.0))
    return q_hourly_metrics(spark, d).select("bucket", "model_version", rate.alias("high_rate"))


@query(f"""SELECT event_type AS model_version, count(*) AS n, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS high_rate, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) // count(*) AS avg_ms FROM events
WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL '7' DAY GROUP BY 1""")
def q_model_rollup(spark, d):
    rows = rel.since(table(spark, d, "events"), "ts", EVENTS_AS_OF, "'7' DAY").withColumn("ms", F.floor("value"))
    return rows.groupBy(C("event_type").alias("model_version")).agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.count_if(C("value") > 50), F.count(F.lit(1))), 6).alias("high_rate"), F.expr("sum(ms) div count(ms)").alias("avg_ms"))


@query("SELECT feed_id, count(*) AS depth FROM v_stream WHERE action = 'UNASSOCIATED' GROUP BY 1 HAVING count(*) > 0")
def q_queue_depths(spark, d):
    return rel.counted(view(spark, d, "v_stream").where("action = 'UNASSOCIATED'"), "feed_id", name="depth").where("depth > 0")


@query("SELECT action, count(*) AS n, round(avg(CAST(unit AS DOUBLE)), 4) AS mean_unit FROM v_stream GROUP BY 1")
def q_log_statistics(spark, d):
    return view(spark, d, "v_stream").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C("unit").cast("double")), 4).alias("mean_unit"))


@query("SELECT feed_id, min(chunk_id) AS first_seen FROM v_stream GROUP BY 1")
def q_first_seen_feeds(spark, d):
    return view(spark, d, "v_stream").groupBy("feed_id").agg(F.min("chunk_id").alias("first_seen")).orderBy("first_seen")


@query("SELECT *, CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS priority_rank FROM (SELECT incident_id, priority, coalesce(last_updated, opened_at) AS updated FROM v_incidents WHERE status = 'ACTIVE')")
def q_sort_modes(spark, d):
    rows = rel.sort_modes(view(spark, d, "v_incidents").where("status = 'ACTIVE'"))
    return rows.orderBy("priority_rank", C("updated").desc()).select("incident_id", "priority", "updated", "priority_rank")


@query("""SELECT incident_id, status FROM v_incidents WHERE status = 'ACTIVE' UNION ALL (SELECT incident_id, status FROM v_incidents WHERE status = 'RESOLVED' ORDER BY last_updated DESC, incident_id LIMIT 3)""")
def q_active_and_resolved(spark, d):
    return rel.active_and_resolved(view(spark, d, "v_incidents")).select("incident_id", "status")


@query(f"""SELECT incident_id, CASE WHEN status = 'ACTIVE' AND epoch(TIMESTAMP '{ORDERS_AS_OF}' - last_updated) > 172800 THEN 'RESOLVED' ELSE status END AS status FROM v_incidents""")
def q_stale_resolve(spark, d):
    return admin.resolve_stale(view(spark, d, "v_incidents"), F.expr(f"TIMESTAMP_NTZ '{ORDERS_AS_OF}'")).select("incident_id", "status")


@query(f"""WITH s AS (SELECT incident_id, greatest(172800 - CAST(epoch(TIMESTAMP '{ORDERS_AS_OF}' - last_updated) AS BIGINT), 0) AS remaining FROM v_incidents WHERE status = 'ACTIVE')
SELECT incident_id, remaining // 3600 AS hours, remaining % 3600 // 60 AS minutes, round(100.0e0 * least(remaining, 172800) / 172800, 4) AS pct FROM s""")
def q_time_to_stale(spark, d):
    idle = F.unix_timestamp(F.lit(ORDERS_AS_OF).cast("timestamp")) - F.unix_timestamp(C("last_updated").cast("timestamp"))
    rows = view(spark, d, "v_incidents").where("status = 'ACTIVE'").select("incident_id", rel.time_to_stale(idle).alias("t"))
    return rows.select("incident_id", "t.hours", "t.minutes", F.round("t.pct", 4).alias("pct"))


@query("""WITH u AS (SELECT DISTINCT o_custkey % 50 AS incident_id, concat('E-', CAST(o_orderkey % 9 AS STRING)) AS unit FROM orders WHERE o_orderkey % 3 > 0), m AS (SELECT DISTINCT CASE WHEN incident_id = 7 THEN 8 ELSE incident_id END AS incident_id, unit FROM u)
SELECT incident_id, string_agg(unit, ',' ORDER BY unit) AS units, (SELECT count(*) FROM orders o WHERE CASE WHEN o.o_custkey % 50 = 7 THEN 8 ELSE o.o_custkey % 50 END = m.incident_id) AS chunks FROM m GROUP BY 1""")
def q_merge_incidents(spark, d):
    orders = table(spark, d, "orders").select((C("o_custkey") % 50).alias("incident_id"), F.when(C("o_orderkey") % 3 > 0, F.concat(F.lit("E-"), (C("o_orderkey") % 9).cast("string"))).alias("unit"))
    incidents = orders.groupBy("incident_id").agg(F.sort_array(F.collect_set("unit")).alias("units")).withColumn("units_cleared", F.array().cast("array<string>"))
    kept, chunks, _ = admin.merge(incidents, orders.select("incident_id"), orders, 7, 8)
    return kept.join(rel.counted(chunks, "incident_id", name="chunks"), "incident_id").select("incident_id", F.array_join("units", ",").alias("units"), "chunks")


@query("""SELECT i.incident_id, i.feed_id FROM v_incidents i WHERE i.incident_id NOT IN (SELECT incident_id FROM v_incidents WHERE feed_id = 'feed_5')""")
def q_delete_incidents(spark, d):
    incidents = view(spark, d, "v_incidents")
    gone = rel.where_equal(incidents, feed_id="feed_5").select("incident_id")
    return admin.delete(incidents, view(spark, d, "v_chunks"), incidents, gone)[0].select("incident_id", "feed_id")


@query("""SELECT entity, count(*) AS n_events, max_by(action, ts) AS action, max_by(incident_id, CASE WHEN incident_id IS NOT NULL THEN ts END) AS incident_id, max_by(unit, ts) AS unit FROM v_stream GROUP BY 1""")
def q_latest_state(spark, d):
    return rel.latest_state(view(spark, d, "v_stream"), "entity", "ts", "chunk_id", ["action", "incident_id", "unit"])


@query("""WITH l AS (SELECT feed_id, unit, arg_max(action, ts) AS action FROM v_stream GROUP BY 1, 2) SELECT feed_id, string_agg(CAST(unit AS STRING), ',' ORDER BY CAST(unit AS STRING)) AS units FROM l WHERE action <> 'RESOLVE' GROUP BY 1""")
def q_unit_sets(spark, d):
    u, none = F.array(C("unit").cast("string")), F.lit(None).cast("array<string>")
    rows = view(spark, d, "v_stream").select("feed_id", "ts", C("chunk_id").alias("ord"), F.when(C("action") != "RESOLVE", u).otherwise(none).alias("added"), F.when(C("action") == "RESOLVE", u).otherwise(none).alias("cleared"))
    return rel.unit_sets(rows, "feed_id").select("feed_id", F.array_join("units", ",").alias("units"))


@query("""SELECT incident_id, string_agg(CAST(chunk_id AS STRING), ',' ORDER BY ts, chunk_id) AS chunk_ids FROM (SELECT * FROM v_stream WHERE incident_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, chunk_id DESC) <= 500) GROUP BY 1""")
def q_chunk_ids(spark, d):
    return rel.capped_chunk_ids(view(spark, d, "v_stream").where("incident_id IS NOT NULL")).select("incident_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def q_ring_buffer(spark, d):
    return rel.ring_buffer(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type", "ts")


@query("SELECT chunk_id, concat_ws(' | ', strftime(ts, '%Y-%m-%d %H:%M:%S'), action, feed_id, CAST(incident_id AS STRING), CAST(unit AS STRING)) AS line FROM v_stream")
def q_log_lines(spark, d):
    line = sinks.log_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), C("action"), C("feed_id"), C("incident_id"), C("unit"))
    return view(spark, d, "v_stream").select("chunk_id", line.alias("line"))


@query("""WITH l AS (SELECT chunk_id, concat_ws(' | ', strftime(ts, '%Y-%m-%d %H:%M:%S'), action, feed_id, CAST(incident_id AS STRING), CAST(unit AS STRING)) AS line FROM v_stream), h AS (SELECT * FROM l WHERE contains(lower(line), 'resolve'))
SELECT line, least(200, (SELECT count(*) FROM h)) AS showing, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY chunk_id DESC LIMIT 200)""")
def q_log_tail(spark, d):
    path = folder(spark, "log")
    q_log_lines(spark, d).repartitionByRange(4, "chunk_id").sortWithinPartitions("chunk_id").select("line").write.text(path)
    return feeds.log_tail(spark, path, 200, "Resolve")


@query("""SELECT coalesce(n.model_version, o.model_version) AS model_version, coalesce(n.status, o.status) AS status, o.first_ts AS first_ts FROM (SELECT event_type AS model_version, 'shadow' AS status, min(ts) AS first_ts FROM events GROUP BY 1) o
FULL JOIN (SELECT DISTINCT action AS model_version, 'production' AS status FROM v_stream UNION ALL SELECT 'click', 'production') n ON o.model_version = n.model_version""")
def q_registry_upsert(spark, d):
    old = table(spark, d, "events").groupBy(C("event_type").alias("model_version")).agg(F.lit("shadow").alias("status"), F.min("ts").alias("first_ts"))
    named = view(spark, d, "v_stream").select(C("action").alias("model_version")).distinct()
    new = named.union(spark.range(1).select(F.lit("click"))).withColumn("status", F.lit("production"))
    return admin.upsert(old, new, "model_version")
