"""Queries on training examples, model comparison and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchlake.functions import text
from dispatchlake.operators import curate
from dispatchlake.operators import relational as rel
from dispatchlake.plans.registry import query
from dispatchlake.scratch import folder, run_stream
from dispatchlake.streaming import jobs, regions
from dispatchlake.views import table, view

C = F.col
_RANK = "CASE {0} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_B, _L = _RANK.format("base_conf"), _RANK.format("lora_conf")
_T = f"""t AS (SELECT count(*) AS n, count(*) FILTER (WHERE agreed) AS agree, count(*) FILTER (WHERE NOT agreed) AS disagree, count(*) FILTER (WHERE NOT agreed AND {_L} > {_B}) AS lora_wins, count(*) FILTER (WHERE NOT agreed AND {_B} > {_L}) AS base_wins, count(*) FILTER (WHERE NOT agreed AND {_B} = {_L}) AS ties,
count(*) FILTER (WHERE NOT agreed AND lora_result = 'NO_LOCATION' AND base_result <> 'NO_LOCATION' AND base_conf IN ('FAILED', 'LOW')) AS base_hallucinations, count(*) FILTER (WHERE NOT agreed AND base_result = 'NO_LOCATION' AND lora_result <> 'NO_LOCATION' AND lora_conf IN ('FAILED', 'LOW')) AS lora_hallucinations,
CAST(trunc(avg(base_ms)) AS BIGINT) AS avg_base_ms, CAST(trunc(avg(lora_ms)) AS BIGINT) AS avg_lora_ms, count(*) FILTER (WHERE NOT agreed AND base_conf = 'FAILED' AND lora_conf = 'HIGH') AS saves, count(*) FILTER (WHERE base_conf = 'HIGH') AS base_high, count(*) FILTER (WHERE lora_conf = 'HIGH') AS lora_high FROM v_shadow),
u AS (SELECT *, round(agree / n, 4) AS agree_pct, round(disagree / n, 4) AS disagree_pct, round((avg_lora_ms - avg_base_ms) / avg_base_ms, 4) AS overhead_pct, saves // 3 AS prevented FROM t)"""


@query(f"WITH {_T} SELECT * FROM u")
def q_shadow_summary(spark, d):
    return curate.shadow_summary(view(spark, d, "v_shadow"))


@query(f"""WITH {_T}, g AS (SELECT n >= 500 AS gate_rows, disagree > 0 AND lora_wins > base_wins AS gate_wins, lora_hallucinations <= base_hallucinations AS gate_hallucinations, lora_high >= base_high AS gate_high, overhead_pct <= 1.5 AS gate_latency FROM u)
SELECT *, gate_rows AND gate_wins AND gate_hallucinations AND gate_high AND gate_latency AS all_pass FROM g""")
def q_shadow_gates(spark, d):
    return curate.shadow_gates(q_shadow_summary(spark, d))


@query(f"SELECT feed_id, count(*) AS total, count(*) FILTER (WHERE NOT agreed) AS disagree, count(*) FILTER (WHERE NOT agreed AND {_L} > {_B}) AS lora_wins, count(*) FILTER (WHERE NOT agreed AND {_B} > {_L}) AS base_wins FROM v_shadow GROUP BY 1")
def q_shadow_feed(spark, d):
    return curate.shadow_by_feed(view(spark, d, "v_shadow"))


@query("SELECT coalesce(base_conf, 'NONE') AS base_conf, count(*) AS n FROM v_shadow GROUP BY 1")
def q_shadow_hist(spark, d):
    return curate.histogram(view(spark, d, "v_shadow"), "base_conf")


@query("""WITH t AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn FROM labels),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM t)
SELECT tp, fp, fn, tn, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM p""")
def q_confusion_f1(spark, d):
    return curate.confusion(table(spark, d, "labels"), C("quality") == 0, C("toxic") == 1)


@query("SELECT count(*) FILTER (WHERE quality = 0) AS no_location, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS hallucinated, coalesce(round(count(*) FILTER (WHERE quality = 0 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 0), 0), 6), 0.0) AS rate FROM labels")
def q_hallucination(spark, d):
    name = lambda test: F.when(test, F.lit("NO_LOCATION")).otherwise(F.lit("address"))
    return curate.hallucination(table(spark, d, "labels"), name(C("toxic") == 0), name(C("quality") == 0))


@query("""WITH p AS (SELECT addr, CASE WHEN k % 5 = 0 THEN replace(addr, ', MI', ', x, MI') WHEN k % 3 = 0 THEN upper(addr) ELSE concat(' ', addr) END AS said, k FROM v_addr)
SELECT count(*) AS n, round(avg(CASE WHEN lower(trim(said)) = lower(trim(addr)) THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN k % 5 = 0 THEN 0.0 ELSE 1.0 END), 6) AS city, CAST(sum(k) AS BIGINT) // count(*) AS avg_ms FROM p""")
def q_eval_accuracy(spark, d):
    said = F.when(C("k") % 5 == 0, F.replace("addr", F.lit(", MI"), F.lit(", x, MI"))).when(C("k") % 3 == 0, F.upper("addr")).otherwise(F.concat(F.lit(" "), "addr"))
    return curate.accuracy(view(spark, d, "v_addr"), said, C("addr"), C("k"), street=False)


@query("""SELECT metric, base, candidate, round((candidate - base) * CASE metric WHEN 'rate' THEN -1 ELSE 1 END, 6) AS gain, round((candidate - base) * CASE metric WHEN 'rate' THEN -1 ELSE 1 END, 6) >= 0.02 AS passed FROM (
SELECT 'share' AS metric, round(avg(CAST(quality AS DOUBLE)), 6) AS base, round(avg(CAST(toxic AS DOUBLE)), 6) AS candidate FROM labels UNION ALL SELECT 'rate', round(avg(CAST(toxic AS DOUBLE)), 6), round(avg(CAST(quality AS DOUBLE)), 6) FROM labels)""")
def q_compare_models(spark, d):
    means = table(spark, d, "labels").agg(F.round(F.avg(C("quality").cast("double")), 6).alias("q"), F.round(F.avg(C("toxic").cast("double")), 6).alias("t"))
    return curate.compared(means.selectExpr("q AS share", "t AS rate"), means.selectExpr("t AS share", "q AS rate"), [("share", 1, 0.02), ("rate", -1, 0.02)])


_D = "SELECT doc_id, text, doc_id % 3 AS prio, CASE doc_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'claude' ELSE 'auto_negative' END AS origin, CASE WHEN doc_id % 4 = 0 THEN 'NO_LOCATION' ELSE 'address' END AS label, source AS feed_id FROM documents"


def _examples(spark, d):
    """Three labelled sources under each other."""
    rows = table(spark, d, "documents").withColumn("label", F.when(C("doc_id") % 4 == 0, F.lit("NO_LOCATION")).otherwise(F.lit("address")))
    parts = [rows.where(C("doc_id") % 3 == k).select("doc_id", "text", F.lit(k).alias("prio"), C("doc_id").alias("ord"), F.lit(o).alias("origin"), "label", C("source").alias("feed_id")) for k, o in enumerate(("human", "claude", "auto_negative"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH e AS ({_D}), k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY text ORDER BY prio, doc_id) = 1) SELECT doc_id, origin FROM k WHERE text NOT IN (SELECT text FROM benchmark)")
def q_dedup_union(spark, d):
    first = rel.first_of_text(_examples(spark, d).where("text is not null"))
    return rel.missing_from(first, table(spark, d, "benchmark"), "text").select("doc_id", "origin")


@query(f"WITH e AS ({_D}), t AS (SELECT count(*) AS total, count(*) FILTER (WHERE prio < 2) AS reviewed, count(*) FILTER (WHERE label = 'NO_LOCATION') AS no_location FROM e), g AS (SELECT *, round(no_location / total, 4) AS no_location_share, total >= 1000 AS gate_total, reviewed >= 300 AS gate_reviewed FROM t), h AS (SELECT *, no_location_share >= 0.15 AS gate_no_location FROM g) SELECT *, gate_total AND gate_reviewed AND gate_no_location AS all_pass FROM h")
def q_quality_gates(spark, d):
    return curate.quality_gates(_examples(spark, d))


@query("SELECT source AS feed_id, count(*) AS n, count(*) < 50 AS low FROM documents GROUP BY 1")
def q_feed_coverage(spark, d):
    return curate.coverage(_examples(spark, d))


_NTH = "row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS STRING), '42')), doc_id) - 1"


@query(f"SELECT doc_id, CASE WHEN {_NTH} < greatest(50, floor((SELECT count(*) FROM labels) * 0.1)) THEN 'eval' ELSE 'train' END AS part FROM labels")
def q_split(spark, d):
    return curate.split(table(spark, d, "labels"), "doc_id").select("doc_id", "part")


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS few, count(*) FILTER (WHERE toxic = 0) AS many FROM labels), f AS (SELECT doc_id, {_NTH} AS nth FROM labels WHERE toxic = 1)
SELECT doc_id, unnest(range(CAST(floor((greatest(few, floor(many * 0.35 / 0.65)) - nth - 1) / few) AS BIGINT) + 1)) AS copy FROM f, c UNION ALL SELECT doc_id, 0 FROM labels WHERE toxic = 0""")
def q_oversample(spark, d):
    return curate.oversampled(table(spark, d, "labels"), C("toxic") == 1, "doc_id").select("doc_id", "copy")


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 0) AS big, count(*) FILTER (WHERE toxic <> 0) AS rest FROM labels), f AS (SELECT doc_id, {_NTH} AS nth FROM labels WHERE toxic = 0)
SELECT doc_id FROM f, c WHERE nth < CASE WHEN big / (big + rest) > 0.6 THEN floor(rest * 0.4 / 0.6) ELSE big END UNION ALL SELECT doc_id FROM labels WHERE toxic <> 0""")
def q_cap_majority(spark, d):
    return curate.capped(table(spark, d, "labels"), C("toxic") == 0, "doc_id").select("doc_id")


@query("SELECT count(*) FILTER (WHERE toxic = 1 OR quality = 1) AS labelled, count(*) FILTER (WHERE (toxic = 1 OR quality = 1) AND quality = toxic) AS kept, count(*) FILTER (WHERE (toxic = 1 OR quality = 1) AND quality <> toxic) AS changed, count(*) FILTER (WHERE (toxic = 1 OR quality = 1) AND toxic = 0) AS no_location, count(*) FILTER (WHERE NOT (toxic = 1 OR quality = 1)) AS skipped, greatest(0, 500 - count(*) FILTER (WHERE toxic = 1 OR quality = 1)) AS remaining FROM labels")
def q_labelling_counts(spark, d):
    name = lambda c: F.when(C(c) == 1, F.lit("address")).otherwise(F.lit("NO_LOCATION"))
    return curate.labelling_counts(table(spark, d, "labels").select(name("quality").alias("old"), F.when((C("toxic") == 1) | (C("quality") == 1), name("toxic")).alias("new")))


@query("SELECT doc_id, text AS transcript FROM documents")
def q_chat_round_trip(spark, d):
    rows = table(spark, d, "documents").withColumn("chat", text.chat_text("Normalise the address.", C("text"), F.lit("NO_LOCATION")))
    return rows.select("doc_id", text.transcript_of(C("chat")).alias("transcript"))


def _event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1, 2")
def q_stream_hourly(spark, d):
    sums = {"n": F.lit(1).cast("long"), "high": F.when(C("value") > 50, F.lit(1)).otherwise(0).cast("long")}
    return run_stream(jobs.hourly(_event_stream(spark, d), "ts", ["event_type"], sums), "hourly", ["bucket", "event_type"])


@query("SELECT event_id, event_type FROM events")
def q_stream_dedup(spark, d):
    """Every event comes twice and is kept once."""
    twice = _event_stream(spark, d).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return run_stream(jobs.without_replays(twice, "ts", "event_id").select("event_id", "event_type"), "dedup")


@query()
def q_stream_retry(spark, d):
    rows = _event_stream(spark, d).select(C("event_id").alias("chunk_id"), F.concat(F.lit("feed_"), (C("user_id") % 17).cast("string")).alias("feed_id"), "ts", F.when(C("event_type") == "error", F.lit("UNASSOCIATED")).otherwise(F.lit("UPDATE")).alias("action"))
    return run_stream(jobs.retries(rows), "retry")


@query("""WITH e AS (SELECT user_id % 4 AS r, event_id, ts, event_type AS t FROM events), g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY r, t ORDER BY ts, event_id)) <= 1800 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY ts, event_id) AS run FROM g), m AS (SELECT *, first_value(event_id) OVER (PARTITION BY r, t, run ORDER BY ts, event_id) AS inc, row_number() OVER (PARTITION BY r, t, run ORDER BY ts, event_id) AS n FROM s),
l AS (SELECT r, t, run, min(inc) AS inc, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM m GROUP BY 1, 2, 3), x AS (SELECT *, lead(began) OVER (PARTITION BY r, t ORDER BY run) AS next FROM l), y AS (SELECT *, ended + INTERVAL '7200' SECOND AS due FROM x WHERE next IS NULL OR epoch(next) - epoch(ended) > 7200)
SELECT CAST(r AS STRING) AS region, inc AS incident_id, event_id AS chunk_id, CASE WHEN fresh = 1 THEN 'NEW' ELSE 'UPDATE' END AS action, n AS n_chunks FROM m UNION ALL SELECT CAST(y.r AS STRING), inc, e.event_id, 'RESOLVE', n FROM y ASOF JOIN e ON y.r = e.r AND y.due < e.ts""")
def q_stream_incidents(spark, d):
    rows = _event_stream(spark, d).select((C("user_id") % 4).cast("string").alias("region"), C("event_id").alias("chunk_id"), "ts", C("event_type").alias("incident_type"))
    open_ = regions.OpenIncidents(spark, folder(spark, "incidents"), idle_s=7200, join_s=1800)
    open_.run(rows, availableNow=True).awaitTermination()
    return open_.rows().withColumn("n_chunks", C("n_chunks").cast("int"))


@query("""WITH c AS (SELECT concat('feed_', CAST(user_id % 17 AS STRING)) AS feed_id, event_type AS incident_type, event_id AS chunk_id, ts FROM events),
g AS (SELECT *, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM c WINDOW w AS (PARTITION BY feed_id, incident_type ORDER BY ts, chunk_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_ms(ts) - epoch_ms(before) > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, incident_type ORDER BY ts, chunk_id) AS life FROM g),
r AS (SELECT *, first_value(chunk_id) OVER l AS incident_id, row_number() OVER l AS n FROM s WINDOW l AS (PARTITION BY feed_id, incident_type, life ORDER BY ts, chunk_id)),
e AS (SELECT feed_id, incident_type, incident_id, CAST(NULL AS BIGINT) AS chunk_id, 'RESOLVE' AS action, max(n) AS n_chunks, date_trunc('milliseconds', max(ts)) + INTERVAL '6' HOUR AS ended, max(after) AS after FROM r GROUP BY feed_id, incident_type, incident_id, life)
SELECT feed_id, incident_type, incident_id, chunk_id, CASE n WHEN 1 THEN 'NEW' ELSE 'UPDATE' END AS action, n AS n_chunks, date_trunc('milliseconds', ts) AS "at" FROM r
UNION ALL SELECT feed_id, incident_type, incident_id, chunk_id, action, n_chunks, ended FROM e WHERE (SELECT max(x.ts) FROM c x WHERE x.feed_id = e.feed_id AND x.incident_type = e.incident_type) > ended OR ended <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10' MINUTE FROM c)""")
def q_stream_lives(spark, d):
    """Incidents that end by a timer in event time, whether another chunk comes or not."""
    rows = _event_stream(spark, d).select(F.concat(F.lit("feed_"), (C("user_id") % 17).cast("string")).alias("feed_id"), C("event_type").alias("incident_type"), C("event_id").alias("chunk_id"), "ts")
    out = run_stream(jobs.lives(rows, idle_s=21_600), "lives")
    return out.withColumns({"at": F.date_trunc("millisecond", "at").cast("timestamp_ntz"), "n_chunks": C("n_chunks").cast("long")})
