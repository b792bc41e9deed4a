"""A decision's every reason: calls and cases made so that each step of the decision is met, and what goes into queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchlake.functions import fixed
from dispatchlake.operators import admin, correlate, intervals
from dispatchlake.plans.places import _DECIDED
from dispatchlake.plans.registry import query
from dispatchlake.scratch import folder
from dispatchlake.streaming import live
from dispatchlake.views import view

C = F.col

#: what one kind of call and its case look like; kinds are dealt by event_id % len(KINDS). Without `case` there is none.
#: feed, busy: the call's; type, case_type; street, number: shared with the case; km: the case lies so far north;
#: unit, clears: the call names, or clears, the case's unit; two: the case has a second unit
BASE = {"feed": "wayneco_dearborn", "type": "MEDICAL", "case_type": "MEDICAL", "said": True, "number": False, "street": False, "km": 9.0, "unit": False, "clears": False, "two": False, "incident": True, "confidence": "HIGH", "answer": None, "case": True, "case_feed": None}
BUSY = "wayneco_downriver"
KINDS = [BASE | k for k in (
    {"incident": False}, {"said": False, "confidence": "FAILED", "type": "THEFT"}, {"said": False, "feed": BUSY}, {"clears": True, "km": 1.0}, {"clears": True, "two": True, "km": 1.0}, {"case": False},
    {"number": True, "street": True, "km": 0.1}, {"number": True, "street": True, "km": 0.1, "answer": "veto"}, {"unit": True, "case_type": "STRUCTURE_FIRE", "km": 1.0}, {"street": True, "km": 0.3, "answer": "Retry, please"},
    {"street": True, "km": 0.3, "number": True}, {"street": True, "km": 3.0, "case_type": "UNKNOWN", "case_feed": "elsewhere"}, {"km": 0.3}, {"number": True, "km": 0.1, "answer": "MATCH:@"}, {"number": True, "km": 0.1, "answer": "match"},
    {"feed": BUSY, "unit": True}, {"feed": BUSY, "unit": True, "second": True}, {"said": False}, {"km": 0.3, "answer": "MATCH 0"}, {"street": True, "number": True, "km": 0.3, "answer": "NEW"},
)]
_AGENCY = {"wayneco_dearborn": "DBN", BUSY: "DNR"}


def _each(of) -> str:
    """SQL: a value by the kind of call."""
    said = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}e0"
    return "CASE event_id % " + str(len(KINDS)) + " " + " ".join(f"WHEN {i} THEN {said(of(k))}" for i, k in enumerate(KINDS)) + " END"


def _place(offset: str) -> str:
    return f"30.0e0 + (event_id % 97) * 0.25e0 + {offset} / 111.19e0 AS lat, -120.0e0 + (event_id % 101) * 0.3e0 AS lng"


_SOME = "event_type IN ('signup', 'error')"
_FEED = _each(lambda k: k["feed"])
_OWN = f"concat({_each(lambda k: _AGENCY[k['feed']])}, ':E-', CAST(event_id AS STRING))"
_CALL = f"""SELECT event_id AS chunk_id, ts, {_FEED} AS feed, {_each(lambda k: k['feed'] == BUSY)} AS busy, {_each(lambda k: k['type'])} AS kind,
 CASE WHEN {_each(lambda k: k['said'])} THEN concat(CAST(event_id + 1000 AS STRING), ' Street', CAST(event_id AS STRING), ' Road') ELSE 'NO_LOCATION' END AS address, {_place('0.0e0')}, CASE WHEN {_each(lambda k: k['unit'] or k['clears'])} THEN {_OWN} END AS unit, {_each(lambda k: k['clears'])} AS clears, {_each(lambda k: k['unit'])} AS names,
 {_each(lambda k: k['incident'])} AS has_incident, {_each(lambda k: k['confidence'])} AS confidence, false AS inferred, replace({_each(lambda k: k['answer'])}, '@', CAST(event_id AS STRING)) AS answer FROM {{}} WHERE {_SOME}"""
#: a case's own call is a minute younger; the second case of a kind is of another feed and type, nearer
_CASE = f"""SELECT event_id AS incident_id, ts - INTERVAL '1' MINUTE AS opened_at, ts - INTERVAL '1' MINUTE AS last_updated, coalesce({_each(lambda k: k['case_feed'])}, {_FEED}) AS feed, {_each(lambda k: k['case_type'])} AS kind,
 concat(CAST(event_id + CASE WHEN {_each(lambda k: k['number'])} THEN 1000 ELSE 5000000 END AS STRING), ' ', CASE WHEN {_each(lambda k: k['street'])} THEN 'Street' ELSE 'Lake' END, CAST(event_id AS STRING), ' Road') AS address, {_place(_each(lambda k: k['km']))}, {_OWN} AS unit, {_each(lambda k: k['two'])} AS two FROM {{0}} WHERE {_SOME} AND {_each(lambda k: k['case'])}
UNION ALL SELECT event_id + 9000000, ts - INTERVAL '1' MINUTE, ts - INTERVAL '1' MINUTE, 'elsewhere', 'UNKNOWN', concat('7 Hill', CAST(event_id AS STRING), ' Road'), {_place('0.3e0')}, 'UNK:E-7', false FROM {{0}} WHERE {_SOME} AND {_each(lambda k: k.get('second', False))}"""


def _calls_and_cases(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    none = F.array().cast("array<string>")
    calls = spark.sql(_CALL.format("{e}"), e=events).select(
        "chunk_id", C("feed").alias("feed_id"), "ts", C("kind").alias("incident_type"), "address", "lat", "lng", F.when(C("names"), F.array("unit")).otherwise(none).alias("units"), F.when(C("clears"), F.array("unit")).otherwise(none).alias("units_cleared"),
        "has_incident", "confidence", "answer",
    )
    second = F.regexp_replace("unit", ":E-", ":L-")
    cases = spark.sql(_CASE.format("{e}"), e=events).select("incident_id", C("feed").alias("i_feed"), "opened_at", "last_updated", C("kind").alias("i_type"), C("address").alias("i_address"), C("lat").alias("i_lat"), C("lng").alias("i_lng"), F.when(C("two"), F.array("unit", second)).otherwise(F.array("unit")).alias("i_units"))
    return calls, cases


_REASONS = f"""c AS ({_CALL.format('events')}), i AS ({_CASE.format('events')}), {_DECIDED},
w AS (SELECT chunk_id, incident_id, score, agrees, fits, row_number() OVER (PARTITION BY chunk_id ORDER BY confirmed DESC, score DESC, opened_at, incident_id) AS n FROM f WHERE worth),
m AS (SELECT w.*, trim(regexp_extract(upper(c.answer), '^MATCH:?\\s*(.*)$', 1)) AS part FROM w JOIN c ON w.chunk_id = c.chunk_id WHERE n <= 4 AND starts_with(upper(c.answer), 'MATCH')),
x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY part <> '' AND contains(CAST(incident_id AS STRING), part) DESC, n) = 1),
r AS (SELECT c.chunk_id, feed, ts, t.incident_id AS ti, j.incident_id AS ji, x.incident_id AS xi, t.score, CASE WHEN NOT has_incident THEN 'no incident' WHEN c.address = 'NO_LOCATION' AND ((confidence = 'FAILED' AND NOT names) OR c.busy) THEN 'noisy' WHEN t.confirmed AND c.clears THEN CASE WHEN t.two THEN 'units left' ELSE 'units cleared' END
 WHEN t.chunk_id IS NULL THEN 'no match' WHEN t.score >= 0.85 AND starts_with(upper(answer), 'VETO') THEN 'vetoed' WHEN t.score >= 0.85 THEN 'strong match' WHEN j.chunk_id IS NULL THEN 'none to judge' WHEN starts_with(upper(answer), 'RETRY') THEN 'retry' WHEN x.score >= 0.5 THEN 'judged a match' WHEN x.chunk_id IS NOT NULL THEN 'match too weak' WHEN answer IS NOT NULL THEN 'judged new'
 WHEN j.agrees AND j.fits AND j.score >= 0.5 THEN 'judged a match' WHEN j.agrees THEN 'match too weak' ELSE 'judged new' END AS reason FROM c LEFT JOIN t ON c.chunk_id = t.chunk_id LEFT JOIN j ON c.chunk_id = j.chunk_id LEFT JOIN x ON c.chunk_id = x.chunk_id),
a AS (SELECT *, CASE WHEN reason IN ('no incident', 'noisy', 'retry') THEN 'UNASSOCIATED' WHEN reason = 'units cleared' THEN 'RESOLVE' WHEN reason IN ('units left', 'strong match', 'judged a match') THEN 'UPDATE' ELSE 'NEW' END AS action FROM r)"""


@query(f"""WITH {_REASONS} SELECT chunk_id, CAST(chunk_id % {len(KINDS)} AS INTEGER) AS kind, action, CASE WHEN reason = 'judged a match' THEN coalesce(xi, ji) WHEN action IN ('UPDATE', 'RESOLVE') THEN ti END AS incident_id, coalesce(score, 0.0) AS score, reason FROM a""")
def q_decision_reasons(spark, d):
    """Decisions on calls that meet each reason: boosts, vetoes, judges' answers and cleared units."""
    decided = correlate.decide(*_calls_and_cases(spark, d))
    return decided.select("chunk_id", (C("chunk_id") % len(KINDS)).cast("int").alias("kind"), "action", "incident_id", "score", "reason")


@query(f"""WITH {_REASONS} SELECT CASE reason WHEN 'retry' THEN 'retry' ELSE 'unassociated' END AS queue, feed AS feed_id, chunk_id, ts AS "at", CASE reason WHEN 'retry' THEN 'retry' ELSE 'noisy_chunk' END AS reason, CASE reason WHEN 'retry' THEN chunk_id % 3 END AS attempt FROM a WHERE reason IN ('noisy', 'retry')
QUALIFY reason = 'noisy' OR row_number() OVER (PARTITION BY reason, feed ORDER BY ts DESC, chunk_id DESC) <= 10""")
def q_decision_queues(spark, d):
    """What decisions put into the queues of noisy chunks and of retries."""
    calls, cases = _calls_and_cases(spark, d)
    told = calls.withColumns({"transcript": C("address"), "attempt": (C("chunk_id") % 3).cast("int")})
    return correlate.queue_rows(correlate.decide(calls, cases), told).withColumn("attempt", C("attempt").cast("long")).drop("transcript")


@query("""WITH d AS (SELECT DISTINCT date_trunc('hour', CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 24) * INTERVAL '1' HOUR AS at_hour FROM orders)
SELECT at_hour AS "at", count(*) AS alive, min(incident_id) AS first_id, count(DISTINCT incident_type) AS kinds FROM d JOIN v_incidents ON at_hour BETWEEN opened_at AND last_updated GROUP BY at_hour""")
def q_alive_at(spark, d):
    """Incidents alive at given hours: the join of times with spans over nodes of a tree."""
    hours = spark.sql("SELECT DISTINCT date_trunc('hour', CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 24) * INTERVAL '1' HOUR AS at FROM {o}", o=spark.read.parquet(f"{d}/orders.parquet"))
    spans = view(spark, d, "v_incidents").select("incident_id", "incident_type", C("opened_at").cast("timestamp").alias("since"), C("last_updated").cast("timestamp").alias("until"))
    alive = intervals.interval_join(hours.withColumn("at", C("at").cast("timestamp")), spans, seconds=3600)
    return alive.groupBy("at").agg(F.count(F.lit(1)).alias("alive"), F.min("incident_id").alias("first_id"), F.countDistinct("incident_type").alias("kinds")).withColumn("at", C("at").cast("timestamp_ntz"))


_APPLIED = f"""WITH {_REASONS}, k AS (SELECT CASE WHEN reason = 'judged a match' THEN coalesce(xi, ji) WHEN action IN ('UPDATE', 'RESOLVE') THEN ti END AS incident_id, count(*) AS n, max(action) AS action, max(a.ts) AS ts, list(c.unit) FILTER (c.names) AS added, list(c.unit) FILTER (c.clears) AS cleared FROM a JOIN c ON a.chunk_id = c.chunk_id WHERE action IN ('UPDATE', 'RESOLVE') GROUP BY 1),
o AS (SELECT i.*, k.n, k.action, k.ts, list_filter(list_distinct(list_concat(CASE WHEN two THEN [unit, replace(unit, ':E-', ':L-')] ELSE [unit] END, coalesce(added, []))), lambda u: NOT list_contains(coalesce(cleared, []), u)) AS held FROM i LEFT JOIN k ON i.incident_id = k.incident_id)
SELECT CAST(incident_id AS STRING) AS incident_id, feed AS feed_id, CASE WHEN action = 'RESOLVE' THEN 'RESOLVED' ELSE 'ACTIVE' END AS status, coalesce(ts, last_updated) AS last_updated, CASE WHEN action = 'RESOLVE' THEN ts END AS resolved_at, array_to_string(list_sort(held), ',') AS units, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks FROM o
UNION ALL SELECT md5('incident|' || CAST(a.chunk_id AS STRING)), a.feed, 'ACTIVE', a.ts, NULL, CASE WHEN names THEN unit ELSE '' END, 1 FROM a JOIN c ON a.chunk_id = c.chunk_id WHERE action = 'NEW'"""


def _open_incidents(spark, d):
    """Chunks and the incidents that they meet, with text ids."""
    calls, cases = _calls_and_cases(spark, d)
    cases = cases.withColumn("incident_id", C("incident_id").cast("string"))
    calls = calls.withColumn("ts", C("ts").cast("timestamp"))
    none = F.array().cast("array<string>")
    incidents = cases.select(
        "incident_id", C("i_feed").alias("feed_id"), F.lit("ACTIVE").alias("status"), C("opened_at").cast("timestamp").alias("opened_at"), C("last_updated").cast("timestamp").alias("last_updated"), F.lit(None).cast("timestamp").alias("resolved_at"), C("i_type").alias("incident_type"), F.lit("UNKNOWN").alias("priority"),
        C("i_address").alias("address"), C("i_lat").alias("lat"), C("i_lng").alias("lng"), F.lit(False).alias("is_location_inferred"), C("i_units").alias("units"), none.alias("units_cleared"), F.lit("").alias("summary"), F.array().cast("array<bigint>").alias("chunk_ids"),
    )
    return calls, cases, incidents


def _after(rows):
    ntz = [C(c).cast("timestamp_ntz").alias(c) for c in ("last_updated", "resolved_at")]
    return rows.select("incident_id", "feed_id", "status", *ntz, F.array_join("units", ",").alias("units"), F.size("chunk_ids").alias("n_chunks"))


@query(_APPLIED)
def q_decisions_applied(spark, d):
    """Incidents after a batch: decided against text ids, created, folded in and resolved."""
    calls, cases, incidents = _open_incidents(spark, d)
    return _after(admin.applied(incidents, calls, correlate.decide(calls, cases)))


@query(_APPLIED)
def q_stream_decisions(spark, d):
    """The same incidents when the chunks come as a stream, in one batch."""
    calls, _, incidents = _open_incidents(spark, d)
    path = folder(spark, "live")
    calls.write.parquet(f"{path}/chunks")
    job = live.LiveIncidents(incidents, path, idle_s=None)
    job.run(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{path}/chunks"), availableNow=True).awaitTermination()
    return _after(job.now())
