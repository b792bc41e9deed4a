"""The engine's tables over the star-schema test tables, in SQL that other engines can read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_incidents": """
SELECT o_orderkey AS incident_id, concat('feed_', CAST(o_custkey % 17 AS STRING)) AS feed_id,
 CASE o_custkey % 4 WHEN 0 THEN 'wayne' WHEN 1 THEN 'oakland' WHEN 2 THEN 'washtenaw' ELSE 'livingston' END AS county,
 CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' ELSE 'ACTIVE' END AS status,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '5' THEN 'LOW' ELSE 'UNKNOWN' END AS priority,
 CASE o_orderkey % 5 WHEN 0 THEN 'STRUCTURE_FIRE' WHEN 1 THEN 'MEDICAL' WHEN 2 THEN 'SHOOTING' WHEN 3 THEN 'WELFARE_CHECK' ELSE 'UNKNOWN' END AS incident_type,
 o_orderdate AS opened_at, o_orderdate + (o_orderkey % 72) * INTERVAL '1' HOUR AS last_updated FROM {orders}""",
    "v_chunks": "SELECT l_orderkey AS incident_id, l_partkey, l_suppkey, l_linenumber, l_shipdate AS ts, l_quantity FROM {lineitem}",
    "v_stream": """
SELECT event_id AS chunk_id, concat('feed_', CAST(user_id % 17 AS STRING)) AS feed_id, user_id AS entity, ts,
 CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'purchase' THEN 'RESOLVE' WHEN 'error' THEN 'UNASSOCIATED' ELSE 'UPDATE' END AS action,
 CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS incident_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS unit FROM {events}""",
    "v_shadow": """
SELECT concat('feed_', CAST(l_suppkey % 17 AS STRING)) AS feed_id,
 CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'FAILED' END AS base_conf,
 CASE l_linestatus WHEN 'O' THEN 'HIGH' ELSE 'LOW' END AS lora_conf, l_returnflag = 'A' AND l_linestatus = 'O' AS agreed,
 CASE WHEN l_returnflag = 'R' THEN 'NO_LOCATION' ELSE 'address' END AS base_result,
 CASE WHEN l_linestatus = 'F' THEN 'NO_LOCATION' ELSE 'address' END AS lora_result,
 CAST(l_quantity AS BIGINT) AS base_ms, CAST(l_quantity * 2 AS BIGINT) AS lora_ms FROM {lineitem}""",
    "v_addr": "SELECT c_custkey AS k, concat(CAST(c_custkey % 9000 + 100 AS STRING), ' ', c_mktsegment, ' Road, ', n_name, ', MI') AS addr FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "v_metrics": "SELECT date_trunc('hour', ts) AS bucket, event_type AS model_version, 1 AS normalize_total, CASE WHEN value > 50 THEN 1 ELSE 0 END AS geocode_high FROM {events}",
    "v_points": "SELECT c_custkey AS k, 41.9e0 + (c_custkey * 7919 % 1000) / 1000.0e0 * 1.1e0 AS lat, -84.1e0 + (c_custkey * 104729 % 1000) / 1000.0e0 * 1.6e0 AS lng FROM {customer}",
    "v_stations": "SELECT s_suppkey AS k, 41.9e0 + (s_suppkey * 7919 % 1000) / 1000.0e0 * 1.1e0 AS lat, -84.1e0 + (s_suppkey * 104729 % 1000) / 1000.0e0 * 1.6e0 AS lng FROM {supplier}",
    "v_radio": """
SELECT event_id AS chunk_id, ts, event_id % 7 AS form, user_id % 3000 + 100 AS number, event_id % 15 + 5 AS mile,
 CASE user_id % 6 WHEN 0 THEN 'wayneco_dearborn' WHEN 1 THEN 'wayneco_detroit_fire' WHEN 2 THEN 'wayneco_downriver' WHEN 3 THEN 'oaklandco_royaloak_fire' WHEN 4 THEN 'washtenaw_metro' ELSE 'elsewhere' END AS feed_id,
 CASE event_id % 7 WHEN 0 THEN 'Engine 30 respond to 14303 East Warren Avenue for a structure fire' WHEN 1 THEN concat('Medic 5 to ', CAST(event_id % 15 + 5 AS STRING), ' Mile and Woodward, unconscious female')
  WHEN 2 THEN 'Copy that, clear the channel please everyone' WHEN 3 THEN concat('Car 42 at ', CAST(user_id % 3000 + 100 AS STRING), ' Fordson Drive, shots fired') WHEN 4 THEN 'ok'
  WHEN 5 THEN 'Units check the welfare of a man near the corner of Fenkell and Livernois' ELSE 'Traffic crash at Michigan and Telegraph, two cars' END AS raw_transcript,
 CASE WHEN event_id % 7 = 2 OR event_id % 7 = 4 THEN 'NO_LOCATION' ELSE 'address' END AS label, CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'FAILED' END AS confidence, event_id % 5 = 0 AS reviewed FROM {events}""",
    "v_text": """
SELECT d.doc_id AS chunk_id, d.source AS feed_id, d.text AS raw_transcript, b.quality, b.toxic, b.doc_id IS NOT NULL AS reviewed,
 CASE WHEN b.quality = 0 THEN 'NO_LOCATION' ELSE 'address' END AS label, CASE WHEN d.doc_id % 3 = 0 THEN 'MEDIUM' WHEN d.doc_id % 3 = 1 THEN 'HIGH' ELSE 'FAILED' END AS confidence
FROM {documents} d LEFT JOIN {labels} b ON d.doc_id = b.doc_id""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark", "embeddings"]
#: the time that stands for "now" over each table
EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def with_views(sql: str) -> str:
    """SQL with the definitions of the views that it names."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql.strip()
    head = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used)
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"
