"""Queries on feeds, layers, queues, logs, records and changes to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchlake.functions import fixed, text
from dispatchlake.operators import admin, records, spatial
from dispatchlake.operators import relational as rel
from dispatchlake.plans.registry import query
from dispatchlake.scratch import folder, run_stream
from dispatchlake.sources import feeds, layers, sinks
from dispatchlake.streaming import jobs
from dispatchlake.views import EVENTS_AS_OF, ORDERS_AS_OF, table, view

C = F.col
_EVENTS_NOW, _ORDERS_NOW = f"TIMESTAMP '{EVENTS_AS_OF}'", f"TIMESTAMP '{ORDERS_AS_OF}'"
_FEEDS = "SELECT n_nationkey AS k, concat('feed_', CAST(n_nationkey AS STRING)) AS feed_id, CASE WHEN n_nationkey % 4 = 0 THEN 'REPLACE_ME' ELSE concat('b', CAST(n_nationkey AS STRING)) END AS broadcast_id, CASE n_nationkey % 5 WHEN 0 THEN 'http://test/a' WHEN 1 THEN '' END AS test_url, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS enabled FROM {nation}"
_LISTED = f"f AS ({_FEEDS.format(nation='nation')}), l AS (SELECT *, coalesce(nullif(test_url, ''), CASE WHEN broadcast_id <> 'REPLACE_ME' THEN concat('http://cdn/', broadcast_id, '.mp3') END) AS url FROM f)"


def _now(as_of):
    return F.expr(f"TIMESTAMP_NTZ '{as_of}'")


def _listed(spark, d):
    rows = spark.sql(_FEEDS.format(nation="{nation}"), nation=table(spark, d, "nation"))
    return feeds.with_stream_url(rows, "http://cdn/%s.mp3")


@query(f"WITH {_LISTED} SELECT feed_id, url, url IS NOT NULL AS configured FROM l WHERE coalesce(enabled, true)")
def q_feed_listing(spark, d):
    return feeds.enabled_feeds(_listed(spark, d)).select("feed_id", "url", "configured")


@query(f"WITH {_LISTED}, a AS (SELECT unnest(['feed_4', 'feed_5', 'feed_99']) AS feed_id) SELECT a.feed_id, url, CASE WHEN k IS NULL THEN 'unknown feed' WHEN url IS NULL THEN 'not configured' ELSE 'configured' END AS state FROM a LEFT JOIN l ON a.feed_id = l.feed_id")
def q_feed_status(spark, d):
    one, two, three = (layers.feed_status(_listed(spark, d), f).select("feed_id", "url", "state") for f in ("feed_4", "feed_5", "feed_99"))
    return one.union(two).union(three)


@query("SELECT chunk_id, feed_id, raw_transcript AS transcript FROM v_radio")
def q_queue_round_trip(spark, d):
    """Chunks pushed to a queue and read back as a stream."""
    path, rows = folder(spark, "queue"), view(spark, d, "v_radio")
    sinks.push(rows.where("form < 3").select("chunk_id", "feed_id", C("raw_transcript").alias("transcript")), path)
    sinks.push(rows.where("form >= 3").select("chunk_id", "feed_id", C("raw_transcript").alias("transcript")), path)
    return run_stream(feeds.queued(spark, path, "chunk_id long, feed_id string, transcript string", stream=True), "pulled")


_LINE = "CASE form WHEN 4 THEN concat('{bad', CAST(chunk_id AS STRING)) ELSE concat('{\"chunk_id\": ', CAST(chunk_id AS STRING), ', \"feed_id\": \"', feed_id, '\"}') END"


@query(f"SELECT CASE WHEN form <> 4 THEN chunk_id END AS chunk_id, CASE WHEN form <> 4 THEN feed_id END AS feed_id, CASE WHEN form = 4 THEN {_LINE} END AS raw FROM v_radio")
def q_broken_lines(spark, d):
    rows = layers.queue_lines(view(spark, d, "v_radio").select(F.expr(_LINE).alias("value")), "chunk_id long, feed_id string")
    return rows.select("item.chunk_id", "item.feed_id", "raw")


@query(f"SELECT chunk_id, CASE WHEN form <> 4 THEN feed_id END AS feed_id FROM (SELECT *, {_LINE} AS body FROM v_radio)")
def q_documents(spark, d):
    rows = view(spark, d, "v_radio").select("chunk_id", F.expr(_LINE).alias("body"))
    return records.documents(rows, "body", "chunk_id long, feed_id string").select("chunk_id", "doc.feed_id")


_AREA = "SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN concat('L', CAST(s_suppkey AS STRING)) END AS label_name, concat('B', CAST(s_nationkey AS STRING)) AS battalion, CASE s_suppkey % 2 WHEN 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM {supplier}"


@query(f"WITH a AS ({_AREA.format(supplier='supplier')}) SELECT ord, coalesce(label_name, battalion) AS name, concat('Precinct ', coalesce(label_name, battalion)) AS label, CASE kind WHEN 'Polygon' THEN 1 ELSE 2 END AS n_rings, CASE kind WHEN 'Polygon' THEN 3 ELSE 4 END AS last_points FROM a")
def q_area_labels(spark, d):
    one, two = "[[[0, 0], [1, 0], [0, 1]], [[9, 9], [9, 8], [8, 8]]]", "[[[[0, 0], [1, 0], [0, 1]]], [[[2, 2], [3, 2], [3, 3], [2, 3]]]]"
    rows = spark.sql(_AREA.format(supplier="{supplier}"), supplier=table(spark, d, "supplier"))
    layer = rows.select("ord", F.create_map(F.lit("Label_Name"), "label_name", F.lit("Battalion"), "battalion").alias("properties"), "kind", F.when(C("kind") == "Polygon", F.lit(one)).otherwise(F.lit(two)).alias("coordinates"))
    return feeds.areas(layer, "Precinct ", ("Label_Name", "Battalion")).select("ord", "name", "label", F.size("rings").alias("n_rings"), F.size(F.element_at("rings", -1)).alias("last_points"))


_OFFENSES = ["HOMICIDE", "SEXUAL ASSAULT - CSC", "ROBBERY", "Aggravated Assault", "burglary", "VEHICLE THEFT", "LARCENY", "ARSON", "FRAUD"]
_OFFENSE = f"list_extract([{', '.join(repr(o) for o in _OFFENSES)}], CAST(event_id % 9 AS INT) + 1)"
_PLACE = "41.9e0 + (event_id * 7919 % 1000) / 1000.0e0 * 1.3e0 AS lat, CASE WHEN event_id % 17 = 0 THEN NULL ELSE -84.1e0 + (event_id * 104729 % 1000) / 1000.0e0 * 1.6e0 END AS lng"
_CRIME_COLOUR = " ".join(f"WHEN contains(upper(offense), '{w}') THEN '{c}'" for w, c in fixed.CRIME_COLOURS)


@query(f"""WITH c AS (SELECT event_id, {_OFFENSE} AS offense, ts, {_PLACE} FROM events)
SELECT event_id, offense, CASE {_CRIME_COLOUR} ELSE '#888888' END AS colour FROM c WHERE ts >= {_EVENTS_NOW} - INTERVAL '48' HOUR AND lng IS NOT NULL AND lat BETWEEN 42.0 AND 43.1 AND lng BETWEEN -84.1 AND -82.5 ORDER BY ts DESC, offense, lat, lng LIMIT 500""")
def q_crimes(spark, d):
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _OFFENSES)), (C("event_id") % 9).cast("int") + 1).alias("offense"), "ts", *[F.expr(x) for x in _PLACE.split(", ", 1)])
    return feeds.crimes(rows, _now(EVENTS_AS_OF)).select("event_id", "offense", "colour")


@query(f"SELECT event_id, CASE {_CRIME_COLOUR} ELSE '#888888' END AS colour FROM (SELECT event_id, {_OFFENSE} AS offense FROM events)")
def q_crime_colours(spark, d):
    offense = F.element_at(F.array(*map(F.lit, _OFFENSES)), (C("event_id") % 9).cast("int") + 1)
    return table(spark, d, "events").select("event_id", text.crime_colour(offense).alias("colour"))


_KINDS = [*fixed.TAG_CLASSES, "STRUCTURE_FIRE", "brush fire", "OTHER"]
_TAGS = {k: fixed.TAG_CLASSES.get(k, "fire" if "FIRE" in k.upper() else "unknown") for k in _KINDS}


@query(f"WITH k AS (SELECT p_partkey, list_extract([{', '.join(repr(k) for k in _KINDS)}], CAST(p_partkey % {len(_KINDS)} AS INT) + 1) AS kind FROM part) SELECT p_partkey, CASE kind {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _TAGS.items())} END AS class FROM k")
def q_tag_classes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (C("p_partkey") % len(_KINDS)).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", text.tag_class(kind).alias("class"))


@query(f"""WITH o AS (SELECT k, lat, lng FROM v_stations WHERE lat + 0.05 >= 42.0 AND lat - 0.05 <= 43.1 AND lng + 0.05 >= -84.1 AND lng - 0.05 <= -82.5 ORDER BY k LIMIT 500)
SELECT k, (SELECT count(*) FROM o) AS _count, strftime({_ORDERS_NOW}, '%Y-%m-%d %H:%M:%S') AS _fetched_at FROM o""")
def q_outages(spark, d):
    corner = lambda dx, dy: F.struct((C("lng") + dx).alias("x"), (C("lat") + dy).alias("y"))
    rows = view(spark, d, "v_stations").select(C("k").alias("ord"), F.array(F.array(corner(-0.05, -0.05), corner(0.05, -0.05), corner(0.05, 0.05))).alias("rings"))
    out = layers.outages(rows, _now(ORDERS_AS_OF))
    return out.select(C("ord").alias("k"), "_count", F.date_format("_fetched_at", "yyyy-MM-dd HH:mm:ss").alias("_fetched_at"))


_CACHE = "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'crimes' WHEN 1 THEN 'outages' ELSE concat('layer', CAST(n_nationkey AS STRING)) END AS dataset, n_nationkey AS k, CAST({now} - n_nationkey * INTERVAL '100' MINUTE AS TIMESTAMP{ntz}) AS fetched_at FROM {nation}"


@query(f"""WITH c AS ({_CACHE.format(now=_ORDERS_NOW, ntz='', nation='nation')}), f AS (SELECT *, true AS hit FROM c WHERE epoch({_ORDERS_NOW} - fetched_at) < CASE dataset WHEN 'outages' THEN 900 ELSE 86400 END)
SELECT dataset, k, hit FROM f UNION ALL SELECT dataset, k, false FROM (SELECT DISTINCT dataset, -1 AS k FROM c) s WHERE dataset NOT IN (SELECT dataset FROM f)""")
def q_cached_layers(spark, d):
    cache = spark.sql(_CACHE.format(now=f"TIMESTAMP_NTZ '{ORDERS_AS_OF}'", ntz="_NTZ", nation="{nation}"), nation=table(spark, d, "nation"))
    source = cache.select("dataset").distinct().withColumn("k", F.lit(-1))
    return layers.read_through(cache, source, _now(ORDERS_AS_OF)).select("dataset", "k", "hit")


@query("WITH a AS (SELECT unnest(['crimes', 'nothing']) AS dataset) SELECT dataset, CASE dataset WHEN 'crimes' THEN (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) ELSE 0 END AS removed, CASE dataset WHEN 'crimes' THEN 'ok' ELSE 'unknown dataset' END AS status, (SELECT count(*) FROM nation) - CASE dataset WHEN 'crimes' THEN (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) ELSE 0 END AS kept FROM a")
def q_cache_invalidate(spark, d):
    cache = spark.sql(_CACHE.format(now=f"TIMESTAMP_NTZ '{ORDERS_AS_OF}'", ntz="_NTZ", nation="{nation}"), nation=table(spark, d, "nation"))
    out = []
    for name in ("crimes", "nothing"):
        kept, said = layers.invalidated(cache, name)
        out.append(said.select(F.lit(name).alias("dataset"), "removed", "status").join(kept.agg(F.count(F.lit(1)).alias("kept")), F.lit(True)))
    return out[0].union(out[1])


@query(f"SELECT count(*) AS entries, count(*) FILTER (WHERE fetched_at + INTERVAL '1' DAY > {_ORDERS_NOW}) AS live, 1 AS ttl_days FROM ({_CACHE.format(now=_ORDERS_NOW, ntz='', nation='nation')})")
def q_cache_statistics(spark, d):
    cache = spark.sql(_CACHE.format(now=f"TIMESTAMP_NTZ '{ORDERS_AS_OF}'", ntz="_NTZ", nation="{nation}"), nation=table(spark, d, "nation"))
    return records.cache_state(cache, _now(ORDERS_AS_OF), 1)


@query("SELECT 'stations' AS layer, count(*) AS n FROM supplier UNION ALL SELECT 'precincts', count(*) FROM nation UNION ALL SELECT unnest(['battalions', 'outages']), 0")
def q_layer_frames(spark, d):
    path = folder(spark, "layers")
    point = lambda k: F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("Firehouse"), k.cast("string")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(-83.0), F.lit(42.0)).alias("coordinates")).alias("geometry"))
    ring = F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))))
    area = lambda k: F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("name"), k.cast("string")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    sinks.write_layer(table(spark, d, "supplier").select(C("s_suppkey").alias("k"), point(C("s_suppkey")).alias("f")), "k", f"{path}/stations.geojson")
    sinks.write_layer(table(spark, d, "nation").select(C("n_nationkey").alias("k"), area(C("n_nationkey")).alias("f")), "k", f"{path}/precincts.geojson")
    found = [f.agg(F.lit(n).alias("layer"), F.count(F.lit(1)).alias("n")) for n, f in layers.layer_frames(spark, path).items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT length(string_agg(r_name, ' ')) AS n FROM region")
def q_hints(spark, d):
    path = folder(spark, "hints")
    table(spark, d, "region").agg(F.concat(F.lit("\n  "), F.array_join(F.collect_list("r_name"), " "), F.lit("  "))).coalesce(1).write.text(path)
    return layers.hints(spark, path).select(F.length("hints").cast("long").alias("n"))


@query("SELECT md5(concat('incident:', lower(action), '|', CAST(chunk_id AS STRING), '|', feed_id)) AS event_uuid, concat('incident:', lower(action)) AS event, chunk_id FROM v_stream WHERE action <> 'UNASSOCIATED'")
def q_event_rows(spark, d):
    rows = view(spark, d, "v_stream")
    parts = [sinks.events(rows.where(C("action") == a), f"incident:{a.lower()}", "chunk_id", "feed_id") for a in ("NEW", "UPDATE", "RESOLVE")]
    all_ = parts[0].union(parts[1]).union(parts[2])
    return all_.select("event_uuid", "event", F.get_json_object("payload", "$.chunk_id").cast("long").alias("chunk_id"))


@query("SELECT chunk_id, concat('[', strftime(ts, '%H:%M:%S'), '] [', action, ']', CASE action WHEN 'NEW' THEN concat(' incident=', CAST(incident_id AS STRING), coalesce(concat(' | unit=', CAST(unit AS STRING)), '')) WHEN 'RESOLVE' THEN concat(' incident=', CAST(incident_id AS STRING)) WHEN 'UNASSOCIATED' THEN concat(' feed=', feed_id) ELSE '' END) AS line FROM v_stream")
def q_event_lines(spark, d):
    own = {"NEW": [("incident", C("incident_id")), ("unit", C("unit"))], "RESOLVE": [("incident", C("incident_id"))], "UNASSOCIATED": [("feed", C("feed_id"))]}
    return view(spark, d, "v_stream").select("chunk_id", sinks.event_line(F.date_format("ts", "HH:mm:ss"), C("action"), own).alias("line"))


@query("SELECT 'incidents' AS kind, count(*) AS n FROM v_stream WHERE action = 'NEW' UNION ALL SELECT concat('chunks ', action), count(*) FROM v_stream GROUP BY 1")
def q_written_rows(spark, d):
    """Incidents and chunks written batch by batch by a stream, counted from the files."""
    out = folder(spark, "written")
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rows = rows.select(C("event_id").alias("chunk_id"), "user_id", F.when(C("event_type") == "signup", "NEW").when(C("event_type") == "purchase", "RESOLVE").when(C("event_type") == "error", "UNASSOCIATED").otherwise("UPDATE").alias("action"))
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(sinks.micro_batch_writer(f"{out}/incidents", f"{out}/chunks")).start().awaitTermination()
    opened, chunks = (spark.read.parquet(f"{out}/{k}") for k in ("incidents", "chunks"))
    return opened.agg(F.lit("incidents").alias("kind"), F.count(F.lit(1)).alias("n")).union(chunks.groupBy(F.concat(F.lit("chunks "), "action")).count())


@query("SELECT event_type AS model_version, 2 * count(*) AS n, round(2 * sum(value), 2) AS total FROM events GROUP BY 1")
def q_eval_appended(spark, d):
    path, rows = folder(spark, "evals"), table(spark, d, "events").select(C("event_type").alias("model_version"), "value")
    for _ in range(2):
        sinks.write_jsonl(rows, path, "append")
    back = spark.read.schema("model_version string, value double").json(path)
    return back.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT count(*) AS n FROM events")
def q_report(spark, d):
    rows = table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.max("props").alias("sample_props"), F.min("props").alias("sample_other"))
    return sinks.report(rows)


_LOOKED = "WITH r AS (SELECT k AS chunk_id, CASE k % 4 WHEN 0 THEN 'NO_LOCATION' ELSE addr END AS base_result, CASE k % 3 WHEN 0 THEN 'NO_LOCATION' ELSE concat(addr, ', apt 4') END AS lora_result, addr FROM v_addr), g AS (SELECT addr AS a, min(k) AS m FROM v_addr WHERE k % 2 = 0 GROUP BY 1)"


@query(f"""{_LOOKED} SELECT chunk_id, 500 AS n_said, CASE WHEN base_result <> 'NO_LOCATION' THEN CASE WHEN m IS NULL THEN 'FAILED' ELSE 'HIGH' END END AS base_geo_conf, CASE WHEN lora_result <> 'NO_LOCATION' THEN CASE WHEN m IS NULL THEN 'FAILED' ELSE 'HIGH' END END AS lora_geo_conf, CASE WHEN base_result <> 'NO_LOCATION' THEN CAST(m AS DOUBLE) END AS base_lat FROM r LEFT JOIN g ON addr = a""")
def q_ab_log(spark, d):
    rows = view(spark, d, "v_addr")
    asked = rows.select(C("k").alias("chunk_id"), F.lit("f").alias("feed_id"), F.repeat(F.lit("word "), 200).alias("transcript"), F.when(C("k") % 4 == 0, F.lit(text.NO_LOCATION)).otherwise(C("addr")).alias("base_result"), F.when(C("k") % 3 == 0, F.lit(text.NO_LOCATION)).otherwise(F.concat("addr", F.lit(", apt 4"))).alias("lora_result"), F.lit(5).alias("base_ms"), F.lit(6).alias("lora_ms"))
    known = rows.where("k % 2 = 0").groupBy(text.cache_key(C("addr")).alias("key")).agg(F.min("k").cast("double").alias("lat")).withColumns({"lng": F.lit(-83.0), "confidence": F.lit("HIGH")})
    return records.ab_log(asked, known).select("chunk_id", F.length("transcript").alias("n_said"), "base_geo_conf", "lora_geo_conf", "base_lat")


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@query(f"""WITH n AS (SELECT incident_id, count(*) AS c FROM v_chunks GROUP BY 1) SELECT CAST(i.incident_id AS STRING) AS incident_id, feed_id, county, status, {_ISO.format('opened_at')} AS opened_at, {_ISO.format('last_updated')} AS last_updated, CAST(NULL AS STRING) AS resolved_at, incident_type, priority, CAST(NULL AS STRING) AS address_raw, CAST(NULL AS STRING) AS address_full, CAST(NULL AS STRING) AS city, CAST(NULL AS STRING) AS lat, CAST(NULL AS STRING) AS lng,
CASE WHEN i.incident_id % 2 = 0 THEN 'E-1' ELSE '' END AS units, '' AS units_cleared, CAST(NULL AS STRING) AS summary, CAST(NULL AS STRING) AS precinct, CAST(NULL AS STRING) AS battalion, CAST(NULL AS STRING) AS nearest_stations, coalesce(c, 0) AS chunk_count FROM v_incidents i LEFT JOIN n ON i.incident_id = n.incident_id""")
def q_incident_records(spark, d):
    rows = rel.with_chunk_counts(view(spark, d, "v_incidents"), view(spark, d, "v_chunks")).withColumn("units", F.when(C("incident_id") % 2 == 0, F.array(F.lit("E-1"))))
    out = records.projected(rows, records.INCIDENT)
    return out.withColumns({c: F.array_join(c, ",") for c in ("units", "units_cleared")})


@query(f"""SELECT CAST(chunk_id AS STRING) AS chunk_id, CAST(NULL AS STRING) AS incident_id, feed_id, {_ISO.format('ts')} AS timestamp, raw_transcript, CAST(NULL AS STRING) AS normalized_address, CAST(NULL AS STRING) AS correlation_action, CAST(NULL AS STRING) AS correlation_method, CAST(NULL AS STRING) AS correlation_confidence, CAST(NULL AS STRING) AS geocode_source, confidence AS geocode_confidence, CAST(NULL AS STRING) AS whisper_model, CAST(NULL AS STRING) AS lora_version, CAST(NULL AS STRING) AS processing_ms FROM v_radio""")
def q_chunk_records(spark, d):
    rows = view(spark, d, "v_radio").withColumnsRenamed({"ts": "timestamp", "confidence": "geocode_confidence"})
    return records.projected(rows, records.CHUNK)


@query(f"""SELECT CAST(incident_id AS STRING) AS incident_id, feed_id, county, status, {_ISO.format('opened_at')} AS opened_at, {_ISO.format('last_updated')} AS last_updated, incident_type, priority, CAST(NULL AS STRING) AS address_raw, CAST(NULL AS STRING) AS address_full, CAST(NULL AS STRING) AS city, CAST(NULL AS STRING) AS lat, CAST(NULL AS STRING) AS lng, '' AS units, '' AS units_cleared, CAST(NULL AS STRING) AS summary, 0 AS chunk_count FROM v_incidents""")
def q_shown_incidents(spark, d):
    out = records.projected(view(spark, d, "v_incidents"), records.SHOWN)
    return out.withColumns({c: F.array_join(c, ",") for c in ("units", "units_cleared")})


@query("""WITH h AS (SELECT o_orderkey AS incident_id FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey FROM orders)
SELECT 'hot' AS way, incident_id FROM v_incidents WHERE status = 'ACTIVE' AND feed_id = 'feed_3' AND incident_id % 3 = 0 UNION ALL SELECT 'table', incident_id FROM v_incidents WHERE status = 'ACTIVE' AND feed_id = 'feed_3'""")
def q_active_set(spark, d):
    incidents, keys = view(spark, d, "v_incidents"), table(spark, d, "orders")
    hot = keys.where("o_orderkey % 3 = 0").select(C("o_orderkey").alias("incident_id")).union(keys.select(-C("o_orderkey")))
    way = lambda h, n: records.active_set(h, incidents, "feed_3").select(F.lit(n).alias("way"), "incident_id")
    return way(hot, "hot").union(way(hot.limit(0), "table"))


_INC = "SELECT o_orderkey AS incident_id, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 42.0e0 END AS lat, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE -83.0e0 END AS lng, CASE o_orderkey % 5 WHEN 0 THEN 'NO_LOCATION' WHEN 1 THEN NULL ELSE 'old full' END AS address_full, CASE o_orderkey % 7 WHEN 0 THEN 'NO_LOCATION' ELSE 'old raw' END AS address_raw FROM {orders}"


@query(f"""WITH i AS ({_INC.format(orders='orders')}), j AS (SELECT *, incident_id % 2 = 0 AND incident_id % 6 <> 0 AND (lat IS NULL OR address_full IS NULL OR address_full = 'NO_LOCATION' OR address_raw = 'NO_LOCATION') AS filled FROM i)
SELECT incident_id, CASE WHEN filled THEN 42.5e0 ELSE lat END AS lat, CASE WHEN filled THEN 'new full' ELSE address_full END AS address_full, CASE WHEN filled AND address_raw = 'NO_LOCATION' THEN 'new raw' ELSE address_raw END AS address_raw, filled FROM j""")
def q_backfill(spark, d):
    incidents = spark.sql(_INC.format(orders="{orders}"), orders=table(spark, d, "orders"))
    found = incidents.where("incident_id % 2 = 0").select("incident_id", F.lit(42.5).alias("n_lat"), F.lit(-83.5).alias("n_lng"), F.lit("new full").alias("n_full"), F.lit("new raw").alias("n_raw"), F.when(C("incident_id") % 6 == 0, F.lit("FAILED")).otherwise(F.lit("HIGH")).alias("n_confidence"))
    return records.backfilled(incidents, found).select("incident_id", "lat", "address_full", "address_raw", "filled")


@query("SELECT chunk_id, CASE WHEN incident_id IS NULL AND chunk_id % 2 = 0 THEN -chunk_id ELSE incident_id END AS incident_id, incident_id IS NULL AND chunk_id % 2 = 0 AS relinked FROM v_stream")
def q_reprocess(spark, d):
    rows = view(spark, d, "v_stream").select("chunk_id", "incident_id")
    return records.reprocessed(rows, rows.where("chunk_id % 2 = 0").select("chunk_id", (-C("chunk_id")).alias("n_incident")))


@query("""WITH m AS (SELECT l_orderkey AS chunk_id, l_partkey AS incident_id, CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS km FROM lineitem)
SELECT chunk_id, incident_id, confidence, km FROM m QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, coalesce(km, 1e9), incident_id) = 1""")
def q_best_match(spark, d):
    rows = table(spark, d, "lineitem").select(C("l_orderkey").alias("chunk_id"), C("l_partkey").alias("incident_id"), F.when(C("l_returnflag") == "A", "HIGH").when(C("l_returnflag") == "N", "MEDIUM").otherwise("LOW").alias("confidence"), F.when(C("l_linenumber") % 3 > 0, C("l_quantity")).alias("km"))
    return records.best_match(rows).select("chunk_id", "incident_id", "confidence", "km")


_NEAR = """WITH p AS (SELECT k, lat, lng, CASE k % 3 WHEN 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, k % 5 AS f FROM v_points), q AS (SELECT p.k AS chunk_id, s.k AS incident_id, {km} AS km FROM p, v_stations s WHERE confidence <> 'LOW' AND {km} <= 6.0 AND ({any} OR f = s.k % 5))
SELECT {any} AS any_feed, chunk_id, incident_id, round(km, 6) AS km FROM q QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY km, incident_id) = 1"""
_KM = "(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))))"


@query(f"SELECT * FROM ({_NEAR.format(km=_KM, any='true')}) UNION ALL SELECT * FROM ({_NEAR.format(km=_KM, any='false')})")
def q_nearest_incident(spark, d):
    chunks = view(spark, d, "v_points").select(C("k").alias("chunk_id"), "lat", "lng", F.when(C("k") % 3 == 0, "LOW").otherwise("HIGH").alias("confidence"), (C("k") % 5).alias("feed_id"))
    open_ = view(spark, d, "v_stations").select(C("k").alias("incident_id"), C("lat").alias("r_lat"), C("lng").alias("r_lng"), (C("k") % 5).alias("i_feed"))
    one, two = (records.nearest_incident(chunks, open_, 6.0, same).select(F.lit(not same).alias("any_feed"), "chunk_id", "incident_id", F.round("km", 6).alias("km")) for same in (False, True))
    return one.union(two)


@query("SELECT event_type AS model_version, min(ts) AS created_at FROM events GROUP BY 1")
def q_registry_listing(spark, d):
    return records.registry_listing(table(spark, d, "events").groupBy(C("event_type").alias("model_version")).agg(F.min("ts").alias("created_at")))


@query(f"""WITH r AS (SELECT event_type AS model_version, CASE event_type WHEN 'click' THEN 'production' WHEN 'view' THEN 'retired' ELSE 'shadow' END AS status FROM (SELECT DISTINCT event_type FROM events))
SELECT model_version, CASE model_version WHEN 'error' THEN 'production' WHEN 'click' THEN 'retired' ELSE status END AS status, model_version = 'error' AS deployed, model_version = 'click' AS retired FROM r""")
def q_promote_model(spark, d):
    rows = table(spark, d, "events").select(C("event_type").alias("model_version")).distinct()
    none = F.lit(None).cast("timestamp_ntz")
    rows = rows.withColumns({"status": F.when(C("model_version") == "click", "production").when(C("model_version") == "view", "retired").otherwise("shadow"), "deployed_at": none, "retired_at": none})
    return admin.promote(rows, "error", _now(EVENTS_AS_OF)).select("model_version", "status", C("deployed_at").isNotNull().alias("deployed"), C("retired_at").isNotNull().alias("retired"))


@query("SELECT count(*) FILTER (WHERE feed_id = 'feed_5') AS deleted, count(*) FILTER (WHERE incident_id % 7 = 0 AND feed_id <> 'feed_5' AND status <> 'RESOLVED') AS changed, 1 AS added FROM v_incidents")
def q_affected_rows(spark, d):
    before = view(spark, d, "v_incidents").select("incident_id", "feed_id", "status")
    after = before.where("feed_id <> 'feed_5'").withColumn("status", F.when(C("incident_id") % 7 == 0, "RESOLVED").otherwise(C("status")))
    return records.affected(before, after.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("feed_0"), F.lit("ACTIVE"))), "incident_id")


@query("SELECT o_orderkey AS k, round((o_orderkey % 40 + o_orderkey % 25) / (100.0 + o_orderkey % 60), 6) AS ratio FROM orders WHERE o_orderkey % 9 > 0 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 9 = 0")
def q_speech_ratio(spark, d):
    k = C("o_orderkey")
    part = lambda a, n: F.struct(F.lit(a).cast("long").alias("start"), (F.lit(a) + n).cast("long").alias("stop"))
    rows = table(spark, d, "orders").select(k.alias("k"), F.array(part(0, k % 40), part(50, k % 25)).alias("s"), F.when(k % 9 == 0, F.lit(0)).otherwise(F.lit(100) + k % 60).cast("long").alias("n"))
    return rows.select("k", F.round(records.speech_ratio(C("s"), C("n")), 6).alias("ratio"))


@query("""WITH g AS (SELECT o_orderkey AS k, o_orderkey % 20 AS p, o_orderkey % 2 AS odd FROM orders),
gaps AS (SELECT k, greatest(p, 21.0) AS stop, (greatest(p, 21.0) + p + 2.0) / 2 AS middle, 1 AS n FROM g WHERE p > 21 AND p + 2 < 29 UNION ALL SELECT k, 26.0, 27.0, 2 FROM g WHERE odd = 0 UNION ALL SELECT k, 20.0 + (k % 11) * 0.5, 21.0 + (k % 11) * 0.5, 3 FROM g WHERE odd = 1 AND k % 11 > 2),
best AS (SELECT * FROM gaps WHERE abs(middle - 25) < 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(middle - 25), n) = 1)
SELECT g.k, coalesce(stop, 25.0) AS at FROM g LEFT JOIN best ON g.k = best.k""")
def q_cut_point(spark, d):
    """Speech with silences of 2 s: one before the window, and around 27 s or between 21 and 27 s."""
    k = C("o_orderkey") % 20
    gap = F.lit(20.0) + (C("o_orderkey") % 11) * 0.5
    part = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("stop"))
    two = F.array(part(F.lit(0), k), part(k + 2, F.lit(26)), part(F.lit(28), F.lit(39)))
    one = F.array(part(F.lit(0), gap), part(gap + 2, F.lit(39)))
    rows = table(spark, d, "orders").select(C("o_orderkey").alias("k"), F.when(C("o_orderkey") % 2 == 0, two).otherwise(one).alias("s"))
    return rows.select("k", records.cut_point(C("s"), F.lit(40.0), F.lit(25), 4.0).alias("at"))


_LOG = "SELECT concat(feed_id, ':', CAST(unit AS STRING)) AS unit, feed_id, CASE WHEN action = 'RESOLVE' THEN NULL ELSE incident_id END AS incident_id, ts FROM v_stream WHERE action <> 'UNASSOCIATED'"


@query(f"""WITH l AS ({_LOG}), m AS (SELECT upper(unit) AS unit, incident_id, ts FROM l WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY upper(unit) ORDER BY ts DESC, incident_id NULLS FIRST) = 1)
SELECT unit, incident_id FROM m WHERE incident_id IS NOT NULL AND ts + INTERVAL '28800' SECOND > TIMESTAMP '2024-01-20 00:00:00'""")
def q_current_units(spark, d):
    """Assignments and releases appended to a log, and the units assigned at one time."""
    rows = view(spark, d, "v_stream").where("action <> 'UNASSOCIATED'")
    changes = rows.select(F.concat("feed_id", F.lit(":"), C("unit").cast("string")).alias("unit"), "feed_id", F.when(C("action") != "RESOLVE", C("incident_id")).alias("incident_id"), "ts")
    log = spark.createDataFrame([], "unit string, incident_id long, assigned_at timestamp_ntz, expires_at timestamp_ntz")
    return records.current_units(records.assigned(records.assigned(log, changes.where("incident_id is not null")), changes.where("incident_id is null")), _now("2024-01-20 00:00:00"))


@query("SELECT (SELECT count(*) FROM v_stream WHERE action = 'UNASSOCIATED' AND feed_id = 'feed_2') AS cleared, (SELECT count(*) FROM v_stream WHERE action = 'UNASSOCIATED' AND feed_id <> 'feed_2') AS kept")
def q_queue_clear(spark, d):
    kept, cleared = records.without_feed(view(spark, d, "v_stream").where("action = 'UNASSOCIATED'"), "feed_2")
    return cleared.join(kept.agg(F.count(F.lit(1)).alias("kept")), F.lit(True))


@query("SELECT feed_id, chunk_id FROM v_stream WHERE action = 'UNASSOCIATED' QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY ts, chunk_id) <= 50")
def q_queue_pages(spark, d):
    return records.queue_page(view(spark, d, "v_stream").where("action = 'UNASSOCIATED'")).select("feed_id", "chunk_id")


@query(f"SELECT incident_id, CASE WHEN incident_id % 3 = 0 AND status = 'ACTIVE' THEN 'RESOLVED' ELSE status END AS status, CASE WHEN incident_id % 3 = 0 AND status = 'ACTIVE' THEN strftime({_ORDERS_NOW} + INTERVAL '30' MINUTE, '%H:%M') END AS shown_until FROM v_incidents")
def q_resolve(spark, d):
    rows = view(spark, d, "v_incidents").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    out = records.resolved(rows, rows.where("incident_id % 3 = 0").select("incident_id"), _now(ORDERS_AS_OF))
    return out.select("incident_id", "status", F.date_format("shown_until", "HH:mm").alias("shown_until"))


@query("SELECT chunk_id, form, number, feed_id, 'ACTIVE' AS status, ts AS opened_at, 1 AS n_chunks, CASE form WHEN 3 THEN concat(CAST(number AS STRING), ' Fordson Drive') ELSE 'Unknown' END AS city FROM v_radio")
def q_create_incidents(spark, d):
    rows = view(spark, d, "v_radio")
    chunks = rows.withColumns({"incident_type": F.lit("UNKNOWN"), "address": F.when(C("form") == 3, F.concat(C("number").cast("string"), F.lit(" Fordson Drive, Dearborn, MI"))), "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "units": F.array(F.lit("E-1"))})
    made = admin.create(chunks).withColumn("chunk_id", C("chunk_ids")[0])
    return made.join(rows.select("chunk_id", "form", "number"), "chunk_id").select("chunk_id", "form", "number", "feed_id", "status", "opened_at", F.size("chunk_ids").alias("n_chunks"), "city")


@query("""WITH i AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS changed, o_orderkey % 6 = 0 AS inferred FROM orders)
SELECT k, CASE WHEN changed THEN 'E-1,E-3' ELSE 'E-1,E-2' END AS units, CASE WHEN changed THEN 'E-2' ELSE '' END AS units_cleared, CASE WHEN changed AND k % 4 = 0 THEN 'new' ELSE 'old' END AS summary, CASE WHEN changed AND k % 8 <> 0 THEN 'HIGH' ELSE 'LOW' END AS priority,
CASE WHEN changed AND (k % 5 = 0 OR NOT inferred) THEN 43.0e0 WHEN k % 5 = 0 THEN NULL ELSE 42.0e0 END AS lat, CASE WHEN changed THEN '5 Main Street, Troy, MI' ELSE 'Troy, MI' END AS address, CASE WHEN changed THEN 3 ELSE 2 END AS n_chunks FROM i""")
def q_update_incidents(spark, d):
    k, strings = C("o_orderkey"), lambda *x: F.array(*map(F.lit, x))
    base = table(spark, d, "orders").select(
        k.alias("incident_id"), strings("E-1", "E-2").alias("units"), F.array().cast("array<string>").alias("units_cleared"), F.lit("old").alias("summary"), F.lit("LOW").alias("priority"), F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("chunk_ids"),
        F.when(k % 5 != 0, F.lit(42.0)).alias("lat"), F.when(k % 5 != 0, F.lit(-83.0)).alias("lng"), F.lit("Troy, MI").alias("address"), C("o_orderdate").alias("last_updated"),
    )
    changes = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(
        k.alias("incident_id"), C("o_orderdate").alias("ts"), strings("E-3", "E-2").alias("added"), strings("E-2").alias("cleared"), F.when(k % 4 == 0, "new").otherwise("").alias("n_summary"), F.when(k % 8 == 0, "UNKNOWN").otherwise("HIGH").alias("n_priority"),
        k.alias("chunk_id"), F.lit(43.0).alias("n_lat"), F.lit(-82.0).alias("n_lng"), (k % 6 == 0).alias("inferred"), F.lit("5 Main Street, Troy, MI").alias("n_address"), F.lit("HIGH").alias("confidence"),
    )
    out = admin.update(base, changes)
    return out.select(C("incident_id").alias("k"), F.array_join("units", ",").alias("units"), F.array_join("units_cleared", ",").alias("units_cleared"), "summary", "priority", "lat", "address", F.size("chunk_ids").alias("n_chunks"))


_NEWS = """SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, ['E-1', 'E-2', 'E-3', 'E-4'][CAST(l_partkey % 4 AS INT) + 1] AS added, ['E-1', 'E-2', 'E-3', 'none'][CAST(l_suppkey % 4 AS INT) + 1] AS cleared, CASE WHEN l_partkey % 3 = 0 THEN concat('s', CAST(l_partkey AS STRING)) ELSE '' END AS summary,
 ['HIGH', 'UNKNOWN', 'LOW'][CAST(l_suppkey % 3 AS INT) + 1] AS priority, CASE WHEN l_partkey % 5 > 1 THEN 42.0e0 + l_partkey % 7 END AS lat, l_suppkey % 2 = 0 AS guess, ['7 Main Street, Troy, MI', 'Troy, MI', 'NO_LOCATION', '', '9 Lake Road, Novi, MI'][CAST(l_partkey % 5 AS INT) + 1] AS address, ['HIGH', 'LOW', 'MEDIUM'][CAST((l_partkey + l_suppkey) % 3 AS INT) + 1] AS sure FROM lineitem"""


@query(f"""WITH RECURSIVE news AS MATERIALIZED ({_NEWS}), steps AS (
SELECT o_orderkey AS k, 0 AS n, ['E-1', 'E-9'] AS units, CAST([] AS VARCHAR[]) AS gone, 'old' AS summary, 'LOW' AS priority, CASE WHEN o_orderkey % 3 > 0 THEN 41.0e0 END AS lat, o_orderkey % 3 = 1 AS guess, CASE o_orderkey % 4 WHEN 0 THEN '1 Old Road, Troy, MI' WHEN 1 THEN 'Troy, MI' WHEN 2 THEN 'NO_LOCATION' END AS address, 0 AS n_chunks FROM orders
UNION ALL SELECT s.k, s.n + 1, CASE WHEN w.k IS NULL THEN s.units ELSE list_filter(list_distinct(list_append(s.units, w.added)), lambda u: u <> w.cleared) END, CASE WHEN w.k IS NULL THEN s.gone ELSE list_distinct(list_append(s.gone, w.cleared)) END,
 CASE WHEN w.summary <> '' THEN w.summary ELSE s.summary END, CASE WHEN w.priority <> 'UNKNOWN' THEN w.priority ELSE s.priority END, CASE WHEN w.lat IS NOT NULL AND (s.lat IS NULL OR NOT w.guess OR s.guess) THEN w.lat ELSE s.lat END, CASE WHEN w.lat IS NOT NULL AND (s.lat IS NULL OR NOT w.guess OR s.guess) THEN w.guess ELSE s.guess END,
 CASE WHEN w.address <> '' AND w.sure IN ('HIGH', 'MEDIUM') AND (s.address IS NULL OR s.address = 'NO_LOCATION' OR (s.address = 'Troy, MI' AND w.address LIKE '% Road,%' OR s.address = 'Troy, MI' AND w.address LIKE '% Street,%')) THEN w.address ELSE s.address END, s.n_chunks + CASE WHEN w.k IS NULL THEN 0 ELSE 1 END
FROM steps s LEFT JOIN news w ON w.k = s.k AND w.n = s.n + 1 WHERE s.n < 24)
SELECT k, array_to_string(list_sort(units), ',') AS units, array_to_string(list_sort(gone), ',') AS units_cleared, summary, priority, lat, guess, address, least(n_chunks, 3) AS n_chunks FROM steps WHERE n = 24""")
def q_update_fold(spark, d):
    """Several changes for each incident, in one batch, held against taking them one after the other."""
    none, strings = F.array().cast("array<string>"), lambda *x: F.array(*map(F.lit, x))
    k = C("o_orderkey")
    address = F.when(k % 4 == 0, "1 Old Road, Troy, MI").when(k % 4 == 1, "Troy, MI").when(k % 4 == 2, "NO_LOCATION")
    base = table(spark, d, "orders").select(
        k.alias("incident_id"), strings("E-1", "E-9").alias("units"), none.alias("units_cleared"), F.lit("old").alias("summary"), F.lit("LOW").alias("priority"), F.array().cast("array<long>").alias("chunk_ids"), F.when(k % 3 > 0, F.lit(41.0)).alias("lat"),
        F.when(k % 3 > 0, F.lit(-83.0)).alias("lng"), (k % 3 == 1).alias("is_location_inferred"), address.alias("address"), F.lit(None).cast("timestamp").alias("last_updated"),
    )
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    part, supp, n = C("l_partkey"), C("l_suppkey"), C("n")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    changes = table(spark, d, "lineitem").withColumn("n", order).select(
        C("l_orderkey").alias("incident_id"), F.timestamp_seconds(n).alias("ts"), F.array(pick(["E-1", "E-2", "E-3", "E-4"], part)).alias("added"), F.array(pick(["E-1", "E-2", "E-3", "none"], supp)).alias("cleared"), F.when(part % 3 == 0, F.concat(F.lit("s"), part.cast("string"))).otherwise("").alias("n_summary"),
        pick(["HIGH", "UNKNOWN", "LOW"], supp).alias("n_priority"), n.cast("long").alias("chunk_id"), F.when(part % 5 > 1, 42.0 + part % 7).alias("n_lat"), F.lit(-82.0).alias("n_lng"), (supp % 2 == 0).alias("inferred"), pick(["7 Main Street, Troy, MI", "Troy, MI", "NO_LOCATION", "", "9 Lake Road, Novi, MI"], part).alias("n_address"),
        pick(["HIGH", "LOW", "MEDIUM"], part + supp).alias("confidence"),
    )
    out = admin.update(base, changes, most_chunks=3)
    joined = [F.array_join(c, ",").alias(c) for c in ("units", "units_cleared")]
    return out.select(C("incident_id").alias("k"), *joined, "summary", "priority", "lat", C("is_location_inferred").alias("guess"), "address", F.size("chunk_ids").alias("n_chunks"))


_VERDICT = "CASE WHEN chunk_id = 900 THEN 'quit' ELSE CASE chunk_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'edit' WHEN 2 THEN 'none' ELSE 'skip' END END"


@query(f"""WITH v AS (SELECT chunk_id, label, confidence, {_VERDICT} AS verdict FROM v_radio) SELECT chunk_id, CASE WHEN chunk_id < 900 THEN CASE verdict WHEN 'keep' THEN label WHEN 'edit' THEN 'edited' WHEN 'none' THEN 'NO_LOCATION' ELSE 'machine' END ELSE 'machine' END AS review_label,
CASE WHEN chunk_id < 900 AND verdict <> 'skip' THEN 'human' ELSE 'claude' END AS review_source FROM v""")
def q_save_labels(spark, d):
    """A review of chunks, stopped at one of them, and its labels saved."""
    rows = view(spark, d, "v_radio")
    said = rows.select("chunk_id", F.expr(_VERDICT).alias("verdict"), F.lit("edited").alias("edited"), C("chunk_id").alias("ord"))
    chunks = rows.select("chunk_id", C("label").alias("machine"), F.lit("machine").alias("review_label"), F.lit("claude").alias("review_source"), F.lit(None).cast("timestamp_ntz").alias("reviewed"))
    labels = records.reviewed(chunks, said, "human", _now(EVENTS_AS_OF))
    return admin.save_labels(chunks, labels).select("chunk_id", "review_label", "review_source")


@query("SELECT chunk_id, CASE WHEN chunk_id % 3 > 0 AND label <> 'NO_LOCATION' AND confidence IN ('FAILED', 'LOW') THEN NULL ELSE label END AS review_label FROM v_radio")
def q_clear_unverifiable(spark, d):
    rows = view(spark, d, "v_radio").select("chunk_id", C("label").alias("review_label"), F.when(C("chunk_id") % 3 > 0, "claude").otherwise("human").alias("review_source"), C("reviewed"), C("confidence").alias("geocode_confidence"))
    return admin.clear_unverifiable(rows).select("chunk_id", "review_label")


@query("SELECT DISTINCT concat(feed_id, ':', CAST(unit AS STRING)) AS unit FROM v_stream WHERE incident_id % 5 = 0 AND action <> 'UNASSOCIATED'")
def q_units_of_deleted(spark, d):
    rows = view(spark, d, "v_stream").where("action <> 'UNASSOCIATED'").select(F.concat("feed_id", F.lit(":"), C("unit").cast("string")).alias("unit"), "incident_id")
    gone = rows.where("incident_id % 5 = 0").select("incident_id").distinct()
    return rows.join(gone, "incident_id", "left_semi").select("unit").distinct()


@query(f"SELECT feed_id, chunk_id, CASE feed_id {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in fixed.COUNTIES.items())} ELSE 'unknown' END AS county FROM v_radio")
def q_county_dim(spark, d):
    return view(spark, d, "v_radio").select("feed_id", "chunk_id", records.county_of(C("feed_id")).alias("county"))


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_radio), 6) AS share FROM v_radio GROUP BY 1")
def q_label_shares(spark, d):
    return records.label_shares(view(spark, d, "v_radio"))


@query("SELECT chunk_id, CASE WHEN form < 2 THEN CASE WHEN form = 0 THEN 'v3' ELSE 'lora-unknown' END WHEN form < 4 THEN 'base+shadow' ELSE 'base' END AS model_version, date_trunc('hour', ts) AS bucket FROM v_radio")
def q_model_label(spark, d):
    label = records.model_label(C("form") < 2, C("form") < 4, F.when(C("form") == 0, F.lit("v3")))
    return view(spark, d, "v_radio").select("chunk_id", label.alias("model_version"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"))


@query("""WITH s AS (SELECT ts, chunk_id, feed_id, raw_transcript, lag(raw_transcript) OVER w AS before, lag(ts) OVER w AS t FROM v_radio WINDOW w AS (PARTITION BY feed_id ORDER BY ts)), l AS (SELECT *, string_split(before, ' ') AS x FROM s)
SELECT chunk_id, CASE WHEN before IS NOT NULL AND epoch(date_trunc('second', ts)) - epoch(date_trunc('second', t)) < 300 THEN array_to_string(list_slice(x, greatest(len(x) - 4, 1), len(x)), ' ') END AS tail FROM l""")
def q_context_tail_guard(spark, d):
    return rel.context_tail(view(spark, d, "v_radio"), "feed_id", "ts", "raw_transcript", words=5, valid_s=300).select("chunk_id", "tail")


@query("""SELECT incident_id, string_agg(CAST(chunk_id AS STRING), ',' ORDER BY ts, chunk_id) AS chunk_ids FROM (SELECT * FROM v_stream WHERE incident_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, chunk_id DESC) <= 3) GROUP BY 1""")
def q_chunk_ids_capped(spark, d):
    return rel.capped_chunk_ids(view(spark, d, "v_stream").where("incident_id IS NOT NULL"), 3).select("incident_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1800' SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def q_stream_bursts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = run_stream(jobs.bursts(stream, "ts", "user_id", "30 minutes"), "bursts", ["user_id", "start"], mode="complete")
    return out.select("user_id", C("start").cast("timestamp_ntz").alias("started"), "n").where("n > 0")
