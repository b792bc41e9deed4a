"""Queries on addresses, units and display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchlake.functions import fixed, score, text
from dispatchlake.operators import admin, curate
from dispatchlake.plans.registry import query
from dispatchlake.views import ORDERS_AS_OF, table, view

C = F.col


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TOKENS = f"list_transform(list_filter(string_split_regex(addr, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_in(fixed.ADDRESS_STOP)}, lower(w))), lambda w: lower(trim(w, '.,()')))"
_PRIMARY = f"list_transform(list_filter(string_split_regex(addr, '\\s+'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_in(sorted({*fixed.ADDRESS_STOP, *fixed.STREET_SUFFIX}))}, lower(w)) AND length(w) > 3), lambda w: lower(trim(w, '.,()')))"


@query(f"SELECT k, array_to_string(list_sort(list_distinct({_TOKENS})), ' ') AS tokens FROM v_addr")
def q_addr_tokens(spark, d):
    return view(spark, d, "v_addr").select("k", F.array_join(F.array_sort(text.address_tokens(C("addr"))), " ").alias("tokens"))


_PAIRED = "a AS (SELECT k, addr, lead(addr) OVER (ORDER BY k) AS next FROM v_addr)"


def _paired(spark, d):
    """Each address with that of the next key, by a join: keys are dense."""
    rows = view(spark, d, "v_addr")
    return rows.join(rows.select((C("k") - 1).alias("k"), C("addr").alias("next")), "k", "left")


@query(f"""WITH {_PAIRED}, t AS (SELECT k, list_distinct({_TOKENS}) AS x, list_distinct({_TOKENS.replace("addr", "coalesce(next, '')")}) AS y FROM a)
SELECT k, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) ELSE 0.0 END AS overlap FROM t""")
def q_jaccard(spark, d):
    pair = text.token_overlap(text.address_tokens(C("addr")), text.address_tokens(C("next")))
    return _paired(spark, d).select("k", F.round(pair, 6).alias("overlap"))


@query(f"""WITH t AS (SELECT k, {_PRIMARY} AS l FROM v_addr) SELECT k, coalesce(l[list_position(list_transform(l, lambda w: length(w)), list_max(list_transform(l, lambda w: length(w))))], '') AS street FROM t""")
def q_primary_street(spark, d):
    return view(spark, d, "v_addr").select("k", text.primary_street(C("addr")).alias("street"))


@query("SELECT k, trim(split_part(addr, ',', 1)) AS city, lower(trim(split_part(addr, ',', 2))) AS eval_city FROM v_addr")
def q_city(spark, d):
    return view(spark, d, "v_addr").select("k", text.city_of(C("addr")).alias("city"), text.eval_city(C("addr")).alias("eval_city"))


@query("SELECT k, regexp_matches(addr, '^\\s*[0-9]') AS numbered FROM (SELECT k, CASE WHEN k % 2 = 0 THEN addr ELSE substr(addr, 5) END AS addr FROM v_addr)")
def q_house_number(spark, d):
    a = F.when(C("k") % 2 == 0, C("addr")).otherwise(F.substring("addr", 5, 1000))
    return view(spark, d, "v_addr").select("k", text.has_house_number(a).alias("numbered"))


@query("SELECT k, addr AS stripped FROM v_addr")
def q_strip_unit(spark, d):
    a = F.concat("addr", F.concat(F.lit(", Apt "), (C("k") % 40).cast("string")))
    return view(spark, d, "v_addr").select("k", text.strip_unit_suffix(a).alias("stripped"))


_SAID = "CASE unit % 6 WHEN 0 THEN concat('E-', CAST(unit AS STRING)) WHEN 1 THEN CAST(unit AS STRING) WHEN 2 THEN 'UNIT' WHEN 3 THEN concat('WARREN ', CAST(unit AS STRING)) WHEN 4 THEN concat('1-2-', CAST(unit AS STRING)) ELSE concat('X:MEDIC ', CAST(unit AS STRING)) END"


@query(f"""WITH u AS (SELECT chunk_id, regexp_replace(trim(upper({_SAID})), '^[^:]*:', '') AS uid FROM v_stream)
SELECT chunk_id, length(uid) >= 2 AND NOT regexp_full_match(uid, '[0-9]{{1,2}}') AND NOT list_contains({_in(fixed.UNIT_BLACKLIST)}, uid) AND NOT regexp_full_match(regexp_replace(uid, '[- ]', '', 'g'), '[0-9]{{1,2}}')
 AND NOT list_has_any(string_split_regex(lower(replace(uid, '-', ' ')), '\\s+'), {_in(fixed.UNIT_ADDRESS_WORDS)})
 AND NOT (len(list_filter(string_split(replace(uid, ' ', '-'), '-'), lambda p: regexp_full_match(p, '[0-9]+'))) >= 3) AND (regexp_matches(uid, '[0-9]') OR regexp_matches(uid, '^({"|".join(fixed.UNIT_PREFIXES)})')) AS valid FROM u""")
def q_unit_valid(spark, d):
    return view(spark, d, "v_stream").select("chunk_id", text.unit_valid(F.expr(_SAID)).alias("valid"))


_FEEDS = [*(a for a, _ in fixed.AGENCIES), "elsewhere"]
_FEED = f"concat(list_extract({_in(_FEEDS)}, CAST(c_custkey % {len(_FEEDS)} AS INT) + 1), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '_x' END)"


def _case(pairs, default, quote):
    whole = " ".join(f"WHEN feed = '{k}' THEN {quote}{v}{quote}" for k, v in pairs)
    start = " ".join(f"WHEN starts_with(feed, '{k}') THEN {quote}{v}{quote}" for k, v in pairs)
    return f"CASE {whole} {start} ELSE {quote}{default}{quote} END"


def _feeds(spark, d):
    names = F.array(*map(F.lit, _FEEDS))
    feed = F.concat(F.element_at(names, (C("c_custkey") % len(_FEEDS)).cast("int") + 1), F.when(C("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit("_x")))
    return table(spark, d, "customer").select(C("c_custkey").alias("k"), feed.alias("feed"))


@query(f"WITH f AS (SELECT c_custkey AS k, {_FEED} AS feed FROM customer) SELECT k, {_case(fixed.AGENCIES, 'UNK', chr(39))} AS agency, {_case(fixed.UNIT_TTL, fixed.UNIT_TTL_DEFAULT, '')} AS ttl FROM f")
def q_prefix_dim(spark, d):
    return _feeds(spark, d).select("k", text.agency(C("feed")).alias("agency"), text.unit_ttl(C("feed")).alias("ttl"))


@query(f"WITH f AS (SELECT c_custkey AS k, {_FEED} AS feed FROM customer) SELECT k, concat({_case(fixed.AGENCIES, 'UNK', chr(39))}, ':E-', CAST(k % 60 AS STRING)) AS unit FROM f")
def q_unit_namespace(spark, d):
    unit = F.concat(F.lit("OLD:E-"), (C("k") % 60).cast("string"))
    return _feeds(spark, d).select("k", text.namespaced(unit, C("feed")).alias("unit"))


@query(f"""WITH a AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'NO_LOCATION' ELSE addr END AS addr FROM v_addr),
t AS (SELECT k, addr, {_PRIMARY.replace("string_split_regex(addr", "string_split_regex(split_part(addr, ',', 1)")} AS l FROM a)
SELECT k, CASE WHEN k % 3 = 0 AND addr <> 'NO_LOCATION' THEN 'NO_LOCATION' ELSE addr END AS checked FROM t""")
def q_checked_extraction(spark, d):
    """The transcript names the street but for every third."""
    rows = view(spark, d, "v_addr").withColumn("a", F.when(C("k") % 4 == 0, F.lit(text.NO_LOCATION)).otherwise(C("addr")))
    said = F.when(C("k") % 3 == 0, F.lit("nothing said here")).otherwise(F.concat(F.lit("respond to "), C("addr")))
    return rows.select("k", text.checked_extraction(said, C("a"))["address"].alias("checked"))


@query("SELECT k, CASE WHEN k % 3 = 2 THEN concat(addr, '\"') ELSE addr END AS address FROM v_addr")
def q_sanitize(spark, d):
    """Answers of three kinds made of addresses."""
    forms = F.array(F.concat(F.lit("```json\n{\"address\": \""), C("addr"), F.lit("\"}\n```")), F.concat(F.lit("Address: "), C("addr")), F.concat(F.lit('"'), C("addr"), F.lit('". It is near. Yes')))
    return view(spark, d, "v_addr").select("k", text.sanitize(F.element_at(forms, (C("k") % 3).cast("int") + 1)).alias("address"))


@query("""SELECT p_partkey AS k, CASE WHEN contains(upper(p_name), 'FIRE') THEN 'fire' ELSE 'unknown' END AS class,
 CASE WHEN contains(upper(p_type), 'ARSON') THEN '#ff4400' ELSE '#888888' END AS colour, CASE WHEN length(p_name) > 8 THEN concat(substr(p_name, 1, 8), '…') ELSE p_name END AS short FROM part""")
def q_display(spark, d):
    return table(spark, d, "part").select(C("p_partkey").alias("k"), text.tag_class(C("p_name")).alias("class"), text.crime_colour(C("p_type")).alias("colour"), text.shorten(C("p_name"), 8).alias("short"))


@query("""SELECT incident_id, CASE WHEN incident_type LIKE '%FIRE%' THEN 'fire' WHEN incident_type = 'MEDICAL' THEN 'medical' WHEN incident_type = 'SHOOTING' THEN 'shooting' WHEN incident_type = 'WELFARE_CHECK' THEN 'police' ELSE 'unknown' END AS class FROM v_incidents""")
def q_tag_class(spark, d):
    return view(spark, d, "v_incidents").select("incident_id", text.tag_class(C("incident_type")).alias("class"))


@query(f"""WITH s AS (SELECT incident_id, CAST(epoch(TIMESTAMP '{ORDERS_AS_OF}' - last_updated) AS BIGINT) AS s FROM v_incidents)
SELECT incident_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(s // 60 AS STRING), 'm ago') WHEN s < 86400 THEN concat(CAST(s // 3600 AS STRING), 'h ago') ELSE concat(CAST(s // 86400 AS STRING), 'd ago') END AS age FROM s""")
def q_age_text(spark, d):
    s = F.unix_timestamp(F.lit(ORDERS_AS_OF).cast("timestamp")) - F.unix_timestamp(C("last_updated").cast("timestamp"))
    return view(spark, d, "v_incidents").select("incident_id", text.age_text(s).alias("age"))


@query("""SELECT incident_id, concat_ws(' | ', concat('- ', CAST(incident_id AS STRING)), incident_type, priority, 'unknown location', 'units: none') AS line FROM v_incidents WHERE status = 'ACTIVE'""")
def q_context_lines(spark, d):
    line = text.context_line(C("incident_id"), C("incident_type"), C("priority"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    return view(spark, d, "v_incidents").where("status = 'ACTIVE'").select("incident_id", line.alias("line"))


@query("""WITH g AS (SELECT addr AS a, min(k) AS g FROM v_addr WHERE k % 2 = 0 GROUP BY 1) SELECT k, CASE WHEN k % 5 = 0 THEN 3 WHEN g IS NOT NULL THEN g END AS place, CASE WHEN k % 5 = 0 OR g IS NOT NULL THEN 'HIGH' ELSE 'FAILED' END AS confidence FROM v_addr LEFT JOIN g ON addr = a""")
def q_geocode_lookup(spark, d):
    """Half of the addresses and one landmark are known; addresses come with unit suffixes, or as the landmark."""
    rows = view(spark, d, "v_addr")
    asked = rows.select("k", F.lit("f").alias("feed_id"), F.when(C("k") % 5 == 0, F.lit("Hart Plaza, downtown")).otherwise(F.concat("addr", F.lit(", apt 3"))).alias("address"))
    known = rows.where("k % 2 = 0").groupBy(text.cache_key(C("addr")).alias("key")).agg(F.min("k").alias("place"))
    known = known.union(spark.range(1).select(text.cache_key(F.lit("Hart Plaza, Detroit, MI")), F.lit(3).cast("long"))).withColumn("confidence", F.lit("HIGH"))
    return admin.geocode(asked, known).select("k", "place", "confidence")


@query("""SELECT chunk_id, (CASE WHEN unit % 4 = 0 THEN 'FAILED' ELSE 'HIGH' END) = 'FAILED' AND unit % 8 < 4 AND action = 'UPDATE' AS noisy, (unit <= 1 OR unit % 3 = 0) AS summarise FROM v_stream""")
def q_gates(spark, d):
    confidence = F.when(C("unit") % 4 == 0, F.lit("FAILED")).otherwise(F.lit("HIGH"))
    address = F.when(C("action") == "UPDATE", F.lit(text.NO_LOCATION)).otherwise(F.lit("5 Main Road"))
    gate = score.noisy(confidence, F.when(C("unit") % 8 < 4, 0).otherwise(1), address, F.lit(False), C("feed_id"))
    return view(spark, d, "v_stream").select("chunk_id", gate.alias("noisy"), score.should_summarise(C("unit")).alias("summarise"))


_STREETS = ["Woodward Avenue", "Woodword Ave", "Woodard Avenue", "Gratiot Avenue", "Fenkell Street", "Fenkel St", "West Warren Road", "W Warren Road", "Warren Road West", "Mile Road", "Eight Mile Road", "Mound"]


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey AS k, c_custkey % 7 AS form, list_extract([{', '.join(f"'{s}'" for s in _STREETS)}], CAST(c_custkey % {len(_STREETS)} AS INT) + 1) AS a, list_extract([{', '.join(f"'{s}'" for s in _STREETS)}], CAST(c_custkey // {len(_STREETS)} % {len(_STREETS)} AS INT) + 1) AS b FROM customer),
d AS (SELECT DISTINCT lower(a) AS a, lower(b) AS b FROM p),
runs AS MATERIALIZED (SELECT a, b, i, j, k FROM (SELECT a, b, i, j, unnest(range(1, least(length(a) - i, length(b) - j) + 2)) AS k FROM (SELECT a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM d))) WHERE substr(a, i, k) = substr(b, j, k)),
r AS (SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS n, true AS whole FROM d
UNION ALL SELECT a, b, CASE side WHEN 0 THEN alo ELSE i + k END, CASE side WHEN 0 THEN i ELSE ahi END, CASE side WHEN 0 THEN blo ELSE j + k END, CASE side WHEN 0 THEN j ELSE bhi END, CASE side WHEN 0 THEN k ELSE 0 END, false
 FROM (SELECT r.*, runs.i, runs.j, runs.k, row_number() OVER (PARTITION BY r.a, r.b, alo, ahi, blo, bhi ORDER BY runs.k DESC, runs.i, runs.j) AS best FROM r JOIN runs ON r.a = runs.a AND r.b = runs.b AND runs.i >= alo AND runs.i + runs.k <= ahi AND runs.j >= blo AND runs.j + runs.k <= bhi) m, (VALUES (0), (1)) s(side) WHERE best = 1),
ratio AS (SELECT a, b, 2.0 * sum(n) / (length(a) + length(b)) AS ratio FROM r GROUP BY a, b)
SELECT k, CASE form WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE ratio > 0.8 END AS match FROM p JOIN ratio ON lower(p.a) = ratio.a AND lower(p.b) = ratio.b""")
def q_street_match(spark, d):
    """Similar streets, with equal, different and missing numbers and without a location, held against matching blocks in SQL."""
    k, form = C("k"), C("k") % 7
    street = lambda at: F.element_at(F.array(*map(F.lit, _STREETS)), (at % len(_STREETS)).cast("int") + 1)
    line = lambda number, s, city: F.concat(number, s, F.lit(city))
    a, b = street(k), street(F.floor(k / len(_STREETS)))
    said = F.when(form < 2, F.lit(text.NO_LOCATION)).when(form < 5, line(F.lit("17 "), a, ", Detroit, MI")).otherwise(a)
    label = F.when(form == 0, line(F.lit("17 "), b, "")).when(form == 1, F.lit(text.NO_LOCATION)).when(form == 2, line(F.lit("18 "), b, ", Troy")).when(form < 5, line(F.lit(" 17  "), b, "")).when(form == 5, line(F.lit("5 "), b, ", Troy")).otherwise(b)
    return curate.with_street_match(view(spark, d, "v_addr").select("k"), said, label, "match")
