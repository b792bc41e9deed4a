"""Queries on the rules of addresses, units, judges and models that no other query runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dispatchlake import models
from dispatchlake.functions import fixed, score, text
from dispatchlake.operators import curate, phrases
from dispatchlake.plans.registry import query
from dispatchlake.sources import layers
from dispatchlake.views import EVENTS_AS_OF, table, view

C = F.col


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(names, key, n=None):
    """The name at a key modulo their number, in Spark."""
    return F.element_at(F.array(*map(F.lit, names)), (key % (n or len(names))).cast("int") + 1)


def _picked(names, key) -> str:
    """The same in SQL."""
    return f"list_extract({_in(names)}, CAST({key} % {len(names)} AS INT) + 1)"


_TYPES = ["STRUCTURE_FIRE", "VEHICLE_FIRE", "MEDICAL", "SHOOTING", "WELFARE_CHECK", "ASSAULT", "PURSUIT", "HAZMAT", "BOMB_THREAT", "UNKNOWN"]
_BAD = [f"{a}|{b}" for x in fixed.INCOMPATIBLE for a, b in (x, x[::-1])]
_PAIR = f"SELECT o_orderkey AS k, {_picked(_TYPES, 'o_orderkey')} AS a, {_picked(_TYPES, '(o_orderkey // 10)')} AS b, o_custkey % 40000 AS age, o_orderkey % 3 = 0 AS unit FROM orders"


@query(f"""WITH p AS ({_PAIR}) SELECT k, list_contains({_in(_BAD)}, concat(a, '|', b)) AS incompatible, age <= CASE WHEN unit THEN 28800 ELSE 14400 END AND (unit OR NOT list_contains({_in(_BAD)}, concat(a, '|', b))) AS accepted FROM p""")
def q_weak_gate(spark, d):
    """Incompatible types, and age limits with and without a unit match; times that can't be read pass."""
    k = C("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), _pick(_TYPES, k).alias("a"), _pick(_TYPES, F.floor(k / 10)).alias("b"), (C("o_custkey") % 40000).alias("age"), (k % 3 == 0).alias("unit"))
    return rows.select("k", score.incompatible(C("a"), C("b")).alias("incompatible"), score.accepts_weak(C("age"), C("a"), C("b"), C("unit")).alias("accepted"))


_SITES = ["14303 East Warren Avenue, Detroit, MI", "Warren and Fenkell, Detroit, MI", "9 Mile Road, Livonia, MI", "NO_LOCATION", "Unknown", "22 Fordson Drive, Dearborn, MI", "Detroit, MI"]
_WORDS = ["14303,warren,avenue,detroit", "warren,fenkell,detroit", "mile,road,livonia", "", "", "fordson,drive,dearborn", "detroit"]  # what stands before a comma is no stop word


@query(f"""WITH p AS (SELECT o_orderkey AS k, {_picked(_WORDS, 'o_orderkey')} AS a, {_picked(_WORDS, '(o_orderkey // 7)')} AS b, {_picked(_TYPES, '(o_orderkey // 49)')} AS x, {_picked(_TYPES, '(o_orderkey // 490)')} AS y FROM orders),
d AS (SELECT *, a <> '' AND b <> '' AND NOT list_has_any(string_split(a, ','), string_split(b, ',')) AS differ FROM p) SELECT k, differ, NOT (differ AND list_contains({_in(_BAD)}, concat(x, '|', y))) AS kept FROM d""")
def q_clearly_different(spark, d):
    """Addresses that share no telling word, and the candidates that this and incompatible types together rule out."""
    k = C("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), _pick(_SITES, k).alias("a"), _pick(_SITES, F.floor(k / 7)).alias("b"), _pick(_TYPES, F.floor(k / 49)).alias("x"), _pick(_TYPES, F.floor(k / 490)).alias("y"))
    return rows.select("k", score.clearly_different(C("a"), C("b")).alias("differ"), score.worth_judging(C("a"), C("b"), C("x"), C("y")).alias("kept"))


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'UPDATE' ELSE 'UNASSOCIATED' END AS action, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 42.0e0 END AS old, CASE o_orderkey % 5 WHEN 0 THEN 42.0005e0 WHEN 1 THEN 42.002e0 WHEN 2 THEN 0.0e0 ELSE 42.0e0 END AS lat FROM orders)
SELECT k, action = 'NEW' OR (action = 'UPDATE' AND lat <> 0 AND (old IS NULL OR coalesce(abs(lat - old) > 0.001, false))) AS enrich FROM p""")
def q_should_enrich(spark, d):
    k = C("o_orderkey")
    action = F.when(k % 3 == 0, "NEW").when(k % 3 == 1, "UPDATE").otherwise("UNASSOCIATED")
    old, lat = F.when(k % 4 != 0, F.lit(42.0)), F.when(k % 5 == 0, 42.0005).when(k % 5 == 1, 42.002).when(k % 5 == 2, 0.0).otherwise(42.0)
    return table(spark, d, "orders").select(k.alias("k"), score.should_enrich(action, old, F.lit(-83.0), lat, F.lit(-83.0)).alias("enrich"))


_PLACES = ["Oak Manor", "Oak Manor, Detroit, MI", "5 Oak Manor", "Oak and Manor", "Grace & Grove", "Northland Center, Southfield", "nowhere in particular", "NO_LOCATION", ""]
_NAMED = [True, True, False, False, False, True, False, False, False]


@query(f"SELECT p_partkey AS k, list_extract({[bool(x) for x in _NAMED]}, CAST(p_partkey % {len(_NAMED)} AS INT) + 1) AS named FROM part".replace("True", "true").replace("False", "false"))
def q_named_place(spark, d):
    return table(spark, d, "part").select(C("p_partkey").alias("k"), text.is_named_place(_pick(_PLACES, C("p_partkey"))).alias("named"))


_CITIES = ["Detroit", "Dearborn Heights", "", "Royal Oak", "Toledo"]


@query(f"""WITH p AS (SELECT k, lower({_picked(_CITIES, 'k')}) AS city, lower(trim(split_part(addr, ',', 2))) AS hint FROM (SELECT k, CASE k % 4 WHEN 0 THEN 'Main Street' WHEN 1 THEN '5 Main Street, Dearborn, MI' WHEN 2 THEN '5 Main, Toledo, OH' ELSE addr END AS addr FROM v_addr))
SELECT k, hint = '' OR city = '' OR contains(city, hint) OR contains(hint, city) AS plausible FROM p""")
def q_place_plausible(spark, d):
    a = F.when(C("k") % 4 == 0, "Main Street").when(C("k") % 4 == 1, "5 Main Street, Dearborn, MI").when(C("k") % 4 == 2, "5 Main, Toledo, OH").otherwise(C("addr"))
    return view(spark, d, "v_addr").select("k", text.place_plausible(_pick(_CITIES, C("k")), a).alias("plausible"))


_OSM, _OSM_VALUES = ["house", "street", "locality", "district", "city", "other"], ["bus_stop", "crossing", "residential", "park"]


@query(f"""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 900 AS STRING) END AS number, CASE WHEN c_custkey % 3 > 0 THEN 'Main Street' END AS street, CASE WHEN c_custkey % 7 > 2 THEN 'Clark Park' END AS name, CASE WHEN c_custkey % 5 > 0 THEN ', Troy' ELSE '' END AS city,
 CASE WHEN c_custkey % 11 = 0 THEN ', OH' ELSE ', MI' END AS state, {_picked(_OSM, 'c_custkey')} AS kind, {_picked(_OSM_VALUES, '(c_custkey // 6)')} AS v FROM customer)
SELECT k, ltrim(concat(CASE WHEN number IS NOT NULL AND street IS NOT NULL THEN concat(', ', number, ' ', street) WHEN street IS NOT NULL THEN concat(', ', street) WHEN name IS NOT NULL THEN concat(', ', name) ELSE '' END, city, state), ', ') AS formatted,
 CASE WHEN kind = 'house' OR (number IS NOT NULL AND street IS NOT NULL) THEN 'HIGH' WHEN kind IN ('street', 'locality') OR street IS NOT NULL THEN 'HIGH' WHEN v IN ('bus_stop', 'crossing') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM p""")
def q_formatted_address(spark, d):
    """Numbers with and without a street, names, places without a state."""
    k = C("c_custkey")
    number, street = F.when(k % 2 == 0, (k % 900).cast("string")), F.when(k % 3 > 0, F.lit("Main Street")).otherwise(F.lit(" "))
    made = text.formatted_address(number, street, F.when(k % 5 > 0, F.lit(" Troy ")), F.when(k % 11 == 0, F.lit("OH")), F.when(k % 7 > 2, F.lit("Clark Park")))
    sure = text.found_confidence(_pick(_OSM, k), _pick(_OSM_VALUES, F.floor(k / 6)), number, F.nullif(F.trim(street), F.lit("")))
    return table(spark, d, "customer").select(k.alias("k"), made.alias("formatted"), sure.alias("confidence"))


_LOCATION = ["ROOFTOP", "RANGE_INTERPOLATED", "GEOMETRIC_CENTER", "APPROXIMATE", "OTHER"]
_SETS = {"wide": ["locality", "political"], "near": ["park", "locality"], "odd": ["bus_station"], "none": []}


@query(f"""WITH p AS (SELECT c_custkey AS k, {_picked(_LOCATION, 'c_custkey')} AS t, c_custkey % 4 = 0 AS numbered, {_picked(list(_SETS), '(c_custkey // 5)')} AS s FROM customer)
SELECT k, CASE t WHEN 'ROOFTOP' THEN 'HIGH' WHEN 'RANGE_INTERPOLATED' THEN 'HIGH' WHEN 'APPROXIMATE' THEN CASE WHEN numbered THEN 'MEDIUM' ELSE 'LOW' END ELSE 'MEDIUM' END AS confidence,
CASE WHEN s = 'wide' OR (t = 'APPROXIMATE' AND s <> 'near') THEN NULL WHEN t IN ('ROOFTOP', 'RANGE_INTERPOLATED') THEN 'HIGH' ELSE 'MEDIUM' END AS place FROM p""")
def q_geocode_confidence(spark, d):
    k = C("c_custkey")
    kinds = F.element_at(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in _SETS.values()]), (F.floor(k / 5) % 4).cast("int") + 1)
    kind, a = _pick(_LOCATION, k), _pick([" 5 Main", "Main", "8th Street", "17"], k)
    return table(spark, d, "customer").select(k.alias("k"), text.geocode_confidence(kind, a).alias("confidence"), text.place_confidence(kind, kinds, a).alias("place"))


_OLD, _NEW = ["Troy, MI", "NO_LOCATION", "5 Oak Road, Troy, MI", ""], ["7 Elm Street, Troy, MI", "Detroit, MI", ""]


@query(f"""WITH p AS (SELECT c_custkey AS k, {_picked(_OLD, 'c_custkey')} AS o, {_picked(_NEW, '(c_custkey // 4)')} AS n, {_picked(['HIGH', 'LOW', 'MEDIUM'], '(c_custkey // 12)')} AS c FROM customer)
SELECT k, CASE WHEN n <> '' AND c <> 'LOW' AND (o IN ('NO_LOCATION', '') OR (o = 'Troy, MI' AND n = '7 Elm Street, Troy, MI')) THEN n ELSE o END AS address FROM p""")
def q_promoted_address(spark, d):
    k = C("c_custkey")
    new = text.promoted_address(_pick(_OLD, k), _pick(_NEW, F.floor(k / 4)), _pick(["HIGH", "LOW", "MEDIUM"], F.floor(k / 12)))
    return table(spark, d, "customer").select(k.alias("k"), new.alias("address"))


_N, _K = "lpad(CAST(s_suppkey AS STRING), 2, '0')", "CAST(s_suppkey AS STRING)"
_ENGINE = ", ".join([f"concat('{x}', {_N})" for x in ("ENGINE ", "ENGINE", "ENG ", "ENG")] + [f"concat('{x}', {_K})" for x in ("E-", "E", "E ")])
_LADDER = ", ".join([f"concat('{x}', {_N})" for x in ("LADDER ", "LADDER", "LAD ", "LAD", "L ", "L")] + [f"concat('{x}', {_K})" for x in ("L-", "L", "L ")])


@query(f"SELECT s_suppkey AS k, array_to_string(list_sort(list_distinct(CASE WHEN s_suppkey % 2 = 0 THEN [{_ENGINE}] ELSE [{_LADDER}] END)), ',') AS forms FROM supplier")
def q_unit_variants(spark, d):
    k = C("s_suppkey")
    number = F.lpad(k.cast("string"), 2, "0")
    name, short = F.concat(F.when(k % 2 == 0, "ENGINE ").otherwise("LADDER "), number), F.concat(F.when(k % 2 == 0, "E-").otherwise("L-"), k.cast("string"))
    return table(spark, d, "supplier").select(k.alias("k"), F.array_join(text.unit_variants(name, short), ",").alias("forms"))


_ANSWERS = ["MATCH: abc", "match bcd", "MATCH", "RETRY later", "NEW incident", "", "MATCH: zzz"]


@query(f"""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 7 AS INT) AS a, p_partkey % 3 = 0 AS none FROM part)
SELECT k, CASE WHEN a IN (0, 1, 2, 6) AND NOT none THEN 'MATCH' WHEN a = 3 THEN 'RETRY' ELSE 'NEW' END AS decision, CASE WHEN a IN (0, 1, 2, 6) AND NOT none THEN CASE a WHEN 1 THEN 'bcd-2' ELSE 'abc-1' END END AS incident_id FROM p""")
def q_judge_answers(spark, d):
    k = C("p_partkey")
    candidates = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("abc-1"), F.lit("bcd-2")))
    said = text.decision_of(_pick(_ANSWERS, k), candidates)
    return table(spark, d, "part").select(k.alias("k"), said["decision"].alias("decision"), said["incident_id"].alias("incident_id"))


@query("SELECT chunk_id, concat_ws(' | ', concat('- ', CAST(chunk_id AS STRING)), 'MEDICAL', confidence, raw_transcript, concat('units: ', CASE WHEN form = 2 THEN 'none' ELSE 'E-1, L-2' END)) AS line, CASE feed_id WHEN 'wayneco_dearborn' THEN 'dearborn' WHEN 'wayneco_detroit_fire' THEN 'detroit fire' WHEN 'wayneco_downriver' THEN 'downriver' ELSE replace(feed_id, '_', ' ') END AS feed FROM v_radio")
def q_lines_with_units(spark, d):
    units = F.when(C("form") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("E-1"), F.lit("L-2")))
    line = text.context_line(C("chunk_id"), F.lit("MEDICAL"), C("confidence"), C("raw_transcript"), units)
    return view(spark, d, "v_radio").select("chunk_id", line.alias("line"), text.feed_short_name(C("feed_id")).alias("feed"))


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS same, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 200) / 10.0e0 END AS km, o_orderkey % 3 = 0 AS inferred FROM orders)
SELECT k, CASE WHEN (coalesce(km < 0.5, false) AND NOT inferred) OR (same AND coalesce(km < 5, false)) THEN 'HIGH' WHEN same AND (km IS NULL OR km < 15) THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN km IS NULL THEN 'unknown' ELSE concat(printf('%.2f', km), ' km apart', CASE WHEN inferred THEN ' (location inferred from units)' ELSE '' END) END AS apart FROM p""")
def q_pair_judge(spark, d):
    k = C("o_orderkey")
    km = F.when(k % 7 != 0, (k % 200) / 10.0)
    return table(spark, d, "orders").select(k.alias("k"), score.judge_confidence(k % 2 == 0, km, k % 3 == 0).alias("confidence"), text.distance_text(km, k % 3 == 0).alias("apart"))


@query(f"SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(ts))) / 60) AS BIGINT) END AS minutes, CASE WHEN event_id % 9 > 0 THEN concat(CAST(CAST(floor((epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(ts))) / 60) AS BIGINT) AS STRING), ' minutes ago') ELSE 'unknown' END AS said FROM events")
def q_age_minutes(spark, d):
    written = F.when(C("event_id") % 9 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("not a time"))
    return table(spark, d, "events").select("event_id", text.age_minutes(written, F.lit(EVENTS_AS_OF).cast("timestamp")).alias("a")).select("event_id", "a.*")


_CONTEXT = "concat('Feed: ', {0}, chr(10), 'Primary city/area: ', {1}, chr(10), 'County: ', {2}, chr(10), 'Geographic context: ', {3})"


@query("WITH c AS (SELECT chunk_id, confidence, raw_transcript, form, CASE WHEN form < 3 THEN " + _CONTEXT.format("'Dearborn'", "'Dearborn'", "'Wayne County'", "'note'") + " ELSE " + _CONTEXT.format(*(f"'{x}'" for x in fixed.DEFAULT_CONTEXT)) + """ END AS context FROM v_radio)
SELECT chunk_id, concat('Feed context: ', context, chr(10), 'Geocode confidence of the model''s output: ', confidence, chr(10), 'The model''s output: NO_LOCATION', chr(10), chr(10), 'Transcript:', chr(10), raw_transcript) AS request,
CASE form WHEN 0 THEN 'hints' WHEN 1 THEN concat('hints [Previous transmission: ', raw_transcript, ']') WHEN 2 THEN '' ELSE concat('[Previous transmission: ', raw_transcript, ']') END AS opening FROM c""")
def q_prompt_texts(spark, d):
    known = lambda x: F.when(C("form") < 3, F.lit(x))
    context = layers.feed_context(C("feed_id"), known("Dearborn"), known("Dearborn"), known("Wayne County"), known("note"))
    hints, tail = F.when(C("form") < 2, F.lit("hints")), F.when(~C("form").isin(0, 2), C("raw_transcript"))
    return view(spark, d, "v_radio").select("chunk_id", layers.label_request(context, C("confidence"), F.lit("NO_LOCATION"), C("raw_transcript")).alias("request"), layers.opening_prompt(hints, tail).alias("opening"))


@query("""SELECT chunk_id, CASE form WHEN 0 THEN '14303 East Warren Avenue' WHEN 1 THEN CASE WHEN mile > 0 THEN concat(CAST(mile AS STRING), ' Mile and Woodward') END WHEN 3 THEN concat(CAST(number AS STRING), ' Fordson Drive') WHEN 5 THEN 'Fenkell and Livernois' WHEN 6 THEN 'Michigan and Telegraph' ELSE 'NO_LOCATION' END AS address,
CASE form WHEN 0 THEN 'STRUCTURE_FIRE' WHEN 1 THEN 'MEDICAL' WHEN 3 THEN 'SHOOTING' WHEN 5 THEN 'WELFARE_CHECK' WHEN 6 THEN 'TRAFFIC_ACCIDENT' ELSE 'UNKNOWN' END AS incident_type, form NOT IN (2, 4) AS has_incident, CASE WHEN form IN (0, 3) THEN 'HIGH' WHEN form IN (1, 6) THEN 'MEDIUM' WHEN form = 5 THEN 'LOW' ELSE 'UNKNOWN' END AS priority,
CASE form WHEN 0 THEN 'ENGINE 30' WHEN 1 THEN 'MEDIC 5' WHEN 3 THEN 'CAR 42' ELSE '' END AS units FROM v_radio""")
def q_models(spark, d):
    """The rule-based models: address, type, and all that a transcript tells."""
    m = models.Models()
    rows = view(spark, d, "v_radio").select("chunk_id", m.address(C("raw_transcript"), C("feed_id")).alias("address"), m.structure(C("raw_transcript")).alias("s"))
    return rows.select("chunk_id", "address", "s.incident_type", "s.has_incident", "s.priority", F.array_join("s.units_added", ",").alias("units"))


@query("""WITH t AS (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first, arg_max(text, turn) AS last FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN n > 1 THEN concat(first, ' … ', last) ELSE first END AS summary FROM t""")
def q_summaries(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.select("conv_id", models.Models().summary(C("texts")).alias("summary"))


@query("""SELECT chunk_id AS ord, raw_transcript AS transcript, 'address' AS pred, label FROM v_radio WHERE label = 'NO_LOCATION' AND confidence <> 'LOW' ORDER BY chunk_id LIMIT 10""")
def q_hallucinated_examples(spark, d):
    rows = view(spark, d, "v_radio").select(C("chunk_id").alias("ord"), text.chat_text("Say where.", C("raw_transcript"), C("label")).alias("text"), F.when(C("confidence") == "LOW", text.NO_LOCATION).otherwise("address").alias("pred"), "label")
    return curate.hallucinated_examples(rows)


@query("""WITH p AS (SELECT k, lower(trim(regexp_extract(addr, '^[0-9]+ ([^,]+)', 1))) AS street FROM v_addr), q AS (SELECT *, k % 3 <> 1 OR k % 9000 + 100 = 77 AS numbers, 2.0 * length(street) / (2 * length(street) + k % 15) > 0.8 AS near FROM p)
SELECT count(*) AS n, round(avg(CASE WHEN numbers AND near THEN 1.0 ELSE 0.0 END), 6) AS street FROM q""")
def q_eval_street(spark, d):
    """The measure of streets: the label's own street with letters added, after the same, another or no number."""
    street = F.regexp_extract("addr", "^[0-9]+ ([^,]+)", 1)
    said = F.concat(F.when(C("k") % 3 == 0, F.concat((C("k") % 9000 + 100).cast("string"), F.lit(" "))).when(C("k") % 3 == 1, F.lit("77 ")).otherwise(F.lit("")), street, F.repeat(F.lit("x"), (C("k") % 15).cast("int")))
    return curate.accuracy(view(spark, d, "v_addr"), said, C("addr")).select("n", "street")


@query("""WITH f AS (SELECT k, addr, k % 6 AS form FROM v_addr) SELECT k, CASE form WHEN 2 THEN concat(addr, '"') WHEN 4 THEN 'NO_LOCATION' WHEN 5 THEN 'NO_LOCATION' ELSE addr END AS address FROM f""")
def q_sanitize_forms(spark, d):
    """Answers as fenced JSON, with a prefix, quoted with a sentence after (quotes go before sentences are cut), with dots, empty, and as a long story."""
    forms = F.array(F.concat(F.lit("```json\n{\"address\": \""), C("addr"), F.lit("\"}\n```")), F.concat(F.lit("Address: "), C("addr")), F.concat(F.lit('"'), C("addr"), F.lit('". It is near. Yes')), F.concat(C("addr"), F.lit("...")), F.lit("  "), F.lit("the caller does not say anything about where this is or what is going on there at all"))
    return view(spark, d, "v_addr").select("k", text.sanitize(F.element_at(forms, (C("k") % 6).cast("int") + 1)).alias("address"))


_NAMES = ["mgm", "mgm grand", "MGM Casino", "Henry Ford", "u of d", "ren cen", "fairlane town center", "fairlane", "Belle  Isle", "nowhere hall", "grand", "little caesars arena"]
_SPOKEN = ["Car 4 to {n} and then {m}, copy", "{n} {m} at the door", "all units, {n}", "nothing said", "{n}; {n}"]


def _spoken(name: str, other: str) -> str:
    """SQL: a transcript that names places."""
    each = " ".join(f"WHEN {i} THEN replace(replace('{t}', '{{n}}', {name}), '{{m}}', {other})" for i, t in enumerate(_SPOKEN))
    return f"CASE event_id % {len(_SPOKEN)} {each} END"


_NAMED = _spoken(_picked(_NAMES, "(event_id // 5)"), _picked(_NAMES, "(event_id // 60)"))


@query(f"""WITH RECURSIVE known AS (SELECT unnest(map_entries(MAP {{{', '.join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in fixed.LANDMARKS.items())}}})) AS e), p AS (SELECT e.key AS phrase, e.value AS v, len(string_split(e.key, ' ')) AS n FROM known),
t AS (SELECT event_id AS k, regexp_extract_all(lower({_NAMED}), '[a-z0-9'']+') AS w FROM events),
m AS MATERIALIZED (SELECT k, i, arg_max(v, n) AS v, max(n) AS n FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM t) x JOIN p ON array_to_string(list_slice(w, i, i + p.n - 1), ' ') = phrase GROUP BY 1, 2),
s AS (SELECT k, CAST(1 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS v, len(w) AS last FROM t UNION ALL SELECT s.k, s.i + coalesce(m.n, 1), m.v, last FROM s LEFT JOIN m ON m.k = s.k AND m.i = s.i WHERE s.i <= last)
SELECT k, string_agg(v, ' | ' ORDER BY i) AS places FROM s WHERE v IS NOT NULL GROUP BY k""")
def q_landmarks_said(spark, d):
    """Landmarks named in free text, the longest name at each place."""
    rows = _said(spark, d)
    known = spark.createDataFrame(list(fixed.LANDMARKS.items()), "phrase string, value string")
    return phrases.found(rows, known, "k", "said").select("k", F.array_join(F.transform("found", lambda m: m["value"]), " | ").alias("places"))


def _said(spark, d):
    k = C("event_id")
    name, other = _pick(_NAMES, F.floor(k / 5)), _pick(_NAMES, F.floor(k / 60))
    each = [F.replace(F.replace(F.lit(t), F.lit("{n}"), name), F.lit("{m}"), other) for t in _SPOKEN]
    said = F.element_at(F.array(*each), (k % len(_SPOKEN)).cast("int") + 1)
    return table(spark, d, "events").select(k.alias("k"), said.alias("said"))
