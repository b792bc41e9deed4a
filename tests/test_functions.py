"""Scalar functions, merge and retry against expected values worked out by hand."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import fixed, geo, score, text
from dispatchlake.operators import admin, relational, spatial
from dispatchlake.sources import feeds


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_addresses(spark):
    a = F.col("a")
    rows = [("8 Mile Road, Detroit, MI",), ("a, b, MI",), ("a, b",), ("",), (None,)]
    got = values(spark, rows, "a string", text.address_tokens(a), text.city_of(a), text.has_house_number(a))
    # the stop test precedes the punctuation strip: "Road," and "Detroit," stay
    assert got == [(["mile", "road", "detroit"], "8 Mile Road", True), ([], "a", False), ([], "a", False), ([], "Unknown", False), ([], "Unknown", False)]
    rows = [("14 Warren Ave, Apt 3",), ("Belle Isle.",), ("Hart Plaza, downtown",), ("Oak Manor",), ("Oak and Manor",), ("5 Oak Manor",)]
    got = values(spark, rows, "a string", text.strip_unit_suffix(a), text.resolve_landmark(a), text.is_named_place(a))
    assert [g[0] for g in got[:1]] == ["14 Warren Ave"]
    assert [g[1] for g in got[1:3]] == ["Belle Isle Park, Detroit, MI", "Hart Plaza, Detroit, MI"]
    assert [g[2] for g in got[3:]] == [True, False, False]


def test_units(spark):
    rows = [("E-30",), ("5",), ("UNIT",), ("WARREN 12",), ("1-2-3",), ("XYZ",), ("DFD:MEDIC 4",)]
    got = values(spark, rows, "u string", text.unit_valid(F.col("u")))
    assert [g[0] for g in got] == [True, False, False, False, False, False, True]
    got = values(spark, [("DFD:E-30", "wayneco_dearborn"), ("E-1", "nowhere")], "u string, f string", text.namespaced(F.col("u"), F.col("f")), text.unit_ttl(F.col("f")))
    assert got == [("DBN:E-30", 28800), ("UNK:E-1", 28800)]
    got = values(spark, [("ENGINE 01", "E-1")], "n string, s string", text.unit_variants(F.col("n"), F.col("s")))
    assert "ENG01" in got[0][0] and "E 1" in got[0][0] and "ENGINE 1" not in got[0][0]


def test_answers(spark):
    said = ['```json\n{"address": "5 Oak St"}\n```', "Address: 5 Oak St", '"5 Oak St". It is near. Yes', "", "somewhere over the far hills", " ".join(["w1"] * 13)]
    got = values(spark, [(s,) for s in said], "s string", text.sanitize(F.col("s")))
    assert [g[0] for g in got[:2]] == ["5 Oak St", "5 Oak St"]
    assert [g[0] for g in got[3:]] == ["NO_LOCATION"] * 3
    ids = F.array(F.lit("abc1"), F.lit("def2"))
    got = values(spark, [("MATCH:def",), ("match zzz",), ("RETRY later",), ("?",)], "s string", text.decision_of(F.col("s"), ids))
    assert [tuple(g[0]) for g in got] == [("MATCH", "def2"), ("MATCH", "abc1"), ("RETRY", None), ("NEW", None)]
    got = values(spark, [("fire at 9 Oak Street", "9 Oak Street, X"), ("nothing", "9 Oak Street, X"), ("x", "NO_LOCATION")], "t string, a string", text.checked_extraction(F.col("t"), F.col("a")))
    assert [g[0]["address"] for g in got] == ["9 Oak Street, X", "NO_LOCATION", "NO_LOCATION"]


def test_street_match(spark):
    pairs = [("5 Oak Street, X", "5 Oak Streat, X"), ("5 Oak Street", "6 Oak Street"), ("NO_LOCATION", "NO_LOCATION"), ("5 Oak", "NO_LOCATION"), ("Elm", "Willow")]
    got = values(spark, pairs, "a string, b string", text.street_match(F.col("a"), F.col("b")))
    assert difflib.SequenceMatcher(None, "oak street", "oak streat").ratio() > 0.8
    assert [g[0] for g in got] == [True, False, True, False, False]


def test_scores(spark):
    km = [0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
    got = values(spark, [(x,) for x in km], "x double", geo.proximity(F.col("x")))
    assert [g[0] for g in got] == [1.0, 0.85, 0.65, 0.40, 0.15, 0.0]
    got = values(spark, [(x,) for x in (0.85, 0.50, 0.20, 0.19)], "x double", score.classify(F.col("x")))
    assert [g[0] for g in got] == ["STRONG_MATCH", "WEAK_MATCH", "AMBIGUOUS", "NO_MATCH"]
    got = values(spark, [(n,) for n in (0, 1, 2, 3, 4, 6)], "n int", score.should_summarise(F.col("n")))
    assert [g[0] for g in got] == [True, True, False, True, False, True]
    got = values(spark, [("MEDICAL", "SHOOTING"), ("SHOOTING", "MEDICAL"), ("MEDICAL", "MEDICAL"), (None, "MEDICAL")], "a string, b string", score.incompatible(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, True, False, False]
    assert len(fixed.INCOMPATIBLE) == 14


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]])
    points = [(1.0, 1.0), (0.5, 2.0), (3.5, 2.9), (2.0, 3.0), (5.0, 1.0)]
    got = values(spark, points, "x double, y double", geo.in_ring(F.col("x"), F.col("y"), ring))
    assert [g[0] for g in got] == [True, True, True, False, False]


def test_radius_join_finds_all(spark):
    import math
    import random

    rng = random.Random(5)
    left = [(i, rng.uniform(41.9, 42.1), rng.uniform(-83.2, -83.0)) for i in range(150)]
    right = [(i, rng.uniform(41.9, 42.1), rng.uniform(-83.2, -83.0)) for i in range(150)] + [(999, 0.0, 0.0)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    found = spatial.within_radius(spark.createDataFrame(left, "l long, lat double, lng double"), spark.createDataFrame(right, "r long, r_lat double, r_lng double"), 3.0)
    assert {(x.l, x.r) for x in found.collect()} == {(a, b) for a, y, x in left for b, v, u in right if km(y, x, v, u) <= 3.0}


def test_stations(spark):
    stations = spark.createDataFrame([(0, "ENGINE 01", "E-1", "1", 42.0, -83.0), (1, "LADDER 02", "L-2", "2", 42.1, -83.0), (2, None, None, None, 42.0, -83.0)], "ord int, name string, short string, battalion string, lat double, lng double")
    chunks = spark.createDataFrame([(1, 42.0, -83.0, ["DFD:E-1", "lad 02"]), (2, 42.5, -83.0, ["e1"]), (3, 42.0, -83.0, ["nobody"])], "k long, lat double, lng double, units array<string>")
    index = spatial.station_index(stations)
    away = {r.k: (r.unit, r.verdict) for r in spatial.unit_distances(chunks, index).collect()}
    assert away == {1: ("DFD:E-1", "plausible"), 2: ("e1", "invalid"), 3: (None, None)}
    place = {r.k: (round(r.lat, 3), r.battalion) for r in spatial.inferred_location(chunks, index).collect()}
    assert place == {1: (42.05, "1"), 2: (42.0, "1")}


def test_merge(spark):
    incidents = spark.createDataFrame([("a", ["E-1"], ["M-1"]), ("b", ["E-2", "E-1"], None), ("c", [], [])], "incident_id string, units array<string>, units_cleared array<string>")
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "chunk_id long, incident_id string")
    kept, moved, _ = admin.merge(incidents, chunks, chunks, "a", "b")
    assert {r.incident_id: (r.units, r.units_cleared) for r in kept.collect()} == {"b": (["E-1", "E-2"], ["M-1"]), "c": ([], [])}
    assert sorted((r.chunk_id, r.incident_id) for r in moved.collect() if r.incident_id) == [(1, "b"), (2, "b")]
    with pytest.raises(ValueError):
        admin.merge(incidents, chunks, chunks, "a", "a")
    with pytest.raises(LookupError):
        admin.merge(incidents, chunks, chunks, "a", "zz")


def test_unit_sets_and_context(spark):
    rows = [("i", 1, 1, ["A", "B"], None), ("i", 2, 2, ["C"], ["A"]), ("i", 3, 3, ["A"], ["A"])]
    got = relational.unit_sets(spark.createDataFrame(rows, "k string, ts int, ord int, added array<string>, cleared array<string>"), "k").collect()
    assert [(r.k, r.units) for r in got] == [("i", ["B", "C"])]


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"feed_id": "f", "transcript": "x"}\nnot json\n')
    assert feeds.queued(spark, str(tmp_path / "q.json")).count() == 1
    assert feeds.geojson(spark, str(tmp_path / "none.geojson")).count() == 0
    layer = '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Firehouse": "ENGINE 01", "FH_Short": "E-1", "Lat": -83.0}, "geometry": {"type": "Point", "coordinates": [-83.05, 42.33]}}]}'
    (tmp_path / "s.geojson").write_text(layer)
    station = feeds.stations(feeds.geojson(spark, str(tmp_path / "s.geojson"))).first()
    assert (station.name, station.lat, station.lng) == ("ENGINE 01", 42.33, -83.05)
    got = values(spark, [('```json\n{"has_incident": true}\n```',), ("?",)], "s string", feeds.structured(F.col("s")))
    assert [(g[0]["has_incident"], g[0]["priority"]) for g in got] == [(True, "UNKNOWN"), (False, "UNKNOWN")]


def test_similar_against_difflib_and_few_pairs_reach_python(spark, monkeypatch):
    rng = random.Random(8)
    names = ["woodward avenue", "gratiot", "west warren road", "é", "", "aaaa", "abab" * 60, "x" * 230]
    edit = lambda s: "".join(c for c in s if rng.random() > 0.1) + rng.choice(["", "e", " st"])
    pairs = [(a, rng.choice([edit(a), edit(rng.choice(names)), a])) for a in names * 60] + [(None, None), (None, "a"), ("", "")]
    want = [difflib.SequenceMatcher(None, a or "", b or "").ratio() > 0.8 for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    assert [r.s for r in df.select("i", text.similar(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()] == want
    monkeypatch.setattr(text, "similarity", lambda a, b: F.lit(None).cast("double"))
    left = df.where(text.similar(F.col("a"), F.col("b")).isNull()).count()
    assert 0 < left < len(pairs) / 2  # what columns alone don't decide
