"""Feeds, GeoJSON layers, queued chunks and logs as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispatchlake.functions import fixed, geo, text

CHUNK = "feed_id string, chunk_path string, timestamp double, transcript string"
FEED = "feed_id string, name string, county string, broadcast_id string, test_url string, enabled boolean"
_FEATURE = "first int, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def enabled_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where(F.coalesce("enabled", F.lit(True)))


def with_stream_url(feeds: DataFrame, pattern: str) -> DataFrame:
    """url: the test URL, else the pattern (with %s) filled with the broadcast id; configured tells if there is one."""
    named = F.when(F.col("broadcast_id") != "REPLACE_ME", F.format_string(pattern, F.col("broadcast_id")))
    return feeds.withColumn("url", F.coalesce(F.nullif("test_url", F.lit("")), named)).withColumn("configured", F.col("url").isNotNull())


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ord, properties, kind, coordinates as JSON text) of a layer's features; a missing file has none.

    A layer is one file, or a folder of files (see `sinks.write_layer`), each of which tells by `first` how its features are numbered.
    """
    try:
        # as text: the reader of JSON goes back to the file for each nested value that is kept as text
        files = spark.read.text(path, wholetext=True).select(F.from_json("value", _FEATURE).alias("layer")).select("layer.*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], _FEATURE)
    each = files.select("first", F.posexplode("features").alias("pos", "f")).withColumn("ord", F.coalesce("first", F.lit(0)) + F.col("pos"))
    return each.select("ord", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def stations(layer: DataFrame) -> DataFrame:
    """(ord, name, short, address, battalion, lat, lng) of a point layer; the geometry tells the place."""
    at = F.from_json("coordinates", "array<double>")
    p = F.col("properties")
    return layer.select("ord", p["Firehouse"].alias("name"), p["FH_Short"].alias("short"), p["Address"].alias("address"), p["Battalion"].alias("battalion"), at[1].alias("lat"), at[0].alias("lng"))


def areas(layer: DataFrame, prefix: str = "", keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(ord, name, label, rings) of a polygon layer: the outer rings; holes are left out."""
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    one = F.from_json("coordinates", "array<array<array<double>>>")
    outer = F.when(F.col("kind") == "MultiPolygon", F.transform(many, lambda p: p[0])).when(F.col("kind") == "Polygon", F.array(one[0]))
    rings = F.transform(outer, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    name = F.coalesce(*[F.col("properties")[k] for k in keys])
    return layer.select("ord", name.alias("name"), F.concat(F.lit(prefix), name).alias("label"), F.coalesce(rings, F.array().cast("array<array<struct<x: double, y: double>>>")).alias("rings"))


def crimes(features: DataFrame, as_of: Column, hours: int = 48, most: int = 500) -> DataFrame:
    """The newest crimes (offense, ts, lat, lng) of the last hours inside the box, with a colour."""
    recent = features.where((F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    inside = recent.where(geo.in_box(F.col("lat"), F.col("lng"), fixed.LAYER_BOX))
    return inside.withColumn("colour", text.crime_colour(F.col("offense"))).orderBy(F.col("ts").desc(), "offense", "lat", "lng").limit(most)


def queued(spark: SparkSession, path: str, schema: str | StructType = CHUNK, stream: bool = False) -> DataFrame:
    """Chunks from a folder of JSON lines; lines that are no JSON are left out."""
    reader = (spark.readStream if stream else spark.read).schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).option("mode", "DROPMALFORMED")
    return reader.json(path)


def log_tail(spark: SparkSession, path: str, n: int, contains: str = "") -> DataFrame:
    """(line, showing, total) the last n lines that contain a text, in any case, oldest first, and how many there are.

    The lines of several files follow each other in the order of the files' names.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    hits = rows.where(F.contains(F.lower("value"), F.lit(contains.lower())))
    order = [F.col(c) for c in ("file", "block", "at")]
    last = hits.orderBy(*[c.desc() for c in order]).limit(n)
    counts = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("showing", F.least("total", F.lit(n)))
    return last.join(F.broadcast(counts), F.lit(True)).orderBy(*order).select(F.col("value").alias("line"), "showing", "total")


STRUCTURED = "has_incident boolean, correlation_action string, incident_id string, incident_type string, priority string, units_added array<string>, units_cleared array<string>, summary_update string"


def structured(answer: Column) -> Column:
    """A model's JSON answer as a struct; code fences go, missing keys get defaults, no JSON is no incident."""
    got = F.from_json(F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), "```(json)?", "")), STRUCTURED)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(got["has_incident"], F.lit(False)).alias("has_incident"), F.coalesce(got["correlation_action"], F.lit("NEW")).alias("correlation_action"), got["incident_id"].alias("incident_id"),
        F.coalesce(got["incident_type"], F.lit("UNKNOWN")).alias("incident_type"), F.coalesce(got["priority"], F.lit("UNKNOWN")).alias("priority"),
        F.coalesce(got["units_added"], none).alias("units_added"), F.coalesce(got["units_cleared"], none).alias("units_cleared"), F.coalesce(got["summary_update"], F.lit("")).alias("summary_update"),
    )
