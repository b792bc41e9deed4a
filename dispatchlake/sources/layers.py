"""Map layers, cached reads of them, hint files and queues whose lines may be broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions import fixed
from dispatchlake.sources import feeds

#: seconds for which a fetched layer is used again
FRESH_S = {"crimes": 86_400, "outages": 900}


def outages(features: DataFrame, as_of: Column, box=fixed.LAYER_BOX, most: int = 500) -> DataFrame:
    """Outage areas (ord, rings) whose bounds meet the box, at most so many, with their number and the time of the read."""
    ends = lambda f, axis: f(F.transform(F.flatten("rings"), lambda p: p[axis]))
    meets = (ends(F.array_max, "y") >= box[0]) & (ends(F.array_min, "y") <= box[1]) & (ends(F.array_max, "x") >= box[2]) & (ends(F.array_min, "x") <= box[3])
    kept = features.where(meets).orderBy("ord").limit(most)
    count = kept.agg(F.count(F.lit(1)).alias("_count"))
    return kept.join(F.broadcast(count), F.lit(True)).withColumn("_fetched_at", as_of)


def read_through(cache: DataFrame, source: DataFrame, as_of: Column, default_s: int = 86_400) -> DataFrame:
    """Cached rows (dataset, fetched_at, ...) that are young enough, and for other datasets the source's (dataset, ...) at `as_of`; hit tells which."""
    ages = F.create_map(*[F.lit(x) for pair in FRESH_S.items() for x in pair])
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    fresh = cache.where(age < F.coalesce(F.try_element_at(ages, F.col("dataset")), F.lit(default_s))).withColumn("hit", F.lit(True))
    read = source.join(fresh.select("dataset").distinct(), "dataset", "left_anti").withColumns({"fetched_at": as_of.cast(cache.schema["fetched_at"].dataType), "hit": F.lit(False)})
    return fresh.unionByName(read)


def invalidated(cache: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """A cache without a dataset, and one row on what happened: an unknown dataset is an error."""
    gone = F.coalesce(F.col("dataset") == dataset, F.lit(False))
    said = cache.agg(F.count_if(gone).alias("removed"))
    return cache.where(~gone), said.withColumn("status", F.when(F.col("removed") > 0, F.lit("ok")).otherwise(F.lit("unknown dataset")))


def layer_frames(spark: SparkSession, folder: str, prefix: str = "Precinct ") -> dict[str, DataFrame]:
    """The layers of a folder of GeoJSON files by name; a layer without a file is empty."""
    read = lambda name: feeds.geojson(spark, f"{folder}/{name}.geojson")
    return {
        "stations": feeds.stations(read("stations")), "precincts": feeds.areas(read("precincts"), prefix, ("name",)),
        "battalions": feeds.areas(read("battalions"), "", ("Label_Name", "Battalion")), "outages": feeds.areas(read("outages")),
    }


def hints(spark: SparkSession, path: str) -> DataFrame:
    """(hints) the whole of a vocabulary file, trimmed; no row without the file."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "value string")
    return rows.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("hints"))


def queue_lines(lines: DataFrame, schema: str = feeds.CHUNK) -> DataFrame:
    """Queued lines (value) as (item, raw): what is no JSON is kept as raw, and item is null."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    good = parsed["_bad"].isNull()
    return lines.select(F.when(good, parsed.dropFields("_bad")).alias("item"), F.when(~good, F.col("value")).alias("raw"))


def feed_status(listed: DataFrame, feed_id: str) -> DataFrame:
    """A feed's row with its state; an unknown feed has one row that says so."""
    asked = listed.sparkSession.range(1).select(F.lit(feed_id).alias("feed_id"))
    state = F.when(F.col("configured").isNull(), F.lit("unknown feed")).when(F.col("configured"), F.lit("configured")).otherwise(F.lit("not configured"))
    return asked.join(listed.where(F.col("feed_id") == feed_id), "feed_id", "left").withColumn("state", state)


def feed_context(feed: Column, names: Column, city: Column, county: Column, note: Column) -> Column:
    """The lines that tell a model about a feed; defaults where nothing is known."""
    known = lambda c, default: F.coalesce(c, F.lit(default))
    d = fixed.DEFAULT_CONTEXT
    return F.concat_ws("\n", F.concat(F.lit("Feed: "), known(names, d[0])), F.concat(F.lit("Primary city/area: "), known(city, d[1])), F.concat(F.lit("County: "), known(county, d[2])), F.concat(F.lit("Geographic context: "), known(note, d[3])))


def label_request(context: Column, confidence: Column, output: Column, transcript: Column) -> Column:
    """What a labeller is asked about one transcript."""
    return F.concat(F.lit("Feed context: "), context, F.lit("\nGeocode confidence of the model's output: "), confidence, F.lit("\nThe model's output: "), output, F.lit("\n\nTranscript:\n"), transcript)


def opening_prompt(hints_text: Column, tail: Column) -> Column:
    """Vocabulary hints and the end of the transmission before, as far as there are any."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" ", some(hints_text), F.concat(F.lit("[Previous transmission: "), some(tail), F.lit("]")))
