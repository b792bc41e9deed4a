"""Where results go: event tables, JSON lines, log lines and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import fixed, geo

#: features in a file of a layer
LAYER_FILE = 10_000


def events(rows: DataFrame, event: str, key: str, ts: str) -> DataFrame:
    """(event_uuid, event, ts, payload): the same row gives the same id, so replays can be told."""
    uid = F.md5(F.concat_ws("|", F.lit(event), F.col(key).cast("string"), F.col(ts).cast("string")).cast("binary"))
    return rows.select(uid.alias("event_uuid"), F.lit(event).alias("event"), F.col(ts).alias("ts"), F.to_json(F.struct("*")).alias("payload"))


def push(rows: DataFrame, path: str) -> None:
    """Put rows at the end of a queue: a folder of JSON lines that `feeds.queued` reads, as a batch or a stream."""
    write_jsonl(rows, path, "append")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def report(summary: DataFrame) -> DataFrame:
    """A report without its samples."""
    return summary.drop(*[c for c in summary.columns if c.startswith("sample_")])


def log_line(ts: Column, event: Column, *fields: Column, most: int = 120) -> Column:
    """One line of a log: what is null is left out, long fields are cut."""
    return F.concat_ws(" | ", ts.cast("string"), event, *[F.substring(f.cast("string"), 1, most) for f in fields])


def event_line(ts: Column, event: Column, fields: dict[str, list[tuple[str, Column]]]) -> Column:
    """One line of a log: the time, the event and, of the fields named for the event, those that have a value, as name=value."""
    detail = F.lit(None).cast("string")
    for name, own in fields.items():
        said = F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in own])
        detail = F.when(event == name, said).otherwise(detail)
    return F.concat_ws(" ", F.concat(F.lit("["), ts, F.lit("]")), F.concat(F.lit("["), event, F.lit("]")), F.nullif(detail, F.lit("")))


def features(rows: DataFrame) -> DataFrame:
    """GeoJSON features of incidents with a place (incident_id, incident_type, status, priority, address_full, address_raw, summary, county, units, lat, lng)."""
    text_of = lambda c, default="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    kind = text_of("incident_type", "UNKNOWN")
    colours = F.create_map(*[F.lit(x) for pair in fixed.INCIDENT_COLOURS.items() for x in pair])
    address = F.coalesce(F.nullif(F.col("address_full"), F.lit("")), text_of("address_raw"))
    props = F.struct(
        "incident_id", kind.alias("incident_type"), text_of("status", "ACTIVE").alias("status"), text_of("priority", "UNKNOWN").alias("priority"), address.alias("address"), text_of("summary").alias("summary"), text_of("county").alias("county"),
        F.array_join(F.coalesce("units", F.array().cast("array<string>")), ", ").alias("units"), F.coalesce(F.try_element_at(colours, kind), F.lit(fixed.INCIDENT_COLOURS["UNKNOWN"])).alias("color"), F.lit(0).alias("selected"),
    )
    placed = rows.where(geo.present(F.col("lat"), F.col("lng")))
    return placed.select(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))


def write_layer(rows: DataFrame, key: str, path: str, most: int = LAYER_FILE) -> None:
    """Write features (key, a whole number from 0 on, each once; f) as a folder of GeoJSON files, each a collection of at most `most` features by key.

    A file is read by one task, and a collection is one row: so neither grows with the layer. `feeds.geojson` reads the folder as one layer.
    """
    part = F.floor(F.col(key) / most)
    kept = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), F.to_json("f").alias("f"))))
    made = F.concat(F.lit('{"type":"FeatureCollection","first":'), F.format_string("%d", F.col("_part") * most), F.lit(',"features":['), F.array_join(F.transform("_all", lambda x: x["f"]), ","), F.lit("]}"))
    rows.groupBy(part.alias("_part")).agg(kept.alias("_all")).select(made.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def micro_batch_writer(incidents_path: str, chunks_path: str):
    """For foreachBatch: new incidents first, then the chunks that refer to them, under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        opened = batch.where("action = 'NEW'")
        opened.write.mode("overwrite").parquet(f"{incidents_path}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        batch.unpersist()

    return write
