"""The folder that driver and executors share, for streams and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one that goes with a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="dispatchlake-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        named = _own[app]
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to a new folder and read it back, so that several uses share one computation."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `folder` named, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_stream(stream: DataFrame, label: str, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over what there is now into the shared folder, and read its rows.

    With keys, the stream's last row of each key counts (update or complete mode); else all rows do.
    """
    spark, out = stream.sparkSession, folder(stream.sparkSession, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    if keys is None:
        writer.format("parquet").option("path", f"{out}/rows").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/part={number}")

    writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows/part=*")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
