"""Chunks decided as they come: each micro-batch is scored against all open incidents, whatever their feed, and changes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispatchlake.operators import admin, correlate
from dispatchlake.scratch import remove

_SIDE = {"feed_id": "i_feed", "incident_type": "i_type", "address": "i_address", "lat": "i_lat", "lng": "i_lng", "units": "i_units"}


class LiveIncidents:
    """The incidents of a live feed, as a table with a version for each micro-batch, under one shared folder.

    Batch n reads version n, decides its chunks by all signals (`correlate.decide`), and writes version n + 1 and its
    decisions. Both are written over if the batch comes again after a failure, and what a batch reads is never written
    by it, so each chunk counts once. Chunks of one batch don't see the incidents that the others open: a
    batch is as long as that may take. The version before the one read is deleted.

    first: incidents to begin with (batch 0 reads them), columns of `admin.KEPT`. With `idle_s`, active incidents that have
    been idle for longer than that at the batch's earliest chunk are resolved first. An empty batch changes nothing.
    """

    def __init__(self, first: DataFrame, path: str, idle_s: int | None = 172_800) -> None:
        self.spark, self.path, self.idle_s = first.sparkSession, path.rstrip("/"), idle_s
        self.first = first.select(*admin.KEPT)

    def _version(self, n: int | str) -> str:
        return f"{self.path}/incidents-{n}"

    def incidents(self, version: int) -> DataFrame:
        """The incidents as batch `version` finds them, that is after `version` batches."""
        return self.first if version == 0 else self.spark.read.schema(self.first.schema).parquet(self._version(version))

    def now(self) -> DataFrame:
        """The incidents after the last batch that was written whole."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._version('*')}/_SUCCESS")
        whole = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return self.incidents(max((int(f.getPath().getParent().getName().removeprefix("incidents-")) for f in whole or ()), default=0))

    def decisions(self) -> DataFrame:
        """chunk_id, action, incident_id, score, reason of all batches so far, with batch."""
        return self.spark.read.option("basePath", f"{self.path}/decisions").parquet(f"{self.path}/decisions/batch=*")

    def take(self, batch: DataFrame, number: int) -> None:
        """Decide a batch and write what follows from it."""
        chunks, before = batch.persist(), self.incidents(number)
        try:
            if self.idle_s is not None:
                began = chunks.agg(F.min("ts")).first()[0]  # one value
                before = before if began is None else admin.resolve_stale(before, F.lit(began), self.idle_s)
            decided_at = f"{self.path}/decisions/batch={number}"
            told = correlate.decide(chunks, before.withColumnsRenamed(_SIDE))
            told.select("chunk_id", "action", "incident_id", "score", "reason").write.mode("overwrite").parquet(decided_at)
            decided = self.spark.read.parquet(decided_at)
            after = admin.applied(before, chunks, decided)
            after.select(*[F.col(f.name).cast(f.dataType) for f in self.first.schema]).write.mode("overwrite").parquet(self._version(number + 1))
        finally:
            chunks.unpersist()
        if number > 1:
            remove(self.spark, self._version(number - 1))

    def run(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Start on a stream of chunks (see `correlate.decide` and `admin.applied`); trigger as in `DataStreamWriter.trigger`."""
        writer = stream.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.take)
        return (writer.trigger(**trigger) if trigger else writer).start()
