"""Structured Streaming jobs: hourly counters, replays, retries and incidents that end by a timer in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: keyed state needs a store with several columns
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RETRY_S, RETRY_TRIES, RETRY_QUEUE = 600, 3, 10
#: seconds after which the store forgets a queue that no row has touched
QUEUE_TTL_S = 3_600


def hourly(stream: DataFrame, ts: str, keys: list[str], sums: dict, late: str = "1 hour") -> DataFrame:
    """Additive counters for each hour and key; sums: name to column."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = rows.groupBy(F.window("_ts", "1 hour").alias("w"), *keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *keys, *sums)


def without_replays(stream: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it comes again within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def bursts(stream: DataFrame, ts: str, key: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


class RetryQueue(StatefulProcessor):
    """Of each feed the chunks to try again: at most ten, for ten minutes, three times.

    A new chunk of the feed first drains the queue, oldest first; a row comes out for every
    attempt, and for chunks that are given up (outcome dropped, expired or exhausted). Ages are
    event time; with `forget`, the store also drops the queue of a feed that has been silent for `QUEUE_TTL_S`.
    """

    def __init__(self, forget: bool = False) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "chunk_id long, attempt int, queued_at double", ttlDurationMs=QUEUE_TTL_S * 1000 if self.forget else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "chunk_id"]).itertuples():
            now = r.ts.timestamp()
            waiting, held = sorted(held, key=lambda x: (x[2], x[0])), []
            for chunk, attempt, at in waiting:
                if now - at > RETRY_S:
                    out.append((key[0], chunk, attempt, "expired"))
                elif attempt >= RETRY_TRIES:
                    out.append((key[0], chunk, attempt, "exhausted"))
                else:
                    out.append((key[0], chunk, attempt + 1, "retried"))
                    if r.action == "UNASSOCIATED":  # what it failed for still holds
                        held.append((chunk, attempt + 1, at))
            if r.action == "UNASSOCIATED":
                held.append((int(r.chunk_id), 0, now))
                held.sort(key=lambda x: (x[2], x[0]))
                while len(held) > RETRY_QUEUE:
                    chunk, attempt, _ = held.pop(0)
                    out.append((key[0], chunk, attempt, "dropped"))
        self.queue.put(held) if held else self.queue.clear()
        yield pd.DataFrame(out, columns=["feed_id", "chunk_id", "attempt", "outcome"])

    def close(self) -> None:
        pass


def retries(stream: DataFrame, forget: bool = False) -> DataFrame:
    """(feed_id, chunk_id, attempt, outcome) from chunks (chunk_id, feed_id, ts, action).

    forget is for jobs that run on: a run over what there is now would wait for state to expire.
    """
    stream.sparkSession.conf.set(*next(iter(STORE.items())))
    rows = stream.select("chunk_id", "feed_id", F.col("ts").cast("timestamp").alias("ts"), "action")
    return rows.groupBy("feed_id").transformWithStateInPandas(RetryQueue(forget), "feed_id string, chunk_id long, attempt int, outcome string", "Append", "ProcessingTime" if forget else "None")


class Lives(StatefulProcessor):
    """The open incident of a feed and type: chunks join it until it has been idle for too long, then it ends by itself.

    A timer in event time stands at the end of the idle time and moves with each chunk. When the watermark
    passes it, the incident is resolved as of then and its state goes, though no chunk of the key ever
    comes again. A chunk after that end resolves it too, if the watermark lags; so batches of any size give the same rows.
    """

    def __init__(self, idle_s: int) -> None:
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "incident_id long, last long, n int")

    def _ended(self, key, state: tuple) -> tuple:
        return (*key, state[0], None, "RESOLVE", state[2], pd.Timestamp(state[1] + self.idle_ms, unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.open.get() if self.open.exists() else None, []
        if state:
            self.handle.deleteTimer(state[1] + self.idle_ms)
        for r in pd.concat(list(rows)).sort_values(["ts", "chunk_id"]).itertuples():
            now = int(r.ts.timestamp() * 1000)
            if state and now - state[1] > self.idle_ms:
                out.append(self._ended(key, state))
                state = None
            action = "UPDATE" if state else "NEW"
            state = (state[0], max(state[1], now), state[2] + 1) if state else (int(r.chunk_id), now, 1)
            out.append((*key, state[0], int(r.chunk_id), action, state[2], r.ts))
        self.open.update(state)
        self.handle.registerTimer(state[1] + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        self.open.clear()
        yield self._frame([self._ended(key, state)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["feed_id", "incident_type", "incident_id", "chunk_id", "action", "n_chunks", "at"])
        return out.astype({"chunk_id": "Int64"})

    def close(self) -> None:
        pass


def lives(stream: DataFrame, idle_s: int = 172_800, late: str = "10 minutes") -> DataFrame:
    """(feed_id, incident_type, incident_id, chunk_id, action, n_chunks, at) from chunks (feed_id, incident_type, chunk_id, ts).

    NEW and UPDATE have their chunk and its time; RESOLVE has no chunk, and the time at which the idle time ended. An
    incident that is idle when the watermark (the largest time less `late`) has passed that end is resolved. Chunks
    behind the watermark are left out. A restart from the checkpoint goes on with timers and state as they were.
    """
    stream.sparkSession.conf.set(*next(iter(STORE.items())))
    rows = stream.select("feed_id", "incident_type", "chunk_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    out = "feed_id string, incident_type string, incident_id long, chunk_id long, action string, n_chunks int, at timestamp"
    return rows.groupBy("feed_id", "incident_type").transformWithStateInPandas(Lives(idle_s), out, "Append", "EventTime")
