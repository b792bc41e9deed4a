"""Joins, aggregates, windows, ranks and set operations over incidents, chunks and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.operators import stretches


def where_equal(df: DataFrame, status=None, incident_type=None, county=None, feed_id=None) -> DataFrame:
    """Rows that equal the given values; None asks for nothing."""
    wanted = {"status": status and status.upper(), "incident_type": incident_type and incident_type.upper(), "county": county and county.lower(), "feed_id": feed_id}
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1] is not None], df)


def with_chunk_counts(incidents: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_count for each incident, 0 without chunks; counted before the join."""
    counts = chunks.groupBy("incident_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return incidents.join(counts, "incident_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def since(df: DataFrame, ts: str, as_of: str, interval: str) -> DataFrame:
    return df.where(F.col(ts).cast("timestamp_ntz") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {interval}"))


def counted(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def unit_votes(mentions: DataFrame, assignments: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """(chunk, incident_id, votes): the incident that most units of a chunk are assigned to, the smallest id of equals."""
    votes = mentions.join(assignments, "unit").groupBy(chunk, "incident_id").agg(F.countDistinct("unit").alias("votes"))
    return votes.groupBy(chunk).agg(F.min_by(F.struct("incident_id", "votes"), F.struct(-F.col("votes"), "incident_id")).alias("best")).select(chunk, "best.*")


def live_assignment(mentions: DataFrame, log: DataFrame, ts: str = "ts") -> DataFrame:
    """Mentions (unit, ts) with the incident that the unit was last assigned to and isn't released from or expired.

    log: unit, incident_id (null: released), assigned_at, expires_at. Both sides go through one
    sort by unit and time, so no mention meets all assignments of its unit.
    """
    event = F.struct("incident_id", "expires_at").alias("said")
    said = log.select("unit", F.col("assigned_at").alias("at"), event, F.lit(0).alias("kind"), F.lit(None).cast(mentions.schema).alias("row"))
    asked = mentions.select("unit", F.col(ts).alias("at"), F.lit(None).cast(said.schema["said"].dataType).alias("said"), F.lit(1).alias("kind"), F.struct(*mentions.columns).alias("row"))
    order = Window.partitionBy("unit").orderBy("at", "kind", F.col("said.incident_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = said.unionByName(asked).withColumn("now", F.last("said", ignorenulls=True).over(order)).where("kind = 1")
    live = F.when(F.col("now.expires_at") > F.col("at"), F.col("now.incident_id"))
    return both.select("row.*", live.alias("live_incident"))


def first_of_text(examples: DataFrame) -> DataFrame:
    """One row for each text: the first in the order of prio and ord."""
    return latest(examples, ["text"], [F.col("prio"), F.col("ord")])


def missing_from(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key), key, "left_anti")


def sessions(df: DataFrame, key: str, ts: str, gap_s: int, tie: str, width: int | None = None) -> DataFrame:
    """session number of each row: a new one after a gap of `gap_s` seconds or more."""
    rows = stretches.before(stretches.cut_up(df, ts, width), key, [ts, tie], [ts])
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"_before.{ts}").cast("timestamp"))
    new = F.when(gap < gap_s * 1_000_000, 0).otherwise(1)
    return stretches.running_sum(rows, key, [ts, tie], new, "session").select(*df.columns, "session")


def context_tail(df: DataFrame, key: str, order: str, text: str, words: int = 30, valid_s: int | None = None, width: int | None = None) -> DataFrame:
    """tail: the last words of the text before, of the same key, if that isn't too old."""
    rows = stretches.before(stretches.cut_up(df, order, width), key, [order], [order, text])
    before = F.col(f"_before.{text}")
    if valid_s is not None:
        before = F.when(F.unix_timestamp(F.col(order).cast("timestamp")) - F.unix_timestamp(F.col(f"_before.{order}").cast("timestamp")) < valid_s, before)
    said = F.filter(F.split(before, " "), lambda w: w != "")
    return rows.withColumn("tail", F.when(before.isNotNull(), F.array_join(F.slice(said, F.greatest(F.size(said) - words + 1, F.lit(1)), words), " "))).select(*df.columns, "tail")


def failure_backoff(df: DataFrame, key: str, ts: str, failed: Column, first_s: int = 5, most_s: int = 120, width: int | None = None) -> DataFrame:
    """run (failures in a row so far) and wait_s of each row; a success ends a run."""
    rows = stretches.run_lengths(stretches.cut_up(df, ts, width), key, [ts], failed, "run")
    wait = F.when(F.col("run") > 0, F.least(F.lit(most_s), first_s * F.pow(F.lit(2), F.least(F.col("run") - 1, F.lit(20))).cast("int"))).otherwise(0)
    return rows.withColumn("wait_s", wait).select(*df.columns, "run", "wait_s")


def seeded_order(key: Column, seed: str) -> Column:
    """An order that looks random and is the same each time."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))


def sort_modes(incidents: DataFrame) -> DataFrame:
    """The ranks by which incidents are listed: priority_rank and updated."""
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).when(F.col("priority") == "LOW", 2).otherwise(3)
    return incidents.withColumns({"priority_rank": rank, "updated": F.coalesce("last_updated", "opened_at")})


def active_and_resolved(incidents: DataFrame, resolved: int = 3) -> DataFrame:
    done = incidents.where("status = 'RESOLVED'").orderBy(F.col("last_updated").desc(), "incident_id").limit(resolved)
    return incidents.where("status = 'ACTIVE'").unionByName(done)


def latest_state(events: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """The last value that isn't null of each column, for each key."""
    order = F.struct(ts, tie)
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_events"))


def unit_sets(events: DataFrame, key: str) -> DataFrame:
    """units: what is left after adding and clearing units (arrays added, cleared) in the order of (ts, ord).

    A unit is present if it was last added, not cleared; what one event adds and clears is gone.
    """
    each = events.select(key, "ts", "ord", F.explode(F.concat(F.transform(F.coalesce("added", F.array().cast("array<string>")), lambda u: F.struct(u.alias("unit"), F.lit(0).alias("gone"))), F.transform(F.coalesce("cleared", F.array().cast("array<string>")), lambda u: F.struct(u.alias("unit"), F.lit(1).alias("gone"))))).alias("e"))
    last = each.groupBy(key, F.col("e.unit").alias("unit")).agg(F.max(F.struct("ts", "ord", "e.gone")).alias("last"))
    return last.where("last.gone = 0").groupBy(key).agg(F.sort_array(F.collect_list("unit")).alias("units"))


def capped_chunk_ids(chunks: DataFrame, most: int = 500) -> DataFrame:
    """chunk_ids of each incident, oldest first, the last `most` of them."""
    kept = latest(chunks, ["incident_id"], [F.col("ts").desc(), F.col("chunk_id").desc()], most)
    return kept.groupBy("incident_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "chunk_id"))), lambda r: r["chunk_id"]).alias("chunk_ids"))


def time_to_stale(idle_s: Column, stale_s: int = 172_800) -> Column:
    left = F.greatest(F.lit(stale_s) - idle_s, F.lit(0))
    return F.struct(F.floor(left / 3600).alias("hours"), F.floor(left % 3600 / 60).alias("minutes"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * left / stale_s)).alias("pct"))


def ring_buffer(events: DataFrame, ts: str, tie: str, most: int = 1000) -> DataFrame:
    return events.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(most).orderBy(ts, tie)
