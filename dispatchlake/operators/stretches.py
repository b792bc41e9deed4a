"""Windows over few, long keys without one task per key (W5, W7, W9): stretches of the order, then what is carried from stretch to stretch.

A key's rows are cut into stretches of their order (of time, or of a number). Windows run within (key, stretch);
one row per stretch says what it hands on; windows over those rows, a fraction of all, tell what each stretch
starts with. Rows meet that by an equi-join on (key, stretch), by which they are dealt already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: seconds, or units of a number, of one stretch
SECONDS, UNITS = 86_400, 4_096
STRETCH = "_stretch"


def cut_up(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """Rows with the number of their stretch; those without a place in the order come first."""
    kind = df.schema[order].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    at = F.unix_timestamp(F.col(order).cast("timestamp")) if timed else F.col(order)
    number = F.floor(at / (width or (SECONDS if timed else UNITS))).cast("long")
    return df.withColumn(STRETCH, F.coalesce(number, F.lit(-(2**63))))


def _with_carry(rows: DataFrame, key: str, carry: DataFrame) -> DataFrame:
    """Rows with the columns that `carry` has for their key and stretch; a null key is a key."""
    named = carry.withColumnsRenamed({key: "_key", STRETCH: "_of"})
    return rows.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col(STRETCH) == F.col("_of"))).drop("_key", "_of")


def before(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str = "_before") -> DataFrame:
    """Stretched rows with a struct of the columns of the row before, of the same key; null for the first."""
    said = F.struct(*columns)
    within = Window.partitionBy(key, STRETCH).orderBy(*order)
    last = rows.groupBy(key, STRETCH).agg(F.max_by(said, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy(STRETCH))).drop("_last")
    own = rows.withColumn(name, F.lag(said).over(within)).withColumn("_n", F.row_number().over(within))
    return _with_carry(own, key, carry).withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col(name))).drop("_n", "_carry")


def running_sum(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Stretched rows with the sum of a value up to their place, of the same key."""
    rows = rows.withColumn("_v", value)
    totals = rows.groupBy(key, STRETCH).agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(key).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    own = rows.withColumn(name, F.sum("_v").over(Window.partitionBy(key, STRETCH).orderBy(*order)))
    return _with_carry(own, key, carry).withColumn(name, F.col(name) + F.col("_carry")).drop("_v", "_carry")


def run_lengths(rows: DataFrame, key: str, order: list[str], hit: Column, name: str) -> DataFrame:
    """Stretched rows with how many hits in a row end at their place, of the same key; no hit, null included, ends a run."""
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    miss, one = F.sum((~F.col("_hit")).cast("long")), F.sum(F.col("_hit").cast("long"))
    within = Window.partitionBy(key, STRETCH).orderBy(*order)
    own = rows.withColumn("_run", miss.over(within))
    own = own.withColumn(name, one.over(Window.partitionBy(key, STRETCH, "_run").orderBy(*order)))
    ends = own.groupBy(key, STRETCH).agg(F.max("_run").alias("_ended"), F.max_by(name, F.struct("_run", name)).alias("_tail"))
    # a stretch without a miss goes on with the run that it starts with
    ends = ends.withColumn("_g", F.sum((F.col("_ended") > 0).cast("long")).over(Window.partitionBy(key).orderBy(STRETCH)))
    ends = ends.withColumn("_sum", F.sum("_tail").over(Window.partitionBy(key, "_g").orderBy(STRETCH)))
    carry = ends.select(key, STRETCH, F.coalesce(F.lag("_sum").over(Window.partitionBy(key).orderBy(STRETCH)), F.lit(0)).alias("_carry"))
    return _with_carry(own, key, carry).withColumn(name, F.col(name) + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)).drop("_run", "_hit", "_carry")
