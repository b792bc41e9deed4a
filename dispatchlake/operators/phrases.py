"""Known phrases in free text (X2, F11, S21): a table of phrases joined by first word, then as a whole; the longest at the leftmost place wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: first words up to this number are broadcast; more are joined by a shuffle
BROADCAST = 100_000


def words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def found(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): for each text that has some the phrases in it, in order, as array<struct<at, n, value>> (first word from 0, words, value).

    phrases: phrase, value; of equal ones the smallest value counts, and those without a word are left out. Matches
    don't overlap: at each place the longest phrase is taken, and the search goes on behind it. A row meets the lengths of
    the phrases that begin with one of its words, never all phrases; so hundreds of thousands of them cost no more. A null key is a key.
    """
    known = phrases.select(words(F.col("phrase")).alias("w"), "value").where(F.size("w") > 0)
    known = known.select(F.col("w")[0].alias("first"), F.size("w").alias("n"), F.array_join("w", " ").alias("said"), "value").groupBy("first", "n", "said").agg(F.min("value").alias("value"))
    heads = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    count, longest = known.agg(F.countDistinct("first"), F.max("n")).first()
    heads = F.broadcast(heads) if count <= BROADCAST else heads
    spoken = words(F.col(text))
    # of each place no more words than the longest phrase has
    places = texts.select(F.struct(key).alias("_key"), spoken.alias("_w")).select("_key", F.posexplode(F.transform("_w", lambda _, i: F.slice(F.col("_w"), i + 1, longest or 1))).alias("at", "ahead"))
    met = places.join(heads, F.col("ahead")[0] == F.col("first")).select("_key", "at", "first", "ahead", F.explode("lengths").alias("n")).where(F.size("ahead") >= F.col("n"))
    met = met.select("_key", "at", "first", "n", F.array_join(F.slice("ahead", 1, F.col("n")), " ").alias("said")).join(known, ["first", "n", "said"])
    best = met.groupBy("_key", "at").agg(F.max_by(F.struct("at", "n", "value"), "n").alias("m"))  # no more rows than places
    ordered = best.groupBy("_key").agg(F.sort_array(F.collect_list("m")).alias("m"))

    def take(s: Column, m: Column) -> Column:
        return F.when(m["at"] >= s["end"], F.struct((m["at"] + m["n"]).alias("end"), F.concat(s["taken"], F.array(m)).alias("taken"))).otherwise(s)

    start = F.struct(F.lit(0).alias("end"), F.filter("m", lambda m: F.lit(False)).alias("taken"))
    return ordered.select(F.col(f"_key.{key}").alias(key), F.aggregate("m", start, take, lambda s: s["taken"]).alias("found"))
