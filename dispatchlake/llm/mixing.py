"""Mixing sources to target weights, with DataFrame functions only.

Each source's words stand in a row, document after document, and are packed into blocks of a
fixed length. All slots of the mix are drawn together: a source's slots get places in the mix by
a pseudorandom permutation of all places, and a shard is a stretch of places. So a shard's
counts of the sources are a multinomial draw, held to each source's total over all shards. A
source's slots are numbered; slot j takes, in round j div n, the block at a pseudorandom
permutation of j mod n of its n blocks. How often a block is taken, and by which shard first, is
joined to the documents' blocks by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
ROUNDS = 12
#: slots that one row stands for before they are told apart
CHUNK = 1 << 16


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, sid, source_size, target): one row per source, null last.

    Targets share all words by weight; one that exceeds `cap` times its source's size stops
    there, and the excess is shared anew. With sources in the order of cap to weight, the first
    that does not reach its cap tells the share per weight of all after it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cyclic = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = totals.select("source", "source_size", F.row_number().over(by_name).alias("sid"), cyclic.alias("weight"))
    rows = rows.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    capped = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    rows = rows.withColumn("share", (F.sum("source_size").over(all_) - capped) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("share"), F.col("share"))).over(all_))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return rows.select("source", "sid", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: rounds that swap a place with its mirror image or not."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("turn"), *key, r), n) - x, n)
        coin = F.xxhash64(F.lit("coin"), *key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def draw_slots(sources: DataFrame, block_words: int, shard_blocks: int, cap: int, seed: int) -> DataFrame:
    """(sid, shard, place, slot, block) of every slot; shards have `shard_blocks` slots, the last one the rest.

    A source gets as many slots as blocks come nearest to its target. Slots are made in chunks,
    so a source of any size is spread over the tasks.
    """
    # one row per source: few, whatever the number of documents
    upto = Window.partitionBy().orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    blocks = F.ceil(F.col("source_size") / block_words)
    due = F.least(F.round(F.col("target") / F.col("source_size") * blocks).cast("long"), cap * blocks)
    rows = sources.where("source_size > 0").select("sid", blocks.alias("blocks"), due.alias("due")).where("due > 0")
    rows = rows.withColumn("start", F.sum("due").over(upto) - F.col("due")).withColumn("slots", F.sum("due").over(Window.partitionBy()))
    # a few rows become many: dealt to a number of parts that isn't lowered for their present size
    dealt = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("due") - 1, F.lit(CHUNK).cast("long")))).repartition(dealt, "sid", "chunk")
    slots = chunks.withColumn("slot", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, "due") - 1)))
    place = permuted(F.col("start") + F.col("slot"), F.col("slots"), F.lit(seed), F.lit("place"))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), F.floor(F.col("slot") / F.col("blocks")))
    return slots.select("sid", "slot", place.alias("place"), block.alias("block")).withColumn("shard", F.floor(F.col("place") / shard_blocks))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 9) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, taken, first_shard.

    size counts the words of a text (null: 0); taken counts the words that the mix takes,
    repeats included; first_shard is the first output shard that has words of the document, null
    for none. No block is taken more than `cap` times. A null source is a source of its
    own, the last. Documents of a source follow each other by a hash bucket and then doc_id;
    repeated rows are documents of their own. Empty texts are taken 0 times; if all are empty,
    all targets are 0. A source that is due less than half a block is not taken. An empty table
    gives an empty result. Only doc_id, source and text are read. The same rows give the same mix.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    sources = cut(source_targets(sized, weights, cap), "targets")
    slots = draw_slots(sources, block_words, shard_blocks, cap, seed)
    taken_blocks = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    # places of the documents in their source: sums of buckets, then of documents in a bucket
    buckets = max(1, round(sized.count() ** 0.5))
    named = sized.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    keys = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source"), "sid", F.col("source").alias("name"), "source_size", "target")
    rows = named.join(F.broadcast(keys) if sources.count() <= 10_000 else keys, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    # rows that repeat a document share its bucket: one of them stands for all until the places are told
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("sum")).drop("sum")
    alike = rows.groupBy("sid", "bucket", "doc_id", "tie", "size", "name", "source_size", "target").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("sid", "bucket").orderBy("doc_id", "tie", "size")
    at = F.col("before") + F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("copies")
    each = alike.join(sums, ["sid", "bucket"]).withColumn("at", at).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.withColumn("at", F.col("at") + F.col("nth") * F.col("size"))
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    parts = each.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("at"), F.col("block") * block_words)
    parts = parts.join(taken_blocks.hint("merge"), ["sid", "block"], "left").withColumn("took", F.coalesce(overlap * F.col("times"), F.lit(0)))
    out = parts.groupBy("sid", "at", "nth", "doc_id", "tie", "name", "size", "source_size", "target").agg(F.sum("took").alias("taken"), F.min("shard").alias("first_shard"))
    return out.select("doc_id", F.col("name").alias("source"), "size", "source_size", "target", "taken", "first_shard")
