"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range and no other, so its
size grows with the text, two texts of very unequal length can be compared, and the sketch of
two texts together is the union of theirs. Short texts may have no hash below the threshold; so
a sketch also has a digest of all its shingles, which decides where neither of two sketches
keeps a hash: such texts are alike only if they have equal shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.llm.common import words_of

SHINGLE = 5
FRACTION = 4  # one hash in so many
RANGE = 2**31
#: bytes of text that one part of the ordered documents has, about
PART_BYTES = 32 << 20


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """A 31-bit hash of each run of `shingle` words; of all words, if they are fewer; none for none."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
    each = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, F.lit(shingle))), 33).cast("int"))
    return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<int>"))


def sketch(hashes: Column, fraction: int = FRACTION) -> Column:
    """struct(digest, hashes) from ascending distinct hashes."""
    return F.struct(F.xxhash64(hashes).alias("digest"), F.filter(hashes, lambda h: h < F.lit(RANGE // fraction)).alias("hashes"))


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Add the sketch of a text column; a null text has the sketch of an empty one."""
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn("_hashes", F.sort_array(F.array_distinct(shingle_hashes(F.col("_words"), shingle))))
    return df.withColumn(name, sketch(F.col("_hashes"), fraction)).drop("_words", "_hashes")


def _unless_bare(estimate: Column, kept: Column, a: Column, b: Column) -> Column:
    """The estimate where hashes are kept; else 1 for equal digests and 0 for others; null if a sketch is."""
    bare = F.when(a["digest"] == b["digest"], F.lit(1.0)).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))
    return F.when(kept > 0, estimate).otherwise(bare)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, from 0 to 1; 1 for two without words."""
    both, all_ = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(a["hashes"]) + F.size(b["hashes"])
    return _unless_bare(both / (all_ - both), all_, a, b)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too, whatever the size of b."""
    both, own = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(a["hashes"])
    return _unless_bare(both / own, own, a, b)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together; its digest is 0 unless theirs are equal."""
    digest = F.when(a["digest"] == b["digest"], a["digest"]).otherwise(F.lit(0).cast("long"))
    return F.struct(digest.alias("digest"), F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def as_text(a: Column) -> Column:
    """16 hex digits of the digest, then 8 of each hash."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(a["digest"], 16), F.array_join(F.transform(a["hashes"], lambda h: digits(h, 8)), ""))


def _part(bounds: list[int]) -> Column:
    """How many of the ascending bounds are not beyond doc_id, by binary search; 0 for null."""
    n, cuts = max(1, len(bounds)), F.lit(bounds or [0]).cast("array<long>")
    steps = F.lit([1 << k for k in range(n.bit_length() - 1, -1, -1)])
    beyond = lambda k: (k <= n) & (F.try_element_at(cuts, k) <= F.col("doc_id"))
    return F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.coalesce(beyond(k + step), F.lit(False)), k + step).otherwise(k))


def _parts(docs: DataFrame, part_bytes: int) -> int:
    """How many parts documents are dealt to: by the bytes of their texts, and no fewer than there are shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def _followed(docs: DataFrame, parts: int) -> DataFrame:
    """Documents with the text and sketch of the next one in the order of doc_id; the first follows the last.

    Rows are dealt out by quantiles of doc_id, lowered or raised to the least doc_id of each
    part, and each part is one task's. The first row of a part is dealt to the part before it as
    well, where it only follows the last row.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    wanted = [k / parts for k in range(parts)]
    near = ids.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", wanted, 0.2 / parts)
    near = sorted({min(int(x), 2**63 - 1) for x in near})
    bounds = sorted(r.least for r in ids.groupBy(_part(near)).agg(F.min("doc_id").alias("least")).collect())
    n, cuts = max(1, len(bounds)), F.lit(bounds or [0]).cast("array<long>")
    rows = docs.withColumn("part", _part(bounds))
    first = F.coalesce(F.try_element_at(cuts, F.nullif(F.col("part"), F.lit(0))) == F.col("doc_id"), F.lit(False)) if bounds else F.lit(False)
    before = F.when(F.col("part") == 1, F.lit(n)).otherwise(F.col("part") - 1)
    own, copy = F.struct(F.col("part").alias("at"), F.lit(0).alias("copy")), F.struct(before.alias("at"), F.lit(1).alias("copy"))
    rows = rows.withColumn("place", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))).select("doc_id", "text", "own", "place.*")
    order = Window.partitionBy("at").orderBy("copy", "doc_id", "text")
    follows = lambda c: F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order))
    rows = rows.repartitionById(n + 1, F.col("at").cast("int"))
    return rows.withColumn("next_text", follows("text")).withColumn("next", follows("own")).where("copy = 0").drop("at", "copy")


def fingerprint_edits(docs: DataFrame, parts: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of `docs`: its fingerprint, and that of its text with the last quarter replaced.

    The last floor(n_chars / 4) code points give way to the first as many (or all) of the next
    document in ascending doc_id; after the last comes the first. Rows that repeat a doc_id
    follow each other in the order of their texts. A null text is empty. A null doc_id has no
    next document: its text stays as it is and near_next is null. An empty table gives an empty
    result. A text of any length is one row in a task, with 4 bytes for each shingle; parts hold
    about `part_bytes` of text unless their number is given. Only doc_id and text are read, so
    other columns may have any name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _followed(with_sketch(rows, "text", "own"), parts or _parts(rows, part_bytes))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    whole = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumn("edited_text", F.coalesce(whole, "text")).withColumn("n_chars", n.cast("long")).drop("text", "next_text")
    rows = with_sketch(rows, "edited_text", "edited")
    own, edited, following = F.col("own"), F.col("edited"), F.col("next")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
        containment(own, edited).alias("in_edited"), containment(own, following).alias("in_next"),
    )
