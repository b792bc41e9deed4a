"""Training examples, model comparison, evaluation and gates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import score, text
from dispatchlake.operators.relational import seeded_order

NO_LOCATION = text.NO_LOCATION


def _n(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def label_queues(rows: DataFrame) -> dict[str, DataFrame]:
    """Unlabelled chunks worth a review: raw_transcript, label, confidence, reviewed."""
    open_ = rows.where(~F.col("reviewed"))
    length = F.length("raw_transcript")
    return {
        "mile": open_.where(F.col("raw_transcript").rlike("[0-9]+ Mile") & (length > 20)),
        "medium": open_.where((F.col("confidence") == "MEDIUM") & (length > 20)),
        "noloc": open_.where((F.col("label") == NO_LOCATION) & (length > 20) & (length < 600)),
        "high": open_.where((F.col("confidence") == "HIGH") & (length > 20)),
    }


def sampled(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in an order that looks random and is the same each time."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def _nth(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """nth: 0 for the first in the seeded order, found without sorting all rows in one task.

    Rows are counted by the first four digits of their hash; a row's place is what the digits
    before it count and its place among its own.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("_order", seeded_order(F.col(key), seed)).withColumn("_head", F.substring("_order", 1, 4))
    heads = rows.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_head")) - F.col("_n")
    heads = heads.select("_head", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_head").orderBy("_order", key)) - 1
    return rows.join(heads, "_head").withColumn("nth", F.col("_before") + own).drop("_order", "_head", "_before")


def split(rows: DataFrame, key: str, seed: str = "42", share: float = 0.10, least: int = 50) -> DataFrame:
    """part: eval for max(least, share) of the rows in the seeded order, train for the rest."""
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    held = F.greatest(F.lit(least), F.floor(F.col("_all") * share))
    return _nth(rows, key, seed).join(F.broadcast(total), how="inner").withColumn("part", F.when(F.col("nth") < held, F.lit("eval")).otherwise(F.lit("train"))).drop("nth", "_all")


def oversampled(rows: DataFrame, minority: Column, key: str, seed: str = "42", share: float = 0.35) -> DataFrame:
    """copy: rows of the minority repeat, in the seeded order, until they are `share` of all; 0 for the first of each."""
    few, many = rows.where(minority), rows.where(~minority)
    counts = rows.agg(_n(minority).alias("_few"), _n(~minority).alias("_many"))
    exact = Decimal(str(share))  # as a double, 39 * 0.35 / 0.65 falls short of 21
    target = F.greatest(F.col("_few"), F.floor((F.col("_many") * F.lit(exact)).cast("double") / float(1 - exact)))
    few = _nth(few, key, seed).join(F.broadcast(counts), how="inner").withColumn("_target", target)
    times = F.floor((F.col("_target") - F.col("nth") - 1) / F.col("_few"))
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times)))
    return few.select(*rows.columns, "copy").union(many.select(*rows.columns, F.lit(0).cast("long")))


def capped(rows: DataFrame, majority: Column, key: str, seed: str = "42", over: float = 0.60, share: float = 0.40) -> DataFrame:
    """Rows of a majority above `over` are cut, in the seeded order, to `share` of what is left."""
    counts = rows.agg(_n(majority).alias("_big"), _n(~majority).alias("_rest"))
    most = F.when(F.col("_big") / (F.col("_big") + F.col("_rest")) > over, F.floor(F.col("_rest") * share / (1 - share))).otherwise(F.col("_big"))
    kept = _nth(rows.where(majority), key, seed).join(F.broadcast(counts), how="inner").where(F.col("nth") < most)
    return kept.select(*rows.columns).union(rows.where(~majority))


def quality_gates(rows: DataFrame) -> DataFrame:
    """Totals of examples (label, origin) and the gates they must pass."""
    t = rows.agg(F.count(F.lit(1)).alias("total"), _n(F.col("origin").isin("human", "claude")).alias("reviewed"), _n(F.col("label") == NO_LOCATION).alias("no_location"))
    t = t.withColumn("no_location_share", F.coalesce(F.round(F.try_divide("no_location", "total"), 4), F.lit(0.0)))
    gates = {"gate_total": F.col("total") >= 1000, "gate_reviewed": F.col("reviewed") >= 300, "gate_no_location": F.col("no_location_share") >= 0.15}
    return t.withColumns(gates).withColumn("all_pass", F.col("gate_total") & F.col("gate_reviewed") & F.col("gate_no_location"))


def coverage(rows: DataFrame, key: str = "feed_id", least: int = 50) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.col("n") < least)


def shadow_summary(rows: DataFrame) -> DataFrame:
    """One row of figures on two models' results for the same chunks; see FIXTURES.md for the columns."""
    base, lora = score.confidence_rank(F.col("base_conf")), score.confidence_rank(F.col("lora_conf"))
    differ, poor = ~F.col("agreed"), lambda c: F.col(c).isNull() | F.col(c).isin("FAILED", "LOW")
    none, some = lambda c: F.col(c) == NO_LOCATION, lambda c: F.col(c) != NO_LOCATION
    t = rows.agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("agreed")).alias("agree"), _n(differ).alias("disagree"),
        _n(differ & (lora > base)).alias("lora_wins"), _n(differ & (base > lora)).alias("base_wins"), _n(differ & (base == lora)).alias("ties"),
        _n(differ & none("lora_result") & some("base_result") & poor("base_conf")).alias("base_hallucinations"),
        _n(differ & none("base_result") & some("lora_result") & poor("lora_conf")).alias("lora_hallucinations"),
        F.coalesce(F.avg("base_ms").cast("long"), F.lit(0)).alias("avg_base_ms"), F.coalesce(F.avg("lora_ms").cast("long"), F.lit(0)).alias("avg_lora_ms"),
        _n(differ & (F.col("base_conf").isNull() | (F.col("base_conf") == "FAILED")) & (F.col("lora_conf") == "HIGH")).alias("saves"),
        _n(F.col("base_conf") == "HIGH").alias("base_high"), _n(F.col("lora_conf") == "HIGH").alias("lora_high"),
    )
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return t.withColumns({
        "agree_pct": share(F.col("agree"), F.col("n")), "disagree_pct": share(F.col("disagree"), F.col("n")),
        "overhead_pct": share(F.col("avg_lora_ms") - F.col("avg_base_ms"), F.col("avg_base_ms")), "prevented": F.expr("saves div 3"),
    })


def shadow_gates(summary: DataFrame) -> DataFrame:
    gates = {
        "gate_rows": F.col("n") >= 500, "gate_wins": (F.col("disagree") > 0) & (F.col("lora_wins") > F.col("base_wins")),
        "gate_hallucinations": F.col("lora_hallucinations") <= F.col("base_hallucinations"),
        "gate_high": F.col("lora_high") >= F.col("base_high"), "gate_latency": F.col("overhead_pct") <= 1.5,
    }
    out = summary.withColumns(gates)
    all_ = out["gate_rows"] & out["gate_wins"] & out["gate_hallucinations"] & out["gate_high"] & out["gate_latency"]
    return out.select(*gates, all_.alias("all_pass"))


def shadow_by_feed(rows: DataFrame) -> DataFrame:
    base, lora, differ = score.confidence_rank(F.col("base_conf")), score.confidence_rank(F.col("lora_conf")), ~F.col("agreed")
    return rows.groupBy("feed_id").agg(F.count(F.lit(1)).alias("total"), _n(differ).alias("disagree"), _n(differ & (lora > base)).alias("lora_wins"), _n(differ & (base > lora)).alias("base_wins"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(key), F.lit("NONE")).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, said: Column, label: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of two boolean columns; 0 where nothing can be told."""
    t = rows.agg(_n(said & label).alias("tp"), _n(said & ~label).alias("fp"), _n(~said & label).alias("fn"), _n(~said & ~label).alias("tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    t = t.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return t.withColumns({k: F.round(k, 6) for k in ("precision", "recall", "f1")})


def hallucination(rows: DataFrame, said: Column, label: Column) -> DataFrame:
    """Share of rows labelled NO_LOCATION for which an address was said."""
    none = label == NO_LOCATION
    t = rows.agg(_n(none).alias("no_location"), _n(none & (said != NO_LOCATION)).alias("hallucinated"))
    return t.withColumn("rate", F.coalesce(F.round(F.try_divide("hallucinated", "no_location"), 6), F.lit(0.0)))


def with_street_match(rows: DataFrame, said: Column, label: Column, name: str) -> DataFrame:
    """rows with a column that tells what `text.street_match` does. Streets are parsed once, and each different pair of them is compared once, whatever the number of rows that have it."""
    c, kept = F.col, rows.columns
    rows = rows.withColumns({"_said": said, "_label": label})
    (n1, s1), (n2, s2) = text.street_parts(c("_said")), text.street_parts(c("_label"))
    rows = rows.withColumns({"_n1": n1, "_s1": s1, "_n2": n2, "_s2": s2})
    none, differ = text.street_told(c("_said"), c("_label"), c("_n1"), c("_n2"))
    street = lambda s: F.coalesce(F.when(~(none | differ), c(s)), F.lit(""))
    rows = rows.withColumns({"_a": street("_s1"), "_b": street("_s2")})
    pairs = rows.select("_a", "_b").distinct().withColumn("_similar", text.similar(c("_a"), c("_b")))
    return rows.join(pairs, ["_a", "_b"], "left").select(*kept, F.when(none, c("_said") == c("_label")).otherwise(~differ & c("_similar")).alias(name))


def accuracy(rows: DataFrame, said: Column, label: Column, ms: Column | None = None, street: bool = True) -> DataFrame:
    share = lambda test: F.round(F.coalesce(F.avg(test.cast("double")), F.lit(0.0)), 6)
    measures = {"exact": share(text.exact_match(said, label)), "city": share(text.eval_city(said) == text.eval_city(label))}
    if street:
        rows = with_street_match(rows, said, label, "_street")
        measures |= {"street": share(F.col("_street"))}
    measures |= {"avg_ms": F.coalesce(F.expr("sum(ms) div count(ms)"), F.lit(0))} if ms is not None else {}
    rows = rows.withColumn("ms", ms) if ms is not None else rows
    return rows.agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()])


def compared(base: DataFrame, other: DataFrame, gates: list[tuple[str, int, float]]) -> DataFrame:
    """metric, base, candidate, gain, passed from two one-row frames; gates: (metric, +1 more is better or -1, least gain)."""
    names = [g[0] for g in gates]
    long = lambda df, name: df.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "metric", name)
    known = base.sparkSession.createDataFrame(gates, "metric string, direction int, least double")
    both = long(base, "base").join(long(other, "candidate"), "metric").join(F.broadcast(known), "metric")
    gain = F.round((F.col("candidate") - F.col("base")) * F.col("direction"), 6)
    return both.withColumn("gain", gain).withColumn("passed", F.col("gain") >= F.col("least")).drop("direction", "least")


def hallucinated_examples(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first n examples (ord, text, pred, label) in which an address was made up."""
    bad = rows.where((F.col("label") == NO_LOCATION) & (F.col("pred") != NO_LOCATION))
    return bad.orderBy("ord").limit(n).select("ord", text.transcript_of(F.col("text")).alias("transcript"), "pred", "label")


def labelling_counts(rows: DataFrame, target: int = 500) -> DataFrame:
    """What a labelling run did: rows of (old, new), new null where it was skipped."""
    done = F.col("new").isNotNull()
    t = rows.agg(_n(done).alias("labelled"), _n(done & (F.col("new") == F.col("old"))).alias("kept"), _n(done & (F.col("new") != F.col("old"))).alias("changed"), _n(F.col("new") == NO_LOCATION).alias("no_location"), _n(~done).alias("skipped"))
    return t.withColumn("remaining", F.greatest(F.lit(0), target - F.col("labelled")))
