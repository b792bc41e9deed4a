"""Gates, signals and scores of pairs of a chunk and an incident, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchlake.functions import fixed, geo, text

W = fixed.WEIGHTS


def seconds(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))


def incompatible(a: Column, b: Column) -> Column:
    pairs = ["|".join(sorted(p)) for p in fixed.INCOMPATIBLE]
    return F.coalesce(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)).isin(pairs), F.lit(False))


def noisy(confidence: Column, n_units: Column, address: Column, inferred: Column, feed: Column) -> Column:
    """Chunks that say too little to be an incident; on busy feeds units alone say too little."""
    nowhere = ~text.has_address(F.coalesce(address, F.lit(""))) & ~F.coalesce(inferred, F.lit(False))
    return nowhere & (((F.coalesce(confidence, F.lit("LOW")) == "FAILED") & (n_units == 0)) | feed.isin(fixed.BUSY_FEEDS))


def accepts_weak(age_s: Column, incoming: Column, existing: Column, unit_match: Column, weak_s: int = 14_400, strong_s: int = 28_800) -> Column:
    limit = F.when(unit_match, strong_s).otherwise(weak_s)
    return F.coalesce(age_s <= limit, F.lit(True)) & (unit_match | ~incompatible(incoming, existing))


def unit_plausible(km: Column, most: float = 3.0) -> Column:
    return F.coalesce(km <= most, F.lit(True))


def clearly_different(a: Column, b: Column) -> Column:
    one, two = text.address_tokens(a, fixed.DIFFERENT_STOP), text.address_tokens(b, fixed.DIFFERENT_STOP)
    known = lambda c: text.has_address(F.coalesce(c, F.lit(""))) & (c != "Unknown")
    return known(a) & known(b) & (F.size(one) > 0) & (F.size(two) > 0) & ~F.arrays_overlap(one, two)


def worth_judging(a: Column, b: Column, incoming: Column, existing: Column) -> Column:
    """Whether a judge should see a candidate: not if both its address and its type are another."""
    return ~(F.coalesce(clearly_different(a, b), F.lit(False)) & incompatible(incoming, existing))


def should_enrich(action: Column, old_lat: Column, old_lng: Column, lat: Column, lng: Column, moved: float = 0.001) -> Column:
    far = (F.abs(lat - old_lat) > moved) | (F.abs(lng - old_lng) > moved)
    return (action == "NEW") | ((action == "UPDATE") & geo.present(lat, lng) & (old_lat.isNull() | old_lng.isNull() | F.coalesce(far, F.lit(False))))


def should_summarise(n_chunks: Column, every: int = 3) -> Column:
    return (n_chunks <= 1) | (n_chunks % every == 0)


def score(s: dict[str, Column]) -> Column:
    """The weighted score, 0 to 1. s: overlap, street, km, units (shared), unit_feed, busy, same_type, compatible, burst, age_s, same_feed."""
    term = lambda test, w: F.when(F.coalesce(test, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    near = F.when(s["km"].isNotNull(), geo.proximity(s["km"]) * W["proximity"] + term(s["km"] >= 5.0, W["far"])).otherwise(F.lit(0.0))
    unit = F.when(s["units"] > 0, F.lit(W["unit"]) + term(s["busy"], W["busy_unit"]) + term(s["unit_feed"], W["unit_feed"])).otherwise(F.lit(0.0))
    total = s["overlap"] * W["overlap"] + term(s["street"], W["street"]) + near + unit + term(s["same_type"], W["type"]) + term(s["burst"], W["burst"]) + term(s["age_s"] > 1800, W["old"]) + term(s["same_feed"], W["feed"])
    return F.when(s["compatible"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(F.lit(0.0))


def reasons(s: dict[str, Column]) -> Column:
    """What a score consists of, in a fixed order."""
    km, unit = s["km"], s["units"] > 0
    told = [
        F.when(s["overlap"] > 0, F.format_string("addr_overlap=%.2f", s["overlap"])),
        F.when(s["street"], F.lit("exact_street")),
        F.when(km >= 5.0, F.format_string("far_geocode(%.1fkm)", km)),
        F.when(km.isNotNull(), F.format_string("dist=%.2fkm", km)),
        F.when(unit & s["busy"], F.lit("unit(high_vol_penalty)")).when(unit, F.format_string("unit_match(x%d)", s["units"])),
        F.when(unit & s["unit_feed"], F.lit("unit_same_feed")),
        F.when(s["same_type"], F.lit("type_match")),
        F.when(s["burst"], F.lit("burst_window")),
        F.when(s["age_s"] > 1800, F.format_string("old(%dmin)", F.floor(s["age_s"] / 60))),
        F.when(s["same_feed"], F.lit("same_feed")),
    ]
    return F.when(s["compatible"], F.array_compact(F.array(*told))).otherwise(F.array(F.lit("incompatible_types")))


def classify(value: Column) -> Column:
    return F.when(value >= fixed.STRONG, F.lit("STRONG_MATCH")).when(value >= fixed.WEAK, F.lit("WEAK_MATCH")).when(value >= fixed.AMBIGUOUS, F.lit("AMBIGUOUS")).otherwise(F.lit("NO_MATCH"))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0)


def judge_confidence(same_type: Column, km: Column, inferred: Column) -> Column:
    """How sure a pairwise match is; LOW ones are to be dropped."""
    under = lambda most: F.coalesce(km < most, F.lit(False))
    high = (under(0.5) & ~inferred) | (same_type & under(5.0))
    return F.when(high, F.lit("HIGH")).when(same_type & (under(15.0) | km.isNull()), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
