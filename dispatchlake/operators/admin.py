"""Changes to incidents, chunks, units and registries as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions import geo, text
from dispatchlake.operators.relational import latest
from dispatchlake.scratch import cut


def _set(c) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def merge(incidents: DataFrame, chunks: DataFrame, assignments: DataFrame, source, target) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incident `source` becomes part of `target`: chunks and units follow it, and it is gone.

    Raises ValueError for one id given twice, LookupError for an id that no incident has.
    """
    if source == target:
        raise ValueError("an incident can't be merged into itself")
    both = incidents.where(F.col("incident_id").isin(source, target))
    if both.select("incident_id").distinct().count() < 2:
        raise LookupError("no such incident")
    units = both.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(_set(c))))).alias(c) for c in ("units", "units_cleared")])
    joined = units.withColumn("incident_id", F.lit(target).cast(incidents.schema["incident_id"].dataType)).withColumnsRenamed({"units": "_u", "units_cleared": "_c"})
    kept = incidents.where(F.col("incident_id") != source).join(F.broadcast(joined), "incident_id", "left")
    kept = kept.withColumns({"units": F.coalesce("_u", "units"), "units_cleared": F.coalesce("_c", "units_cleared")}).select(*incidents.columns)
    moved = F.when(F.col("incident_id") == source, F.lit(target)).otherwise(F.col("incident_id"))
    relink = lambda df: df.withColumn("incident_id", moved.cast(df.schema["incident_id"].dataType))
    return kept, relink(chunks), relink(assignments)


def delete(incidents: DataFrame, chunks: DataFrame, assignments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the incidents of `ids`, their chunks and their units."""
    return tuple(df.join(ids, "incident_id", "left_anti") for df in (incidents, chunks, assignments))


def resolve_stale(incidents: DataFrame, as_of: Column, idle_s: int = 172_800) -> DataFrame:
    """Active incidents idle for longer than `idle_s` are resolved; others stay. Running it twice changes nothing."""
    idle = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.coalesce("last_updated", "opened_at").cast("timestamp"))
    stale = (F.col("status") == "ACTIVE") & (idle > idle_s)
    out = incidents.withColumn("resolved_at", F.when(stale, as_of).otherwise(F.col("resolved_at"))) if "resolved_at" in incidents.columns else incidents
    return out.withColumn("status", F.when(stale, F.lit("RESOLVED")).otherwise(F.col("status")))


def create(chunks: DataFrame, *more: str | Column) -> DataFrame:
    """The incidents that chunks open: one for each, named by a hash of its chunk. more: further columns."""
    return chunks.select(
        F.md5(F.concat(F.lit("incident|"), F.col("chunk_id").cast("string")).cast("binary")).alias("incident_id"), "feed_id", F.lit("ACTIVE").alias("status"),
        F.col("ts").alias("opened_at"), F.col("ts").alias("last_updated"), "incident_type", "address", text.city_of(F.col("address")).alias("city"), "lat", "lng", "units", F.array("chunk_id").alias("chunk_ids"), *more,
    )


def update(incidents: DataFrame, changes: DataFrame, most_chunks: int = 500) -> DataFrame:
    """Incidents with their changes applied in order (ts, chunk_id): units, cleared, summary, priority, place and address.

    changes: incident_id, ts, added, cleared, n_summary, n_priority, chunk_id, n_lat, n_lng, inferred, n_address, confidence;
    any number for an incident. Changes to unknown incidents are left out. A change adds units, then clears some. An
    inferred place takes the place of none or of an inferred one (incidents' is_location_inferred, if they have it); a real one of any.
    The steps don't commute, yet each field follows from first, last or largest values, so changes are folded in
    parts, whatever number an incident has; of chunk_ids no more than `most_chunks` come together.
    """
    c = F.col
    at = F.struct("ts", "chunk_id")
    known = changes.join(incidents.select("incident_id"), "incident_id", "left_semi")
    placed, real = geo.present(c("n_lat"), c("n_lng")), ~F.coalesce("inferred", F.lit(False))
    good = (F.coalesce("n_address", F.lit("")) != "") & F.coalesce(c("confidence").isin("HIGH", "MEDIUM"), F.lit(False))
    whole = ~text.is_city_level(c("n_address"))
    place, address = F.struct("n_lat", "n_lng"), c("n_address")
    folded = known.groupBy("incident_id").agg(
        F.max("ts").alias("f_ts"), F.max_by("n_summary", F.when(F.coalesce("n_summary", F.lit("")) != "", at)).alias("f_summary"), F.max_by("n_priority", F.when(F.coalesce("n_priority", F.lit("UNKNOWN")) != "UNKNOWN", at)).alias("f_priority"),
        F.max_by(place, F.when(placed & real, at)).alias("f_real"), F.max_by(place, F.when(placed & ~real, at)).alias("f_guess"),
        # a missing address takes any good one, one of a city a whole one, and a whole one stays
        F.min_by(address, F.when(good & text.has_address(address) & whole, at)).alias("f_whole"), F.min_by(address, F.when(good & text.has_address(address) & ~whole, at)).alias("f_city"), F.max_by(address, F.when(good & ~text.has_address(address), at)).alias("f_none"),
    )
    said = F.concat(F.transform(_set("added"), lambda u: F.struct(u.alias("unit"), F.lit(0).alias("gone"))), F.transform(_set("cleared"), lambda u: F.struct(u.alias("unit"), F.lit(1).alias("gone"))))
    each = known.select("incident_id", at.alias("at"), F.explode(said).alias("e")).groupBy("incident_id", c("e.unit").alias("unit")).agg(F.max(F.struct("at", "e.gone")).alias("last"), F.max("e.gone").alias("ever"))
    units = each.groupBy("incident_id").agg(*[F.coalesce(F.collect_set(F.when(test, c("unit"))), F.array().cast("array<string>")).alias(n) for n, test in (("f_added", c("last.gone") == 0), ("f_gone", c("last.gone") == 1), ("f_cleared", c("ever") == 1))])
    newest = latest(known.select("incident_id", "ts", "chunk_id"), ["incident_id"], [c("ts").desc_nulls_last(), c("chunk_id").desc_nulls_last()], most_chunks)
    chunks = newest.groupBy("incident_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "chunk_id"))), lambda r: r["chunk_id"]).alias("f_chunks"))
    rows = incidents.join(folded, "incident_id", "left").join(units, "incident_id", "left").join(chunks, "incident_id", "left")
    old_guess = F.coalesce("is_location_inferred", F.lit(False)) if "is_location_inferred" in incidents.columns else F.lit(False)
    nowhere = c("lat").isNull() | c("lng").isNull()
    moved = F.when(c("f_real").isNotNull(), c("f_real")).when(nowhere | old_guess, c("f_guess"))
    old, better = c("address"), F.coalesce("f_whole", F.when(~text.has_address(c("address")), F.coalesce("f_city", "f_none")))
    out = {
        "units": F.array_sort(F.array_union(F.array_except(_set("units"), _set("f_gone")), _set("f_added"))), "units_cleared": F.array_sort(F.array_union(_set("units_cleared"), _set("f_cleared"))), "last_updated": F.coalesce("f_ts", "last_updated"),
        "summary": F.coalesce("f_summary", "summary"), "priority": F.coalesce("f_priority", "priority"), "chunk_ids": F.when(c("f_chunks").isNull(), c("chunk_ids")).otherwise(F.reverse(F.slice(F.reverse(F.concat(F.coalesce("chunk_ids", F.array().cast(incidents.schema["chunk_ids"].dataType)), c("f_chunks"))), 1, most_chunks))),
        "lat": F.coalesce(moved["n_lat"], c("lat")), "lng": F.coalesce(moved["n_lng"], c("lng")), "address": F.when(text.has_address(old) & ~text.is_city_level(old), old).otherwise(F.coalesce(better, old)),
    }
    if "is_location_inferred" in incidents.columns:
        out["is_location_inferred"] = F.when(moved.isNotNull(), c("f_real").isNull()).otherwise(c("is_location_inferred"))
    return rows.select(*[out[n].alias(n) if n in out else c(n) for n in incidents.columns])


#: what `applied` keeps of an incident
KEPT = "incident_id feed_id status opened_at last_updated resolved_at incident_type priority address lat lng is_location_inferred units units_cleared summary chunk_ids".split()


def applied(incidents: DataFrame, chunks: DataFrame, decided: DataFrame) -> DataFrame:
    """The incidents after a batch of decisions: those that chunks open, and the old ones with their chunks folded in, resolved where a decision says so.

    incidents: the columns of `KEPT`; decided: chunk_id, action, incident_id. chunks: chunk_id, feed_id, ts, incident_type,
    address, lat, lng, units, units_cleared; and priority, summary, confidence, inferred where they are known. A new
    incident's id is a text, so ids are.
    """
    kinds = {"priority": "string", "summary": "string", "confidence": "string", "inferred": "boolean"}
    said = chunks.select("*", *(F.lit(None).cast(k).alias(n) for n, k in kinds.items() if n not in chunks.columns))
    needed = ["chunk_id", "feed_id", "ts", "incident_type", "address", "lat", "lng", "units", "units_cleared", *kinds]
    told = cut(said.select(*needed).join(decided.select("chunk_id", "action", "incident_id"), "chunk_id"), "told")  # decided once for all that follows
    new = create(told.where("action = 'NEW'"), "priority", "summary", F.coalesce("inferred", F.lit(False)).alias("is_location_inferred"))
    new = new.withColumns({"resolved_at": F.lit(None).cast("timestamp"), "units_cleared": F.array().cast("array<string>")})
    known = told.where("action IN ('UPDATE', 'RESOLVE')")
    changes = known.select("incident_id", "ts", "chunk_id", F.col("units").alias("added"), F.col("units_cleared").alias("cleared"), F.col("summary").alias("n_summary"), F.col("priority").alias("n_priority"), F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"), "inferred", F.col("address").alias("n_address"), "confidence")
    ends = known.where("action = 'RESOLVE'").groupBy("incident_id").agg(F.max("ts").alias("_end"))
    old = update(incidents.select(*KEPT), changes).join(ends, "incident_id", "left")
    over = F.col("_end").isNotNull()
    old = old.withColumns({"status": F.when(over, F.lit("RESOLVED")).otherwise(F.col("status")), "resolved_at": F.coalesce(F.col("_end").cast("timestamp"), "resolved_at")})
    return old.select(*KEPT).unionByName(new.select(*KEPT))


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones with what the new ones say that isn't null."""
    new = rows.withColumnsRenamed({c: f"_{c}" for c in rows.columns if c != key})
    joined = registry.join(new, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in rows.columns else F.col(c) for c in registry.columns if c != key])


def promote(registry: DataFrame, version: str, at: Column) -> DataFrame:
    """One version goes into production; what was there retires."""
    now, before = F.col("model_version") == version, (F.col("status") == "production") & (F.col("model_version") != version)
    return registry.withColumns({
        "deployed_at": F.when(now, at).otherwise(F.col("deployed_at")), "retired_at": F.when(before, at).otherwise(F.col("retired_at")),
        "status": F.when(now, F.lit("production")).when(before, F.lit("retired")).otherwise(F.col("status")),
    })


def save_labels(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Review labels (chunk_id, label, source, at) put on their chunks."""
    joined = chunks.join(labels.withColumnsRenamed({"label": "_l", "source": "_s", "at": "_a"}), "chunk_id", "left")
    return joined.withColumns({"review_label": F.coalesce("_l", "review_label"), "review_source": F.coalesce("_s", "review_source"), "reviewed": F.coalesce("_a", "reviewed")}).select(*chunks.columns)


def clear_unverifiable(chunks: DataFrame, machine: str = "claude") -> DataFrame:
    """Without machine labels that name a place which couldn't be found."""
    bad = (F.col("review_source") == machine) & (F.col("review_label") != text.NO_LOCATION) & F.col("geocode_confidence").isin("FAILED", "LOW")
    bad = F.coalesce(bad, F.lit(False))
    return chunks.withColumns({c: F.when(~bad, F.col(c)) for c in ("review_label", "review_source", "reviewed")})


def geocode(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """addresses (k, feed_id, address) with what the gazetteer (key, lat, lng, formatted, confidence) knows.

    The address as it is goes first, then without its unit suffix, then as a landmark.
    """
    forms = F.array(F.col("address"), text.strip_unit_suffix(F.col("address")), text.resolve_landmark(F.col("address")))
    each = addresses.select("k", F.posexplode(forms)).where(text.has_address(F.col("col"))).select("k", "pos", text.cache_key(F.col("col")).alias("key"))
    found = each.join(gazetteer, "key").groupBy("k").agg(F.min_by(F.struct(*[c for c in gazetteer.columns if c != "key"]), "pos").alias("g"))
    out = addresses.join(found, "k", "left").select(*addresses.columns, "g.*")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit("FAILED")))
