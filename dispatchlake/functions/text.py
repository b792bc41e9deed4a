"""Addresses, units and display text as column expressions. Null and empty texts count as missing."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dispatchlake.functions import fixed

NO_LOCATION = "NO_LOCATION"


def _list(words) -> Column:
    return F.array(*map(F.lit, words))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _words(c: Column) -> Column:
    return F.filter(F.split(_text(c), r"\s+"), lambda w: w != "")


def _bare(w: Column) -> Column:
    """A word without dots, commas and brackets at its ends, in lower case."""
    return F.lower(F.regexp_replace(w, r"^[.,()]+|[.,()]+$", ""))


def has_address(a: Column) -> Column:
    return a.isNotNull() & ~a.isin("", NO_LOCATION)


def address_tokens(a: Column, stop=fixed.ADDRESS_STOP) -> Column:
    """Distinct telling words of an address; the stop list is tried before punctuation is stripped."""
    told = F.filter(_words(a), lambda w: (F.length(w) > 2) & ~F.array_contains(_list(stop), F.lower(w)))
    return F.array_distinct(F.transform(told, _bare))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def primary_street(a: Column) -> Column:
    """The first longest telling word that is no number; empty if there is none."""
    stop = _list(sorted({*fixed.ADDRESS_STOP, *fixed.STREET_SUFFIX}))
    told = F.filter(_words(a), lambda w: ~w.rlike("^[0-9]+$") & ~F.array_contains(stop, F.lower(w)) & (F.length(w) > 3))
    return F.aggregate(F.transform(told, _bare), F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def shares_primary_street(a: Column, b: Column) -> Column:
    return (primary_street(a) != "") & (primary_street(a) == primary_street(b))


def has_house_number(a: Column) -> Column:
    return F.coalesce(a.rlike(r"^\s*[0-9]"), F.lit(False))


def _parts(a: Column) -> Column:
    return F.transform(F.split(_text(a), ","), lambda p: F.trim(p))


def city_of(a: Column) -> Column:
    """Third part from the end of three or more, else the first; Unknown for none."""
    parts = _parts(a)
    return F.when(_text(a) == "", F.lit("Unknown")).when(F.size(parts) >= 3, F.element_at(parts, -3)).otherwise(F.element_at(parts, 1))


def eval_city(a: Column) -> Column:
    parts = _parts(a)
    return F.when(F.size(parts) >= 2, F.lower(F.element_at(parts, -2))).otherwise(F.lit(""))


def checked_extraction(transcript: Column, address: Column) -> Column:
    """struct(address, in_context): NO_LOCATION where the address's main word isn't in the transcript.

    in_context tells whether a word that goes with places, or a number of 3 to 5 digits, stands near that word.
    """
    first = F.lower(F.trim(F.element_at(F.split(_text(address), ","), 1)))
    skip = _list(sorted({*fixed.DIRECTIONS, *fixed.STREET_SUFFIX}))
    keys = F.filter(_words(first), lambda w: ~w.rlike("^[0-9]+$") & ~F.array_contains(skip, w))
    primary = F.aggregate(keys, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    said = F.lower(_text(transcript))
    quoted = F.concat(F.lit(r"(?s)(.{0,50})\b\Q"), primary, F.lit(r"\E\b(.{0,50})"))
    before, after = F.regexp_extract_all(said, quoted, F.lit(1)), F.regexp_extract_all(said, quoted, F.lit(2))
    street = F.arrays_overlap(_words(F.array_join(F.concat(before, after), " ")), _list(fixed.CONTEXT_WORDS))
    close = F.concat(F.transform(before, lambda b: F.substring(b, -30, 30)), F.transform(after, lambda b: F.substring(b, 1, 30)))
    near = F.exists(close, lambda c: c.rlike(r"\b[0-9]{3,5}\b"))
    known = has_address(address) & (primary != "")
    absent = known & ~F.contains(said, primary)
    return F.struct(F.when(absent, F.lit(NO_LOCATION)).otherwise(address).alias("address"), (known & ~absent & (street | near)).alias("in_context"))


def sanitize(raw: Column) -> Column:
    """A model's answer as one address: without fences, JSON, prefixes, quotes and further sentences."""
    text = F.regexp_replace(F.regexp_replace(_text(raw), "```[a-z]*", ""), r"^\s+|\s+$", "")
    keyed = F.coalesce(*[F.try_variant_get(F.try_parse_json(text), f"$.{k}", "string") for k in ("address", "location", "normalized", "result")])
    text = F.when(text.startswith("{"), F.coalesce(keyed, text)).otherwise(text)
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, r"\r?\n"), lambda p: F.trim(p)), lambda s: s != ""), F.lit(1)), F.lit(""))
    line = F.trim(F.regexp_replace(line, f"^(?i)(?:{'|'.join(fixed.SAID_BEFORE)})", ""))
    line = F.regexp_replace(line, "^[\"'`]+|[\"'`]+$", "")
    line = F.regexp_replace(F.element_at(F.split(line, r"\.\s+[A-Z]"), 1), r"\.+$", "")
    line = F.substring(line, 1, 120)
    words = _words(line)
    named = F.arrays_overlap(F.transform(words, F.lower), _list(fixed.ANSWER_WORDS))
    vague = (F.size(words) > 12) | ((F.size(words) > 3) & ~line.rlike("[0-9]") & ~named)
    return F.when(vague | (line == ""), F.lit(NO_LOCATION)).otherwise(line)


def strip_unit_suffix(a: Column) -> Column:
    cut = F.regexp_replace(_text(a), r"(?i),?\s*(apartment|apt|unit|suite|ste|floor|fl|room|rm|#)\s*[\w-]+", "")
    return F.trim(F.regexp_replace(F.trim(cut), "^,+|,+$", ""))


def is_named_place(a: Column) -> Column:
    words, low = _words(a), F.lower(_text(a))
    numbered = F.coalesce(F.try_element_at(words, F.lit(1)).rlike("^[0-9]+$"), F.lit(False))
    crossing = F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(" & "))
    return has_address(a) & ~numbered & ~crossing & F.arrays_overlap(F.transform(words, _bare), _list(fixed.PLACE_WORDS))


def resolve_landmark(a: Column) -> Column:
    """The address of a known landmark, by the whole name or what stands before its first comma; else null."""
    known = F.create_map(*[F.lit(x) for pair in fixed.LANDMARKS.items() for x in pair])
    key = F.regexp_replace(F.trim(F.lower(_text(a))), r"[.,]+$", "")
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.trim(F.element_at(F.split(key, ","), 1))))


def place_plausible(city: Column, a: Column) -> Column:
    """Whether a result's city fits the one that an address names; true where either says nothing."""
    parts = F.split(_text(a), ",")
    hint = F.when(F.size(parts) >= 2, F.trim(F.regexp_replace(F.lower(F.trim(F.element_at(parts, -2))), " mi| oh", ""))).otherwise(F.lit(""))
    found = F.lower(_text(city))
    return (hint == "") | (found == "") | F.contains(found, hint) | F.contains(hint, found)


def formatted_address(number: Column, street: Column, city: Column, state: Column, name: Column | None = None) -> Column:
    """A found place in a line: a number counts with a street only, a name where there is no street; the state is MI if none is given."""
    blank = lambda c: F.nullif(F.trim(_text(c)), F.lit(""))
    named = blank(name) if name is not None else F.lit(None).cast("string")
    line = F.coalesce(F.concat(blank(number), F.lit(" "), blank(street)), blank(street), named)
    return F.concat_ws(", ", line, blank(city), F.coalesce(blank(state), F.lit("MI")))


def found_confidence(kind: Column, value: Column, number: Column, street: Column) -> Column:
    """How sure a place from an open map is, by its kind and value and by what its address has."""
    some = lambda c: _text(c) != ""
    sure = kind.isin("house", "street", "locality") | some(street) | value.isin("bus_stop", "crossing")
    return F.when(F.coalesce(sure, some(street)), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def geocode_confidence(location_type: Column, a: Column) -> Column:
    near = F.when(F.trim(_text(a)).rlike(r"^[0-9]+\s"), F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return F.when(location_type.isin("ROOFTOP", "RANGE_INTERPOLATED"), F.lit("HIGH")).when(location_type == "APPROXIMATE", near).otherwise(F.lit("MEDIUM"))


def place_confidence(location_type: Column, kinds: Column, formatted: Column) -> Column:
    """How sure a found place is, by its kinds; null for one that is a whole city or more."""
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    near = F.arrays_overlap(kinds, _list(fixed.NEAR_PLACES))
    wide = (F.size(kinds) > 0) & (F.size(F.array_except(kinds, _list(fixed.WIDE_PLACES))) == 0)
    vague = (location_type == "APPROXIMATE") & ~near  # the first part of an address has no comma
    sure = F.when(location_type.isin("ROOFTOP", "RANGE_INTERPOLATED"), F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    return F.when(~wide & ~F.coalesce(vague, F.lit(False)) & formatted.isNotNull(), sure)


def is_city_level(a: Column) -> Column:
    first = F.element_at(_parts(a), 1)
    street = F.lower(first).rlike("|".join(fixed.CITY_STREETS))
    return ~first.rlike(r"^[0-9]+\s") & (F.size(_parts(a)) <= 3) & ~street


def promoted_address(old: Column, new: Column, confidence: Column) -> Column:
    """A better address takes the place of a missing or city-level one."""
    good = (_text(new) != "") & F.coalesce(confidence.isin("HIGH", "MEDIUM"), F.lit(False))
    return F.when(good & (~has_address(old) | old.isNull() | (is_city_level(old) & ~is_city_level(new))), new).otherwise(old)


def unit_valid(unit: Column) -> Column:
    uid = F.regexp_replace(F.trim(F.upper(_text(unit))), "^[^:]*:", "")
    joined, parts = F.regexp_replace(uid, "[- ]", ""), F.split(F.regexp_replace(uid, " ", "-"), "-")
    numbers = F.size(F.filter(parts, lambda p: p.rlike("^[0-9]+$")))
    words = F.filter(F.split(F.lower(F.regexp_replace(uid, "-", " ")), r"\s+"), lambda w: w != "")
    starts = uid.rlike("^(" + "|".join(fixed.UNIT_PREFIXES) + ")")
    return (
        (F.length(uid) >= 2) & ~uid.rlike("^[0-9]{1,2}$") & ~uid.isin(fixed.UNIT_BLACKLIST) & ~joined.rlike("^[0-9]{1,2}$")
        & ~F.arrays_overlap(words, _list(fixed.UNIT_ADDRESS_WORDS)) & ~((numbers >= 3) & (F.size(parts) >= 3)) & (uid.rlike("[0-9]") | starts)
    )


def by_prefix(key: Column, pairs, default) -> Column:
    """The value of the key itself, else of the first pair whose key it starts with, else the default."""
    whole = [(key == k, v) for k, v in pairs]
    out = None
    for test, value in [*whole, *[(key.startswith(k), v) for k, v in pairs]]:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def agency(feed: Column) -> Column:
    return by_prefix(feed, fixed.AGENCIES, "UNK")


def unit_ttl(feed: Column) -> Column:
    return by_prefix(feed, fixed.UNIT_TTL, fixed.UNIT_TTL_DEFAULT)


def namespaced(unit: Column, feed: Column) -> Column:
    return F.concat(agency(feed), F.lit(":"), F.regexp_replace(unit, "^[^:]*:", ""))


def unit_variants(name: Column, short: Column) -> Column:
    """The ways in which a station's units are called; ENGINE 1 is no way to call ENGINE 01."""
    name, short = F.trim(F.upper(_text(name))), F.trim(F.upper(_text(short)))
    number = F.substring(name, 8, 100)
    said = [name, F.replace(name, F.lit(" "), F.lit("")), short, F.replace(short, F.lit("-"), F.lit("")), F.replace(short, F.lit("-"), F.lit(" "))]
    for start, forms in (("ENGINE ", ("ENG ", "ENG", "ENGINE")), ("LADDER ", ("LAD ", "LAD", "LADDER", "L ", "L"))):
        said += [F.when(name.startswith(start), F.concat(F.lit(f), number)) for f in forms]
    said += [F.when(name == "FIREBOAT", F.lit(f)) for f in ("FB", "FIRE BOAT")]
    streets = "|".join(w for w in fixed.UNIT_ADDRESS_WORDS if w not in ("trail", "terrace"))
    return F.array_sort(F.filter(F.array_distinct(F.array_compact(F.array(*said))), lambda v: (v != "") & ~F.lower(v).rlike(streets)))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two texts, for which no built-in function exists; null where either is null. Equal pairs of a batch are compared once."""
    ratio = lru_cache(maxsize=None)(lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio())
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def shared_letters(a: Column, b: Column) -> Column:
    """How many characters two texts have in common, as multisets: matching blocks have no more."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


def similar(a: Column, b: Column, above: float = 0.80) -> Column:
    """Whether the ratio of matching blocks of two texts exceeds a bound.

    2 M / T, of T characters M in blocks: no more than the shorter text, or than the letters in common, and no less than a common
    beginning or end (of texts under 200 characters, since of longer ones frequent letters are left out). Only pairs that this leaves open are compared in Python.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    total, short = F.length(a) + F.length(b), F.least(F.length(a), F.length(b))
    same = lambda x, y: F.size(F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda n: (n <= short) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))))
    begin = F.greatest(same(a, b), same(F.reverse(a), F.reverse(b)))
    sure = F.when(a == b, F.lit(True)).when(2 * short <= above * total, F.lit(False)).when(2 * shared_letters(a, b) <= above * total, F.lit(False)).when((F.length(b) < 200) & (2 * begin > above * total), F.lit(True))
    open_ = sure.isNull()
    return F.coalesce(sure, similarity(F.when(open_, a), F.when(open_, b)) > above)


def street_parts(c: Column) -> tuple[Column, Column]:
    """The house number of an address, else an empty text, and its street."""
    pattern = r"^\s*([0-9]+)\s+(.+?)(?:,|$)"
    number = F.regexp_extract(c, pattern, 1)
    return number, F.when(number != "", F.lower(F.trim(F.regexp_extract(c, pattern, 2)))).otherwise(F.lower(c))


def street_told(said: Column, label: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """What decides two addresses before their streets are compared: one is none at all; their house numbers differ."""
    return (said == NO_LOCATION) | (label == NO_LOCATION), (n1 != "") & (n2 != "") & (n1 != n2)


def street_match(said: Column, label: Column) -> Column:
    """Equal house numbers, where both have one, and similar streets. Over many rows see `curate.with_street_match`."""
    (n1, s1), (n2, s2) = street_parts(said), street_parts(label)
    none, differ = street_told(said, label, n1, n2)
    told = none | differ
    return F.when(none, said == label).otherwise(~differ & similar(F.when(~told, s1), F.when(~told, s2)))


def exact_match(said: Column, label: Column) -> Column:
    return F.lower(F.trim(said)) == F.lower(F.trim(label))


def chat_text(system: str, transcript: Column, label: Column) -> Column:
    """A training example in a chat template."""
    turn = lambda role, c: F.concat(F.lit(f"<|im_start|>{role}\n"), c, F.lit("<|im_end|>"))
    return F.concat_ws("\n", turn("system", F.lit(system)), turn("user", F.concat(F.lit("Transmission: "), transcript)), turn("assistant", label))


def transcript_of(chat: Column) -> Column:
    return F.regexp_extract(chat, r"(?s)<\|im_start\|>user\n(?:Transmission: )?(.*?)<\|im_end\|>", 1)


def crime_colour(offense: Column) -> Column:
    out = F
    for word, colour in fixed.CRIME_COLOURS:
        out = out.when(F.contains(F.upper(_text(offense)), F.lit(word)), F.lit(colour))
    return out.otherwise(F.lit(fixed.CRIME_COLOURS[-1][1]))


def tag_class(kind: Column) -> Column:
    kind = F.upper(_text(kind))
    known = F.create_map(*[F.lit(x) for pair in fixed.TAG_CLASSES.items() for x in pair])
    return F.when(F.contains(kind, F.lit("FIRE")), F.lit("fire")).otherwise(F.coalesce(F.try_element_at(known, kind), F.lit("unknown")))


def age_text(seconds: Column) -> Column:
    n = lambda per, unit: F.concat(F.floor(seconds / per).cast("string"), F.lit(unit))
    return F.when(seconds.isNull(), F.lit("--")).when(seconds < 60, F.lit("just now")).when(seconds < 3600, n(60, "m ago")).when(seconds < 86400, n(3600, "h ago")).otherwise(n(86400, "d ago"))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def cache_key(a: Column, feed: Column | None = None) -> Column:
    """The key of a looked-up address; with a feed, since results depend on its area."""
    key = F.lower(F.trim(a))
    return F.md5((key if feed is None else F.concat_ws("|", feed, key)).cast("binary"))


def decision_of(answer: Column, candidates: Column) -> Column:
    """struct(decision, incident_id) of a judge's answer; `candidates` are ids, the best first."""
    said = F.upper(F.trim(_text(answer)))
    part = F.lower(F.substring(F.trim(F.regexp_extract(said, r"^MATCH:?\s*(.*)$", 1)), 1, 36))
    fits = F.filter(candidates, lambda c: (part != "") & F.contains(F.lower(c), part))
    match = F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(candidates, F.lit(1)))
    kind = F.when(said.startswith("MATCH") & match.isNotNull(), F.lit("MATCH")).when(said.startswith("RETRY"), F.lit("RETRY")).otherwise(F.lit("NEW"))
    return F.struct(kind.alias("decision"), F.when(kind == "MATCH", match).alias("incident_id"))


def context_line(incident_id: Column, kind: Column, priority: Column, address: Column, units: Column) -> Column:
    named = F.coalesce(F.nullif(F.array_join(units, ", "), F.lit("")), F.lit("none"))
    return F.concat_ws(" | ", F.concat(F.lit("- "), incident_id.cast("string")), kind, priority, F.coalesce(address, F.lit("unknown location")), F.concat(F.lit("units: "), named))


def feed_short_name(feed: Column) -> Column:
    return F.replace(F.regexp_replace(feed, "^wayneco_", ""), F.lit("_"), F.lit(" "))


def distance_text(km: Column, inferred: Column) -> Column:
    note = F.when(inferred, F.lit(" (location inferred from units)")).otherwise(F.lit(""))
    return F.when(km.isNotNull(), F.concat(F.format_string("%.2f km apart", km), note)).otherwise(F.lit("unknown"))


def age_minutes(ts: Column, as_of: Column) -> Column:
    """struct(minutes, said): whole minutes since a time given as text; null and unknown for one that is no time."""
    since = F.try_to_timestamp(F.regexp_replace(ts, "Z$", ""))
    minutes = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(since)) / 60)
    return F.struct(minutes.alias("minutes"), F.coalesce(F.concat(minutes.cast("string"), F.lit(" minutes ago")), F.lit("unknown")).alias("said"))
