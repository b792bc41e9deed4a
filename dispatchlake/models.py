"""Where models plug in: functions from columns to a column, with rules as defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispatchlake.functions import fixed, text

_STREET = r"(?i)\b([0-9]{1,5} (?:(?:north|south|east|west) )?[A-Za-z0-9]+(?: [A-Za-z]+)? (?:road|rd|avenue|ave|street|st|drive|dr|boulevard|blvd|lane|ln|court|ct|highway|hwy))\b"
_CROSSING = r"\b([A-Z][a-z]+|[0-9]{1,2} Mile) and ([A-Z][a-z]+|[0-9]{1,2} Mile)\b"
#: incident types and the words that tell them, in order
TYPE_WORDS = [
    ("VEHICLE_FIRE", "vehicle fire|car fire|car on fire|truck fire"), ("STRUCTURE_FIRE", "structure fire|building on fire|house fire|smoke|fire alarm"), ("SHOOTING", "shots fired|gunshot|person shot|shooting"),
    ("TRAFFIC_ACCIDENT", "crash|accident|hit and run|collision"), ("PURSUIT", "pursuit|fleeing"), ("BOMB_THREAT", "bomb|explosive|suspicious package"), ("HAZMAT", "gas leak|hazmat|chemical"),
    ("ROBBERY", "robbery|carjacking"), ("BURGLARY", "breaking and entering|home invasion|burglary"), ("DOMESTIC", "domestic|family fight"), ("ASSAULT", "assault|battery|fight"), ("THEFT", "larceny|shoplifting|stolen"),
    ("USE_OF_FORCE", "use of force"), ("WELFARE_CHECK", "welfare|wellness"), ("SUSPICIOUS", "suspicious"), ("PRISONER", "prisoner|in custody|detention|jail"), ("MEDICAL", "medical|unconscious|cardiac|overdose|injury|ems"),
    ("OTHER", "respond|responding|en route|caller"),
]


def extract_address(transcript: Column, feed: Column) -> Column:
    """House number and street, else a crossing, else the address of a landmark that is named, else NO_LOCATION."""
    named = "|".join(sorted(fixed.LANDMARKS, key=len, reverse=True))
    landmark = text.resolve_landmark(F.regexp_extract(F.lower(transcript), rf"\b({named})\b", 1))
    street, crossing = F.regexp_extract(transcript, _STREET, 1), F.regexp_extract(transcript, _CROSSING, 0)
    return F.coalesce(F.nullif(street, F.lit("")), F.nullif(crossing, F.lit("")), landmark, F.lit(text.NO_LOCATION))


def incident_type(transcript: Column) -> Column:
    out = F
    for kind, words in TYPE_WORDS:
        out = out.when(F.lower(transcript).rlike(rf"\b(?:{words})"), F.lit(kind))
    return out.otherwise(F.lit("UNKNOWN"))


#: the priority of incident types, and what units are called
HIGH, MEDIUM = ["STRUCTURE_FIRE", "VEHICLE_FIRE", "SHOOTING", "BOMB_THREAT", "HAZMAT", "PURSUIT", "ROBBERY"], ["MEDICAL", "TRAFFIC_ACCIDENT", "ASSAULT", "DOMESTIC", "BURGLARY"]
_UNIT = r"(?i)\b((?:engine|ladder|medic|car|squad|rescue|truck|battalion|chief) [0-9]+)\b"
_CLEARED = r"(?i)\b((?:engine|ladder|medic|car|squad|rescue|truck|battalion|chief) [0-9]+) (?:is )?(?:clear|available|in service)\b"


def structure(transcript: Column) -> Column:
    """struct of what a transcript tells: has_incident, incident_type, priority, units_added, units_cleared, summary_update (its first sentence)."""
    kind = incident_type(transcript)
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(transcript, F.lit("")), F.lit(pattern), F.lit(1)), F.upper))
    priority = F.when(kind.isin(HIGH), F.lit("HIGH")).when(kind.isin(MEDIUM), F.lit("MEDIUM")).when(kind == "UNKNOWN", F.lit("UNKNOWN")).otherwise(F.lit("LOW"))
    cleared = found(_CLEARED)
    return F.struct((kind != "UNKNOWN").alias("has_incident"), kind.alias("incident_type"), priority.alias("priority"), F.array_except(found(_UNIT), cleared).alias("units_added"), cleared.alias("units_cleared"), F.trim(F.regexp_extract(F.coalesce(transcript, F.lit("")), r"^[^.!?]*[.!?]?", 0)).alias("summary_update"))


def summarise(texts: Column) -> Column:
    """The first and the last of an incident's texts."""
    return F.when(F.size(texts) > 1, F.concat_ws(" … ", F.element_at(texts, 1), F.element_at(texts, -1))).otherwise(F.try_element_at(texts, F.lit(1)))


@dataclass(frozen=True)
class Models:
    """The engine's opaque functions; pass pandas UDFs to call models."""

    address: Callable[[Column, Column], Column] = extract_address
    type: Callable[[Column], Column] = incident_type
    structure: Callable[[Column], Column] = structure
    summary: Callable[[Column], Column] = summarise
