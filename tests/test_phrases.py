"""Phrases in free text against a plain search, with few and with very many phrases."""

import random
import re

from dispatchlake import models
from dispatchlake.operators import phrases
from pyspark.sql import functions as F


def plain(said, known):
    words = re.findall(r"(?:[^\W_]|')+", (said or "").lower())
    at, out = 0, []
    longest = max((len(k) for k in known), default=0)
    while at < len(words):
        n = next((n for n in range(longest, 0, -1) if tuple(words[at : at + n]) in known and at + n <= len(words)), 0)
        if n:
            out.append((at, n, known[tuple(words[at : at + n])]))
        at += n or 1
    return out


def test_against_a_plain_search(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "c's", "dé", "E", "7"])
    listed = [(" ".join(word() for _ in range(rng.randrange(1, 5))), f"v{i}") for i in range(40)] + [("A  b!", "zz"), ("", "none"), (None, "none"), ("?!", "none")]
    rows = [(i, "".join(word() + rng.choice([" ", ", ", "-"]) for _ in range(rng.randrange(12)))) for i in range(300)] + [(400, None), (401, ""), (None, "a b a b"), (402, "a b " * 3000)]
    known = {}
    for phrase, value in listed:
        key = tuple(re.findall(r"(?:[^\W_]|')+", (phrase or "").lower()))
        if key:
            known[key] = min(known.get(key, value), value)
    want = {i: plain(t, known) for i, t in rows}
    got = phrases.found(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame(listed, "phrase string, value string"), "k", "t")
    assert {r.k: [tuple(m) for m in r.found] for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_a_hundred_thousand_phrases_and_none(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST", 10)
    many = spark.range(100_000).selectExpr("concat('lot ', id % 300, ' row ', id) as phrase", "cast(id as string) as value")
    texts = spark.range(200).selectExpr("id as k", "concat('near lot ', id, ' row ', id, ' or lot ', id, ' row 5') as t")
    got = {r.k: [m.value for m in r.found] for r in phrases.found(texts, many, "k", "t").collect()}
    assert got == {k: [str(k)] + ["5"] * (k == 5) for k in range(200)}
    assert phrases.found(texts, many.limit(0), "k", "t").count() == 0


def test_landmarks_and_kinds_in_transcripts(spark):
    said = ["Medics to MGM Grand, third floor", "Meet at 5 Main Street by Hart Plaza", "Prisoner transport", "Caller says nothing. More", "officer use of force report", "ok"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = rows.select("i", models.extract_address(F.col("t"), F.lit("f")).alias("a"), models.structure(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.a for r in got[:3]] == ["MGM Grand Detroit Casino, Detroit, MI", "5 Main Street", "NO_LOCATION"]
    assert [r.s.incident_type for r in got[2:]] == ["PRISONER", "OTHER", "USE_OF_FORCE", "UNKNOWN"]
    assert got[3].s.summary_update == "Caller says nothing."
