"""URL rules found by their rarest literal token; only rules so found run their regular expression.

A rule is a host with all its subdomains and the start of a path. Its tokens are the runs of
letters and digits that end inside the rule, so that a URL it fits has them whole. Each rule is
filed under the token that the fewest URLs have. A URL fetches the rules filed under its own
tokens; among those whose expression fits, the longest decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: rules up to this number travel inside the query; more are joined
INLINE = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", self.name)
        return rf"^([^/]*\.)?{quoted}"

    @property
    def tokens(self) -> list[str]:
        whole = re.sub(r"[A-Za-z0-9]+$", "", self.name)  # a URL may go on in the middle of the last one
        return sorted(set(re.findall(r"[A-Za-z0-9]+", whole)))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit("([A-Za-z0-9]+)"), 1))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """The token of each rule that the fewest rows of `urls` (subject) have; '' for a rule without tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = urls.select(F.explode(_tokens(F.col("subject"))).alias("token"))
    vocabulary = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counts = {r.token: r["count"] for r in seen.join(F.broadcast(vocabulary) if len(wanted) <= 8 * INLINE else vocabulary, "token").groupBy("token").count().collect()} if wanted else {}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="") for r in rules}


def _inline(rows: DataFrame, filed: dict[Rule, str]) -> DataFrame:
    """Candidates come from a map of the rules that is part of the query."""
    entry = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex"))
    by_token: dict[str, list[Rule]] = {}
    for rule, token in filed.items():
        by_token.setdefault(token, []).append(rule)
    index = F.create_map(*[x for t, rules in by_token.items() for x in (F.lit(t), F.array(*map(entry, rules)))])
    keys = F.filter(F.concat(_tokens(F.col("subject")), F.array(F.lit(""))), lambda t: F.map_contains_key(index, t))
    candidates = F.flatten(F.transform(keys, lambda t: F.element_at(index, t)))
    fits = F.filter(candidates, lambda c: F.regexp_like(F.col("subject"), c["regex"]))
    return rows.withColumn("best", F.array_max(fits))


def _joined(rows: DataFrame, filed: dict[Rule, str]) -> DataFrame:
    """Candidates come from a join of the distinct URLs' tokens with the rules."""
    entries = [(token, len(r.name), r.verdict, r.name, r.regex) for r, token in filed.items()]
    rules = rows.sparkSession.createDataFrame(entries, "token string, size int, verdict string, name string, regex string")
    subjects = rows.select("subject").distinct()
    tokens = subjects.select("subject", F.explode(F.concat(_tokens(F.col("subject")), F.array(F.lit("")))).alias("token"))
    fits = tokens.join(rules, "token").where(F.regexp_like("subject", F.col("regex")))
    best = fits.groupBy("subject").agg(F.max(F.struct("size", "verdict", "name", "regex")).alias("best"))
    return rows.join(best, "subject", "left")


def judge(pages: DataFrame, rules: list[Rule], otherwise: str = "allow", inline: int = INLINE) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule (null if none fits), verdict.

    Of several rules of one length, block goes before allow. A null url, or one without
    "://", has an empty host and path, which no rule with a token fits. Repeated rows are judged
    alike. Only page_id and url are read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("subject", F.concat("host", "path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    filed = rarest_tokens(rows, rules)
    rows = (_inline if len(rules) <= inline else _joined)(rows, filed)
    return rows.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
