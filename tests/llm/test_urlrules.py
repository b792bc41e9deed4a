import random

import pytest
from dispatchlake.llm.queries import URL_RULES
from dispatchlake.llm.urlrules import Rule, judge


def plain(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), r.verdict, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else otherwise


@pytest.mark.parametrize("inline", [100, 0])
def test_against_plain_rules(spark, inline):
    rng = random.Random(3)
    rules = [*URL_RULES, Rule("block", "a-b.com", "/x.y/(z"), Rule("block", "net"), Rule("allow", "net", "/ads"), Rule("block", "", "/only")]
    hosts = ["example.org", "EN.Example.ORG", "xexample.org", "org", "com", "a.b.com", "a-b.com", "www.a-b.com:80", "net", "é.net", "", "user@x.net"]
    paths = ["", "/", "/es/a", "/es", "/en/1", "/en/12", "/EN/1", "/fr/x?y", "/de/#t", "/x.y/(z1", "/ads?u=http://b.org/", "/only", "?q=/fr/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "x://y://", "") for h in hosts for p in paths] + [None, "", "no scheme", "http://a\n.org/\nes/"]
    rng.shuffle(urls)
    rows = [(i, u, "html") for i, u in enumerate(urls)] + [(3, urls[3], None), (None, urls[4], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("html", "host")
    got = judge(pages, rules, inline=inline).collect()
    want = [(i, *plain(u, rules)) for i, u, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_rows_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, URL_RULES).count() == 0
    assert judge(spark.createDataFrame([(1, None)], "page_id long, url string"), []).first().verdict == "allow"
