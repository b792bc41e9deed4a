import base64
import gzip
import hashlib
import random
import time

from dispatchlake.llm import warc

PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>var t="</p>";</script><p>One <b>two</b>&nbsp;three &lt;4&gt;<br>five<p>six < seven</body></html>'


def test_plain_text():
    assert warc.plain_text(PAGE) == "One two three <4>\nfive\nsix < seven"
    assert warc.title_of(PAGE) == "A & B"
    assert warc.plain_text("") == warc.title_of("") == ""


def test_records_round_trip_and_link(spark):
    rows = [(1, "http://a.org/é", PAGE), (2, None, None), (2, None, None), (2, None, None), (None, "http://b.org", "x" * 300_000), (None, "http://b.org", "y"), (None, None, "y"), (4, "u", ""), (4, "u", None), (4, "u", "")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, hexed string, nth string")
    responses = warc.responses_from_pages(pages)
    got = warc.derive(responses).collect()
    assert len(got) == 2 * len(rows)
    sources = {r.record_id: r for r in responses.collect()}
    data = b"".join(warc.to_bytes([tuple(h) for h in r.headers], r.block) for r in got)
    back = warc.from_bytes(data)
    assert [([tuple(h) for h in r.headers], bytes(r.block)) for r in got] == back
    for r in got:
        source = sources[r.refers_to]
        named = dict(tuple(h) for h in r.headers)
        assert r.refers_to == named["WARC-Refers-To"] == source.record_id
        assert r.target_uri == source.target_uri and r.date == source.date
        assert named["WARC-Block-Digest"] == warc.digest(r.block) and int(named["Content-Length"]) == len(r.block)
        assert r.source_payload_digest == warc.digest((source.payload or "").encode())
        if r.warc_type == "metadata":
            said = dict(warc.fields(r.block.decode()))
            assert said["payload-digest"] == r.source_payload_digest
            assert said["http-header-content-type"] == "text/html; charset=utf-8" and said["http-status"] == "HTTP/1.1 200 OK"
        else:
            assert r.block.decode() == warc.plain_text(source.payload or "")
    assert len({r.record_id for r in got} | {r.record_id for r in responses.collect()}) == 3 * len(rows)
    assert sorted(map(str, got)) == sorted(map(str, warc.derive(warc.responses_from_pages(pages.repartition(3))).collect()))


def test_folded_headers():
    assert warc.fields("A: b\r\n c\r\nD:e\r\nnothing") == [("A", "b c"), ("D", "e")]


def test_no_pages(spark):
    assert warc.derive(warc.responses_from_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


KINDS = ("script", "style", "noscript", "template", "head")
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&eacute;": "é", "&#65;": "A"}


def plain(page):
    """A page's text, letter by letter: no regular expressions and nothing of the operator's own."""
    out, i, low = "", 0, page.lower()
    while i < len(page):
        if low.startswith("<!--", i) and "-->" in low[i + 4 :]:
            out, i = out + " ", low.index("-->", i + 4) + 3
            continue
        name = ""
        if page[i] == "<" and i + 1 < len(page):
            j = i + 1 + (page[i + 1] == "/")
            while j < len(page) and (low[j].isalnum() or low[j] == "_"):
                name += low[j]
                j += 1
        opened = page.find(">", i)
        if name in KINDS and page[i + 1] != "/" and opened >= 0:
            k = opened + 1
            while k >= 0 and (k := low.find(f"</{name}", k)) >= 0:
                e = k + len(name) + 2
                while e < len(page) and page[e].isspace():
                    e += 1
                if e < len(page) and page[e] == ">":
                    break
                k += 1
            if k >= 0:
                out, i = out + " ", e + 1
                continue
        if page[i] == "<" and opened >= 0 and i + 1 < len(page) and (page[i + 1].isascii() and page[i + 1].isalpha() or page[i + 1] in "/!?"):
            out, i = out + ("\n" if name in BLOCKS else ""), opened + 1
            continue
        out, i = out + page[i], i + 1
    for k, v in NAMED.items():
        if k != "&amp;":
            out = out.replace(k, v)
    out = out.replace("&amp;", "&")
    return "\n".join(x for x in (" ".join(line.split()) for line in out.split("\n")) if x)


def random_page(rng):
    bits = ["word ", "two  words", "\n", "é", "<p>", "</p>", "<b>", "</b>", "<br/>", "<li class='x'>", "<h2 id=a>", "<span\n>", "< no tag", "a > b", "<!-- c -->", "<!-- open", "-->", "<script>", "<script src='x'>", "</script >", "</SCRIPT>", "<style>", "</style>", "<head>", "</head>", "<header>", "<noscript>", "<", ">", *NAMED]
    return "".join(rng.choices(bits, k=rng.randrange(25)))


def test_records_match_a_plain_derivation(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, f"http://h{i}.org/p"]), random_page(rng)) for i in range(600)]
    responses = warc.responses_from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    ids = {r.key: r.record_id for r in responses.collect()}
    got = {(r.key, r.warc_type): r for r in warc.derive(responses).collect()}
    assert len(got) == 1200
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for i, url, page in rows:
        raw = page.encode()
        said = [("http-status", "HTTP/1.1 200 OK"), ("http-header-content-type", "text/html; charset=utf-8"), ("payload-digest", sha(raw)), ("block-digest", sha(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + raw)), ("payload-length", str(len(raw))), ("title", "")]
        for kind, block, content in (("metadata", "".join(f"{a}: {b}\r\n" for a, b in said), "application/warc-fields"), ("conversion", plain(page), "text/plain; charset=utf-8")):
            r = got[i, kind]
            assert bytes(r.block).decode() == block, page
            want = {"WARC-Type": kind, "WARC-Record-ID": r.record_id, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url, "WARC-Refers-To": ids[i], "WARC-Block-Digest": sha(block.encode()), "Content-Type": content, "Content-Length": str(len(block.encode()))}
            assert {h["name"]: h["value"] for h in r.headers} == {k: v for k, v in want.items() if v is not None}


def test_hostile_pages_take_one_pass():
    began = time.time()
    for bit in ("<script>", "<!--", "<a", "<p", "<title>", "</script ", "<style <", "<head>x</head"):
        warc.plain_text(bit * (1_000_000 // len(bit)))
        warc.title_of(bit * (1_000_000 // len(bit)))
    assert time.time() - began < 20


def test_files_are_read(spark, tmp_path):
    rows = [("<urn:uuid:1>", "http://a.org", "HTTP/1.1 200 OK\r\nA: b\r\n", "<p>é</p>"), ("<urn:uuid:2>", "http://b.org", "", "plain")]
    records = [warc.to_bytes([("WARC-Type", "warcinfo"), ("Content-Length", "2")], b"hi")]
    for source, uri, head, page in rows:
        block = (head + "\r\n" if head else "").encode() + page.encode()
        records.append(warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", source), ("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Length", str(len(block)))], block))
    (tmp_path / "one.warc").write_bytes(b"".join(records))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_responses(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(2 * [(s, u, "2024-01-01T00:00:00Z", h, p) for s, u, h, p in rows])
    assert warc.derive(warc.read_responses(spark, str(tmp_path))).count() == 8
