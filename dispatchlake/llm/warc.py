"""WARC derivatives: for each response record a metadata and a plain-text conversion record.

Both refer to the response by WARC-Refers-To and repeat its target and date. The metadata record
holds the response's HTTP status line and headers, its digests and the page's title as
warc-fields; the conversion record holds the page's text. Digests are SHA-1 in base 32. Record
ids are made of what a response is and, of equal ones, which it is, so that no two are equal
and the same input gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.llm.common import cut

RESPONSE = "key long, record_id string, target_uri string, date string, http_head string, payload string"
RECORD = "key long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name: string, value: string>>, block_digest string, source_payload_digest string, block binary"

#: repeated responses up to this number of different ones are told by a broadcast; more by a shuffle
BROADCAST = 200_000
_MARK = re.compile(r"<(?:!--|(/?)([A-Za-z]\w*)|[/!?])")
_CLOSING = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "head", "title")}
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
# fixed values: elements that start a line of their own
BLOCKS = "address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(page: str) -> str:
    """The text of a page: a line for each block, white space in a line as one space.

    Comments, and elements whose text isn't shown, give a space; one that is never closed is a tag
    like any other. One pass forwards: what is known to have no end isn't looked for again.
    """
    out, at, endless = [], 0, set()
    while mark := _MARK.search(page, at):
        kind = "-->" if mark[0] == "<!--" else (mark[2] or "").lower()
        opened = page.find(">", mark.end())
        end, shown = -1, " "
        if kind not in endless:
            if kind == "-->":
                end = page.find(kind, mark.end()) + 3
                end = end if end > 2 else -1
            elif kind in _CLOSING and kind != "title" and not mark[1] and opened >= 0:
                closing = _CLOSING[kind].search(page, opened + 1)
                end = closing.end() if closing else -1
            else:
                kind = ""
            if end < 0 and kind:
                endless.add(kind)
        if end < 0:
            end, shown = opened + 1, "\n" if (mark[2] or "").lower() in BLOCKS else ""
        if end == 0:  # no tag ends any more
            break
        out += [page[at : mark.start()], shown]
        at = end
    lines = (" ".join(line.split()) for line in html.unescape("".join(out) + page[at:]).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str:
    opened = _TITLE.search(page[: page.rfind(">") + 1])
    closed = _CLOSING["title"].search(page, opened.end()) if opened else None
    return " ".join(html.unescape(page[opened.end() : closed.start()]).split()) if closed else ""


def fields(head: str) -> list[tuple[str, str]]:
    """(name, value) of the lines of a header block; a folded line belongs to the one before it."""
    out: list[tuple[str, str]] = []
    for line in head.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _derive(key, source, uri, date, head, page) -> list[dict]:
    head, page = head or "", page or ""
    payload = page.encode()
    status = head.replace("\r\n", "\n").split("\n")[0]
    lines = [("http-status", status)] if status else []
    lines += [(f"http-header-{n.lower()}", v) for n, v in fields(head[len(status) :])]
    lines += [("payload-digest", digest(payload)), ("block-digest", digest(head.encode() + b"\r\n" + payload)), ("payload-length", str(len(payload))), ("title", title_of(page))]
    out = []
    for kind, content, block in (
        ("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in lines).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode()),
    ):
        own = record_id(kind, source or "", uri or "", digest(payload))
        named = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
        headers = [{"name": n, "value": v} for n, v in named if v is not None]
        out.append({"key": key, "warc_type": kind, "record_id": own, "refers_to": source, "target_uri": uri, "date": date, "content_type": content, "headers": headers, "block_digest": digest(block), "source_payload_digest": digest(payload), "block": block})
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response (see RESPONSE): its metadata and its conversion (see RECORD).

    A null payload or header block counts as empty; a null target, date or record id is left out
    of the headers. Record ids name the kind and the response's own id, target and payload, so they differ as those
    do: `responses_from_pages` tells equal rows apart. A page of any length is one row in a task,
    read once from start to end. An empty table gives an empty result; columns other than those
    of RESPONSE are not read.
    """
    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"key": pa.int64(), "headers": header, "block": pa.binary()}
    names = [c.split()[0] for c in re.split(r", (?=\w+ (?:long|string|array|binary))", RECORD)]
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True)
                yield pa.RecordBatch.from_pylist([x for r in rows for x in _derive(*r)], schema=schema)

    columns = [c.split()[0] for c in RESPONSE.split(", ")]
    return responses.select(*columns).mapInArrow(run, RECORD)


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records from a table of (page_id, url, html).

    Ids name the page_id, the url and the html, and of rows equal in all three which one it is:
    only those rows are numbered, and shuffled for it.
    """
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    shown = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = pages.select("page_id", "url", "html", F.md5(F.concat_ws("\x1f", F.lit("response"), shown("page_id"), shown("url"), F.md5(shown("html").cast("binary"))).cast("binary")).alias("hexed"))
    again = cut(rows.groupBy("hexed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hexed"), "repeated")
    again = F.broadcast(again) if again.count() <= BROADCAST else again
    nth = F.row_number().over(Window.partitionBy("hexed").orderBy("page_id"))
    numbered = rows.join(again, "hexed", "left_semi").withColumn("nth", nth)
    numbered = numbered.withColumn("hexed", F.when(F.col("nth") > 1, F.md5(F.concat_ws("\x1f", "hexed", F.col("nth").cast("string")).cast("binary"))).otherwise(F.col("hexed")))
    rows = rows.join(again, "hexed", "left_anti").unionByName(numbered.drop("nth"))
    parts = [F.substring("hexed", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    source = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return rows.select(F.col("page_id").cast("long").alias("key"), source.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(head).alias("http_head"), F.col("html").alias("payload"))


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def from_bytes(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The (headers, block) of the records of an uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        end = len(data) if end < 0 else end
        version, _, head = data[at:end].partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = fields(head.decode())
        size = int(dict(headers)["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return out


def unzipped(data: bytes) -> bytes:
    """The bytes of a WARC file whose records may be gzip members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) + data


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records (see RESPONSE) of WARC files, gzipped or not; key is null.

    A file is one row, so it may have 2 GB at most. Payloads that are no UTF-8 have replacement
    characters; a response without a header block of its own has an empty one.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in from_bytes(unzipped(data.as_py())):
                    named = {n.lower(): v for n, v in headers}
                    if named.get("warc-type") == "response":
                        head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                        head = head.decode("utf-8", "replace") + "\r\n" if head else ""
                        rows.append((None, named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), head, payload.decode("utf-8", "replace")))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "key" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)
