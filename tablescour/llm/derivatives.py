"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records, written one after the other, each a gzip member of its
own: ``metadata`` (title, language, links, and the source's digests and HTTP headers as
``application/warc-fields``) and ``conversion`` (the visible text). Both name the response
in ``WARC-Refers-To``, with its address, date and payload digest. Identifiers follow from
the response's, so a run that is repeated writes the same files.

Text: comments, scripts and styles go, tags of blocks part lines, other tags vanish,
entities are read, blanks are collapsed. An element or comment that is never closed ends
with the page; a ``<`` that begins no tag is text.

Defined cases: a null or empty page gives an empty conversion; a null address leaves the
address headers out; a null id leaves ``X-Source-Id`` out; line breaks in an address are
percent-encoded; equal rows give equal records, all written; an empty table writes no
file; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.llm.files import Output, open_input
from tablescour.session import shared_dir

DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, n_records long, n_bytes long"
RECORDS = (
    "page_id long, url string, response_id string, metadata_id string, conversion_id string, "
    "payload_digest string, text_digest string, title string, lang string, n_links long, "
    "n_chars long, linked boolean, metadata_offset long, conversion_offset long, file string"
)

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
_HEAD = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|blockquote|pre|hr|"
    r"title|body|html|head|dl|dt|dd|figure|form|main|aside|option|td|th)\b[^<>]*>", re.I
)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>")
_BLANKS = "\t\r\f\v\xa0"
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
# A path from the root that joins as it stands: no empty or dot segments, no further parts.
_ROOTED = re.compile(r"(?:/(?!\.\.?(?:/|\Z))[^\x00-\x20/;?#]+)+")

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _BASE32 for b in _BASE32]


def visible_text(page: str) -> str:
    text = _HIDDEN.sub("", page)
    text = _TAG.sub("", _BREAK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    for blank in _BLANKS:
        text = text.replace(blank, " ")
    text = _single(text, " ").replace(" \n", "\n").replace("\n ", "\n")
    return _single(text, "\n").strip()


def _single(text: str, char: str) -> str:
    """Runs of ``char`` as one; each round halves them."""
    while char * 2 in text:
        text = text.replace(char * 2, char)
    return text


def _digest(block: bytes) -> str:
    bits = int.from_bytes(hashlib.sha1(block).digest())
    return "sha1:" + "".join([_PAIRS[bits >> at & 1023] for at in range(150, -1, -10)])


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers if v is not None)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _derived(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>"


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def outlinks(base: str, links: list[str]) -> list[str]:
    """Links joined to the address of their page; paths from the root share one join."""
    root = _joined(base, "/x")[:-2]
    return [root + link if _ROOTED.fullmatch(link) else _joined(base, link) for link in links]


def derive(source: dict) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response.

    ``source``: source_id, record_id, target_uri, date, http_headers (text), payload (text).
    """
    page = source["payload"] or ""
    payload = page.encode()
    http = source["http_headers"]
    uri = None if source["target_uri"] is None else _one_line(source["target_uri"])
    digest, whole = _digest(payload), _digest(http.encode() + b"\r\n\r\n" + payload)
    text = visible_text(page).encode()
    title = _HEAD.search(page)
    title = " ".join(html.unescape(title[1]).split()) if title else ""
    lang = _LANG.search(page)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    fields = [("title", title), ("html-lang", lang[1] if lang else ""), ("links", str(len(links)))]
    fields += [("outlink", _one_line(f"{link} L a/@href")) for link in outlinks(uri or "", links)]
    fields += [("source-block-digest", whole), ("source-payload-digest", digest)]
    first, *rest = http.split("\r\n")
    fields += [("source-status", first), *(("source-header", line) for line in rest if line)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()

    def record(kind, content_type, block):
        number = source["source_id"]
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", _derived(source["record_id"], kind)),
            ("WARC-Date", source["date"]), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", source["date"]), ("X-Refers-To-Payload-Digest", digest),
            ("X-Source-Id", None if number is None else str(number)),
            ("WARC-Block-Digest", _digest(block)), ("Content-Type", content_type),
        ]
        return _record(headers, block)

    return record("metadata", "application/warc-fields", about), record("conversion", "text/plain; charset=utf-8", text)


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table (page_id, url, html)."""
    key = F.sha1(F.concat_ws("\u0001", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    cut = lambda a, n: F.substring(key, a, n)
    name = F.concat(
        F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"),
        cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"),
    )
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string")
    )
    return pages.select(
        F.col("page_id").cast("long").alias("source_id"), name.alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), http.alias("http_headers"),
        F.col("html").alias("payload"),
    )


def write_derivatives(responses: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Write the records of each partition to one file; the index has a row per file."""

    def write(batches):
        context, output, n, size = TaskContext.get(), None, 0, 0
        for batch in batches:
            if output is None and batch.num_rows:
                name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
                output = Output(name, context.taskAttemptId())
            names = batch.schema.names
            for row in zip(*batch.columns):
                for record in derive({c: v.as_py() for c, v in zip(names, row)}):
                    member = gzip.compress(record, level, mtime=0)
                    output.stream.write(member)
                    n, size = n + 1, size + len(member)
        if output is not None:
            output.finish()
            columns = [pa.array([name]), pa.array([n]), pa.array([size])]
            yield pa.record_batch(columns, names=["file", "n_records", "n_bytes"])

    responses.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return responses.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(uri: str, chunk: int = 1 << 20, piece: int = 1 << 12):
    """(offset, headers, block) of each record of a file, member by member. An engine that
    ends copies what it was given beyond its member, so it is given small pieces."""
    with open_input(uri) as file:
        offset, start, engine, parts = 0, 0, zlib.decompressobj(31), []
        while data := file.read(chunk):
            data, at = memoryview(data), 0
            while at < len(data):
                given = data[at : at + piece]
                parts.append(engine.decompress(given))
                used = len(given) - len(engine.unused_data)
                at, offset = at + used, offset + used
                if not engine.eof:
                    continue
                raw = b"".join(parts)
                head, _, rest = raw.partition(b"\r\n\r\n")
                headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                yield start, headers, rest[: int(headers["Content-Length"])]
                start, engine, parts = offset, zlib.decompressobj(31), []


def read_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per response from the files. ``linked``: both records name the same response
    and its payload, and their blocks have the digests stated."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")

    def rows(uri):
        records = read_records(uri)
        for (at, meta, about), (then, text, block) in zip(records, records):
            fields = dict(reversed([line.split(": ", 1) for line in about.decode().split("\r\n") if line]))
            same = all(meta.get(k) == text.get(k) for k in ("WARC-Refers-To", "X-Source-Id", "X-Refers-To-Payload-Digest"))
            linked = (
                same and meta["WARC-Type"] == "metadata" and text["WARC-Type"] == "conversion"
                and meta["WARC-Block-Digest"] == _digest(about) and text["WARC-Block-Digest"] == _digest(block)
                and fields["source-payload-digest"] == text["X-Refers-To-Payload-Digest"]
            )
            number = text.get("X-Source-Id")
            yield (
                None if number is None else int(number), text.get("WARC-Refers-To-Target-URI"),
                text["WARC-Refers-To"], meta["WARC-Record-ID"], text["WARC-Record-ID"],
                text["X-Refers-To-Payload-Digest"], text["WARC-Block-Digest"], fields["title"],
                fields["html-lang"], int(fields["links"]), len(block.decode()), linked, at, then, uri,
            )

    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held = []
                for row in rows(uri):
                    held.append(row)
                    if len(held) == 2000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)

    files = index.select("file").repartition(max(1, index.count()))
    return files.mapInArrow(read, RECORDS)


def build(pages: DataFrame) -> DataFrame:
    """Write the derivatives of all pages to a new shared folder and read them back."""
    folder = shared_dir(pages.sparkSession, "derivatives")
    write_derivatives(page_responses(pages), folder)
    return read_derivatives(pages.sparkSession, folder)
