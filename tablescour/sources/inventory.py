"""One pass over a set of files: what each holds and whether it can be loaded."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from contextlib import suppress
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.functions.text import trim
from tablescour.sources.header import normalize_header

# What the first bytes mean, and what each extension must hold.
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06")
OLE2_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
CONTROL_BYTES = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
KIND_OF = {"csv": "text", "xlsx": "zip", "xls": "ole2"}
DELIMITERS = ",;\t|"
SNIFFED_CHARS = 16384
TEXTUAL_BYTES = 8192
# Bytes that Windows-1252 leaves undefined, as hexadecimal pairs.
UNDEFINED_CP1252 = "^(?:..)*?(?:81|8D|8F|90|9D)"

_HEAD_BYTES = 4 * SNIFFED_CHARS
MOST_HEAD_BYTES = 1 << 26
# A whole record after any blank lines: quoted parts may hold line ends.
_RECORD = re.compile(rb'\s*(?=\S)[^"\r\n]*(?:"[^"]*"[^"\r\n]*)*[\r\n]')
_HEAD_SCHEMA = (
    "path string, kind string, delimiter string, header array<string>, delimiter_1252 string, header_1252 array<string>"
)


def sniff_kind(head: bytes) -> str:
    if head.startswith(ZIP_MAGIC):
        return "zip"
    if head.startswith(OLE2_MAGIC):
        return "ole2"
    return "binary" if CONTROL_BYTES.search(head[:TEXTUAL_BYTES]) else "text"


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:SNIFFED_CHARS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _read_head(path: str, most: int) -> bytes:
    """The start of a file, at least as far as its first record reaches.

    Reading goes on while the text has no line end outside quotes after its first cell.
    """
    from pyarrow import fs

    if path.startswith("file:"):
        filesystem, name = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    else:
        filesystem, name = fs.FileSystem.from_uri(quote(re.sub("^s3a:", "s3:", path), safe="/:@"))
    with filesystem.open_input_stream(name) as stream:
        head = stream.read(_HEAD_BYTES)
        while len(head) < most and not _RECORD.match(head):
            more = stream.read(len(head))
            if not more:
                break
            head += more
        return head


def _records(sample: str, delimiter: str) -> list[list[str]]:
    """The records of a file's first characters, without one that is cut off at their end."""
    records = []
    with suppress(csv.Error):  # a cell too long for the reader
        records.extend(r for r in csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter) if r)
    return records if sample.endswith(("\n", "\r")) or len(records) < 2 else records[:-1]


def _separates(delimiter: str, sample: str) -> bool:
    """Whether a delimiter splits the first record, or most of the others."""
    first, *others = _records(sample, delimiter) or [[]]
    return len(first) > 1 or 2 * sum(len(r) > 1 for r in others) > len(others)


def find_delimiter(sample: str) -> str:
    """The sniffed delimiter, unless it is only a mark in some texts of the file.

    The sniffer also counts marks inside quoted cells. One that separates nothing would
    break the few records further on that hold it unquoted; so the first delimiter counts
    under which all records are equally wide, as those of a single column are.
    """
    delimiter = sniff_delimiter(sample)
    sample = sample[:_HEAD_BYTES]
    if delimiter == DELIMITERS[0] or _separates(delimiter, sample):
        return delimiter
    return next((d for d in DELIMITERS if len({len(r) for r in _records(sample, d)}) == 1), delimiter)


def _layout(sample: str) -> tuple[str, list[str]]:
    """Delimiter and column names of a file by its first characters."""
    delimiter = find_delimiter(sample)
    records = csv.reader(io.StringIO(sample, newline=""), delimiter=delimiter)
    return delimiter, normalize_header(next((r for r in records if r), []))


def _heads(most: int):
    """Kind of each file, and its layout read in both encodings: which of them the file
    has is only known from all its lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                head = _read_head(path, most)
                kind = sniff_kind(head)
                if kind == "text" and head.strip():
                    # A character may be cut at the end of the head; others are wrong only
                    # where the other layout counts.
                    utf8 = _layout(head.decode("utf-8-sig", errors="replace"))
                    cp1252 = utf8 if head.isascii() else _layout(head.decode("cp1252", errors="replace"))
                    rows.append((path, kind, *utf8, *cp1252))
                else:
                    rows.append((path, kind, None, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HEAD_SCHEMA.split(", ")])

    return run


def plain_local(path: Column) -> Column:
    """One spelling of local paths: file:///x and file:/x name one file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def plain_path(path: Column) -> Column:
    """A metadata path, which is URL-encoded, in the spelling of a file listing."""
    return plain_local(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def line_checks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file, over all its lines: encoding, NUL bytes, quotes that span lines.

    Lines arrive as raw bytes in splittable tasks and reduce to a few flags per file
    before the shuffle, so one huge file is checked by many tasks.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value")
    )
    value = F.col("value")
    wide = ~F.is_valid_utf8(value) | (F.octet_length(value) != F.length(value))
    undefined = F.when(wide, F.hex(value.cast("binary")).rlike(UNDEFINED_CP1252)).otherwise(False)
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(undefined).alias("undefined_cp1252"),
        F.bool_or(F.instr(value, "\x00") > 0).alias("has_nul"),
        F.bool_and(trim(value) == "").alias("blank"),
        F.bool_or(quotes % 2 == 1).alias("spans_lines"),
    )


def inventory(
    spark: SparkSession,
    paths: Sequence[str] | str,
    max_bytes: int | None = None,
    most_head_bytes: int = MOST_HEAD_BYTES,
) -> DataFrame:
    """One row per file: path, filename, extension, size_bytes, kind, encoding, delimiter,
    header, spans_lines, status and error_code (NULL when it can be loaded).

    A first record longer than ``most_head_bytes`` is taken for a quote that is never
    closed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    # The content column is not read: this lists names and sizes only. Scans skip empty
    # files, which the listing of the reader still names.
    listing = spark.read.format("binaryFile").load(paths)
    files = listing.select("path", F.col("length").alias("size_bytes"))
    named = spark.createDataFrame([(p,) for p in listing.inputFiles()], "path string")
    named = named.withColumn("path", plain_path(F.col("path")))
    heads = files.select("path").mapInPandas(_heads(most_head_bytes), _HEAD_SCHEMA)
    checks = line_checks(spark, paths).withColumn("path", plain_path(F.col("path")))
    files = files.withColumn("path", plain_local(F.col("path")))
    heads = heads.withColumn("path", plain_local(F.col("path")))
    joined = named.join(files, "path", "left").join(heads, "path", "left").join(checks, "path", "left")
    joined = joined.withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    filename = F.substring_index("path", "/", -1)
    extension = F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1)))
    expected = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])
    error = (
        F.when(F.try_element_at(expected, F.coalesce("extension", F.lit(""))).isNull(), "unsupported_file_type")
        .when(F.col("size_bytes") == 0, "empty_file")
    )
    if max_bytes is not None:
        error = error.when(F.col("size_bytes") > max_bytes, "file_too_large")
    error = (
        error.when(F.col("kind") == "binary", "invalid_encoding")
        .when(F.try_element_at(expected, F.col("extension")) != F.col("kind"), "content_type_mismatch")
        .when(F.col("kind") != "text", "unsupported_file_type")
        .when(F.coalesce("blank", F.lit(True)), "empty_file")
        .when(F.col("has_nul"), "invalid_encoding")
        .when(~F.col("utf8") & F.col("undefined_cp1252"), "invalid_encoding")
    )
    out = joined.withColumn("filename", filename).withColumn("extension", extension)
    return out.select(
        "path",
        "filename",
        "extension",
        "size_bytes",
        F.coalesce("kind", F.lit("text")).alias("kind"),
        F.when(F.col("kind") == "text", F.when(F.col("utf8"), "UTF-8").when(~F.col("utf8"), "windows-1252")).alias("encoding"),
        F.when(F.col("utf8"), F.col("delimiter")).otherwise(F.col("delimiter_1252")).alias("delimiter"),
        F.when(F.col("utf8"), F.col("header")).otherwise(F.col("header_1252")).alias("header"),
        F.coalesce("spans_lines", F.lit(False)).alias("spans_lines"),
        F.when(error.isNull(), "accepted").otherwise("failed").alias("status"),
        error.alias("error_code"),
    )
