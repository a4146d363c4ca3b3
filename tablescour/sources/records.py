"""Records of CSV files whose quoted cells hold line breaks, found by many tasks per file.

A line's effect on the reading state is a function of two states: it may begin outside or
inside a quoted cell, and it ends outside or inside one. Functions compose, so a block of
lines is such a function too. One pass gives each block's function; composing them along a
file tells the state in which each block begins; a second pass cuts the blocks into
records. Only the parts of records that cross a block's border meet in a shuffle.

A quote opens a cell only as its first character; after the closing quote the rest of the
cell is plain. Lines end at LF, CR LF or CR; inside quotes line ends are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.session import shared_dir

# Beyond this many blocks the states reach the lines by a join instead of a broadcast.
MOST_BROADCAST_BLOCKS = 500_000

# Parts of records: a whole one, the begin of one, and what continues an earlier one.
WHOLE, BEGIN, CONTINUED = 0, 1, 2


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a quoted cell is open at the line's end, if one is (not) open at its begin."""
    at, opening = 0, delimiter + b'"'
    if not inside:
        if line[:1] == b'"':
            at, inside = 1, True
    while True:
        if not inside:
            at = line.find(opening, at)
            if at < 0:
                return False
            at += len(opening)
        close = line.find(b'"', at)
        while close >= 0 and line[close + 1 : close + 2] == b'"':
            close = line.find(b'"', close + 2)
        if close < 0:
            return True
        at, inside = close + 1, False


def _parts(line: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A line read up to LF, cut at single CRs: (text, line end)."""
    if b"\r" not in line:
        yield line, b"\n"
        return
    *firsts, last = line.split(b"\r")
    for i, text in enumerate(firsts):
        ending = b"\r\n" if i == len(firsts) - 1 and not last else b"\r"
        yield text, ending
    if last:
        yield last, b"\n"


class _Lines:
    """The lines of a batch in one piece, each with its line feed."""

    def __init__(self, column: pa.Array):
        wide = pa.types.is_large_binary(column.type)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        ends = ends.astype(np.int64)
        data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        found = np.searchsorted(ends, np.flatnonzero(data == ord('"')), "right") - 1
        self.quoted = np.unique(found)  # numbers of the lines with quotes
        self.ends = ends + np.arange(len(ends))
        self.bytes = np.insert(data, ends[1:], ord("\n")).tobytes()

    def text(self, a: int, b: int) -> bytes:
        return self.bytes[self.ends[a] : self.ends[b]]

    def between(self, a: int, b: int) -> list[int]:
        """Lines with quotes among those from ``a`` to before ``b``."""
        return self.quoted[np.searchsorted(self.quoted, a) : np.searchsorted(self.quoted, b)].tolist()


def _blocks(batches):
    """(key of the block, batch, lines, a, b) for each run of rows of one block, batch by batch."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        lines = _Lines(batch.column("value"))
        for a, b in zip(cuts, cuts[1:]):
            here = (batch.column("path")[a].as_py(), batch.column("block")[a].as_py())
            yield here, batch, lines, a, b


def _functions(delimiter: bytes):
    """Per block: the state after it for both states before it, and whether it has text."""

    def run(batches):
        key, out, within, text = None, False, True, False

        def row():
            return pa.record_batch(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([out]), pa.array([within]), pa.array([text])],
                names=["path", "block", "from_outside", "from_inside", "has_text"],
            )

        for here, _, lines, a, b in _blocks(batches):
            if here != key:
                if key is not None:
                    yield row()
                key, out, within, text = here, False, True, False
            text = text or bool(lines.text(a, b).strip())
            for i in lines.between(a, b):
                for line, _ in _parts(lines.text(i, i + 1)[:-1]):
                    out, within = ends_inside(line, out, delimiter), ends_inside(line, within, delimiter)
        if key is not None:
            yield row()

    return run


_CUT = "path string, block bigint, place bigint, part int, record binary"


def _cut(delimiter: bytes, batch_bytes: int = 1 << 22):
    """Records and parts of records of each block; ``place`` counts those that begin in it."""

    def run(batches):
        key, inside, place, header, held = None, False, 0, False, []
        rows: list[tuple] = []

        def flush():
            nonlocal rows, size
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(
                zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            )], names=["path", "block", "place", "part", "record"])
            rows, size = [], 0
            return batch

        size = 0

        def close(part, ended):
            """The held lines make a record or a part of one."""
            nonlocal held, place, size, header
            record = b"".join(held)
            if ended:
                record = record.removesuffix(b"\n").removesuffix(b"\r")
            held = []
            if part == WHOLE and not record.strip():
                return
            if part != CONTINUED:
                if header:  # the first record of a file names its columns
                    header = False
                    rows.append((*key, -1, part, record))
                else:
                    rows.append((*key, place, part, record))
                    place += 1
            else:
                rows.append((*key, None, part, record))
            size += len(record)

        continued = False
        for here, batch, lines, a, b in _blocks(batches):
            if here != key:
                if held:
                    close(CONTINUED if continued else BEGIN, False)
                if rows:
                    yield flush()
                key, place = here, 0
                inside, header = (batch.column(n)[a].as_py() for n in ("inside", "header"))
                continued = inside
            for quoted in [*lines.between(a, b), b]:
                if inside and a < quoted:  # up to the next quote all is one cell
                    held.append(lines.text(a, quoted))
                    a = quoted
                for i in range(a, min(quoted + 1, b)):
                    for line, ending in _parts(lines.text(i, i + 1)[:-1]):
                        if b'"' in line:
                            inside = ends_inside(line, inside, delimiter)
                        held.append(line + ending)
                        if not inside:
                            close(CONTINUED if continued else WHOLE, True)
                            continued = False
                    if size > batch_bytes:
                        yield flush()
                a = quoted + 1
        if held:
            close(CONTINUED if continued else BEGIN, False)
        if rows:
            yield flush()

    return run


def block_states(functions: DataFrame) -> DataFrame:
    """(path, block, inside, header): the state each block begins in, and whether it holds
    its file's first record. Of the blocks before it, the last one that ends the same way
    from both states decides, and every block since that swaps the states changes it."""
    order = W.partitionBy("path").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = functions.withColumn("swapped", F.sum(swaps).over(order))
    last = F.last(F.when(fixed, F.struct("from_outside", "swapped")), ignorenulls=True).over(before)
    seen = counted.withColumn("fixed", last).withColumn("before", F.col("swapped") - swaps)
    turns = F.col("before") - F.coalesce(F.col("fixed.swapped"), F.lit(0))
    start = F.coalesce(F.col("fixed.from_outside"), F.lit(False))
    earlier = F.coalesce(F.bool_or("has_text").over(before), F.lit(False))
    return seen.select(
        "path",
        "block",
        F.when(turns % 2 == 1, ~start).otherwise(start).alias("inside"),
        (~earlier & F.col("has_text")).alias("header"),
    )


def spanning_records(spark: SparkSession, paths: Sequence[str], delimiter: str) -> DataFrame:
    """(path, block, place, record): the records of the files as raw bytes, headers left out.

    ``block`` is the first byte of the file split a record begins in, and ``place`` counts
    the records that begin there. Blank lines between records are no records.
    """
    folder = shared_dir(spark, "records")
    mark = delimiter.encode()
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("key"),
        F.col("value").cast("binary").alias("value"),
    )
    schema = "path string, block bigint, from_outside boolean, from_inside boolean, has_text boolean"
    lines.mapInArrow(_functions(mark), schema).write.mode("overwrite").parquet(f"{folder}/functions")
    functions = spark.read.parquet(f"{folder}/functions")
    states = block_states(functions)
    if functions.count() <= MOST_BROADCAST_BLOCKS:
        told = lines.join(F.broadcast(states), ["path", "block"])  # lines stay in their order
    else:
        placed = lines.withColumn("line", F.monotonically_increasing_id())
        told = placed.join(states.hint("merge"), ["path", "block"]).sortWithinPartitions("path", "block", "line")
    cut = told.select("path", "block", "key", "value", "inside", "header").mapInArrow(_cut(mark), _CUT)
    cut.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.schema(cut.schema).parquet(f"{folder}/parts")
    return assembled(parts).filter("place >= 0")


def assembled(parts: DataFrame) -> DataFrame:
    """Whole records, and those put together whose parts lie in several blocks."""
    whole = parts.filter(F.col("part") == WHOLE).select("path", "block", "place", "record")
    # Parts are few: at most one record reaches into a block and one out of it.
    so_far = W.partitionBy("path").orderBy("block", F.desc("part")).rowsBetween(W.unboundedPreceding, W.currentRow)
    begin = F.last(F.when(F.col("part") == BEGIN, F.struct("block", "place")), ignorenulls=True).over(so_far)
    crossing = parts.filter(F.col("part") != WHOLE).withColumn("begin", begin)
    pieces = F.sort_array(F.collect_list(F.struct("block", "part", "record")))
    joined = crossing.groupBy("path", "begin").agg(pieces.alias("pieces")).select(
        "path",
        F.col("begin.block").alias("block"),
        F.col("begin.place").alias("place"),
        F.aggregate(
            "pieces", F.lit(b"").cast("binary"), lambda text, piece: F.concat(text, piece["record"])
        ).alias("record"),
    )
    return whole.unionByName(joined)
