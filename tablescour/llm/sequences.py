"""Token ids in Arrow stream files of equal-length sequences.

Documents are put in ascending order of their id, each is encoded and closed by an end
id, and the ids of a shard are cut into rows of ``length`` ids. A shard has two files:

* ``part-N.arrow``: batches of ``rows`` rows with ``ids`` (fixed-size list of unsigned
  16- or 32-bit integers, by vocabulary) and ``mask`` (fixed-size list of booleans; false
  only in the padding that ends a shard). All full batches take equally many bytes, so
  the place of any row follows from the first batch, without an index.
* ``part-N.docs.arrow``: ``doc_id``, first id and number of ids of each document.

Defined cases: a null or empty text is the end id alone; a null id sorts first; rows
with equal ids are ordered by text, and equal rows are all kept; an empty table writes
no shard; other columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescour.llm.files import Output, open_input
from tablescour.llm.workers import kept
from tablescour.llm.words import WordHasher, ragged, text_bytes

LENGTH = 2048
ROWS = 32
MANIFEST = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, first_row long, shard int"


class ChunkEncoder:
    """Encodes batches of texts; each distinct chunk goes to the tokenizer once.

    A chunk begins at a single space between two characters that are surely not white
    space, after a line feed between two such characters, and at an ASCII mark after a
    Latin letter. No piece of the byte-level pattern reaches across such a place, so the
    ids of a text are those of its chunks in order. Chunks are compared by 64-bit hash.
    """

    KEEP = 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.tokenizer = Tokenizer.from_file(path)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype(np.uint16 if self.small else np.uint32)
        self.hasher = WordHasher(lower=False)
        self._forget()
        self.before = np.zeros(256, bool)
        self.before[0x21:0x7F] = True
        self.after = self.before.copy()
        self.after[0xC3:0xE0] = True
        self.after[0xE4:0xF5] = True
        self.letter = np.zeros(256, bool)
        self.letter[0x41:0x5B] = self.letter[0x61:0x7B] = True
        self.mark = self.before & ~self.letter
        self.mark[0x30:0x3A] = False
        added = self.tokenizer.get_added_tokens_decoder().values()
        for c in set("".join(t.content[1:] for t in added)):  # special tokens stay whole
            if ord(c) in (0x20, 0x0A):
                self.before[:] = self.after[:] = False
            if ord(c) < 128:
                self.mark[ord(c)] = False

    def _forget(self):
        self.known = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.n_ids = np.zeros(0, self.dtype), 0

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """First byte of every chunk; ``at`` are bytes with one neighbour or more on each side."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 3:
            here, left, right, far = data[2:-1], data[1:-2], data[3:], data[:-3]
            letter = self.letter[left] | ((far == 0xC3) & (left >= 0x80) & (left != 0x97) & (left != 0xB7))
            solid = self.before[left] | ((left >= 0x80) & (far >= 0xC3) & (far < 0xE0))
            cut[2:-2] = (here == 0x20) & solid & self.after[right] | letter & self.mark[here]
            cut[3:-1] |= (here == 0x0A) & self.before[left] & self.after[right]
        row = np.zeros(len(data) + 2, bool)
        row[bounds] = True
        # the bytes looked at, from two before a cut to one after it, are of one row
        cut &= ~(row[:-1] | row[1:] | np.append(False, row[:-2]))
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(cut[:-1])

    def _learn(self, data, starts, ends, hashes):
        new, at = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.known, new)
        fresh = np.append(self.known, np.uint64(0))[place] != new
        fresh |= place == len(self.known)
        new, at, place = new[fresh], at[fresh], place[fresh]
        if not len(new):
            return
        raw = data.tobytes()
        firsts, counts, ids = [], [], [self.ids]
        for a in range(0, len(at), 20_000):
            some = at[a : a + 20_000]
            texts = [raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())]
            lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.fromiter(map(len, lists), np.int32, len(lists))
            ids.append(np.fromiter(chain.from_iterable(lists), self.dtype, int(n.sum())))
            firsts.append(self.n_ids + np.cumsum(n) - n)
            counts.append(n)
            self.n_ids += int(n.sum())
        self.known = np.insert(self.known, place, new)
        self.first = np.insert(self.first, place, np.concatenate(firsts))
        self.count = np.insert(self.count, place, np.concatenate(counts))
        self.ids = np.concatenate(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and how many each row has."""
        data, bounds = text_bytes(column)
        ids, lengths, a = [], [], 0
        while a < len(bounds) - 1:  # rows of about a million bytes at a time
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 20), "right")) - 1)
            got = self._encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            ids.append(got[0])
            lengths.append(got[1])
            a = b
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode(self, data, bounds):
        if len(self.known) > self.KEEP:
            self._forget()
        starts = self._starts(data, bounds)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = self.hasher.spans(data, starts, ends)
        self._learn(data, starts, ends, hashes)
        place = np.searchsorted(self.known, hashes)
        n = self.count[place] if len(place) else np.zeros(0, np.int64)
        ids = self.ids[ragged(self.first[place], n)] if len(place) else np.zeros(0, self.dtype)
        sums = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(sums[np.searchsorted(starts, bounds)])


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each closed by ``end``."""
    out = np.empty(len(ids) + len(lengths), ids.dtype)
    last = np.cumsum(lengths + 1) - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[body], out[last] = ids, end
    return out, lengths + 1


class SequenceWriter:
    """Writes one shard; holds at most one batch of rows."""

    def __init__(self, folder: str, shard: int, attempt: int, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        about = {"length": str(length), "rows": str(rows)}
        self.schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata=about
        )
        self.names = [f"{folder}/part-{shard:06d}.arrow", f"{folder}/part-{shard:06d}.docs.arrow"]
        self.outputs = [Output(name, attempt) for name in self.names]
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.ids_file = pa.ipc.new_stream(self.outputs[0].stream, self.schema)
        self.docs_file = pa.ipc.new_stream(self.outputs[1].stream, self.index)
        self.left, self.n_tokens, self.n_docs = np.zeros(0, dtype), 0, 0

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (ids, mask)
        ]
        self.ids_file.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        columns = [doc_ids.cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
        self.docs_file.write_batch(pa.record_batch(columns, schema=self.index))
        self.n_tokens += len(ids)
        self.n_docs += len(lengths)
        ids = np.concatenate([self.left, ids])
        step = self.length * self.rows
        full = len(ids) // step * step
        for a in range(0, full, step):
            self._rows(ids[a : a + step], step)
        self.left = ids[full:].copy()

    def close(self) -> tuple:
        real = len(self.left)
        if real:
            padded = np.zeros(-(-real // self.length) * self.length, self.dtype)
            padded[:real] = self.left
            self._rows(padded, real)
        for file, output in zip((self.ids_file, self.docs_file), self.outputs):
            file.close()
            output.finish()
        return (*self.names, self.n_docs, self.n_tokens)


class SequenceReader:
    """Rows of one shard by position, without a copy where the file is mapped."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        stream = pa.ipc.open_stream(self.file)
        self.schema = stream.schema
        self.length = int(self.schema.metadata[b"length"])
        self.rows = int(self.schema.metadata[b"rows"])
        self.file.seek(0)
        pa.ipc.read_message(self.file)
        self.head = self.file.tell()
        pa.ipc.read_message(self.file)
        self.step = self.file.tell() - self.head
        self.held = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.file.seek(self.head + k * self.step)
            self.held = (k, pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema))
        return self.held[1]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row ``i``."""
        batch, at = self.batch(i // self.rows), i % self.rows
        part = slice(at * self.length, (at + 1) * self.length)
        ids, mask = (batch.column(c).flatten() for c in (0, 1))
        return ids.to_numpy()[part], mask[part.start : part.stop].to_numpy(zero_copy_only=False)

    def views(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of row ``i`` as views of the file's memory; masks are bit-packed."""
        batch, at = self.batch(i // self.rows), i % self.rows
        return tuple(batch.column(c).flatten().slice(at * self.length, self.length) for c in (0, 1))

    def pieces(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` to ``stop``, batch by batch."""
        step = self.length * self.rows
        while start < stop:
            k = start // step
            ids = self.batch(k).column(0).flatten().to_numpy()
            yield ids[start - k * step : min(stop - k * step, step)]
            start = min(stop, (k + 1) * step)


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, *, id_col="doc_id", text_col="text",
    end_id=2, length=LENGTH, rows=ROWS,
) -> DataFrame:
    """Write all documents below ``folder``; the manifest has a row per shard.

    The order by id comes from range partitions of ``spark.sql.shuffle.partitions``, each
    written as one shard by one task, in streams.
    """
    spark = docs.sparkSession

    def write(batches):
        context = TaskContext.get()
        encoder = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = kept(("chunks", tokenizer), lambda: ChunkEncoder(tokenizer))
                writer = SequenceWriter(
                    folder, context.partitionId(), context.taskAttemptId(), encoder.dtype, length, rows
                )
            writer.add(batch.column(0), *with_end(*encoder.encode(batch.column(1)), end_id))
        if writer is not None:
            values = [[x] for x in (context.partitionId(), *writer.close())]
            names = ["shard", "ids_file", "docs_file", "n_docs", "n_tokens"]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the files: its place, its number of ids and their CRC-32.

    First ids of shards are sums over the manifest, one row per shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    if not shards:
        return spark.createDataFrame([], DOCUMENTS)
    rows, base = [], 0
    for shard in shards:
        rows.append((shard.shard, base, shard.ids_file, shard.docs_file))
        base += shard.n_tokens

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                reader = SequenceReader(shard["ids_file"])
                for index in pa.ipc.open_stream(open_input(shard["docs_file"])):
                    starts, n = index.column(1).to_numpy(), index.column(2).to_numpy()
                    sums = np.zeros(len(n), np.int64)
                    for i, (a, k) in enumerate(zip(starts.tolist(), n.tolist())):
                        crc = 0
                        for piece in reader.pieces(a, a + k):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        sums[i] = crc
                    columns = [
                        index.column(0), pa.array(starts + shard["base"]), index.column(2),
                        pa.array(sums), pa.array(starts // reader.length),
                        pa.array(np.full(len(n), shard["shard"], np.int32)),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "first_row", "shard"]
                    yield pa.record_batch(columns, names=names)

    plan = spark.createDataFrame(rows, "shard int, base long, ids_file string, docs_file string")
    return plan.repartition(len(rows)).mapInArrow(read, DOCUMENTS)
