"""Exact top-k by inner product with a vector-approximation file.

Rows are written in blocks, two files of the shared folder each: the approximation, which
has a four-bit cell per component (equally filled cells with the least and greatest value
each one holds), and the exact integer vectors in the smallest type that holds them. A task
has the queries of some blocks and a run of candidate blocks, whose files it reads one after
the other. Two products with the cell limits bound every score; rows whose bound lies below
the k-th best score found so far, in this block or an earlier one, are dropped, and the exact
vectors of the others are read. So no vector is copied through a shuffle or the driver;
tasks return at most ``k`` rows a query.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; vectors meet only those of their own length; rows with equal
ids are rows of their own, and only a query's own row is left out; an empty table gives an
empty result; other columns are not read. A score outside 64 bits is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescour.llm.files import Output, open_input
from tablescour.session import shared_dir

BLOCK = 4096
CELLS = 16
SINGLE, EXACT, MOST = 1 << 24, 1 << 53, 2.0**63  # scores below are exact in floats, in doubles, in longs
QUERIES, QUERY_BYTES = 4096, 1 << 25  # that a task holds at least, if the block has them; at most, but for one block's
PAIRS = 1 << 32  # of vectors for each task
PART, GATHERED = 256, 1 << 16  # queries bounded, and pairs scored, at once
_BLOCKS = "dim int, block int, n long, asked long"
_FOUND = "query_key long, query_id long, vec_id long, score long"


def grid(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and the least and greatest value of each cell."""
    n, dim = vectors.shape
    cells = np.zeros((n, dim), np.uint8)
    low = np.zeros((CELLS, dim))
    high = np.zeros((CELLS, dim))
    cuts = np.arange(1, CELLS) * n // CELLS
    for d in range(dim):
        column = vectors[:, d]
        edges = np.unique(np.sort(column)[cuts])
        cells[:, d] = np.searchsorted(edges, column, "right")
        order = np.argsort(cells[:, d], kind="stable")
        held, first = np.unique(cells[order, d], return_index=True)
        low[held, d] = np.minimum.reduceat(column[order], first)
        high[held, d] = np.maximum.reduceat(column[order], first)
    return cells, low, high


def pack(cells: np.ndarray) -> bytes:
    """Two cells in a byte."""
    flat = cells.reshape(-1)
    flat = np.append(flat, np.zeros(len(flat) % 2, np.uint8))
    return (flat[0::2] | flat[1::2] << 4).tobytes()


def unpack(raw: bytes, n: int, dim: int) -> np.ndarray:
    both = np.frombuffer(raw, np.uint8)
    return np.stack([both & 15, both >> 4], 1).reshape(-1)[: n * dim].reshape(n, dim)


def narrow(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds all of them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def _write(uri: str, arrays: list[np.ndarray]) -> None:
    output = Output(uri, TaskContext.get().taskAttemptId())
    output.stream.write(np.array([a.nbytes for a in arrays], np.int64).tobytes())
    for a in arrays:
        output.stream.write(np.ascontiguousarray(a).tobytes())
    output.finish()


def _read(uri: str, n: int) -> list[memoryview]:
    file = open_input(uri)
    sizes = np.frombuffer(file.read_buffer(8 * n), np.int64)
    return [memoryview(file.read_buffer(int(size))) for size in sizes]


def _exact(folder: str, dim: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    ids, raw = _read(f"{folder}/exact/{dim}-{block}", 2)
    ids = np.frombuffer(ids, np.int64)
    kinds = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}
    return ids, np.frombuffer(raw, kinds[len(raw) // (len(ids) * dim) if dim else 1]).reshape(len(ids), dim)


class Block:
    """A block of candidates: bounds of their components, and exact vectors once asked for."""

    def __init__(self, folder: str, dim: int, block: int):
        low, high, first, cells = _read(f"{folder}/cells/{dim}-{block}", 4)
        low, high = (np.frombuffer(x).reshape(CELLS, dim) for x in (low, high))
        self.first, self.n = np.frombuffer(first, np.int64).tolist()  # key of the first row, rows
        self.reach = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        cells, dims = unpack(cells, self.n, dim), np.arange(dim)
        self.bounds = low[cells, dims], high[cells, dims]
        self.place, self.read = (folder, dim, block), {}

    def as_type(self, kind) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest components."""
        if kind not in self.read:
            self.read[kind] = [x.astype(kind) for x in self.bounds]
        return self.read[kind]

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        if "exact" not in self.read:
            self.read["exact"] = _exact(*self.place)
        return self.read["exact"]


class Best:
    """The best ``k`` rows met so far of each query, in order."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, np.zeros(n, np.int64)
        self.scores, self.ids = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def needed(self, part: slice) -> np.ndarray:
        """The k-th score; any score will do while there are fewer."""
        return np.where(self.n[part] == self.k, self.scores[part, -1], -np.inf)

    def held(self, rows: np.ndarray):
        """(query, score, id) of all that is held for the queries."""
        filled = np.arange(self.k) < self.n[rows][:, None]
        return np.repeat(rows, self.n[rows]), self.scores[rows][filled], self.ids[rows][filled]

    def add(self, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(row)
        row, scores, ids = (np.concatenate(x) for x in zip(self.held(rows), (row, scores, ids)))
        order = np.lexsort((ids, -scores, row))
        row, scores, ids = row[order], scores[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.scores[row[best], place[best]] = scores[best]
        self.ids[row[best], place[best]] = ids[best]
        self.n[rows] = np.bincount(row[best])[rows]


def search(query: np.ndarray, keys: np.ndarray, block: Block, best: Best) -> None:
    """Bring the best rows of the queries up to date with a block."""
    k, n = best.k, block.n
    for a in range(0, len(query), PART):
        part = query[a : a + PART]
        sizes = float(np.abs(part).max(initial=0)) * block.reach * part.shape[1]
        own = keys[a : a + PART] - block.first
        mine = np.flatnonzero((own >= 0) & (own < n))
        if len(part) * n == len(mine):
            continue
        if sizes >= MOST:
            raise ArithmeticError("an inner product does not fit 64 bits")
        kind = np.float32 if sizes < SINGLE else np.float64
        slack = 0.0 if sizes < EXACT else sizes * 2.0**-50
        least, most = block.as_type(kind)
        part = part.astype(kind)
        up, down = np.maximum(part, 0), np.minimum(part, 0)
        upper = up @ most.T + down @ least.T + kind(slack)
        needed = best.needed(slice(a, a + PART))
        short = np.flatnonzero(needed == -np.inf)
        if len(short) and n > k:
            lower = up[short] @ least.T + down[short] @ most.T - kind(slack)
            lower[np.searchsorted(short, mine[np.isin(mine, short)]), own[mine[np.isin(mine, short)]]] = -np.inf
            needed[short] = np.partition(lower, n - k, axis=1)[:, n - k]
        near = upper >= needed.astype(kind)[:, None]
        near[mine, own[mine]] = False
        hits = np.count_nonzero(near)
        if not hits:
            continue
        ids, vectors = block.exact()
        if sizes < EXACT and 16 * hits > near.size:  # a product of all is less work than so many rows one by one
            scores = part @ vectors.T.astype(kind)
            scores[~near] = -np.inf
            if n > k:
                needed = np.maximum(needed, np.partition(scores, n - k, axis=1)[:, n - k])
            row, column = np.nonzero(near & (scores >= needed.astype(kind)[:, None]))
            found = scores[row, column].astype(np.int64)
        else:
            row, column = np.nonzero(near)
            exact = kind if sizes < EXACT else np.int64
            whole, found = part.astype(exact), np.empty(hits, np.int64)
            for b in range(0, hits, GATHERED):
                some = slice(b, b + GATHERED)
                found[some] = np.einsum("ij,ij->i", whole[row[some]], vectors[column[some]].astype(exact))
            good = found >= needed[row]
            row, column, found = row[good], column[good], found[good]
        if len(row):
            best.add(a + row, found, ids[column])


def _stage(folder: str, every: int):
    """Task function: rows (vec_id, vector) to the files of a block per length of vector."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.asarray(vectors.flatten(), np.float64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                matrix = flat[(ends[rows] - dim)[:, None] + np.arange(dim)].reshape(len(rows), dim)
                held.setdefault(int(dim), []).append((ids.to_numpy()[rows], np.floor(64.0 * matrix)))
        block, made = TaskContext.get().partitionId(), []
        for number, (dim, parts) in enumerate(held.items()):
            ids, matrix = (np.concatenate(x) for x in zip(*parts))
            cells, low, high = grid(matrix)
            first = block << 40 | number << 24
            _write(f"{folder}/cells/{dim}-{block}", [low, high, np.array([first, len(ids)]), np.frombuffer(pack(cells), np.uint8)])
            _write(f"{folder}/exact/{dim}-{block}", [ids, narrow(matrix)])
            made.append((dim, block, len(ids), int((ids % every == 0).sum())))
        if made:
            kinds, names = (pa.int32(), pa.int32(), pa.int64(), pa.int64()), [x.split()[0] for x in _BLOCKS.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    return run


def plan(blocks: list[tuple[int, int, int, int]], least_tasks: int) -> list[tuple[int, list[int], list[int]]]:
    """(length of vector, blocks of the queries, blocks of the candidates) of each task."""
    every, asking, pairs = {}, {}, {}
    for dim in {b[0] for b in blocks}:
        mine = sorted(b[1:] for b in blocks if b[0] == dim)
        every[dim] = [block for block, _, _ in mine]
        pairs[dim] = sum(n for _, n, _ in mine) * sum(asked for _, _, asked in mine)
        runs, size, most = [], 0, min(QUERIES, QUERY_BYTES // (8 * max(dim, 1)))
        for block, _, asked in (b for b in mine if b[2]):
            if not runs or size + asked > most:
                runs.append([])
                size = 0
            runs[-1].append(block)
            size += asked
        asking[dim] = runs
    tasks, total = [], max(1, sum(pairs.values()))
    for dim in sorted(every):
        wanted = max(total / PAIRS, least_tasks) * pairs[dim] / total
        cuts = min(len(every[dim]), math.ceil(wanted / max(1, len(asking[dim]))))
        tasks += [(dim, run, part.tolist()) for run in asking[dim] for part in np.array_split(every[dim], max(1, cuts))]
    return tasks


def top_k(
    vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", k=20, every=20, block=BLOCK
) -> DataFrame:
    """Best ``k`` rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    folder = shared_dir(spark, "vectors")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(
        "vec_id is not null and vector is not null and "
        "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    n = max(1, math.ceil(rows.count() / block))
    rows.repartition(n).mapInArrow(_stage(folder, every), _BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
    # four numbers a block and length of vector
    made = [tuple(r) for r in spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").collect()]
    tasks = plan(made, 2 * spark.sparkContext.defaultParallelism)

    def scan(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                dim, asking, candidates = tasks[task]
                held = []
                for b in asking:
                    ids, exact = _exact(folder, dim, b)
                    rows = np.flatnonzero(ids % every == 0)
                    held.append((Block(folder, dim, b).first + rows, ids[rows], exact[rows].astype(np.float64)))
                keys, ids, query = (np.concatenate(x) for x in zip(*held))
                best = Best(len(keys), k)
                for b in candidates:
                    search(query, keys, Block(folder, dim, b), best)
                for a in range(0, len(keys), 5_000):
                    row, scores, found = best.held(np.arange(a, min(a + 5_000, len(keys))))
                    columns = [pa.array(c, pa.int64()) for c in (keys[row], ids[row], found, scores)]
                    yield pa.record_batch(columns, names=[x.split()[0] for x in _FOUND.split(", ")])

    found = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(scan, _FOUND)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
