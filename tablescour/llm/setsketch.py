"""Near-duplicate groups by SetSketch registers.

Each document is a set of word shingles. A register is the exponentially spaced level of
the least of many exponential draws, one per shingle: ``floor(1 - log_b(x))``, cut to its
range. Registers of a union are the maxima of the registers. Two documents share a
register about as often as they share a shingle, so equal runs of registers (bands) put
near copies into one bucket. Equal sets are one node from the start. Then

1. every node is held against one node of each of its buckets, the one with most copies;
2. components of the links found are labelled;
3. buckets whose members are still of several components are searched pair by pair inside
   tasks, large ones in blocks of at most ``GROUP`` members against each other. Only pairs
   of different components that meet here first, and whose estimate allows a link, leave.

An estimate is the most likely similarity given the numbers of registers greater, less
and equal, and the set sizes; pairs more than five standard errors below the limit are
dropped, all others are decided on their full sets. Every pair that shares a bucket is so
decided or already connected. A pair at the limit shares none with probability
``(1 - limit ** ROWS) ** bands``.

Defined cases: a null or empty text has an empty set and is linked with nothing; fewer
words than a shingle make one shingle; a null id is never the least of its group, and a
group of null ids only has a null component and keeps none; rows with one id and
different texts are nodes of their own; equal rows are all returned, and all with the
least id are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.llm.components import connected_components
from tablescour.llm.words import WordHasher, mix, text_bytes
from tablescour.session import shared_dir, small_batches

ROWS = 4
FINE, COARSE = 1.001, 140  # base of the band registers; levels merged for the estimate
LEVELS = (1 << 16) - 1
RATE = 20.0
ESTIMATE = 512
GROUP = 500
BROADCAST_IDS = 1_000_000
SLICE = 1 << 20
_SKETCH = "row_id long, text_hash long, node binary, n_shingles long, bands array<long>"
_FULL = "node binary, n long, shingles binary, registers binary, bands array<long>"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    _, _, words, rows = hasher.words(data, bounds)
    with np.errstate(over="ignore"):
        odd = _multipliers(width)[0]
        n = max(0, len(words) - width + 1)
        shingles = np.full(n, width, np.uint64)
        for i in range(width):
            shingles += words[i : i + n] * odd[i]
        shingles = mix(shingles)
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(shingles[a : b - width + 1]))
            elif b > a:
                few = words[a:b] * odd[: b - a]
                out.append(mix(np.array([few.sum(dtype=np.uint64) + np.uint64(b - a)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int, first: int = 0) -> np.ndarray:
    """Levels of the least draws of each set, one row per set; 0 for an empty set."""
    out = np.zeros((len(sets), m), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[i]) for i in full])
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes) - sizes
    odd, plus = (x[first:] for x in _multipliers(first + m))
    least = np.empty((len(full), m), np.uint64)
    scratch = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for i in range(m):
            np.multiply(flat, odd[i], out=scratch)
            np.add(scratch, plus[i], out=scratch)
            least[:, i] = np.minimum.reduceat(scratch, starts)
    # the least of n uniform draws u gives the least of n exponential ones
    draws = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) * 2.0**-64, 1 - 2.0**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(draws) / math.log(FINE)), 0, LEVELS).astype(np.uint16)
    return out


def node_of(s: np.ndarray) -> bytes | None:
    """128 bits of a set, equal for equal sets."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        one, two = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.array([one, two], np.uint64).tobytes()


def likely(n_u, n_v, above, below, m=ESTIMATE, base=FINE**COARSE) -> np.ndarray:
    """Most likely Jaccard similarity of sets of known sizes, from ``m`` registers of which
    ``above`` are greater in the first set and ``below`` in the second."""
    n_u, n_v, above, below = (np.asarray(x, np.float64)[:, None] for x in (n_u, n_v, above, below))
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / math.log(base)
    more, less = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - more - less, 1e-12)
    log = above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12))
    log = log + (m - above - below) * np.log(same)
    return np.take_along_axis(j, log.argmax(1)[:, None], 1)[:, 0]


def _floor(limit: float) -> float:
    return limit - 5 * math.sqrt(limit * (1 - limit) / ESTIMATE)


def _slices(bounds):
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        yield a, b
        a = b


def _band_lists(regs: np.ndarray, bands: int) -> pa.Array:
    longs = np.ascontiguousarray(regs).view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1, dtype=np.int32) * bands), pa.array(longs))


def _sketch(width: int, bands: int, full: bool):
    """Task function: rows (row_id, text, text_hash) to sketches, or to nodes with full sets."""

    def run(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for a, b in _slices(bounds):
                part = bounds[a : b + 1] - bounds[a]
                sets = shingle_sets(data[bounds[a] : bounds[b]], part, width, hasher)
                fine = registers(sets, bands * ROWS)
                nodes = pa.array([node_of(s) for s in sets], pa.binary())
                n = pa.array([len(s) for s in sets], pa.int64())
                lists = _band_lists(fine, bands)
                if full:
                    coarse = (registers(sets, ESTIMATE, bands * ROWS) // COARSE).clip(0, 255).astype(np.uint8)
                    columns = [
                        nodes, n, pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in coarse], pa.binary()), lists,
                    ]
                    yield pa.record_batch(columns, names=["node", "n", "shingles", "registers", "bands"])
                else:
                    columns = [batch.column(0)[a:b], batch.column(2)[a:b], nodes, n, lists]
                    yield pa.record_batch(columns, names=["row_id", "text_hash", "node", "n_shingles", "bands"])

    return run


def _estimated(floor: float):
    """Task function: pairs whose estimated similarity is at least ``floor``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ESTIMATE)
                for c in ("registers", "h_registers")
            )
            j = likely(batch.column("n"), batch.column("h_n"), (u > v).sum(1), (u < v).sum(1))
            keep = batch.filter(pa.array(j >= floor))
            yield pa.record_batch([keep.column("a"), keep.column("b")], names=["a", "b"])

    return run


def _verified(num: int, den: int):
    """Task function: pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles"), batch.column("h_shingles")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([kept.column("a"), kept.column("b")], names=["a", "b"])

    return run


def group_pairs(nodes, labels, sizes, regs, bands, band, floor):
    """Pairs (i, j) of different labels that share no band before ``band``."""
    limit = ESTIMATE * floor  # registers agree at least as often as sets overlap
    for i in range(len(nodes) - 1):
        other = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if band and len(other):
            other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
        if not len(other):
            continue
        above, below = (regs[i] > regs[other]).sum(1), (regs[i] < regs[other]).sum(1)
        some = ESTIMATE - above - below >= limit
        other, above, below = other[some], above[some], below[some]
        if len(other):
            j = likely(np.full(len(other), sizes[i]), sizes[other], above, below)
            for k in other[j >= floor]:
                yield i, int(k)


def _searched(floor: float):
    """Group function: the pairs of one bucket, or of two blocks of one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, labels = table.column("node").to_pylist(), table.column("component").to_pylist()
        _, codes = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, ESTIMATE)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        blocks, mine = table.column("block").to_numpy(), table.column("i")[0].as_py()
        yours = table.column("j")[0].as_py()
        found = group_pairs(nodes, codes, table.column("n").to_numpy(), regs, bands, table.column("band")[0].as_py(), floor)
        pairs = [(nodes[a], nodes[b]) for a, b in found if mine == yours or blocks[a] != blocks[b]]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _grouped(docs: DataFrame, id_col, text_col, width, num, den, bands) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, text_hash, node, n_shingles), and (node, least, whole) of the nodes in
    groups of two rows or more: the least id of a node and the name of its group."""
    spark = docs.sparkSession
    folder, limit = shared_dir(spark, "near"), num / den
    floor = _floor(limit)

    def stored(name, df):
        with small_batches(spark):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = docs.select(
        F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    sketches = stored("sketches", texts.mapInArrow(_sketch(width, bands, False), _SKETCH))
    classes = sketches.where("node is not null").groupBy("node").agg(
        F.min("row_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    classes = stored("classes", classes)
    entries = classes.select("node", "copies", F.posexplode("bands").alias("band", "key"))
    best = F.struct(F.col("copies"), F.xxhash64("node"), F.col("node"))
    buckets = entries.groupBy("band", "key").agg(F.count("*").alias("members"), F.max(best).alias("best"))
    buckets = stored("buckets", buckets.where("members > 1").select("band", "key", "members", F.col("best.node").alias("hub")))
    members = stored("members", entries.join(buckets, ["band", "key"]).select("band", "key", "members", "hub", "node"))

    wanted = members.select("node").distinct()
    ids = classes.join(wanted, "node", "left_semi").select(F.col("least").alias("row_id")).distinct()
    ids = stored("ids", ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    near = texts.join(ids, texts["row_id"].eqNullSafe(ids["row_id"]), "left_semi")
    full = near.mapInArrow(_sketch(width, bands, True), _FULL)
    full = stored("full", full.where("node is not null").join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    def verified(pairs):
        """Links among pairs (a, b), decided on full sets."""
        sets = full.select("node", "shingles")
        rows = pairs.join(sets, pairs["a"] == sets["node"]).drop("node")
        other = sets.withColumnRenamed("shingles", "h_shingles")
        rows = rows.join(other, rows["b"] == other["node"]).drop("node")
        return rows.mapInArrow(_verified(num, den), "a binary, b binary")

    small = full.select("node", "n", "registers")
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    rows = pairs.join(small, pairs["a"] == small["node"]).drop("node")
    hubs = small.select("node", F.col("n").alias("h_n"), F.col("registers").alias("h_registers"))
    rows = rows.join(hubs, rows["b"] == hubs["node"]).drop("node")
    pairs = stored("star_pairs", rows.mapInArrow(_estimated(floor), "a binary, b binary"))
    stars = stored("star_links", verified(pairs))
    parts = stored("parts", connected_components(stars, f"{folder}/cc1"))

    labelled = members.join(parts, "node", "left").select(
        "band", "key", "members", "node", F.coalesce("component", "node").alias("component")
    )
    labelled = stored("labelled", labelled)
    open_ = labelled.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    open_ = labelled.join(open_.where("x <> y").select("band", "key"), ["band", "key"], "left_semi")
    open_ = open_.join(full.select("node", "n", "registers", "bands"), "node")
    blocks = F.ceil(F.col("members") / GROUP).cast("int")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    open_ = open_.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    more = open_.groupBy("band", "key", "i", "j").applyInArrow(_searched(floor), "a binary, b binary")
    more = stored("more_pairs", more.distinct())
    links = stored("more_links", verified(more))

    # links between components found so far
    ends = links.join(parts.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
    ends = ends.join(parts.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    ends = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    last = connected_components(ends, f"{folder}/cc2").select(
        F.col("node").alias("component"), F.col("component").alias("whole")
    )
    joined = parts.union(ends.select("a", "a")).union(ends.select("b", "b")).distinct()
    joined = joined.join(last, "component", "left").select("node", F.coalesce("whole", "component").alias("whole"))
    groups = classes.where("copies > 1").select("node", "least").union(
        classes.join(joined, "node", "left_semi").where("copies <= 1").select("node", "least")
    )
    groups = groups.join(joined, "node", "left").select("node", "least", F.coalesce("whole", "node").alias("whole"))
    return sketches.drop("bands"), stored("groups", groups)


def near_duplicates(
    docs: DataFrame, *, id_col="doc_id", text_col="text", width=3, num=85, den=100, bands=16
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows, groups = _grouped(docs, id_col, text_col, width, num, den, bands)
    first = groups.groupBy("whole").agg(F.min("least").alias("component_id"))
    groups = groups.join(first, "whole").select("node", "component_id")
    out = rows.join(groups, "node", "left").withColumn("component_id", F.coalesce("component_id", "row_id"))
    return out.select(
        F.col("row_id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def one_of_each(
    docs: DataFrame, *, id_col="doc_id", text_col="text", width=5, num=80, den=100, bands=24
) -> DataFrame:
    """One row of each group with all its columns: that of the least id, a null id coming
    last, then of the least hash of its text. Rows without words all stay."""
    spark = docs.sparkSession
    rows, groups = _grouped(docs, id_col, text_col, width, num, den, bands)
    rows = rows.join(groups.select("node", "whole"), "node")
    key = F.struct(F.col("row_id").isNull().alias("none"), "row_id", "text_hash")
    best = rows.groupBy("whole").agg(F.min(key).alias("best"))
    same = F.col("row_id").eqNullSafe(F.col("best.row_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    judged = rows.join(best, "whole").groupBy("row_id", "text_hash").agg(
        F.max(same).alias("stays"), F.count("*").alias("n")
    ).where("not stays or n > 1")
    path = shared_dir(spark, "judged")
    judged.write.mode("overwrite").parquet(path)
    judged = spark.read.schema(judged.schema).parquet(path)
    judged = judged.withColumnsRenamed({"row_id": "_id", "text_hash": "_hash"})
    few = judged.count() <= BROADCAST_IDS

    def keyed(rule):
        part = judged.where(rule)
        part = F.broadcast(part) if few else part
        on = (F.xxhash64(docs[text_col]) == part["_hash"]) & docs[id_col].cast("long").eqNullSafe(part["_id"])
        return part, on

    part, on = keyed("true")
    plain = docs.join(part, on, "left_anti")
    if not judged.where("stays").limit(1).count():
        return plain
    part, on = keyed("stays")  # the same row more than once: one of them stays
    twice = docs.join(part, on).dropDuplicates(["_id", "_hash"]).select(*[docs[c] for c in docs.columns])
    return plain.union(twice)
