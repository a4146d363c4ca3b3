"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into ``BLOCKS`` blocks of their source by a hash of their id. A source's
target is met in whole blocks: every block as often as the target holds the source whole,
then blocks in order until the rest is reached, the last one in part. Those block draws
are dealt to output shards by a tree: a node splits its quota of each source between its
halves with a multivariate-hypergeometric draw, so shards are mixtures of exact sizes
that together use each draw once. Within a source, the shards take consecutive runs of a
permuted list of draws; rows of a shard are then put in random order.

What reaches the driver is one row per source. Defined cases: a null text has no words;
a null source is a source of its own and sorts last; equal rows are in one block and are
all counted; an empty table gives an empty mix; other columns travel along unread.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescour.session import shared_dir

BLOCKS = 4096
SHARDS = 64
BROADCAST_ROWS = 500_000
_WORDS = r"[^\x20\x09-\x0D]+"


def words(text):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Parts of ``share`` times all words by weight; none above ``cap`` times its source."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(cap * sizes[i])
        free = [i for i in free if i not in set(above)]
        left -= sum(out[i] for i in above)
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quota of each source in each of ``shards`` shards of equal sizes."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    size = int(round(int(quotas.sum()) * half / shards))
    left = rng.multivariate_hypergeometric(quotas, size, method="marginals")
    return np.vstack([split(left, half, rng), split(quotas - left, shards - half, rng)])


def _order(*columns):
    return F.xxhash64(F.lit("order"), *columns)


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """Thin rows (doc_id, source, size, block, place), stored once."""
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"),
        *_places(id_col, text_col),
    )
    path = shared_dir(docs.sparkSession, "sizes")
    thin.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(thin.schema).parquet(path)


def _places(id_col, text_col):
    place = F.pmod(F.xxhash64(F.lit("block"), F.col(id_col)), F.lit(BLOCKS)).cast("int")
    return place.alias("block"), _order(F.col(id_col), F.col(text_col)).alias("place")


def plan(
    thin: DataFrame, *, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, shards=None, seed=17, cut=True
) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets, and the draws of each of their blocks.

    A block has the shards it is drawn for. The last draw of a source's last block is
    partial: it has documents up to ``upto`` in the block's order and, with ``cut``,
    ``some`` words of the next, ``partly``.
    """
    spark = thin.sparkSession
    shards = shards or max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    totals = thin.groupBy("source").agg(F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    whole, rest = [], []
    for size, goal in zip(sizes, goals):
        words_due = math.floor(goal + 0.5)
        whole.append(words_due // size if size else 0)
        rest.append(words_due % size if size else 0)
    sources = spark.createDataFrame(
        [(i, r.source, s, g, w, t) for i, (r, s, g, w, t) in enumerate(zip(totals, sizes, goals, whole, rest))],
        "src int, source string, source_size long, target double, whole long, rest long",
    )
    blocks = thin.join(sources, thin["source"].eqNullSafe(sources["source"])).groupBy("src", "block", "whole", "rest")
    blocks = blocks.agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    more = F.col("before") < F.col("rest")
    partial = more & (F.col("before") + F.col("words") > F.col("rest"))
    blocks = blocks.select(
        "src", "block", (F.col("whole") + more.cast("long")).alias("draws"),
        F.when(partial, F.col("rest") - F.col("before")).alias("due"),
    ).where("draws > 0")
    folder = shared_dir(spark, "draws")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(blocks.schema).parquet(f"{folder}/blocks")

    # the documents of each source's last block, up to the words due
    last = blocks.where("due is not null").select("src", "block", "due")
    ends = thin.join(sources.select("src", "source"), thin["source"].eqNullSafe(sources["source"]))
    ends = ends.join(F.broadcast(last), ["src", "block"])  # one row per source
    ends = ends.groupBy("src", "block", "due", "place").agg(
        F.sum("size").alias("words"), F.count("*").alias("n")
    )
    upto = Window.partitionBy("src").orderBy("place")
    ends = ends.withColumn("sum", F.sum("words").over(upto))
    inside = F.col("sum") <= F.col("due")
    ends = ends.groupBy("src", "block").agg(
        F.max(F.when(inside, F.col("place"))).alias("upto"),
        F.min(F.when(~inside, F.struct("place", F.expr("(due - sum + words) div n").alias("some")))).alias("next"),
    )
    ends = ends.select("src", "block", "upto", F.col("next.place").alias("partly"), F.col("next.some").alias("some"))
    if not cut:
        ends = ends.withColumn("some", F.lit(0).cast("long"))

    counts = {r.src: r.n for r in blocks.groupBy("src").agg(F.sum("draws").alias("n")).collect()}
    quotas = np.array([counts.get(i, 0) for i in range(len(totals))], np.int64)
    leaves = split(quotas, shards, np.random.Generator(np.random.PCG64(seed))) if len(quotas) else np.zeros((0, 0))
    runs = [
        (src, shard, int(end - n), int(end))
        for src in range(len(quotas))
        for shard, (n, end) in enumerate(zip(leaves[:, src], np.cumsum(leaves[:, src])))
        if n
    ]
    runs = spark.createDataFrame(runs, "src int, shard int, first long, stop long")
    runs = runs.select("src", "shard", F.explode(F.expr("sequence(first, stop - 1)")).alias("turn"))
    draws = blocks.withColumn("copy", F.explode(F.expr("sequence(1L, draws)")))
    permuted = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "block", "copy"), "block", "copy")
    draws = draws.withColumn("turn", F.row_number().over(permuted).cast("long") - 1).join(runs, ["src", "turn"])
    draws = draws.groupBy("src", "block").agg(
        F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> x.shard)").alias("shards"),
        F.max("due").alias("due"),
    )
    draws = draws.join(ends, ["src", "block"], "left")
    path = f"{folder}/plan"
    draws.write.mode("overwrite").parquet(path)
    draws = spark.read.schema(draws.schema).parquet(path)
    if len(totals) * BLOCKS <= BROADCAST_ROWS:  # else Spark joins by shuffle
        draws = F.broadcast(draws)
    return sources, draws


def drawn(rows: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """Rows (source, size, block, place, …) with ``whole_draws``, shards drawn whole, and
    ``part_words`` for shard ``part_shard``."""
    named = sources.select("src", "source", "source_size", "target").withColumnRenamed("source", "_source")
    rows = rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source")
    rows = rows.join(draws, ["src", "block"], "left")
    n = F.coalesce(F.size("shards"), F.lit(0))
    n = F.when(F.col("shards").isNull(), 0).otherwise(n)
    full = F.col("due").isNull() | F.coalesce(F.col("place") <= F.col("upto"), F.lit(False))
    partly = F.when(F.col("due").isNotNull() & (F.col("place") == F.col("partly")), F.col("some"))
    return rows.withColumns({
        "whole_draws": F.when(n > 0, n - F.when(full, 0).otherwise(1)).otherwise(0).cast("long"),
        "part_words": F.coalesce(partly, F.lit(0)),
        "part_shard": F.when(partly > 0, F.element_at("shards", -1)),
    })


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """Rows of ``docs`` as often as they are drawn: a partition holds whole shards, one
    after another, each in random order.

    A document drawn in part keeps its first words, with single spaces between them.
    """
    thin = sized(docs, id_col, text_col, source_col)
    sources, draws = plan(thin, **options)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(
        whole.alias("_row"), F.col(source_col).cast("string").alias("source"),
        *_places(id_col, text_col),
    )
    rows = drawn(rows, sources, draws)
    every = F.expr(
        "concat(transform(slice(coalesce(shards, array()), 1, int(whole_draws)), x -> struct(x as shard, bigint(null) as words)),"
        " filter(array(struct(part_shard as shard, part_words as words)), x -> x.shard is not null))"
    )
    rows = rows.select("_row", F.posexplode(every).alias("_copy", "_draw"))
    cut = F.array_join(
        F.slice(F.regexp_extract_all(F.col(f"_row.{text_col}"), F.lit(f"({_WORDS})")), F.lit(1), F.col("_draw.words").cast("int")), " "
    )
    columns = [
        F.when(F.col("_draw.words").isNull(), F.col(f"_row.{c}")).otherwise(cut).alias(c)
        if c == text_col else F.col(f"_row.{c}")
        for c in docs.columns
    ]
    shard = F.col("_draw.shard").alias("_shard")
    turn = F.xxhash64(F.lit("turn"), F.col(f"_row.{id_col}"), "_copy", "_draw.shard").alias("_turn")
    rows = rows.select(F.struct(*columns).alias("_row"), shard, turn)
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_turn").select("_row.*")

