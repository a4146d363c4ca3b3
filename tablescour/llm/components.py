"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is its least node.

    Each round is an aggregate and a join by node and is written to ``folder``. A node with
    very many links costs rows, not memory: its least neighbour is found map-side. Rounds
    grow with the logarithm of the longest chain. Null nodes are not linked.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    before, turn = None, 0
    while True:
        path = f"{folder}/stars{turn}"
        edges.write.mode("overwrite").parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        before, turn = mark, turn + 1
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        path = f"{folder}/large{turn}"
        large.write.mode("overwrite").parquet(path)
        large = spark.read.schema(large.schema).parquet(path)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        edges = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            joined.select("a", F.col("m").alias("b"))
        ).distinct()
