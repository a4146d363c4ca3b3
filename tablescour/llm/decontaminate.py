"""Benchmark passages in documents: windows of the items' sizes, found by the items' rarest
shingles, exact weighted-shingle similarity. DataFrame functions only.

Words are runs between ASCII white space, in lower case; features are five-word shingles
(an item of fewer words is one shingle). A window has as many words as an item, so it is
compared with items of that size only. A document shorter than an item is a window itself.

The similarity is the weighted Jaccard of the shingle multisets, by how few items hold a
shingle; at least ``LIMIT`` is a match. A match shares at least ``LIMIT`` of the item's
weight, so it holds one of the item's rarest shingles that together weigh more than the
rest allows to miss: documents and items with such a shingle in common are compared. No
step is left to chance, and shingles that many items share, as boilerplate, are not looked
up unless an item has nothing rarer.

A pair is compared over all windows at once. With ``b`` copies of a shingle in the item, an
occurrence counts in the windows that hold it but not its ``b``-th predecessor, which is one
run of starts; so the weight shared by each window is a running sum over the ends of these
runs. Starts whose shared weight allows ``LIMIT`` get the whole weight of their window from
running sums over the document. The work grows with the places found, not with windows
times their sizes. Weights are whole numbers, so that sums are exact in any order.

Defined cases: null and empty texts and items match nothing; a null id is an id like any
other; rows with equal ids are judged alone, by their own text; equal rows are all
returned; an empty benchmark or table leaves all documents clean or gives no rows; other
columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescour.session import shared_dir

WIDTH = 5
LIMIT = 0.8
EPSILON = 1e-9
ONE = float(1 << 36)  # a weight of 1
BROADCAST_ROWS = 200_000  # of a few numbers each
_BLANK = r"[\x20\x09-\x0D]+"


def _hashed_words(text: str) -> Column:
    words = F.split(F.btrim(F.lower(F.col(text)), F.lit(" \t\n\x0b\x0c\r")), _BLANK)
    words = F.when(F.col(text).isNull(), F.array().cast("array<string>")).otherwise(words)
    hashed = F.transform(words, lambda w: F.when(w != "", F.xxhash64(w)))
    return F.array_compact(hashed)


def _shingles(words: str, width: int) -> Column:
    """Hashes of the runs of ``width`` words of the column ``words``; a window that begins
    at word ``i`` begins at shingle ``i``."""
    w = F.col(words)
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
    )
    return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<long>"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast where a count shows that it is small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _places(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n, at, h): the places of all shingles of ``width`` words."""
    words = docs.select("doc", _hashed_words("text").alias("words"))
    return words.select("doc", F.size("words").alias("n"), F.posexplode(_shingles("words", width)).alias("at", "h"))


def matches(
    docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id",
    item_text_col="text", limit=LIMIT,
) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity): the best window of each pair at least
    ``limit`` similar. ``text_hash`` tells rows with equal ids apart."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "decontamination")

    def stored(name, df):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    bench = items.select(F.col(item_col).alias("item_id"), _hashed_words(item_text_col).alias("words"))
    bench = bench.distinct().withColumn("size", F.size("words")).where("size > 0")
    bench = bench.withColumn("item", F.xxhash64("item_id", "words"))
    whole = F.when(F.col("size") < WIDTH, F.array(F.xxhash64("words"))).otherwise(_shingles("words", WIDTH))
    for k in range(1, WIDTH):
        whole = F.when(F.col("size") == k, _shingles("words", k)).otherwise(whole)
    bench = stored("items", bench.withColumn("shingles", whole).drop("words"))
    held = bench.select("item_id", F.explode(F.array_distinct("shingles")).alias("h")).distinct()
    n_items = float(max(bench.select("item_id").distinct().count(), 1))
    weight = lambda items: F.round(F.ln(F.lit(1.0) + F.lit(n_items) / items) * ONE).cast("long")
    weights = stored("weights", held.groupBy("h").agg(weight(F.count("*")).alias("weight")))
    unknown = weight(F.lit(1.0))  # of a shingle that no item holds
    masses = bench.select("item", "size", F.explode("shingles").alias("h")).groupBy("item", "size", "h").agg(
        F.count("*").cast("int").alias("copies"))
    masses = masses.join(_bounded(weights), "h").withColumn("mass", F.col("copies") * F.col("weight"))
    each = Window.partitionBy("item")
    ranked = each.orderBy(F.desc("weight"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    masses = masses.withColumns({"total": F.sum("mass").over(each), "upto": F.sum("mass").over(ranked)})
    masses = stored("masses", masses)
    spare = F.lit(1 - limit) * F.col("total") * (1 + EPSILON)
    lookup = stored("lookup", masses.where(F.col("upto") - F.col("mass") <= spare).select("h", "size", "item"))
    widths = [r[0] for r in bench.select(F.least("size", F.lit(WIDTH))).distinct().collect()]  # at most WIDTH
    if not widths:
        return spark.createDataFrame(
            [], f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, "
            f"item_id {items.schema[item_col].dataType.simpleString()}, similarity double")

    text = F.col(text_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("doc"), text.alias("text"))
    union = lambda parts: functools.reduce(DataFrame.union, parts)
    pairs = []
    for width in widths:
        sought = _bounded(lookup.where(F.least("size", F.lit(WIDTH)) == width))
        found = _places(keyed, width).join(sought, "h").select("doc", "n", "item", "size").distinct()
        pairs.append(found.withColumn("width", F.lit(width)))
    pairs = stored("pairs", union(pairs))
    known = []
    for width in widths:
        near = keyed.join(_bounded(pairs.where(F.col("width") == width).select("doc").distinct()), "doc")
        # a set, as equal rows have equal places
        known.append(_places(near, width).join(_bounded(weights), "h").groupBy("doc", "h", "weight").agg(
            F.sort_array(F.collect_set("at")).alias("at")).withColumn("width", F.lit(width)))
    known = stored("known", union(known))

    pair = ["doc", "item", "width", "shingles", "last", "total"]
    spans = pairs.withColumns({
        "shingles": F.least("size", "n") - F.col("width") + 1, "last": F.greatest(F.col("n") - F.col("size"), F.lit(0)),
    }).join(masses.select("item", "h", "copies", "weight", "total"), "item").join(known.select("doc", "h", "at"), ["doc", "h"])
    runs = F.transform("at", lambda at, k: F.struct(
        F.greatest(F.lit(0), at - F.col("shingles") + 1, F.get("at", k - F.col("copies")) + 1).alias("first"), (at + 1).alias("end")))
    spans = spans.select(*pair, "weight", F.explode(runs).alias("run")).where("run.first <= last")
    ends = F.array(
        F.struct(F.col("run.first").alias("start"), F.col("weight").alias("step")),
        F.struct(F.col("run.end").alias("start"), (-F.col("weight")).alias("step")))
    steps = spans.select(*pair, F.explode(ends).alias("end")).groupBy(*pair, "end.start").agg(F.sum("end.step").alias("step"))
    along = Window.partitionBy("doc", "item").orderBy("start")
    steps = steps.withColumns({"shared": F.sum("step").over(along), "next": F.lead("start").over(along)})
    steps = steps.where((F.col("start") <= F.col("last")) & (F.col("shared") >= F.lit(limit) * F.col("total") * (1 - EPSILON)))
    starts = steps.withColumn("start", F.explode(F.sequence("start", F.least(F.col("next") - 1, F.col("last")))))

    window = ["item", "start", "shingles", "total", "shared"]
    asked = F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")),
                    F.struct((F.col("start") + F.col("shingles") - 1).alias("at"), F.lit(1).alias("sign")))
    asked = starts.select("doc", "width", *window, F.explode(asked).alias("a")).select(
        "doc", "width", *window, "a.at", "a.sign", F.lit(0).cast("long").alias("less"))
    less = known.select("doc", "width", F.explode("at").alias("at"), (unknown - F.col("weight")).alias("less"))
    upto = Window.partitionBy("doc", "width").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = asked.unionByName(less, allowMissingColumns=True).withColumn("less", F.sum("less").over(upto))
    sums = sums.where("sign is not null").groupBy("doc", *window).agg(F.sum(F.col("sign") * F.col("less")).alias("less"))
    every = F.col("shingles") * unknown - F.col("less") + F.col("total") - F.col("shared")
    similar = sums.groupBy("doc", "item").agg(F.max(F.col("shared") / every).alias("similarity"))
    similar = similar.where(F.col("similarity") >= limit - 1e-12).join(_bounded(bench.select("item", "item_id")), "item")
    return similar.groupBy("doc", "item_id").agg(F.max("similarity").alias("similarity")).select("doc.*", "item_id", "similarity")


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, Column]:
    """Matched documents, one row each, and the condition that joins them to ``docs``."""
    found = matches(docs, items, id_col=id_col, text_col=text_col, **options)
    found = found.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("_n_items"), F.sort_array(F.collect_list("item_id")).alias("_item_ids"),
        F.max("similarity").alias("_similarity"),
    ).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    path = shared_dir(docs.sparkSession, "contaminated")
    found.write.mode("overwrite").parquet(path)
    found = _bounded(docs.sparkSession.read.schema(found.schema).parquet(path))
    return found, (F.xxhash64(docs[text_col]) == found["_hash"]) & docs[id_col].eqNullSafe(found["_doc"])


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id, n_items, item_ids, similarity and kept of each document."""
    found, on = _found(docs, items, id_col, text_col, options)
    return docs.join(found, on, "left").select(
        docs[id_col].alias("doc_id"), F.coalesce(found["_n_items"], F.lit(0)).alias("n_items"),
        found["_item_ids"].alias("item_ids"), found["_similarity"].alias("similarity"),
        found["_n_items"].isNull().alias("kept"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The documents that match no item, with all their columns."""
    found, on = _found(docs, items, id_col, text_col, options)
    return docs.join(found, on, "left_anti")
