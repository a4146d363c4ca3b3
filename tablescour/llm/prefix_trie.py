"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A node stands for the first ``d`` turns, role and text, that one or more conversations
begin with. It is named by two 64-bit polynomial sums over the digests of its turns, so a
conversation's nodes are running sums over its turns in order. Turns are put in order by
one range sort over all conversations; a conversation may lie in any number of sorted
blocks, and what a block lacks (place and sums at its begin) follows from one summary row
of each block before it. No conversation is gathered in one task.

Subtree totals come from rounds of joins over a shrinking tree. *Rake*: every leaf adds
its total to its parent and goes. *Compress*: of the nodes with a single child, a random
half of which no two are neighbours go, and their sums move to the edge above that child.
Both together leave a constant share of the nodes, whatever the tree's depth. Afterwards
the rounds are undone in reverse: a compressed node's total is its own sum, its edge's and
its child's total.

Heads: a conversation may begin with the first turns of another one in place of its own
(:func:`shared_heads`).

Defined cases: rows without conversation id belong to none and are left out; a null turn
sorts first; rows of equal turn are ordered by role and then by digest of the text, and
equal rows are all kept, one turn each; null role and text are empty; a conversation that
is left without turns ends at the root; an empty table has no nodes; other columns are not
read. Names of different nodes are equal with probability below n * n / 2**100.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescour.session import shared_dir

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LAID_OUT = (
    "kind int, block int, place long, conv_id long, part int, depth long, s1 long, s2 long, q1 long, q2 long, "
    "chars long, is_end boolean, h int, hb int, len long, p long"
)
CLOSED, OPEN, SUMMARY = 0, 1, 2
HOT_CHILDREN = 200_000


def _turns(conversations: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.char_length(text).cast("long").alias("chars"),
    )


def shared_heads(turns: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, h, head): conversation ``c`` gives up its first ``h`` = crc32(c) % most
    turns for up to as many first turns of conversation ``c - c % span`` (remainder of
    the sign of ``c``)."""
    order = [F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    first = turns.where(F.col("conv_id") % span == 0).withColumn(
        "d", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    ).where(F.col("d") < most)  # a limit below the shuffle: at most ``most`` rows of a task
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("d", "t1", "t2", "chars"))).alias("head")
    )
    convs = turns.select("conv_id").distinct().select(
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % span).alias("base"),
    )
    return convs.join(heads, "base", "left").select(
        "conv_id", "h", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))).alias("head")
    )


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponents), np.uint64)
    left = exponents.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)) == 1] *= np.uint64(base)
        base = base * base & (1 << 64) - 1
        left >>= np.uint64(1)
    return out


def _sums(terms: np.ndarray, seg: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums within segments (numbered in order), each begun at ``first``."""
    total = np.cumsum(terms)
    begins = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
    before = total[begins] - terms[begins]
    lengths = np.diff(np.append(begins, len(seg)))
    return total - np.repeat(before, lengths) + first[seg]


def _lay_out(batches):
    """Nodes of the conversations that begin in this block, the raw rows of one that began
    before it, and a summary row."""
    block, place, own_open, state = TaskContext.get().partitionId(), 0, 0, None
    names = [c.split()[0] for c in _LAID_OUT.split(", ")]
    kinds = {"kind": pa.int32(), "block": pa.int32(), "part": pa.int32(), "h": pa.int32(), "hb": pa.int32(),
             "is_end": pa.bool_()}

    def out(n, **columns):
        arrays = []
        for name in names:
            kind = kinds.get(name, pa.int64())
            value = columns.get(name)
            if value is None:
                arrays.append(pa.nulls(n, kind))
            elif isinstance(value, np.ndarray):
                arrays.append(pa.array(value.view(np.int64) if value.dtype == np.uint64 else value, kind))
            else:
                arrays.append(pa.array([value] * n, kind))
        return pa.record_batch(arrays, names=names)

    seen = False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        seen = True
        get = lambda name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
        conv, part, order, chars = (get(c).astype(np.int64) for c in ("conv_id", "part", "ord", "chars"))
        t = [get(c).astype(np.int64).view(np.uint64) for c in ("t1", "t2")]
        root = (part == 0) & (order == 0)
        places = place + np.arange(n)
        place += n
        lead = n if not root.any() else int(np.argmax(root))
        if lead and state is None:
            own_open += int(part[:lead].sum())
            yield out(lead, kind=OPEN, block=block, place=places[:lead], conv_id=conv[:lead], part=part[:lead],
                      depth=order[:lead], s1=t[0][:lead], s2=t[1][:lead], chars=chars[:lead])
            if lead == n:
                continue
        cut = lead if state is None else 0
        conv, part, order, chars, root, places = (x[cut:] for x in (conv, part, order, chars, root, places))
        t = [x[cut:] for x in t]
        old = state or dict(h=0, hb=0, len=0, p=0, s=(0, 0))
        at = np.flatnonzero(root)
        seg = np.cumsum(root)
        h, hb, length = (
            np.concatenate([[old[c]], get(c).astype(np.int64)[cut:][at]]) for c in ("h", "hb", "len")
        )
        own = part == 1
        counted = np.cumsum(own)
        base = np.concatenate([[-old["p"]], counted[at]])
        p = counted - base[seg]
        depth = np.where(own, hb[seg] + p - h[seg], order)
        keep = ~own | (p > h[seg])
        ks, kd = seg[keep], depth[keep]
        sums, before = [], []
        last = int(seg[-1])
        ends = []
        for i in (0, 1):
            terms = t[i][keep] * _powers(_BASES[i], kd)
            first = np.zeros(last + 1, np.uint64)
            first[0] = old["s"][i]
            s = _sums(terms, ks, first) if len(ks) else terms
            sums.append(s)
            before.append(s - terms)
            ends.append(int(s[-1]) if len(ks) and ks[-1] == last else int(first[last]))
        state = dict(conv=int(conv[-1]), h=int(h[last]), hb=int(hb[last]), len=int(length[last]), p=int(p[-1]), s=ends)
        yield out(len(ks), kind=CLOSED, block=block, place=places[keep], conv_id=conv[keep], depth=kd, s1=sums[0],
                  s2=sums[1], q1=before[0], q2=before[1], chars=chars[keep], is_end=kd == length[ks])
    if seen:
        sent = {}
        if state is not None:
            s = [np.array([x], np.uint64) for x in state["s"]]
            sent = dict(conv_id=state["conv"], h=state["h"], hb=state["hb"], len=state["len"], depth=state["p"],
                        s1=s[0], s2=s[1])
        yield out(1, kind=SUMMARY, block=block, place=place, p=own_open, **sent)


def _continued(carry: dict[int, dict]):
    """Nodes of the rows of blocks' open conversations; sums begin at 0 in each block."""

    def run(batches):
        block, p, s = None, 0, [0, 0]
        for batch in batches:
            get = lambda name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731,B023
            all_blocks = get("block")
            edges = np.flatnonzero(np.append(True, all_blocks[1:] != all_blocks[:-1])) if len(all_blocks) else []
            for a, b in zip(edges, [*edges[1:], len(all_blocks)]):
                if all_blocks[a] != block:
                    block, s = int(all_blocks[a]), [0, 0]
                    p = carry[block]["p"]
                c, own, order = carry[block], get("part")[a:b] == 1, get("depth")[a:b]
                places = p + np.cumsum(own)
                p = int(places[-1])
                depth = np.where(own, c["hb"] + places - c["h"], order)
                keep = ~own | (places > c["h"])
                kd, columns = depth[keep], []
                for i, name in enumerate(("s1", "s2")):
                    terms = get(name)[a:b].view(np.uint64)[keep] * _powers(_BASES[i], kd)
                    run_sum = np.cumsum(terms) + np.uint64(s[i])
                    s[i] = int(run_sum[-1]) if len(run_sum) else s[i]
                    columns += [run_sum.view(np.int64), (run_sum - terms).view(np.int64)]
                yield pa.record_batch(
                    [
                        pa.array(all_blocks[a:b][keep], pa.int32()), pa.array(get("place")[a:b][keep]),
                        pa.array(get("conv_id")[a:b][keep]), pa.array(kd), pa.array(columns[0]),
                        pa.array(columns[2]), pa.array(columns[1]), pa.array(columns[3]),
                        pa.array(get("chars")[a:b][keep]), pa.array(kd == c["len"]),
                    ],
                    names=["block", "place", "conv_id", "depth", "s1", "s2", "q1", "q2", "chars", "is_end"],
                )

    return run


def _named(begin: dict[int, tuple[int, int]]):
    """Rows with 16-byte names; ``begin`` holds the sums at the begin of open blocks."""

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731,B023
            block = get("block")
            places, inverse = np.unique(block, return_inverse=True)
            pairs = np.array([begin.get(int(b), (0, 0)) for b in places], np.uint64).reshape(-1, 2)
            names = []
            for a, b in (("s1", "s2"), ("q1", "q2")):
                both = np.stack([get(a).view(np.uint64) + pairs[inverse, 0], get(b).view(np.uint64) + pairs[inverse, 1]], 1)
                data = np.ascontiguousarray(both.astype(">u8")).view(np.uint8)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(block), [None, pa.py_buffer(data)])
                names.append(fixed.cast(pa.binary()))
            depth = batch.column("depth")
            yield pa.record_batch(
                [*names, batch.column("conv_id"), depth, batch.column("chars"), batch.column("is_end")],
                names=["node", "parent", "conv_id", "depth", "chars", "is_end"],
            )

    return run


def _stored(df: DataFrame, path: str, *partition: str) -> DataFrame:
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _rows(turns: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """(node, parent, conv_id, depth, chars, is_end): a row for each prefix of each
    conversation."""
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    size = F.coalesce(F.size("head"), F.lit(0)).cast("int")
    opening = lengths.join(heads, "conv_id").select(
        "conv_id", "h", size.alias("hb"),
        (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        F.concat(
            F.array(F.struct(F.lit(0).alias("d"), *(F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "chars")))),
            F.coalesce("head", F.array().cast("array<struct<d:int,t1:bigint,t2:bigint,chars:bigint>>")),
        ).alias("head"),
    )
    kind = turns.schema["turn"].dataType
    opening = opening.select("*", F.explode("head").alias("e")).select(
        "conv_id", F.lit(0).alias("part"), F.col("e.d").alias("ord"), F.lit(None).cast(kind).alias("turn"),
        F.lit("").alias("role"), "e.t1", "e.t2", "e.chars", "h", "hb", "len",
    )
    own = turns.select(
        "conv_id", F.lit(1).alias("part"), F.lit(0).alias("ord"), "turn", "role", "t1", "t2", "chars",
        F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("hb"), F.lit(None).cast("long").alias("len"),
    )
    order = ["conv_id", "part", "ord", F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    sort = opening.unionByName(own).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = _stored(sort.mapInArrow(_lay_out, _LAID_OUT), f"{folder}/laid", "kind")

    # One summary row of each sorted block; their number is that of shuffle partitions.
    summaries = laid.where(F.col("kind") == SUMMARY).orderBy("block").collect()
    carry, opener, now, by = {}, {}, None, None
    for s in summaries:
        if now is not None:
            carry[s.block], opener[s.block] = dict(now), by
            now["p"] += s.p
        if s.conv_id is not None:
            now, by = dict(h=s.h, hb=s.hb, len=s.len, p=s.depth), (s.block, s.s1, s.s2)
    columns = ["block", "place", "conv_id", "depth", "s1", "s2", "q1", "q2", "chars", "is_end"]
    opened = laid.where(F.col("kind") == OPEN).repartition("block").sortWithinPartitions("block", "place")
    schema = laid.select(*columns).schema
    opened = _stored(opened.mapInArrow(_continued(carry), schema), f"{folder}/open")
    totals = {
        r.block: (r.s1, r.s2)
        for r in opened.groupBy("block").agg(F.max_by("s1", "place").alias("s1"), F.max_by("s2", "place").alias("s2")).collect()
    }
    begin, of, sums = {}, None, [0, 0]
    for block in sorted(opener):
        if opener[block] != of:
            of, sums = opener[block], [x & (1 << 64) - 1 for x in opener[block][1:]]
        begin[block] = tuple(sums)
        sums = [(a + b) & (1 << 64) - 1 for a, b in zip(sums, totals.get(block, (0, 0)))]
    named = "node binary, parent binary, conv_id long, depth long, chars long, is_end boolean"
    closed = laid.where(F.col("kind") == CLOSED).select(*columns)
    rows = closed.mapInArrow(_named({}), named).unionByName(opened.mapInArrow(_named(begin), named))
    return rows.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))


def _digests(batches):
    """SHA-256 of each node's ids, comma-joined; rows come sorted by node and id."""
    node, digest = None, None

    def done():
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        a, n, whole = 0, len(ids), []
        while a < n:
            b = a + 1
            while b < n and nodes[b] == nodes[a]:
                b += 1
            text = ",".join(map(str, ids[a:b])).encode()
            if nodes[a] == node:
                digest.update(b"," + text)
            else:
                if node is not None:
                    whole.append((node, digest.hexdigest()))
                node, digest = nodes[a], hashlib.sha256(text)
            a = b
        if whole:
            yield pa.record_batch(
                [pa.array([x for x, _ in whole], pa.binary()), pa.array([y for _, y in whole])], names=["node", "ends_sha256"]
            )
    if node is not None:
        yield done()


def subtree_sums(tree: DataFrame, folder: str, values: list[str]) -> DataFrame:
    """(node, *values): sums of ``values`` over each node's subtree, the node included.

    ``tree`` holds node, parent (null at roots) and the values (long). Each round is a few
    joins and aggregates on unique nodes; records and trees are written to ``folder``.
    """
    edges = [f"edge_{v}" for v in values]
    now = _stored(tree.select("node", "parent", *values, *(F.lit(0).cast("long").alias(e) for e in edges)), f"{folder}/tree0")
    turn, records = 0, []
    while not now.where("parent is not null").isEmpty():
        turn += 1
        coin = lambda c: F.xxhash64(F.col(c), F.lit(turn)) % 2 == 0  # noqa: E731,B023
        kids = now.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count("*").alias("kids"), F.min("node").alias("only")
        )
        state = now.join(kids, "node", "left").withColumn(
            "gone", F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & coin("node") & ~coin("only"), F.lit(False))
        )
        above = state.where("gone").select(
            F.col("only").alias("node"), F.col("node").alias("via"), F.col("parent").alias("new_parent"),
            *(F.col(v).alias(f"via_{v}") for v in values), *(F.col(e).alias(f"via_{e}") for e in edges),
        )
        rest = state.where("not gone").join(above, "node", "left")
        moved = F.col("via").isNotNull()
        record = _stored(rest.select(
            "node", F.when(moved, F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), "via", *values,
            *((F.col(f"via_{v}") + F.col(e)).alias(f"via_{v}") for v, e in zip(values, edges)),
            *(F.when(moved, F.col(e) + F.col(f"via_{v}") + F.col(f"via_{e}")).otherwise(F.col(e)).alias(e)
              for v, e in zip(values, edges)),
            (F.col("kids").isNull() & ~moved & F.col("parent").isNotNull()).alias("raked"),
        ), f"{folder}/round{turn}")
        records.append(record)
        raked = record.where("raked").groupBy(F.col("parent").alias("node")).agg(
            *(F.sum(F.col(v) + F.col(e)).alias(f"add_{v}") for v, e in zip(values, edges))
        )
        now = _stored(record.where("not raked").join(raked, "node", "left").select(
            "node", "parent", *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values), *edges
        ), f"{folder}/tree{turn}")
    known = now.select("node", *values)
    for place, record in reversed(list(enumerate(records, 1))):
        lines = record.where("via is not null").select("via", "node", *(f"via_{v}" for v in values))
        opened = lines.join(known, "node").select(
            F.col("via").alias("node"), *((F.col(v) + F.col(f"via_{v}")).alias(v) for v in values)
        )
        # Written whole each time: sizes shrink by a share per round, so all are a few trees.
        raked = record.where("raked").select("node", *values)
        known = _stored(known.unionByName(opened).unionByName(raked), f"{folder}/known{place}")
    return known


def _parent_ids(nodes: DataFrame) -> DataFrame:
    """``parent_conv_id`` of each node. Parents of very many children reach them by a
    broadcast of at most nodes / ``HOT_CHILDREN`` rows, the others by a join on parent."""
    ids = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(ids.where(F.col("n_children") > HOT_CHILDREN).drop("n_children"))
    cold = ids.where(F.col("n_children").between(1, HOT_CHILDREN)).drop("n_children")
    below = nodes.where("parent is not null")
    few = below.join(hot.select("parent"), "parent", "left_anti").join(cold, "parent")
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return few.unionByName(below.join(hot, "parent")).unionByName(top)


def prefix_trie(
    conversations: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", heads=shared_heads
) -> DataFrame:
    """One row for each node, named by its least conversation and its depth.

    ``heads`` gives (conv_id, h, head) of the turns table, see :func:`shared_heads`; with
    None every conversation keeps its own first turns. ``ends_sha256`` needs the ids of a
    node in one stream, which is hashed as it is read from a sorted partition.
    """
    spark = conversations.sparkSession
    folder = shared_dir(spark, "prefix-trie")
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    if heads is None:
        none = F.lit(None).cast("array<struct<d:int,t1:bigint,t2:bigint,chars:bigint>>")
        opening = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("h"), none.alias("head"))
    else:
        opening = heads(turns)
    rows = _stored(_rows(turns, opening, folder), f"{folder}/rows")
    nodes = rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
    )
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = _stored(nodes, f"{folder}/nodes")
    tree = nodes.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(tree, folder, ["n_leaves", "saved_tokens"])
    ends = rows.where("is_end").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ends.mapInArrow(_digests, "node binary, ends_sha256 string")
    return _parent_ids(nodes).join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
