import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablescour.llm import prefix_trie as trie_module
from tablescour.llm.prefix_trie import prefix_trie, subtree_sums
from tablescour.session import shared_dir

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _plain(rows, heads=True):
    """Nodes of rows (conv_id, turn, role, text) whose turns differ within a conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children[node]]
        out[node] = (
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
            sum(x[5] for x in below) or 1,
            (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(x[6] for x in below),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
    return sorted(out.values(), key=lambda x: x[:2])


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda x: x[:2])


def _table(spark, rows, parts=5):
    schema = "conv_id long, turn long, role string, text string, node string, parent string, kind string, depth string"
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(parts)


def _conversations(seed):
    rng = random.Random(seed)
    texts = ["", None, "yes", "no", "é😀", "tell me", "a longer answer to that"]
    rows = []
    for c in rng.sample(range(400), 80):
        for turn in rng.sample([None, *range(-1, 12)], rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(texts[: rng.randint(1, 7)])))
    for c in (1000, 1001, 1002, 1050, 1077):  # copies
        rows += [(c, t, "user", f"turn {t}") for t in range(8)]
    rows += [(2001, t, "user", "x" * (t % 3)) for t in range(120)]  # a deep one, without a base
    rows += [(2100, t, "user", "same") for t in range(40)] + [(2100 + i, t, "user", "same") for i in (1, 2) for t in range(40 - i)]
    rows += [(-150, 0, "user", "below zero"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


def test_equals_plain_version(spark):
    rows = [r for r in _conversations(3) if r[0] is None or r[0] >= 0]
    assert _got(prefix_trie(_table(spark, rows))) == _plain(rows)


def test_without_heads_and_in_small_blocks(spark):
    """Conversations that lie in many sorted blocks: more partitions than rows of one."""
    rows = _conversations(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert _got(prefix_trie(_table(spark, rows), heads=None)) == _plain(rows, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "HOT_CHILDREN", 3)
    rows = [(c, t, "user", f"{t * c % 7}") for c in range(60) for t in range(3)]
    assert _got(prefix_trie(_table(spark, rows))) == _plain(rows)


def test_ties_and_equal_rows_and_negative_ids(spark):
    rows = [(7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "bot", "b"), (7, None, None, None), (-150, 0, "x", "y"), (-100, 0, "x", "z")]
    got = _got(prefix_trie(_table(spark, rows)))
    assert got == _got(prefix_trie(_table(spark, rows[::-1], 2)))
    seven = [x for x in got if x[0] == 7]
    assert max(x[1] for x in seven) == 4 - min(zlib.crc32(b"7") % 6, 4)
    h = zlib.crc32(b"-150") % 6
    root = [x for x in got if x[1] == 0][0]
    assert root[:4] == (-150, 0, None, 3) and h == h


def test_nothing(spark):
    assert _got(prefix_trie(_table(spark, []))) == []
    assert _got(prefix_trie(_table(spark, [(None, 1, "a", "b")]))) == []


@pytest.mark.parametrize("shape", ["path", "random", "brush", "forest"])
def test_subtree_sums_of_any_tree(spark, shape):
    rng = random.Random(shape)
    n = 80
    parent = {
        "path": lambda i: i - 1, "random": lambda i: rng.randrange(i),
        "brush": lambda i: i - 1 if i % 3 else max(i - 3, 0), "forest": lambda i: i - 1 if i % 20 else None,
    }[shape]
    up = [None] + [parent(i) for i in range(1, n)]
    value = [rng.randint(-5, 9) for _ in range(n)]
    total = list(value)
    for i in reversed(range(n)):
        if up[i] is not None:
            total[up[i]] += total[i]
    tree = spark.createDataFrame([(f"{i}", None if p is None else f"{p}", v, 1) for i, (p, v) in enumerate(zip(up, value))],
                                 "node string, parent string, v long, one long")
    got = subtree_sums(tree, shared_dir(spark, "test-tree"), ["v", "one"]).collect()
    assert {int(r.node): r.v for r in got} == dict(enumerate(total)) and len(got) == n
