import random

import numpy as np
import pytest
from llm_brute import groups, leaks

from tablescour.llm import decontaminate, setsketch
from tablescour.llm.components import connected_components
from tablescour.session import shared_dir


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), shared_dir(spark, "cc"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in got.collect()} == want


def test_registers_and_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(x) for x in (a[:2000], a[200:2200], a[1000:], np.concatenate([a[:2000], a[200:2200]]))]
    regs = setsketch.registers(sets, 512)
    assert (np.maximum(regs[0], regs[1]) == regs[3]).all()
    coarse = (regs // setsketch.COARSE).astype(int)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
        above, below = (coarse[i] > coarse[j]).sum(), (coarse[i] < coarse[j]).sum()
        assert setsketch.likely([2000], [2000], [above], [below])[0] == pytest.approx(true, abs=0.1)


def _near_group(rng):
    """A base and copies with ever more changes, some close to the limit, and chains."""
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    out = [base]
    for k in range(60):
        copy = list(rng.choice(out) if k % 3 == 0 else base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
        out.append(copy)
    return [" ".join(w) for w in out]


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "GROUP", 7)  # buckets are searched in blocks
    rng = random.Random(9)
    texts = [t for _ in range(3) for t in _near_group(rng)] + ["plain words here"] * 5
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    number, sets = groups(rows, 3, 85, 100)
    least = {}
    for (doc_id, _), g in zip(rows, number):
        least[g] = min(least.get(g, doc_id), doc_id)
    want = {(d, len(s), least[g], least[g] == d) for (d, _), g, s in zip(rows, number, sets)}
    assert {tuple(r) for r in found} == want and len(found) == len(rows)


def test_near_duplicates_on_messy_rows(messy, no_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    number, sets = groups(rows, 3, 85, 100)
    least = {}
    for (doc_id, _), g in zip(rows, number):
        known = [x for x in (least.get(g), doc_id) if x is not None]
        least[g] = min(known) if known else None
    want = sorted(
        (str(d), len(s), str(least[g]), d is not None and least[g] == d) for (d, _), g, s in zip(rows, number, sets)
    )
    got = setsketch.near_duplicates(messy).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    assert setsketch.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(messy, no_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    number, sets = groups(rows, 5, 80, 100)
    kept = setsketch.one_of_each(messy)
    assert kept.columns == messy.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    empty = [r for r, s in zip(rows, sets) if not s]
    assert sorted(map(str, (r for r in got if not r[1] or not r[1].split()))) == sorted(map(str, empty))
    full = {}
    for row, g, s in zip(rows, number, sets):
        if s:
            full.setdefault(g, []).append(row)
    rest = [r for r in got if r[1] and r[1].split()]
    assert len(rest) == len(full)
    for members in full.values():
        stays = [r for r in rest if r in members]
        assert len(stays) == 1
        ids = [d for d, _ in members if d is not None]
        assert stays[0][0] == (min(ids) if ids else None)
    assert setsketch.one_of_each(no_docs).count() == 0


@pytest.fixture(scope="module")
def leaking(spark):
    rng = random.Random(11)
    make = lambda n: [f"v{rng.randint(0, 500)}" for _ in range(n)]
    items = {i: make(n) for i, n in enumerate((3, 5, 14, 14, 30, 30, 60, 1))}
    items[8] = ["the"] * 12
    docs = []
    for i, item in items.items():
        cut = list(item)
        cut[-1] = "other"
        docs += [make(40) + item + make(20), [w.upper() for w in item], cut + make(9), make(3) + item[: len(item) // 2], item[1:]]
    docs += [make(200), [], ["the"] * 30]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    docs += [(0, docs[0][1]), (None, docs[0][1]), (1, "v1  \t v2"), (None, None)]
    rows = [(i, " ".join(t)) for i, t in items.items()] + [(90, None), (91, "  ")]
    return docs, rows


def test_leaks_are_those_of_all_windows(spark, leaking):
    docs, items = leaking
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, n string, words int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, size string")
    want = leaks([t for _, t in docs], items)
    got = decontaminate.decontaminate(table, bench).collect()
    plain = sorted((str(d), len(want[k]), sorted(want[k]), round(max(want[k].values(), default=0), 9)) for k, (d, _) in enumerate(docs))
    assert sorted((str(r.doc_id), r.n_items, r.item_ids or [], round(r.similarity or 0, 9)) for r in got) == plain
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns and kept.count() == sum(not w for w in want.values())
    assert decontaminate.decontaminate(table, bench.limit(0)).where("kept").count() == len(docs)
    assert decontaminate.decontaminate(table.limit(0), bench).count() == 0


def test_leaks_with_shared_boilerplate_and_changed_words(spark):
    rng = random.Random(23)
    make = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = make(29)
    items = {i: shared + make(20) for i in range(60)} | {i: make(50) for i in range(60, 64)}
    docs = [items[i][25:] for i in range(60)]  # all 20 own shingles, none of the 25 shared ones
    docs += [items[i][:k] + ["changed"] + items[i][k + 1 :] for i in range(60, 64) for k in range(50)]
    docs += [make(30) + items[60][:25] + ["changed"] + items[60][26:] + make(30), make(10) + shared + make(30)]
    docs, items = [" ".join(d) for d in docs], [(i, " ".join(t)) for i, t in items.items()]
    want = leaks(docs, items)
    assert sum(map(bool, want.values())) > 250 and not want[len(docs) - 1]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids or [] for r in got} == {k: sorted(v) for k, v in want.items()}


def test_long_items_are_compared_over_all_windows(spark):
    rng = random.Random(31)
    make = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    long, loop = make(2000), make(7) * 60  # the second repeats its shingles
    items = [(0, " ".join(long)), (1, " ".join(loop)), (2, " ".join(long[:700] + make(10)))]
    changed = lambda step: [w if k % step else "changed" for k, w in enumerate(long)]
    docs = [
        make(300) + long + make(300), long[100:], long[:1500], changed(60), changed(30), make(50) + loop + loop[:100],
        loop[:380] + make(90), make(20) + long[:690] + make(40), long[:1000] + make(30) + long[1000:] + make(200),
    ]
    docs = [" ".join(d) for d in docs]
    want = leaks(docs, items)
    assert 5 <= sum(map(bool, want.values())) < len(docs)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = decontaminate.matches(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 8) for r in got} == {
        (d, i): round(s, 8) for d, found in want.items() for i, s in found.items()
    }
