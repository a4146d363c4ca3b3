from collections import Counter

import numpy as np
import pytest
from llm_brute import groups, leaks, words
from pyspark.sql import functions as F

import corpus_pipeline
from tablescour.llm import mixing
from tablescour.llm.queries import op10_source_mix

SF = "/root/testdata/sf0.01"


def _targets(sizes, weights):
    """Water level by bisection: every source at its weight's share or at its cap."""
    total = min(1.5 * sum(sizes), 2.0 * sum(sizes))
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2.0 * s, level * w) for s, w in zip(sizes, weights)) < total:
            low = level
        else:
            high = level
    return [min(2.0 * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [0, 5, 0, 7], [1000, 1, 1, 1, 50], [3], []])
def test_targets_fill_to_their_caps(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, weights, 1.5, 2.0) == pytest.approx(_targets(sizes, weights), rel=1e-9, abs=1e-9)


def test_tree_deals_out_every_draw():
    quotas = np.array([1000, 0, 17, 333])
    leaves = mixing.split(quotas, 13, np.random.Generator(np.random.PCG64(3)))
    assert leaves.shape == (13, 4) and (leaves.sum(0) == quotas).all() and (leaves >= 0).all()
    assert np.ptp(leaves.sum(1)) <= 4
    # a leaf's part of a source varies as a draw without replacement does
    first = [mixing.split(np.array([60, 40]), 2, np.random.Generator(np.random.PCG64(s)))[0][0] for s in range(400)]
    assert abs(np.mean(first) - 30) < 0.5 and 1.8 < np.std(first) < 3.2


def test_taken_words_meet_targets(spark):
    rows = op10_source_mix(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    names = sorted(sizes)
    goals = _targets([sizes[n] for n in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])
    for name, goal in zip(names, goals):
        row = next(r for r in rows if r.source == name)
        assert row.source_size == sizes[name] and row.target == pytest.approx(goal, rel=1e-6)
        assert abs(taken[name] - goal) <= 1
    again = op10_source_mix(spark, SF)
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_messy_rows(spark, messy, no_docs):
    thin = mixing.sized(messy)
    rows = mixing.drawn(thin, *mixing.plan(thin)).collect()
    assert len(rows) == messy.count()
    totals, goals = Counter(), {}
    for r in rows:
        totals[r.source] += r.whole_draws * r["size"] + r.part_words
        goals[r.source] = r.target
    copies = max(Counter((r.doc_id, r["size"]) for r in rows).values())
    assert all(abs(totals[s] - goals[s]) <= copies for s in goals)
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    got = dict(mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text")))).collect())
    assert {s: got.get(s, 0) for s in totals} == dict(totals)
    whole = mixing.mix(messy, cut=False)
    texts = {r.text for r in messy.collect()}
    assert {r.text for r in whole.collect()} <= texts
    assert mixing.mix(no_docs).count() == 0
    thin = mixing.sized(no_docs)
    assert mixing.drawn(thin, *mixing.plan(thin)).count() == 0


def test_pipeline_stages_by_plain_versions(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, bench = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "tokens" or docs.columns == columns
        kept[name] = docs.collect()
    rows = kept["quality"]
    number, sets = groups([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    least = {}
    for r, g in zip(rows, number):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(least.values())
    found = leaks([r.text for r in kept["near_dedup"]], bench)
    clean = [r.doc_id for k, r in enumerate(kept["near_dedup"]) if not found[k]]
    assert sorted(r.doc_id for r in kept["decontamination"]) == sorted(clean)
    ids = Counter(r.doc_id for r in kept["mixing"])
    assert set(ids) <= set(clean) and max(ids.values()) <= 2
    assert Counter(r.doc_id for r in kept["tokens"]) == ids
    starts = sorted((r.start, r.n_tokens) for r in kept["tokens"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_stages_on_messy_rows(spark, messy, tmp_path):
    path = tmp_path / "sf"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(path / f"{name}.parquet"))
    docs = messy
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == messy.columns
