import numpy as np
import pytest
from llm_brute import lm_scores

from tablescour.llm import kneser_ney
from tablescour.llm.lm_scores import score_documents
from tablescour.llm.trie import EliasFano, Trie, code_coarse, code_fine, value_coarse, value_fine

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (5, 3), (1000, 10**6), (1000, 2**63), (5000, 700), (3, 2**64 - 1)])
def test_elias_fano_finds_and_reads(n, most):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
    packed = EliasFano.encode(values)
    asked = np.concatenate([values, rng.integers(0, most, 500, dtype=np.uint64, endpoint=True)])
    index = packed.index(asked)
    assert ((index >= 0) == np.isin(asked, values)).all()
    if n:
        assert (packed.at(np.arange(n)) == values).all()
        assert (packed.find(asked) == np.searchsorted(values, asked)).all()


def test_trie_survives_its_file(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    contexts = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    first, second = rng.integers(0, len(contexts), 900), rng.integers(0, 40, 900).astype(np.uint64) * 977
    trie = Trie.build(contexts, np.arange(len(contexts)) + 1, first, second, np.ones(900))
    with pa.OSFile(str(tmp_path / "t"), "wb") as file:
        trie.write(file)
    trie = Trie.open(pa.memory_map(str(tmp_path / "t")))
    counts = {}
    for a, b in zip(first.tolist(), second.tolist()):
        counts[a, b] = counts.get((a, b), 0) + 1
    a, b = np.repeat(np.arange(-1, len(contexts)), 45), np.tile(np.arange(45) * 977, len(contexts) + 1)
    got = trie.joints(a, b.astype(np.uint64))
    assert got.tolist() == [counts.get((x, y), 0) for x, y in zip(a.tolist(), b.tolist())]


def test_codes_are_close():
    counts = np.unique(np.geomspace(1, 1e7, 400).astype(np.int64))
    assert np.abs(value_fine(code_fine(counts)) / counts - 1).max() < 2e-4
    assert np.abs(value_coarse(code_coarse(counts), 0) / counts - 1).max() < 0.035
    assert value_fine(code_fine(np.array([0])))[0] == 0


def test_counts_have_no_ceiling(tmp_path):
    import pyarrow as pa

    counts = np.array([1, 16, 17, 1000, 10**7, 15_800_000, 16_000_000, 10**9, 2**33 + 1, 2**40])
    n = len(counts)
    first, second = np.repeat([0, 1], [n - 3, 3]), np.arange(n, dtype=np.uint64) + np.uint64(100)
    contexts, sums = np.array([5, 9], np.uint64), np.array([counts[:-3].sum(), counts[-3:].sum()])
    trie = Trie.build(contexts, sums, first, second, counts.astype(np.float64))
    with pa.OSFile(str(tmp_path / "t"), "wb") as file:
        trie.write(file)
    trie = Trie.open(pa.memory_map(str(tmp_path / "t")))
    asked = np.random.default_rng(3).permutation(n)
    codes, over = trie.pairs(np.append(first[asked], 0), np.append(second[asked], np.uint64(7)))
    values, want = value_coarse(codes, 0, over), counts[asked]
    assert values[-1] == 0 and np.abs(values[:-1] / want - 1).max() < 0.035
    assert np.array_equal(values[:-1][want >= 10**9], want[want >= 10**9])
    assert np.abs(value_fine(code_fine(counts)) / counts - 1).max() < 2e-4
    assert np.abs(value_fine(trie.mass) / sums - 1).max() < 2e-4


def test_scores_match_a_plain_model(messy, no_docs):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = sorted((*w[:4], round(w[4], 6), w[5]) for w in lm_scores(rows))
    got = score_documents(messy, shards=5).collect()
    got = sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-6) and g[5] == pytest.approx(w[5], abs=0.02 * g[1])
    assert score_documents(no_docs).count() == 0


def test_kneser_ney_is_a_distribution(spark):
    texts = spark.createDataFrame([("abracadabra abba",), ("Cab a bad DAD!",), (None,), ("",)], "text string")
    model = 10.0 ** kneser_ney.fit(texts).astype(np.float64)
    sums = model.reshape(-1, kneser_ney.SYMBOLS).sum(1)
    assert np.allclose(sums, 1, atol=5e-3)
    # one seen gram by hand: levels are discounted counts plus what their context leaves
    counts = kneser_ney.count_grams(texts).toPandas()
    grams = dict(zip(counts.gram, counts.n))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            low = g & ((1 << 6 * k) - 1)
            levels[k][low] = levels[k].get(low, 0) + 1

    def p(k, gram):
        if not k:
            return 1 / 64
        level = levels[k]
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.0 for i in range(3)]
        d = [min(max(x, 0.05), i + 1.0) for i, x in enumerate(d)]
        of = {g: c for g, c in level.items() if g >> 6 == gram >> 6}
        lower = p(k - 1, gram & ((1 << 6 * (k - 1)) - 1))
        if not of:
            return lower
        off = lambda c: d[min(c, 3) - 1]
        own = of[gram] - off(of[gram]) if gram in of else 0
        return (own + sum(map(off, of.values())) * lower) / sum(of.values())

    for gram in [*list(grams)[:40], 0, 12345, (1 << 24) - 1]:
        assert model[gram] == pytest.approx(p(4, gram), rel=4e-3)


def test_no_two_bytes_share_a_spelling(spark):
    table, every = kneser_ney.symbol_table(), np.arange(256, dtype=np.uint8)
    assert len(np.unique(table)) == 256 and (table % kneser_ney.SYMBOLS > 0).all()
    symbols, ends = kneser_ney.spelled(every, np.arange(257), table)
    spellings = {tuple(symbols[a:b].tolist()) for a, b in zip(ends, ends[1:])}
    assert len(spellings) == 256 and {len(x) for x in spellings} == {1, 2}
    assert not {x[0] for x in spellings if len(x) == 1} & {x[0] for x in spellings if len(x) == 2}
    # of bytes that stand alike in a text, the ones trusted texts hold are likelier
    pairs = [("call 117 A now", "call 338 A now"), ("in Ulm", "in Xlm"), ("é là", "è lÀ"), ("a + b", "a @ b")]
    rows = [(i, x[0], "en") for i, x in enumerate(pairs)] + [(i + 10, x[1], "en") for i, x in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 10").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = {r.doc_id: (r.perplexity, r.n_bytes) for r in kneser_ney.classify(docs, labels).collect()}
    for i in range(len(pairs)):
        assert got[i][0] < got[i + 10][0] and got[i][1] == got[i + 10][1]
    # a text's perplexity is that of all its symbols, by byte
    model, text = kneser_ney.fit(docs.where("doc_id < 10").select("text")), np.frombuffer(rows[2][1].encode(), np.uint8)
    logs = model[kneser_ney.grams(text, np.array([0, len(text)]), 4, table)].astype(float)
    assert len(logs) > len(text) and got[2][0] == pytest.approx(10 ** (-logs.sum() / len(text)), rel=1e-9)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    rows = kneser_ney.classify(docs, even).toPandas()
    assert len(rows) == docs.count()
    seen = rows.merge(odd, on="doc_id")
    good = seen[(seen.quality == 1) & (seen.toxic == 0)]
    assert good.kept.mean() > 0.97 and seen[seen.quality == 0].kept.mean() < 0.45


def test_classifier_rejects_held_out_toxic_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    seen = kneser_ney.classify(docs, even).toPandas().merge(odd, on="doc_id")
    toxic = seen[(seen.quality == 1) & (seen.toxic == 1)]
    assert len(toxic) and toxic.kept.mean() < 0.4
    good = seen[(seen.quality == 1) & (seen.toxic == 0)]
    assert good.kept.mean() > 0.97


def test_model_counts_every_trusted_document(spark):
    docs = spark.range(4_400).selectExpr("id AS doc_id", "concat(substr(sha2(string(id), 256), 1, 20), ' end') AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "int(doc_id >= 4300) AS toxic").repartition(3)
    model = kneser_ney.fit(docs.where("doc_id < 4300").select("text"))
    rows = kneser_ney.classify(docs, labels).where("doc_id < 50").toPandas()
    texts = docs.where("doc_id < 50").toPandas().set_index("doc_id").text
    data = {i: np.frombuffer(t.encode(), np.uint8) for i, t in texts.items()}
    codes = {i: kneser_ney.grams(d, np.array([0, len(d)]), 4, kneser_ney.symbol_table()) for i, d in data.items()}
    for r in rows.itertuples():
        assert r.perplexity == pytest.approx(10 ** -model[codes[r.doc_id]].astype(float).mean(), rel=1e-9)
    some = kneser_ney.among(docs, docs.where("doc_id % 7 = 3").select("doc_id"))
    assert sorted(r.doc_id for r in some.collect()) == list(range(3, 4_400, 7))


def test_classifier_on_messy_rows(spark, messy, no_docs):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame(
        [(0, 1, 0), (0, 1, 0), (13, 1, 0), (14, 1, None), (15, 0, 0), (None, 1, 0), (1, None, None)], schema
    )
    rows = kneser_ney.classify(messy, labels).collect()
    assert len(rows) == messy.count()
    assert all((r.perplexity is None and not r.kept) == (r.n_bytes == 0) for r in rows)
    kept = kneser_ney.accepted(messy, labels)
    assert kept.columns == messy.columns and kept.count() == sum(r.kept for r in rows)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()  # whole rows stay in the JVM
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in rows if r.kept)
    unlabelled = kneser_ney.classify(messy, labels.limit(0)).collect()
    assert all(r.kept == (r.n_bytes > 0) for r in unlabelled)
    assert kneser_ney.classify(no_docs, labels).count() == 0
