import random
import re
import zlib
from collections import Counter

import pytest
from llm_brute import ASCII_LOWER, CLASH_VALUES, CLASHING

from tablescour.llm import spelling
from tablescour.llm.spelling import Tree, letter_counts, near_words, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(rows):
    words, out = _words(rows), {}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and _near(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = best if best is not None and words[best] >= 2 * n else None
    result = []
    for w, form in out.items():
        root = w
        while out[root]:
            root = out[root]
        result.append((w, form, root, words[w], len(near[w]), words[form] if form else None))
    return sorted(result)


def _rows(seed, n=120):
    rng = random.Random(seed)
    alphabet = "abcdeéÉ÷ÿn"
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def word():
        w = list(stems[min(int(rng.expovariate(0.08)), 59)])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(alphabet)]])
            w = w or ["a"]
        return "".join(w).upper() if rng.random() < 0.1 else "".join(w)

    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(n)]
    rows += [(None, None), (None, rows[0][1]), (5, rows[5][1]), (900, ""), (901, " ,;× ÿ")]
    rows += [(902, "q" * 3000 + " " + "q" * 2999 + " ") for _ in range(4)]
    return rows


def _table(spark, rows):
    rows = [(*r, *CLASH_VALUES) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


def _got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("cell", [40, 20_000])
def test_equals_plain_version(spark, monkeypatch, cell):
    """Small cells and slices: words meet across cells, batches and pieces of texts."""
    if cell == 40:
        monkeypatch.setattr(spelling, "BUCKET", 3)
        monkeypatch.setattr(spelling, "_WORK", 500)
    rows = _rows(cell)
    assert _got(spelling_variants(_table(spark, rows), cell=cell)) == _plain(rows)


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c"), (3, "once only")]):
        assert _got(spelling_variants(_table(spark, rows))) == []


def test_forms_lead_to_roots(spark):
    times = {"abcde": 3, "abcdf": 6, "abcdfg": 12, "abxdfg": 24, "zzzzz": 3, "zzzzy": 5}
    rows = [(0, " ".join(w for w, n in times.items() for _ in range(n)))]
    assert _words(rows) == times  # no hash hits
    got = {r[0]: r[1:3] for r in _got(spelling_variants(_table(spark, rows)))}
    assert got["abcde"] == ("abcdf", "abxdfg") and got["abxdfg"] == (None, "abxdfg")
    assert got["zzzzz"] == (None, "zzzzz")


def test_each_pair_is_told_once(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(900)}
    vocabulary = spark.createDataFrame([(w, rng.randint(3, 9)) for w in words], "word string, n long")
    got = Counter()
    for r in near_words(vocabulary, cell=60, sample=300).collect():
        got[r.word] += r.n_near
    want = Counter({w: sum(_near(w, x) for x in words) for w in words})
    assert got == want


def test_reach_covers_the_box():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdÿ") for _ in range(7)) for _ in range(400)]
    points = letter_counts(words)
    tree = Tree(points, 25)
    own = tree.own(points)
    assert sorted(i for m in tree.members for i in m.tolist()) == list(range(400))
    for fewer in (0, 1):
        reached = [set() for _ in words]
        for leaf, some in tree.reach(points, fewer):
            for i in some.tolist():
                reached[i].add(leaf)
        for i in range(400):
            d = points - points[i]
            fits = (d.clip(0).sum(1) <= 1) & ((-d).clip(0).sum(1) <= fewer)
            assert set(own[fits].tolist()) <= reached[i]
