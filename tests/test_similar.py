import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tablescour.functions.similar import ratio
from tablescour.operators import match


def test_ratio_equals_matching_blocks(spark):
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("abc_é") for _ in range(rng.randint(0, 12)))
    pairs = [(make(), make()) for _ in range(400)] + [("", ""), ("customername", "customrname"), ("abcabc", "bcabca")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ratio(F.col("a"), F.col("b")).alias("r"))
    for a, b, r in rows.collect():
        assert abs(r - SequenceMatcher(None, a, b).ratio()) < 1e-12, (a, b)


def test_the_index_loses_no_similar_name(spark):
    """Names at all distances from the targets' names, against a comparison with each of them."""
    rng = random.Random(2)
    known = [(t, n) for t in match.TARGETS for n in match._names_of(t, match.SYNONYMS)]
    names = set()
    while len(names) < 1500:
        name = list(rng.choice(known)[1])
        for _ in range(rng.randint(1, 5)):
            at = rng.randint(0, len(name))
            name[at : at + rng.randint(0, 2)] = [rng.choice("aeinrst_")] * rng.randint(0, 2)
        names.add("".join(c for c in name if c != "_"))
    names = sorted(names - {n for _, n in known})
    got = {
        r.plain: (r.target, round(r.near, 9))
        for r in match.similar_targets(
            spark.createDataFrame([(n,) for n in names], "plain string"), match.TARGETS, match.SYNONYMS
        ).collect()
    }
    want = {}
    for name in names:
        scores = [(SequenceMatcher(None, name, n).ratio(), t) for t, n in known]
        near = max(s for s, _ in scores)
        if near >= match.SIMILAR_FROM:
            want[name] = (next(t for s, t in scores if s == near), round(near, 9))
    assert got == want and len(want) > 300


def test_matching_is_native(spark):
    catalog = spark.createDataFrame([("mailx",)], "column string")
    plan = match.suggest(catalog)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
