import random

import pytest
from llm_brute import CLASH_VALUES, CLASHING


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls everywhere, empty, short and long texts, copies and near copies,
    repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, base.upper(), " ".join(near), "  \t\n ", "", None, "one", "one two", "one two",
        make(40_000), make(5), "é ñ × a!b don't <|endoftext|> x", make(200), make(300), make(90),
        "A b\x0bc\x0cd e", "A b\x0bc\x0cd e",
    ]
    rows = [(i, t, "en" if i % 3 else None, "web" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [rows[3], (3, make(30), None, None), (None, make(50), "fr", "web"), (None, None, None, None)]
    rows = [(*r, None if r[1] is None else len(r[1]), *CLASH_VALUES) for r in rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, messy):
    return spark.createDataFrame([], messy.schema)
