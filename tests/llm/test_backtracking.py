import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablescour.llm import backtracking
from tablescour.llm.backtracking import BacktrackingEncoder, Codec, MergeTable, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _check(codec, library, texts):
    ids, counts = codec.encode(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, text
        got = codec.decode(ids[a:b]).tobytes()[:-1].decode()
        assert got == library.decode(want, skip_special_tokens=False), text


def test_ids_and_texts_equal_the_library(codec, library):
    rng = random.Random(1)
    parts = [
        "a", "b", "er", "ing", "the", "\n", " ", "é", "é", "Σ", "ß", "İ", "1", "²", "½", "<|endoftext|>",
        "<|end", "'s", "'LL", "!", "...", "\xa0", "　", "中", "̀", "😀", "ǆ", "ﬁ", "Å", "\x85", "\x1c",
        "\x0b", "l", "n", "o", "s", "t", "i", "in", "th", "aaaa", "<|startoftext|>", "×", "_", "Ž", "ẛ̣",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += ["".join(rng.choice("abcdeilnorstuhgm") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    _check(codec, library, [*texts, "", " \n", "a" * 5000, "ab" * 4000, "é" * 3000])


def test_every_assigned_character(codec, library):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    _check(codec, library, texts[::7] + texts[:0x600])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(Codec, "KEEP", 5)
    monkeypatch.setattr(MergeTable, "KEEP_PAIRS", 3)
    small = Codec(PATH)
    for _ in range(3):
        _check(small, library, ["the quick brown foxes jumped", "over lazy dögs, thrice", "unbelievably"])


def _replay(word, merge, made):
    """Merges in order of rank, leftmost first."""
    while True:
        pairs = [(merge[p], i) for i, p in enumerate(zip(word, word[1:])) if p in merge]
        if not pairs:
            return word
        _, i = min(pairs)
        word = [*word[:i], made[word[i], word[i + 1]], *word[i + 2 :]]


def test_random_merge_lists():
    rng = random.Random(4)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>"])}
        merges = []
        for _ in range(rng.randint(1, 25)):
            a, b = rng.choice([v for v in vocab if not v.endswith("</w>")]), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        table = MergeTable(vocab, merges, "</w>")
        encoder = BacktrackingEncoder(table)
        made = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            symbols = [vocab[c] for c in word[:-1]] + [vocab[word[-1] + "</w>"]]
            assert encoder.encode(word) == _replay(symbols, table.merge, made)


def test_documents(spark, messy, no_docs, library, monkeypatch):
    for size in (backtracking.SLICE, 50):  # 50: nearly all texts come in pieces
        monkeypatch.setattr(backtracking, "SLICE", size)
        rows = encode(messy, PATH)
        got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids), r.n_tokens, r.decoded) for r in rows.collect())
        want = []
        for r in messy.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id is not None, r.doc_id or 0, np.array(ids, "<u4").tobytes(), len(ids), text))
        assert got == sorted(want)
    again = sorted((r.text for r in decode(rows, PATH).collect()))
    assert again == sorted(w[4] for w in want)
    assert encode(no_docs, PATH).count() == 0
    assert encode(messy, PATH, decoded=False).columns == ["doc_id", "n_tokens", "ids"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Codec(public_tokenizers.path("byte_bpe_50k.json"))  # has a decoder of its own
