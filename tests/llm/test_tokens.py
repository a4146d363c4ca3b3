import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_brute import words
from tokenizers import Tokenizer

from tablescour.llm.sequences import ChunkEncoder, SequenceReader, read_documents, write_sequences
from tablescour.llm.wordpieces import Automaton, Counter, byte_pieces, piece_counts
from tablescour.llm.words import text_bytes
from tablescour.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = [
        " ", "  ", "\n", " \n", "a", "bc", "'s", " ", "\xa0", "é", " é", "ñ ", "ж ж", "中 文", "1 2",
        "<|endoftext|>", " <|endoftext|> ", "<|", "|>", "t|", "!", "-", "\t", "😀", "×", "÷!", "a!", "é!", "a\n",
        "\nB", ".\nB", ".\n\nB", "don't", "a's!", "é'll", "1!", "!1", "\x85 b",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    tokenizer = Tokenizer.from_file(PATH)
    ids, lengths = ChunkEncoder(PATH).encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, ends - lengths, ends):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_files_hold_all_documents_in_order(spark, messy):
    folder = shared_dir(spark, "test-sequences")
    shards = write_sequences(messy, folder, PATH, length=64, rows=4).collect()
    got = read_documents(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = {}
    for r in messy.collect():
        texts.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        crc = [zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for i in texts[r.doc_id]]
        assert r.ids_crc32 in crc and r.n_tokens in map(len, texts[r.doc_id])
    assert len(got) == messy.count()
    for shard in shards:
        reader = SequenceReader(shard.ids_file)
        flat = np.concatenate(list(reader.pieces(0, shard.n_tokens)))
        last = (shard.n_tokens - 1) // 64
        for i in (0, last // 2, last):
            ids, mask = reader.row(i)
            part = flat[i * 64 : (i + 1) * 64]
            assert len(ids) == len(mask) == 64 and mask.sum() == len(part) and (ids[: len(part)] == part).all()


def test_views_share_the_memory_of_the_file(spark, messy):
    folder = shared_dir(spark, "test-sequences")
    for shard in write_sequences(messy, folder, PATH, length=64, rows=4).collect():
        reader = SequenceReader(shard.ids_file)
        rows = -(-shard.n_tokens // 64)
        before = pa.total_allocated_bytes()
        views = [reader.views(i) for i in range(rows)]
        assert pa.total_allocated_bytes() == before  # mapped, not copied
        for i in (0, rows - 1):
            ids, mask = reader.row(i)
            assert views[i][0].to_numpy().tolist() == ids.tolist() and views[i][1].to_pylist() == mask.tolist()


def test_no_documents_write_no_shard(spark, no_docs):
    folder = shared_dir(spark, "test-sequences")
    assert write_sequences(no_docs, folder, PATH).count() == 0
    assert read_documents(spark, folder).count() == 0


def _greedy(word, pieces, before=b" "):
    rest, n = before + word, 0
    while rest:
        best = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not best:
            return None
        rest, n = rest[best:], n + 1
    return n


def test_automaton_counts_like_greedy_matching():
    rng = random.Random(3)
    pieces = [b"a", b"abc", b" a", b" ", b"bcd", b"b", b"c", b" ab", b"abcdx"]
    some = ["".join(rng.choice("abcdx") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    data, bounds = text_bytes(pa.array(some))
    _, n, unknown = Counter(Automaton(pieces), 0x20).rows(data, bounds)
    for word, k, u in zip(some, n, unknown):
        want = _greedy(word.encode(), set(pieces))
        assert (k, u) == ((want, 0) if want else (1, 1))


def test_piece_counts(messy, no_docs):
    pieces = set(byte_pieces(PATH))
    got = sorted(tuple(r)[1:] for r in piece_counts(messy, PATH).collect())
    want = []
    for r in messy.collect():
        split = (r.text or "").encode().split()
        counts = {w: _greedy(w, pieces) for w in set(split)}
        want.append((len((r.text or "").encode()), len(split), sum(counts[w] for w in split), 0))
        assert len(split) == len(words(r.text))
    assert got == sorted(want)
    assert piece_counts(no_docs, PATH).count() == 0
