"""Scores of texts under a bigram model kept in sharded Elias-Fano tries.

Texts become blocks of about ``BLOCK`` tokens. A block's distinct words and word pairs go
to shards by the hash of the (first) word, with their counts in training texts; pairs of
very frequent first words are spread over all shards by the hash of the pair. A shard
sums the counts of all blocks, writes its trie to the shared folder, maps it, and answers
every block's words and pairs; a block then adds up the answers for its texts. So each
n-gram crosses the network once a block, the model is never in one place, and nothing is
counted twice.

Model: absolute discounting, interpolated with the add-one unigram estimate,
``p(v | u) = (max(c(uv) - D, 0) + D * T(u) * p(v)) / c(u)``, ``T``: distinct successors;
``p(v)`` alone after a context without training text. The values that enter it are
quantised (see ``trie``); ``base_score`` uses exact counts.

Tokens are words in lower case (A-Z only) and an end after each text. Words are compared
by 64-bit hash, successors of one context by 48 bits of it. Defined cases: a null or empty text is the end alone; the id of a null id
is the empty string for the split; rows with equal ids are scored alone; without training
texts all counts are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.llm.files import Output, open_input
from tablescour.llm.trie import Trie, code_fine, value_coarse, value_fine
from tablescour.llm.words import WordHasher, mix, text_bytes
from tablescour.session import shared_dir

BLOCK = 1_200_000
FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
HOT_SHARE = 1e-3
SHARD_BYTES = 32 << 20  # of text for each shard
BEGIN, END = np.uint64(1), np.uint64(2)
_ASKED = "shard int, block string, payload binary"
_TOLD = "shard int, block string, payload binary, n long, v long, hot array<long>"
_OUT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def token_blocks(batches, size: int = BLOCK):
    """(doc ids, tokens per text, token hashes) of runs of texts."""
    hasher, held = WordHasher(lower=True), []
    count = 0

    def joined():
        ids, n, tokens = zip(*held)
        return [x for part in ids for x in part], np.concatenate(n), np.concatenate(tokens)

    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 21), "right")) - 1)
            _, _, words, rows = hasher.words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            n = np.diff(rows) + 1
            tokens = np.full(int(n.sum()), END, np.uint64)
            ends = np.cumsum(n) - 1
            body = np.ones(len(tokens), bool)
            body[ends] = False
            tokens[body] = words
            held.append((batch.column(0)[a:b].to_pylist(), n, tokens))
            count += len(tokens)
            a = b
            if count >= size:
                yield joined()
                held, count = [], 0
    if held:
        yield joined()


def place_pairs(hashes: np.ndarray, ids: np.ndarray, n: np.ndarray, shards: int, hot: np.ndarray):
    """Pairs of a block's tokens in the order of their shards.

    ``hashes``: distinct words, sorted, with BEGIN; ``ids``: the word number of each token.
    Returns the shard, first and second word of each distinct pair, and each token's pair.
    """
    ends = np.cumsum(n)
    first = np.empty(len(ids), np.int64)
    first[1:] = ids[:-1]
    first[ends - n] = np.searchsorted(hashes, BEGIN)
    keys, pair = np.unique(first * len(hashes) + ids, return_inverse=True)
    u, v = keys // len(hashes), keys % len(hashes)
    with np.errstate(over="ignore"):
        spread = mix(hashes[u] * np.uint64(3) + hashes[v])
    shard = shard_of(np.where(np.isin(hashes[u], hot), spread, hashes[u]), shards)
    order = np.lexsort((v, u, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return shard[order], u[order], v[order], rank[pair]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed block of bytes."""
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    raw = sizes.tobytes() + b"".join(a.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int(np.frombuffer(packed[:8], np.int64)[0]), codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(raw[: 8 * len(kinds)], np.int64)) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip([8 * len(kinds), *ends.tolist()], ends.tolist(), kinds)]


def _halves(hashes: np.ndarray) -> list[np.ndarray]:
    """48 bits of second words: enough to tell the successors of one context apart."""
    return [hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)]


# contexts, own, counts of own contexts, successors here; successor words and pair counts
_QUESTION = [np.uint64, bool, np.uint32, np.uint32, np.uint32, np.uint16, np.uint32]
# counts and width codes of own contexts, codes of pairs, exact counts of pairs above the codes
_ANSWER = [np.int64, np.uint16, np.uint8, np.int64]


def _ask(folder: str, shards: int, hot: np.ndarray):
    """Task function: texts to a row per block and shard; the block itself is a file."""

    def run(batches):
        context = TaskContext.get()
        for k, (doc_ids, n, tokens) in enumerate(token_blocks(batches)):
            name = f"{context.partitionId():06d}-{k:06d}"
            hashes, ids = np.unique(np.append(tokens, BEGIN), return_inverse=True)
            ids = ids[:-1]
            train = np.array([not held_out(x) for x in doc_ids])
            numbers = np.array([x if x is not None else 0 for x in doc_ids], np.int64)
            missing = np.array([x is None for x in doc_ids])
            parts = [numbers, missing, train, n.astype(np.int64), hashes, ids.astype(np.uint32)]
            output = Output(f"{folder}/blocks/{name}", context.taskAttemptId())
            output.stream.write(_pack(parts))
            output.finish()
            used = np.repeat(train, n)
            counts = np.bincount(ids[used], minlength=len(hashes))
            counts[np.searchsorted(hashes, BEGIN)] = train.sum()
            shard, u, v, pair = place_pairs(hashes, ids, n, shards, hot)
            pairs = np.bincount(pair[used], minlength=len(u))
            # contexts: all words in their own shards, and those of pairs that are spread
            own = shard_of(hashes, shards)
            away = own[u] != shard
            foreign = np.unique(shard[away] * len(hashes) + u[away])
            entry_shard = np.concatenate([own, foreign // len(hashes)])
            entry_word = np.concatenate([np.arange(len(hashes)), foreign % len(hashes)])
            order = np.lexsort((entry_word, entry_shard))
            entry_shard, entry_word, mine = entry_shard[order], entry_word[order], (order < len(hashes))
            keys = entry_shard * len(hashes) + entry_word
            widths = np.bincount(np.searchsorted(keys, shard * len(hashes) + u), minlength=len(keys))
            e = np.searchsorted(entry_shard, np.arange(shards + 1))
            p = np.searchsorted(shard, np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(e)):
                a, b, c, d = e[s], e[s + 1], p[s], p[s + 1]
                rows.append((int(s), name, _pack([
                    hashes[entry_word[a:b]], mine[a:b], counts[entry_word[a:b]][mine[a:b]].astype(np.uint32),
                    widths[a:b].astype(np.uint32), *_halves(hashes[v[c:d]]), pairs[c:d].astype(np.uint32),
                ])))
            kinds = [pa.int32(), pa.string(), pa.binary()]
            names = ["shard", "block", "payload"]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.record_batch(columns, names=names)

    return run


def _tell(folder: str, hot: np.ndarray):
    """Group function: all blocks' rows of a shard to its trie, and the answers from it."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = []
        for payload in table.column("payload"):
            contexts, own, counts, widths, low, high, pairs = _unpack(payload.as_py(), _QUESTION)
            words = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
            asked.append({"contexts": contexts, "own": own, "counts": counts, "widths": widths, "words": words, "pairs": pairs})
        flat = {c: np.concatenate([x[c] for x in asked]) for c in asked[0]}
        contexts, number = np.unique(flat["contexts"], return_inverse=True)
        counts = np.bincount(number[flat["own"]], flat["counts"], len(contexts)).astype(np.int64)
        first = np.repeat(number, flat["widths"])
        seen = flat["pairs"] > 0
        # a context of its own shard stays even without training text: it is asked for
        trie = Trie.build(contexts, counts, first[seen], flat["words"][seen], flat["pairs"][seen].astype(np.float64))
        name = f"{folder}/tries/{shard:06d}"
        output = Output(name, TaskContext.get().taskAttemptId())
        trie.write(output.stream)
        output.finish()
        trie = Trie.open(open_input(name))
        rows = []
        for block, x in zip(table.column("block").to_pylist(), asked):
            at = trie.contexts.index(x["contexts"])
            mine = at[x["own"]]
            joint, over = trie.pairs(np.repeat(at, x["widths"]), x["words"])
            rows.append((shard, block, _pack([trie.counts[mine], trie.width[mine], joint, over]), 0, 0, None))
        owned = np.zeros(len(contexts), bool)
        owned[number[flat["own"]]] = True
        token = owned & (contexts != BEGIN)
        place = trie.contexts.index(hot)
        widths = trie.pointers.at(np.maximum(place, 0) + 1) - trie.pointers.at(np.maximum(place, 0))
        widths = np.where(place >= 0, widths.astype(np.int64), 0).tolist() if len(hot) else []
        rows.append((shard, None, None, int(counts[token].sum()), int((counts[token] > 0).sum()), widths))
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _TOLD.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _sum_up(folder: str, shards: int, hot: np.ndarray, hot_widths: np.ndarray, total: int, types: int, discount: float):
    """Group function: all shards' answers for a block to the scores of its texts."""

    def run(table: pa.Table) -> pa.Table:
        name = table.column("block")[0].as_py()
        told = table.sort_by("shard").to_pydict()
        with open_input(f"{folder}/blocks/{name}") as file:
            kinds = [np.int64, bool, bool, np.int64, np.uint64, np.uint32]
            numbers, missing, train, n, hashes, ids = _unpack(file.read(), kinds)
        ids = ids.astype(np.int64)
        answers = [_unpack(x, _ANSWER) for x in told["payload"]]
        own_counts, own_widths, codes, over = (np.concatenate(x) for x in zip(*answers))
        order = np.lexsort((np.arange(len(hashes)), shard_of(hashes, shards)))
        counts, widths = np.empty(len(hashes), np.int64), np.empty(len(hashes))
        counts[order], widths[order] = own_counts, value_fine(own_widths)
        known_mass = value_fine(code_fine(counts))
        if len(hot):
            place = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
            widths = np.where(hot[place] == hashes, hot_widths[place], widths)
        _, u, v, pair = place_pairs(hashes, ids, n, shards, hot)
        base = np.log10((counts + 1.0) / (total + 1.0 * (types + 1)))
        single = (known_mass + 1.0) / (total + 1.0 * (types + 1))
        joint = value_coarse(codes, discount, over)
        mass = known_mass[u]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(mass > 0, (joint + discount * widths[u] * single[v]) / mass, single[v])
        # a context met only before texts' ends has no pairs counted: its mass goes to single
        p = np.where((mass > 0) & (widths[u] == 0), single[v], p)
        logs = np.log10(p)
        starts = np.cumsum(n) - n
        columns = [
            pa.array(numbers, pa.int64(), mask=missing), pa.array(~train), pa.array(n),
            pa.array(np.add.reduceat((counts[ids] > 0).astype(np.int64), starts)),
            pa.array(np.full(len(n), total)), pa.array(np.add.reduceat(base[ids], starts)),
            pa.array(np.add.reduceat(logs[pair], starts)),
        ]
        return pa.table(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def frequent_words(texts: DataFrame, share: float = HOT_SHARE) -> tuple[np.ndarray, int]:
    """Hashes of all words that make up ``share`` of all tokens, and the texts' bytes.

    A pass over all texts. Blocks tell only words with half that share in them: a word of
    the full share has at least half of it in such blocks, so the sums find it, and at
    most ``2 / share`` words reach the driver. They only decide where pairs are kept.
    """

    def count(batches):
        for _, _, tokens in token_blocks(batches):
            words, n = np.unique(tokens, return_counts=True)
            keep = n >= share / 2 * len(tokens)
            columns = [pa.array(words[keep].view(np.int64)), pa.array(n[keep], pa.int64())]
            yield pa.record_batch(columns, names=["word", "n"])
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([len(tokens)], pa.int64())], names=["word", "n"])

    spark, folder = texts.sparkSession, shared_dir(texts.sparkSession, "lm-words")
    counted = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted.write.mode("overwrite").parquet(folder)
    counted = spark.read.schema("word long, n long").parquet(folder)
    total = counted.where("word is null").select("n").first()
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") >= share / 2 * (total.n if total else 0))).collect()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return np.sort(np.append(np.array([r.word for r in rows], np.int64).view(np.uint64), BEGIN)), size


def score_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", discount=DISCOUNT, shards: int | None = None) -> DataFrame:
    """Split, counts and scores of each document; the tries stay in the shared folder."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot, size = frequent_words(texts)
    shards = shards or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    asked = texts.mapInArrow(_ask(folder, shards, hot), _ASKED)
    told = asked.groupBy("shard").applyInArrow(_tell(folder, hot), _TOLD)
    told.write.mode("overwrite").parquet(f"{folder}/told")
    told = spark.read.schema(_TOLD).parquet(f"{folder}/told")
    stats = told.where("block is null")
    sums = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    widths = np.zeros(len(hot))
    for row in stats.select(F.posexplode("hot")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        widths[row.pos] = row.n
    answers = told.where("block is not null").select("shard", "block", "payload")
    return answers.groupBy("block").applyInArrow(_sum_up(folder, shards, hot, widths, sums.n, sums.v, discount), _OUT)
