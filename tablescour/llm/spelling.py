"""Spelling variants: words one letter apart, found by k-d trees over letter counts.

A word is a point: how often it holds each letter of the alphabet. Two words one replaced
letter apart have equal length, and at most one count is one higher and one is one lower;
a word with one letter more has one count one higher and none lower. So for each length
and each pair of lengths (L, L + 1) the near words of a word lie in few boxes of a k-d
tree, and only words in those boxes are compared letter by letter.

The upper levels of the trees are cells of a shuffle: every word is a member of one cell
and is sent as a query to the other cells within reach. A task reads a cell's members,
builds the tree's lower levels over them, and streams the queries through. Splits come
from a sample of about ``sample`` words (by hash); it decides only how words are spread.
A pair of words is found in one cell alone, and what it says about each of the two words
is summed up before it leaves the task.

Defined cases: null and empty texts have no words; a null document id counts as the empty
string in the hash; equal rows are all counted; of near words with the highest count the
first in code-point order is the form; an empty table, or one without frequent words,
gives an empty result; words may have any length; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.llm.backtracking import pieces
from tablescour.llm.words import text_bytes
from tablescour.session import shared_dir

LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF
CELL = 20_000
SAMPLE = 100_000
BUCKET = 32
_WORK = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row and lower-cased text of each maximal run of letters."""
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3  # the letters from U+00C0 to U+00FF are C3 and one byte
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds - bounds[0]] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(bounds - bounds[0], starts, "right") - 1
    kept = _LOWER[data[letter]]
    places = np.append(np.flatnonzero(first[letter]), len(kept)).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return rows, text


def _count(doc_ids: list, data: np.ndarray, bounds: np.ndarray, modulus: int, least: int):
    """(words, counts) of the rows, with the code point deleted that the hash tells."""
    rows, text = _runs(data, bounds)
    coded = text.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if not words:
        return [], []
    pair, times = np.unique(rows * len(words) + np.asarray(coded.indices, np.int64), return_counts=True)
    row, code = np.divmod(pair, len(words))
    begin = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids]
    crc = zlib.crc32
    hashes = np.array([crc(words[c], begin[r]) for r, c in zip(row.tolist(), code.tolist())], np.int64)
    hit = hashes % modulus == 0
    whole = np.bincount(code[~hit], times[~hit], len(words)).astype(np.int64)
    total: dict[str, int] = defaultdict(int)
    for i in np.flatnonzero(whole).tolist():
        total[words[i].decode()] += int(whole[i])
    for i in np.flatnonzero(hit).tolist():
        word = words[code[i]].decode()
        place = int(hashes[i]) % len(word)
        total[word[:place] + word[place + 1 :]] += int(times[i])
    found = [(w, n) for w, n in total.items() if len(w) >= least]
    return [w for w, _ in found], [n for _, n in found]


def frequent_words(
    docs: DataFrame, *, id_col="doc_id", text_col="text", modulus=97, least_letters=5, least_count=3
) -> DataFrame:
    """(word, n) of all words of at least ``least_letters`` that occur ``least_count`` times."""

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for row, part in pieces(data, bounds):
                words, counts = _count(
                    ids[row : row + len(part) - 1], data[part[0] : part[-1]], part, modulus, least_letters
                )
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words one after another, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    numbers = np.where(codes < 0xC0, codes - 0x61, codes - 0xC0 + 26).astype(np.uint8)
    return numbers, np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    numbers, lengths = letters(words)
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * LETTERS + numbers, minlength=len(words) * LETTERS)
    return counts.reshape(len(words), LETTERS).astype(np.int32)


class Tree:
    """A k-d tree over letter counts with at most ``leaves`` leaves.

    ``split[node]`` is (letter, highest count of the left side) and ``kids[node]`` the
    two children; a leaf has neither and a number in ``leaf``.
    """

    def __init__(self, points: np.ndarray, leaves: int, least: int = 1):
        self.split: list[tuple[int, int] | None] = []
        self.kids: list[tuple[int, int] | None] = []
        self.leaf: list[int] = []
        self.members: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaves, least)

    def _grow(self, points, some, leaves, least) -> int:
        node = len(self.split)
        self.split.append(None)
        self.kids.append(None)
        self.leaf.append(-1)
        best = self._best(points[some]) if leaves > 1 and len(some) >= 2 * least else None
        if best is None:
            self.leaf[node] = len(self.members)
            self.members.append(some)
            return node
        letter, count = best
        low = points[some, letter] <= count
        share = max(1, min(leaves - 1, round(leaves * low.mean())))
        self.split[node] = best
        left = self._grow(points, some[low], share, least)
        self.kids[node] = (left, self._grow(points, some[~low], leaves - share, least))
        return node

    @staticmethod
    def _best(points) -> tuple[int, int] | None:
        """The most even split between two counts of a letter."""
        n, best, gap = len(points), None, len(points)
        for count in range(min(int(points.max(initial=0)), 8) + 1):
            low = (points <= count).sum(0)
            off = np.abs(2 * low - n)
            off[(low == 0) | (low == n)] = n
            letter = int(np.argmin(off))
            if off[letter] < gap:
                best, gap = (letter, count), int(off[letter])
        if best is None:  # all counts that differ are high ones
            differ = np.flatnonzero(points.max(0, initial=0) > points.min(0, initial=0)) if n else []
            if len(differ):
                best = (int(differ[0]), int((points[:, differ[0]].max() + points[:, differ[0]].min()) // 2))
        return best

    def own(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, some = stack.pop()
            if self.split[node] is None:
                out[some] = self.leaf[node]
            elif len(some):
                letter, count = self.split[node]
                low = points[some, letter] <= count
                stack += [(self.kids[node][0], some[low]), (self.kids[node][1], some[~low])]
        return out

    def reach(self, points: np.ndarray, fewer: int):
        """(leaf, points) of the leaves that may hold a point with at most one count one
        higher and ``fewer`` counts (0 or 1) one lower."""
        n = len(points)
        stack = [(0, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {}, {})]
        while stack:
            node, some, up, down, floor, ceiling = stack.pop()
            if not len(some):
                continue
            if self.split[node] is None:
                yield self.leaf[node], some
                continue
            letter, count = self.split[node]
            have = points[some, letter]
            # below ``count``: what must go; what earlier splits of the letter asked is in it
            paid = np.maximum(have - ceiling[letter], 0) if letter in ceiling else 0
            less = down + np.maximum(have - count, 0) - paid
            fits = less <= fewer
            stack.append((self.kids[node][0], some[fits], up[fits], less[fits], floor, {**ceiling, letter: count}))
            paid = np.maximum(floor[letter] - have, 0) if letter in floor else 0
            more = up + np.maximum(count + 1 - have, 0) - paid
            fits = more <= 1
            stack.append((self.kids[node][1], some[fits], more[fits], down[fits], {**floor, letter: count + 1}, ceiling))


class Cell:
    """Members of one cell, all of one length, with the lower levels of the tree."""

    def __init__(self, words: list[str], counts: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = np.array(words, object)[order]
        self.n = np.array(counts, np.int64)[order]
        self.points = letter_counts(list(self.words))
        self.length = len(self.words[0])
        self.rows = letters(list(self.words))[0].reshape(len(words), self.length)
        self.tree = Tree(self.points, max(1, -(-len(words) // BUCKET)))

    def _near(self, rows: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, member) that one edit turns into each other."""
        mine, length, found = self.rows[members], rows.shape[1], []
        step = max(1, _WORK // max(1, mine.size))
        for a in range(0, len(rows), step):
            part = rows[a : a + step, None, :]
            if length == self.length:
                q, m = np.nonzero((part != mine[None]).sum(2, dtype=np.int32) == 1)
            else:  # the member has a letter more: prefix and suffix in common cover the row
                differ = part != mine[None, :, :-1]
                prefix = np.where(differ.any(2), differ.argmax(2), length)
                differ = part != mine[None, :, 1:]
                rest = np.where(differ.any(2), length - differ[:, :, ::-1].argmax(2), 0)
                q, m = np.nonzero(rest <= prefix)
            found.append((q + a, members[m]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def pairs(self, words: list[str], itself: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) of all near pairs; of the cell with itself, each pair once."""
        points = self.points if itself else letter_counts(words)
        length = len(words[0])
        rows = self.rows if itself else letters(words)[0].reshape(len(words), length)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for leaf, some in self.tree.reach(points, 1 if length == self.length else 0):
            q, m = self._near(rows[some], self.tree.members[leaf])
            found.append((some[q], m))
        q, m = (np.concatenate(x) for x in zip(*found))
        return (q[q < m], m[q < m]) if itself else (q, m)


def _said(words, of, other_words, other_n, other):
    """For each word in ``of``: how many others it has, and of those with the highest count
    the first; the others are numbered in code-point order."""
    order = np.lexsort((other, -other_n[other], of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(of)))
    return pa.record_batch(
        [
            pa.array(words[of[first]].tolist(), pa.string()), pa.array(other_words[other[first]].tolist(), pa.string()),
            pa.array(other_n[other[first]]), pa.array(times, pa.int64()),
        ],
        names=["word", "near", "near_n", "n_near"],
    )


def _search(batches):
    """Rows come by cell, members first; queries of a cell stream past its members."""
    at, cell, words, counts = None, None, [], []

    def close():
        """The members are complete: compare them with each other."""
        nonlocal cell
        if cell is None and words:
            cell = Cell(words, counts)
            q, m = cell.pairs(list(cell.words), itself=True)
            yield _said(cell.words, np.append(q, m), cell.words, cell.n, np.append(m, q))

    for batch in batches:
        length, leaf, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "leaf", "role"))
        texts, ns = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        key = np.stack([length, leaf, role, sizes], 1)
        cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            here = (int(length[a]), int(leaf[a]))
            if here != at:
                yield from close()
                at, cell, words, counts = here, None, [], []
            if role[a] == 0:
                words += texts[a:b]
                counts += ns[a:b].tolist()
                continue
            yield from close()
            if cell is not None:
                order = sorted(range(a, b), key=texts.__getitem__)
                some, some_n = np.array(texts, object)[order], ns[order]
                q, m = cell.pairs(list(some))
                yield _said(some, q, cell.words, cell.n, m)
                yield _said(cell.words, m, some, some_n, q)
    yield from close()


def _routed(trees: dict[int, Tree]):
    """Each word as a member of its cell and as a query to other cells within reach."""

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            points, sizes = letter_counts(words), np.fromiter(map(len, words), np.int64, len(words))
            rows, lengths, leaves, roles = [], [], [], []

            def send(some, length, leaf, role):
                rows.append(some)
                lengths.append(np.full(len(some), length))
                leaves.append(np.broadcast_to(leaf, len(some)))
                roles.append(np.full(len(some), role))

            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                if size in trees:
                    own = trees[size].own(points[some])
                    send(some, size, own, 0)
                    for leaf, near in trees[size].reach(points[some], 1):
                        send(some[near[own[near] < leaf]], size, leaf, 1)
                else:
                    send(some, size, 0, 0)
                if size + 1 in trees:
                    for leaf, near in trees[size + 1].reach(points[some], 0):
                        send(some[near], size + 1, leaf, 1)
                else:
                    send(some, size + 1, 0, 1)
            rows = np.concatenate(rows)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(lengths), pa.int32()), pa.array(np.concatenate(leaves), pa.int32()),
                    pa.array(np.concatenate(roles), pa.int32()), batch.column("word").take(pa.array(rows)),
                    batch.column("n").take(pa.array(rows)),
                ],
                names=["length", "leaf", "role", "word", "n"],
            )

    return run


def _trees(vocabulary: DataFrame, cell: int, sample: int) -> dict[int, Tree]:
    """Trees of the lengths with more than ``cell`` words; at most words / cell lengths."""
    length = F.char_length("word")
    many = vocabulary.groupBy(length.alias("length")).agg(F.count("*").alias("n")).where(F.col("n") > cell)
    sizes = {r.length: r.n for r in many.collect()}
    if not sizes:
        return {}
    # By a threshold on the hash, so that tasks send what is in the sample and no more.
    one_in = -(-sum(sizes.values()) // sample)
    some = vocabulary.where(length.isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0))
    chosen = [r.word for r in some.select("word").collect()]
    by_length = defaultdict(list)
    for word in chosen:
        by_length[len(word)].append(word)
    return {
        size: Tree(letter_counts(words), -(-sizes[size] // cell), least=20) for size, words in by_length.items()
    }


def near_words(vocabulary: DataFrame, *, cell=CELL, sample=SAMPLE) -> DataFrame:
    """(word, near, near_n, n_near): parts of each word's near words, to be summed up.

    ``vocabulary`` (word, n) holds lower-case words of the alphabet, each once.
    """
    trees = _trees(vocabulary, cell, sample)
    cells = vocabulary.select("word", "n").mapInArrow(
        _routed(trees), "length int, leaf int, role int, word string, n long"
    )
    key = ["length", "leaf"]
    # Few bytes but much work: with a given number, small partitions are not merged.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, *key).sortWithinPartitions(*key, "role", F.char_length("word"))
    return cells.mapInArrow(_search, "word string, near string, near_n long, n_near long")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of each word that has a form: the last word that forms lead to.

    Each round doubles the steps taken. A form is at least twice as frequent as its word,
    so rounds grow with the logarithm of the logarithm of the highest count.
    """
    spark, turn = forms.sparkSession, 0
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        now.write.mode("overwrite").parquet(f"{folder}/roots{turn}")
        now = spark.read.schema(now.schema).parquet(f"{folder}/roots{turn}")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        turn += 1
        after = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        now = now.join(after, "root", "left").select(
            "word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")
        )


def spelling_variants(docs: DataFrame, *, factor=2, cell=CELL, sample=SAMPLE, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word; see :func:`frequent_words`
    for ``options``. A form must occur at least ``factor`` times as often as the word."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "spelling")

    def stored(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    vocabulary = stored(frequent_words(docs, **options), "vocabulary")
    near = near_words(vocabulary, cell=cell, sample=sample).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    enough = -F.col("best.m") >= factor * F.col("n")
    linked = stored(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"),
    ), "linked")
    ends = roots(linked.where("form is not null"), folder)
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
