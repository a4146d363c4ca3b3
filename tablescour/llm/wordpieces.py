"""Word-piece counts by a longest-match automaton in one pass over the letters.

The vocabulary's trie has a failure link for each node: what is left to match after the
longest pieces of the node's string are taken, with the number of pieces taken on the
way. A word's count is then a sum along its walk; no piece is built. The words of a batch
that differ are walked together, one byte of each at a time.

A word is a run of bytes other than ASCII white space; it is matched with ``before`` (a
space) put in front. Greedy matching takes the longest piece at each place.

Defined cases: null and empty texts have no words and no pieces; a word that reaches a
byte no piece begins with counts as one unknown piece; equal rows are all returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.llm.words import WordHasher, text_bytes

SLICE = 1 << 20
_OUT = "doc_id long, n_bytes long, n_words long, n_pieces long, n_unknown long"


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, as bytes."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in keep}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    with open(path) as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens", ()) if t["special"]}
    return [bytes(byte[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special]


class Automaton:
    """Arrays over trie nodes: ``edge`` (sorted node * 256 + byte) and ``child``; ``fail``
    and ``popped`` for a byte without an edge; ``tail``, the pieces left at a word's end.
    A count below 0 stands for a word that cannot be matched."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    whole.append(False)
                node = children[node][b]
            whole[node] = node > 0
        n = len(children)
        fail, popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        tail = np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, node in children[parent].items():
                queue.append(node)
                if whole[node]:
                    fail[node], popped[node] = 0, 1
                else:
                    at, count = fail[parent], popped[parent]
                    while at >= 0 and b not in children[at]:
                        count += popped[at]
                        at = fail[at]
                    if at >= 0:
                        fail[node], popped[node] = children[at][b], count
                if fail[node] < 0:
                    tail[node] = -1
                else:
                    rest = tail[fail[node]]
                    tail[node] = popped[node] + rest if rest >= 0 else -1
        edges = [(node << 8 | b, c) for node, kids in enumerate(children) for b, c in kids.items()]
        edges.sort()
        self.edge = np.array([e for e, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int32)
        self.fail, self.popped, self.tail = fail, popped, tail

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node by its byte, or -1."""
        want = nodes.astype(np.int64) << 8 | byte
        place = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
        return np.where(self.edge[place] == want, self.child[place], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: int) -> np.ndarray:
        """Pieces of each word; -1 where a word cannot be matched."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        node = np.zeros(len(starts), np.int32)
        count = np.zeros(len(starts), np.int32)
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
        for i in range(-1, longest):
            m = len(starts) if i < 0 else int(alive[i])
            todo = np.flatnonzero(node[:m] >= 0)
            byte = np.full(len(todo), before, np.uint8) if i < 0 else data[starts[todo] + i]
            while len(todo):
                here = node[todo]
                there = self.step(here, byte)
                stuck = there < 0
                node[todo[~stuck]] = there[~stuck]
                todo, byte, here = todo[stuck], byte[stuck], here[stuck]
                count[todo] += self.popped[here]
                node[todo] = self.fail[here]
                on = node[todo] >= 0
                todo, byte = todo[on], byte[on]
        rest = np.where(node >= 0, self.tail[node], -1)
        out = np.empty(len(starts), np.int32)
        out[order] = np.where(rest >= 0, count + rest, -1)
        return out


class Counter:
    """Counts of whole batches; words already met are not walked again."""

    KEEP = 1_000_000

    def __init__(self, automaton: Automaton, before: int):
        self.automaton, self.before = automaton, before
        self.hasher = WordHasher(lower=False)
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def rows(self, data: np.ndarray, bounds: np.ndarray):
        """Words, pieces and unknown words of each row."""
        starts, ends, hashes, rows = self.hasher.words(data, bounds)
        if len(self.known) > self.KEEP:
            self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        new, at = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.known, new)
        fresh = (np.append(self.known, np.uint64(0))[place] != new) | (place == len(self.known))
        new, at, place = new[fresh], at[fresh], place[fresh]
        found = self.automaton.counts(data, starts[at], ends[at] - starts[at], self.before)
        self.known = np.insert(self.known, place, new)
        self.count = np.insert(self.count, place, found)
        counts = self.count[np.searchsorted(self.known, hashes)].astype(np.int64)
        pieces = np.concatenate([[0], np.cumsum(np.where(counts < 0, 1, counts))])
        unknown = np.concatenate([[0], np.cumsum(counts < 0)])
        return np.diff(rows), np.diff(pieces[rows]), np.diff(unknown[rows])


def piece_counts(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", before=0x20) -> DataFrame:
    """Bytes, words, pieces and unknown words of each document; each task reads its rows
    once, in slices, and nothing is shuffled."""

    def count(batches):
        counter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            counter = counter or Counter(Automaton(byte_pieces(vocabulary)), before)
            data, bounds = text_bytes(batch.column(1))
            parts, a = [], 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
                parts.append(counter.rows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                a = b
            sums = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)]
            columns = [batch.column(0), pa.array(np.diff(bounds), pa.int64()), *sums]
            yield pa.record_batch(columns, names=["doc_id", "n_bytes", "n_words", "n_pieces", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, _OUT)
