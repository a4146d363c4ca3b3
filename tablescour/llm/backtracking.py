"""Exact byte-pair encoding by backtracking over longest token matches, and decoding.

A word's merges are not replayed. Two facts replace them: a sequence of tokens is the
encoding of a word exactly if each token encodes to itself and each two neighbours are
*compatible*, that is, no merge ever crosses the place where they meet; and such a
sequence is unique. An Aho-Corasick automaton finds the longest token that ends at each
place. The encoder walks from the word's end to its start, takes the longest token that
is compatible with its right neighbour, falls back to the token's longest suffix that is
a token, and takes its last step back where none is left. A place given up once is never
entered again, because what lies right of it is the same each time, so the work is linear
in the word. Compatibility is one table over token pairs, filled on first use.

Decoding looks up each id's bytes in one byte string by an offset table.

Defined cases: a null or empty text, and one of white space alone, has no ids and decodes
to the empty string; strings of added tokens are those tokens wherever they stand, as the
library does by default; equal rows are all returned; a null id stays null; an empty table
gives an empty result; other columns are not read. Texts of any length are worked on in
pieces that end at ASCII white space, which no piece of a text crosses.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tablescour.llm.words import ragged, text_bytes
from tablescour.llm.workers import kept

SLICE = 1 << 20
NEVER = 1 << 62
_END = 0x400  # added to the code point of a word's last symbol


class MergeTable:
    """Tokens of a merge list as strings of symbols, and which of them may be neighbours.

    ``left`` and ``right`` are a token's two parts (-1 for a symbol) and ``rank`` its place
    in the merge list. Every token must be made by one merge, later than its parts.
    """

    KEEP_PAIRS = 2_000_000

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        n = max(vocab.values()) + 1
        self.left, self.right = [-1] * n, [-1] * n
        self.rank, self.text = [-1] * n, [""] * n
        self.merge: dict[tuple[int, int], int] = {}
        made = set()
        for place, (a, b) in enumerate(merges):
            x, y = vocab[a], vocab[b]
            token = vocab[a + b]
            if token in made:
                raise ValueError(f"two merges make the token {a + b!r}")
            made.add(token)
            self.left[token], self.right[token], self.rank[token] = x, y, place
            self.merge[x, y] = place
        for string, token in vocab.items():
            if token not in made:
                last = len(suffix) if suffix and string.endswith(suffix) and string != suffix else 0
                symbol = string[: len(string) - last]
                if len(symbol) == 1:
                    self.text[token] = chr(ord(symbol) + _END) if last else symbol
        for a, b in merges:
            token, x, y = vocab[a + b], vocab[a], vocab[b]
            if max(self.rank[x], self.rank[y]) >= self.rank[token] or not (self.text[x] and self.text[y]):
                raise ValueError(f"the token {a + b!r} is made before its parts")
            self.text[token] = self.text[x] + self.text[y]
        self.size = [len(t) for t in self.text]
        self._edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}  # left token * number of tokens + right token

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one edge of ``token`` while it is built, first to last,
        each with the rank of the merge that consumes it."""
        known = self._edges[side].get(token)
        if known is None:
            parts, known, ends = (self.left, self.right)[side], [], NEVER
            at = token
            while at >= 0:
                known.append((at, ends))
                ends, at = self.rank[at], parts[at]
            known.reverse()
            self._edges[side][token] = known
        return known

    def meet(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of rank below ``before`` crosses from ``a`` into ``b``.

        Equal merges apply from left to right: one that consumes the left token comes
        first, one that consumes the right token comes after.
        """
        xs, ys, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = self.merge.get((x, y), NEVER)
            if rank < before and rank < x_ends and rank <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` may stand left of ``b``; the answer is kept in ``pairs``."""
        if len(self.pairs) >= self.KEEP_PAIRS:
            self.pairs.clear()
        got = self.pairs[a * len(self.text) + b] = self.meet(a, b)
        return got

    def sound(self) -> list[int]:
        """The tokens that encode to themselves; no other token is ever in an encoding."""
        good = [bool(t) for t in self.text]
        for (x, y), place in sorted(self.merge.items(), key=lambda item: item[1]):
            token = self._made(x, y)
            good[token] = good[x] and good[y] and self.meet(x, y, before=place)
        return [t for t, ok in enumerate(good) if ok]

    def _made(self, x: int, y: int) -> int:
        if not hasattr(self, "_by_parts"):
            self._by_parts = {(a, b): t for t, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}
        return self._by_parts[x, y]


class BacktrackingEncoder:
    """Ids of one word at a time."""

    def __init__(self, table: MergeTable):
        self.table = table
        sound = table.sound()
        by_text = {table.text[t]: t for t in sound}
        self.shorter = [-1] * len(table.text)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in sound:
            text = table.text[token]
            self.automaton.add_word(text, token)
            for start in range(1, len(text)):
                if text[start:] in by_text:
                    self.shorter[token] = by_text[text[start:]]
                    break
        self.automaton.make_automaton()

    def symbols(self, word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _END)

    def encode(self, word: str) -> list[int]:
        """Ids of a word whose every symbol is in the vocabulary."""
        size, shorter = self.table.size, self.shorter
        pairs, compatible, n = self.table.pairs, self.table.compatible, len(self.table.text)
        at = len(word)
        longest = [-1] * (at + 1)
        for end, token in self.automaton.iter(self.symbols(word)):
            if longest[end + 1] < 0:  # the automaton tells the longest first
                longest[end + 1] = token
        token, after, taken, given_up = longest[at], -1, [], set()
        while at:
            if token < 0:
                given_up.add(at)
                if not taken:
                    raise ValueError(f"no encoding of {word!r}")
                gone = taken.pop()
                after = taken[-1] if taken else -1
                at += size[gone]
                token = shorter[gone]
                continue
            if after >= 0:
                fits = pairs.get(token * n + after)
                if fits is None:
                    fits = compatible(token, after)
            else:
                fits = True
            if fits and at - size[token] not in given_up:
                taken.append(token)
                at -= size[token]
                after, token = token, longest[at]
            else:
                token = shorter[token]
        taken.reverse()
        return taken


# Rules whose effect on plain Latin text is written out in _PLAIN and lower().
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Codec:
    """A vocabulary file's encoder and decoder for whole batches of texts.

    Texts are cut at ASCII white space; each distinct chunk is normalised and split into
    words by the file's own rules, and each distinct word is encoded, once.
    """

    KEEP = 500_000

    def __init__(self, path: str):
        with open(path) as file:
            spec = json.load(file)
        model, added = spec["model"], spec.get("added_tokens", ())
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("the vocabulary is not plain byte-pair encoding")
        if spec.get("decoder") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("the vocabulary has a decoder or added tokens that take in their surroundings")
        if any(c.isspace() for t in added for c in t["content"]):
            raise ValueError("an added token holds white space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.encoder = BacktrackingEncoder(MergeTable(model["vocab"], merges, model.get("end_of_word_suffix") or ""))
        rules = Tokenizer.from_file(path)
        self.normalizer, self.splitter = rules.normalizer, rules.pre_tokenizer
        self.plain_rules = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLITTER
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        strings = dict(model["vocab"]) | self.added
        table = [b""] * (max(strings.values()) + 1)
        for string, token in strings.items():
            table[token] = string.encode() + b" "
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.place = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}  # by the word's byte characters
        self.plain: dict[str, list[int]] = {}  # by the word itself
        self.chunks: dict[str, int] = {}
        self.first, self.count, self.ids = array("q"), array("q"), array("I")

    def chunk(self, text: str) -> list[int]:
        """Ids of a text without ASCII white space."""
        if self.special is not None and self.special.search(text):
            ids = []
            for i, part in enumerate(self.special.split(text)):
                ids += [self.added[part]] if i % 2 else self.chunk(part)
            return ids
        ids = []
        if self.plain_rules and _LATIN.fullmatch(text):
            for word in _PLAIN.findall(text.lower()):
                got = self.plain.get(word)
                if got is None:
                    letters = word if word.isascii() else self.letters.pre_tokenize_str(word)[0][0]
                    got = self.encoder.encode(letters)
                    if len(word) <= 64:
                        self.plain[word] = got
                ids += got
            return ids
        for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
            got = self.words.get(word)
            if got is None:
                got = self.encoder.encode(word) if word else []
                if len(word) <= 64:
                    self.words[word] = got
            ids += got
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        parts = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(parts.offsets, np.int64)
        flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        if len(self.chunks) > self.KEEP or len(self.words) + len(self.plain) > self.KEEP or len(self.ids) > 8 * self.KEEP:
            self._forget()
        where = []
        for chunk in flat.dictionary.to_pylist():
            place = self.chunks.get(chunk)
            if place is None:
                place = self.chunks[chunk] = len(self.first)
                ids = self.chunk(chunk)
                self.first.append(len(self.ids))
                self.count.append(len(ids))
                self.ids.extend(ids)
            where.append(place)
        where = np.array(where, np.int64)[np.asarray(flat.indices)] if where else np.zeros(0, np.int64)
        count = np.array(self.count, np.int64)[where]
        ids = np.array(self.ids, np.uint32)[ragged(np.array(self.first, np.int64)[where], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, each followed by a space."""
        start = self.place[ids]
        return self.blob[ragged(start, self.place[ids.astype(np.int64) + 1] - start)]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def pieces(data: np.ndarray, bounds: np.ndarray):
    """(first row, row bounds) of runs of rows of about ``SLICE`` bytes; a longer row comes
    in several pieces that end at ASCII white space, if it has any there."""
    row, n = 0, len(bounds) - 1
    while row < n:
        after = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE, "right")) - 1)
        if bounds[row + 1] - bounds[row] <= SLICE:
            yield row, bounds[row : after + 1]
            row = after
            continue
        a, end = int(bounds[row]), int(bounds[row + 1])
        while a < end:
            b = min(a + SLICE, end)
            while b < end:
                stop = np.flatnonzero(_BLANK[data[b : b + SLICE]])
                b = b + int(stop[0]) if len(stop) else min(b + SLICE, end)
                if len(stop):
                    break
            yield row, np.array([a, b])
            a = b
        row += 1


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    part = np.ascontiguousarray(data[bounds[0] : bounds[-1]])
    return pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(part)
    )


def _batch(names, doc_ids, counts, ids, decoded):
    """One output batch; ``ids`` and ``decoded`` are (bytes, bounds)."""
    def column(kind, data, bounds):
        return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])

    parts = [doc_ids, pa.array(counts, pa.int64()), column(pa.large_binary(), *ids).cast(pa.binary())]
    if decoded is not None:
        parts.append(column(pa.large_string(), *decoded).cast(pa.string()))
    return pa.record_batch(parts, names=names)


def encode(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", decoded=True) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document; ``ids`` holds unsigned 32-bit integers,
    little-endian. With ``decoded`` also the text that the ids decode to.

    One pass without a shuffle; a worker keeps its automaton and tables between tasks.
    """
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codec = kept(("codec", vocabulary), lambda: Codec(vocabulary))
            data, bounds = text_bytes(batch.column(1))
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for row, part in pieces(data, bounds):
                ids, counts = codec.encode(_strings(data, part))
                text = codec.decode(ids) if decoded else np.zeros(0, np.uint8)
                if part[0] != bounds[row] or part[-1] < bounds[row + 1]:  # a piece of one long row
                    held.append((ids, text))
                    if part[-1] < bounds[row + 1]:
                        continue
                    ids, text = (np.concatenate(x) for x in zip(*held))
                    held, counts = [], np.array([len(ids)])
                ends = np.concatenate([[0], np.cumsum(counts)])
                spans = None
                if decoded:
                    size = np.diff(codec.place)[ids]
                    reach = np.concatenate([[0], np.cumsum(size)])[ends]
                    last = reach[1:][np.diff(reach) > 0] - 1  # the space after a row's last id
                    text = np.delete(text, last)
                    gone = np.concatenate([[0], np.cumsum(np.diff(reach) > 0)])
                    spans = (text, reach - gone)
                ids = np.ascontiguousarray(ids, "<u4")
                rows = batch.column(0).slice(row, len(counts))
                yield _batch(names, rows, counts, (ids.view(np.uint8), 4 * ends), spans)

    schema = "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, text) of encoded documents; null ids decode to the empty string."""

    def run(batches):
        for batch in batches:
            codec = kept(("codec", vocabulary), lambda: Codec(vocabulary))
            texts = [
                codec.decode(np.frombuffer(ids.as_py() or b"", "<u4")).tobytes()[:-1].decode()
                for ids in batch.column(1)
            ]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
