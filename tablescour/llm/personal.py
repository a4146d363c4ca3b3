"""Personal data by pattern, also where it is disguised, with places in the source text.

Base spans come from four patterns on the text itself. Then a transducer rewrites the
text: homoglyphs and full-width characters become ASCII, words for digits in a row become
digits, and "at" and "dot" disguises become ``@`` and ``.``; each written character keeps
the source span it came from. The same patterns run on the rewritten text, and a match is
mapped back to the source characters from its first to its last. A span is added unless it
lies in a base span of its kind: one that reaches further than a base span shows the rest
of a half disguised identifier.

Signs in brackets, or spoken or set off by blanks: "at" before a domain that is spoken too
or has an ending of ``ENDINGS``, where no word of ``BEFORE_AT`` comes before it; "dot" and
its German, French and Spanish words in brackets, after an "at", or between digits. Digit
words count four in a row, or alone beside a spoken dot between numbers.

Kinds and rules: ``email``; ``ip``, parts at most 255; ``card``, 14 to 19 digits that
pass Luhn; ``phone``, ``+`` and 10 to 15 digits. Matches are leftmost, do not overlap
within a kind, and a match that fails its rule is dropped without another try.

Defined cases: a null or empty text has no spans; equal rows are all returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_OUT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, n_added long"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits begins: each later start in it would match as well
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like ASCII letters (Greek and Cyrillic).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "Ѕ": "S", "І": "I", "Ј": "J", "ԁ": "d", "һ": "h", "ո": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ",
    " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}
# Words for digits in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate((
        "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres",
        "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete",
        "eight acht huit ocho", "nine neun neuf nueve",
    ))
    for w in words.split()
}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
# Endings of domains after a spoken "at", and words before an "at" of place.
ENDINGS = "com org net edu gov info biz io dev app de at ch fr es it nl uk us eu co ca au example test".split()
BEFORE_AT = frozenset(
    "a an and are arrive arrived available be call contact email found here held him her hosted is it lives look mail me "
    "meet met not now online or read reach see seen shop site the them there us visit was we were work works you".split()
)
_DOT = "dot|punkt|point|punto"
_BRACKETED = re.compile(rf"[\[({{<][ \t]*(?:(at|a|@)|{_DOT}|\.)[ \t]*[\])}}>]", re.I)
_SPOKEN = re.compile(r"(?<=[ \t])(?:(at|@)|dot)(?=[ \t])", re.I)
_ENDING = rf"(?:{'|'.join(ENDINGS)})(?![A-Za-z0-9-]|\.[A-Za-z0-9])"
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]+(?:[ \t]+dot[ \t]|[ \t]*[\[({{<][ \t]*(?:{_DOT}|\.)[ \t]*[\])}}>])", re.I)
_WRITTEN = re.compile(rf"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.{_ENDING}", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT_AFTER = re.compile(
    rf"[ \t]+(?:{_DOT}|\.(?=[ \t]+(?:[A-Za-z0-9-]+[ \t]+\.[ \t]+){{,4}}{_ENDING}))[ \t]+(?=[A-Za-z0-9])", re.I
)
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NUMBER = re.compile(
    rf"(?<![^\W\d_])(?:plus[ \t]+)?(?:{_DIGIT})(?:[ \t-]+(?:{_DIGIT}|[0-9]+)(?![^\W\d_])){{3,}}", re.I
)
_QUAD = re.compile(
    rf"(?<![^\W_])(?:{_DIGIT}|[0-9]+)(?:[ \t]+(?:{_DOT})[ \t]+(?:{_DIGIT}|[0-9]+)){{3}}(?![^\W_])", re.I
)
_QUAD_PART = re.compile(rf"([ \t]+(?:{_DOT})[ \t]+)|({_DIGIT})|([0-9]+)", re.I)
_PART = re.compile(rf"(plus)|({_DIGIT})|([0-9]+)", re.I)


def _odd_characters() -> dict[int, str]:
    """Code points that are rewritten alone: look-alikes and compatibility forms of ASCII."""
    table = {ord(c): x for c, x in LOOKALIKES.items()}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and " " < plain < "\x7f":
            table.setdefault(code, plain)
    return table


ODD = _odd_characters()
_ODD_SET = frozenset(map(chr, ODD))
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(ODD)))) + "]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Found from each ``@``: the run before it, no further left than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        rest = _DOMAIN.match(text, at) if start < at else None
        if rest:
            yield start, rest.end()
        done = rest.end() if rest else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the patterns, kinds by their place in KINDS."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewriter:
    """The transducer's output: runs of text, each from a source span."""

    def __init__(self, text: str):
        self.text, self.parts, self.size = text, [], 0
        self.at: list[tuple[int, int, int, bool]] = []  # (place written, source start, source end, copied)

    def put(self, written: str, start: int, end: int) -> None:
        if written:
            self.at.append((self.size, start, end, False))
            self.parts.append(written)
            self.size += len(written)

    def copy(self, start: int, end: int) -> None:
        if end > start:
            self.at.append((self.size, start, end, True))
            self.parts.append(self.text[start:end])
            self.size += end - start

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source span of the written span from ``start`` to ``end``."""
        first, last = (self.at[bisect_left(self.at, (i + 1,)) - 1] for i in (start, end - 1))
        a = first[1] + (start - first[0] if first[3] else 0)
        b = last[1] + end - last[0] if last[3] else last[2]
        return a, b


def _plain(text: str) -> Rewriter | None:
    """First pass: look-alikes, one character for one."""
    if text.isascii() or _ODD_SET.isdisjoint(text):
        return None
    out, done = Rewriter(text), 0
    for m in _ODD.finditer(text):
        out.copy(done, m.start())
        for i, c in enumerate(m[0], m.start()):
            out.put(ODD[ord(c)], i, i + 1)
        done = m.end()
    out.copy(done, len(text))
    return out


def _signs(text: str, low: str):
    """(start, end, sign) of disguised ``@`` and ``.``, with the blanks around them."""
    found, seen = [], set()
    if any(c in text for c in "[({<"):
        found += [(m, True) for m in _BRACKETED.finditer(text)]
    if any(x in low for x in (" dot", "\tdot", " at ", "\tat", "at\t", " @", "\t@")):
        found += [(m, False) for m in _SPOKEN.finditer(text)]
    for m, bracketed in found:
        a, b = m.span()
        while a and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        if not (a and b < len(text) and text[a - 1].isalnum() and text[b].isalnum()):
            continue
        if not m[1]:
            yield a, b, "."
            continue
        label = _LABEL.match(text, b)
        dot = label and _DOT_AFTER.match(text, label.end())
        strong = m[1] == "@" or bracketed and m[1].lower() == "at"
        if strong or _AFTER_AT.match(text, b):
            good = bracketed or dot or m[1] != "@" or _WRITTEN.match(text, b)
        else:
            before = _WORD_BEFORE.search(text, max(0, a - 64), a)
            good = before and before[0].lower() not in BEFORE_AT and _WRITTEN.match(text, b)
        if good:
            yield a, b, "@"
        while good and dot and dot.end() not in seen:  # the dots of the domain after it, each once
            seen.add(dot.end())
            yield *dot.span(), "."
            dot = _DOT_AFTER.match(text, _LABEL.match(text, dot.end()).end())


def _quads(text: str, low: str):
    """Four numbers with spoken dots: (start, end, what is written) of their words."""
    if not any(f" {w}" in low or f"\t{w}" in low for w in _DOT.split("|")):
        return
    for m in _QUAD.finditer(text):
        for p in _QUAD_PART.finditer(text, *m.span()):
            yield *p.span(), "." if p[1] else DIGIT_WORDS[p[2].lower()] if p[2] else p[3]


def _numbers(text: str, low: str):
    """(start, end) of four digit words or more in a row."""
    words = low.replace("-", " ").split()
    if DIGIT_WORDS.keys().isdisjoint(words):
        return []
    flags = "".join("1" if w in DIGIT_WORDS or w[:1].isdigit() else "0" for w in words)
    return [m.span() for m in _NUMBER.finditer(text)] if "111" in flags else []


def _spoken(text: str) -> Rewriter | None:
    """Second pass: digit words and disguised signs."""
    low = text.lower()
    found = sorted({*_signs(text, low), *_quads(text, low), *((a, b, "") for a, b in _numbers(text, low))})
    if not found:
        return None
    out, done = Rewriter(text), 0
    for a, b, sign in found:
        if a < done:
            continue
        out.copy(done, a)
        if sign:
            out.put(sign, a, b)
        else:
            for p in _PART.finditer(text, a, b):
                out.put("+" if p[1] else DIGIT_WORDS[p[2].lower()] if p[2] else p[3], *p.span())
        done = b
    out.copy(done, len(text))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source places."""
    passes, now = [], text
    if one := _plain(text):
        passes.append(one)
        now = "".join(one.parts)
    if two := _spoken(now):
        passes.append(two)
        now = "".join(two.parts)
    if not passes:
        return []
    taken = [sorted((a, b) for a, k, b in base if k == kind) for kind in range(len(KINDS))]
    found = []
    for start, kind, end in base_spans(now):
        for step in reversed(passes):
            start, end = step.source(start, end)
        spans = taken[kind]
        i = bisect_left(spans, (start + 1,))
        if not (i and spans[i - 1][1] >= end):
            found.append((start, kind, end))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document; nothing is
    shuffled, and a text is scanned a fixed number of times."""

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(sorted(base + added)), len(added)))
            names = [c.split()[0] for c in _OUT.split(", ")]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, _OUT)
