"""Patterns and word lists whose values decide results, and the dialect bridge."""

from __future__ import annotations

import re

# Cell patterns, written in the usual Python notation.
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[\d\s()./\-]{7,25}$"
SIGNED_NUMBER = r"^[+-]?\d+(?:\.\d+)?$"
FORMULA_START = r"^[=+\-@\t\r]"

# Boolean words and default null words, compared trimmed and lower-cased.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f"]
NULL_WORDS = ["null", "n/a", "na", "none", "nan", "-"]

# The Unicode white space that str.strip and \s know about.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a class that both Java and RE2 read.
WHITESPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Text accepted as a number in range checks (hex, underscores and "nan" are not).
DECIMAL_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE_NUMBER = r"^\s*[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?\s*$"


# A pattern as escapes, character classes, heads of named groups, and single characters.
_PIECES = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P[<=]\w+[>)]|.", re.S)


def _java_class(piece: str) -> str:
    """A class in which ``[`` and ``&&`` are plain characters, as in Python."""
    head = re.match(r"\[\^?\]?", piece).group()
    body = re.sub(r"(?s)(\\.)|([\[&])", lambda m: m[1] or "\\" + m[2], piece[len(head) : -1])
    return head.replace("]", r"\]") + body + "]"


def _java_group(piece: str) -> str:
    """Java's spelling of a named group or reference, and of the end of the text.

    Java's names have letters and digits only, so each name is spelled in code points.
    """
    if piece.startswith("(?P"):
        plain = lambda c: c.isascii() and c.isalpha() and c != "Z"
        name = "g" + "".join(c if plain(c) else f"Z{ord(c)}Z" for c in piece[4:-1])
        return f"(?<{name}>" if piece[3] == "<" else rf"\k<{name}>"
    return r"\z" if piece == r"\Z" else piece


def java(pattern: str) -> str:
    """The pattern for RLIKE with Python's meaning of \\d, \\s, \\w, '.' and '$'.

    U makes the classes Unicode-aware; d makes a final newline the only line end.
    """
    out = "".join(_java_class(p) if p.startswith("[") else _java_group(p) for p in _PIECES.findall(pattern))
    return "(?Ud)" + out


def java_full(pattern: str) -> str:
    """Like :func:`java`, but the whole value must match."""
    return java(rf"\A(?:{pattern})\Z")


def sql_raw(pattern: str) -> str:
    """The pattern as a raw SQL string literal."""
    if "'" in pattern:
        raise ValueError("raw literals hold no single quote")
    return f"r'{pattern}'"
