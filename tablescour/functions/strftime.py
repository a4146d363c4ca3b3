"""strftime formats as column expressions over a TIMESTAMP_NTZ column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescour.errors import CleanError

# English names as the C locale prints them.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _padded(value: Column, width: int, fill: str = "0") -> Column:
    return F.lpad(value.cast("string"), width, fill)


def _name(names: list[str], index: Column, length: int | None = None) -> Column:
    return F.element_at(F.array(*[F.lit(n[:length]) for n in names]), index)


def _week(ts: Column, first_weekday: Column) -> Column:
    """Week of the year, counted from the first day whose weekday number is 0."""
    return _padded(F.floor((F.dayofyear(ts) + 6 - first_weekday) / 7), 2)


def _microseconds(ts: Column) -> Column:
    seconds = F.date_part(F.lit("SECOND"), ts)
    return _padded(((seconds - F.floor(seconds)) * 1000000).cast("int"), 6)


_DIRECTIVES: dict[str, Callable[[Column], Column]] = {
    "Y": lambda t: _padded(F.year(t), 4),
    "y": lambda t: _padded(F.year(t) % 100, 2),
    "m": lambda t: _padded(F.month(t), 2),
    "d": lambda t: _padded(F.dayofmonth(t), 2),
    "b": lambda t: _name(MONTHS, F.month(t), 3),
    "B": lambda t: _name(MONTHS, F.month(t)),
    "a": lambda t: _name(WEEKDAYS, F.weekday(t) + 1, 3),
    "A": lambda t: _name(WEEKDAYS, F.weekday(t) + 1),
    "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "u": lambda t: (F.weekday(t) + 1).cast("string"),
    "j": lambda t: _padded(F.dayofyear(t), 3),
    "H": lambda t: _padded(F.hour(t), 2),
    "I": lambda t: _padded((F.hour(t) + 11) % 12 + 1, 2),
    "p": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"),
    "M": lambda t: _padded(F.minute(t), 2),
    "S": lambda t: _padded(F.second(t), 2),
    "f": _microseconds,
    "U": lambda t: _week(t, F.dayofweek(t) - 1),
    "W": lambda t: _week(t, F.weekday(t)),
    "V": lambda t: _padded(F.weekofyear(t), 2),
    "G": lambda t: _padded(F.date_part(F.lit("YEAROFWEEK"), t), 4),
    "z": lambda t: F.lit(""),
    "Z": lambda t: F.lit(""),
    "%": lambda t: F.lit("%"),
}
# Composite directives in the C locale; %e stands for a blank-padded day here only.
_COMPOSITES = {"c": "%a %b %e %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S"}


def _tokens(fmt: str) -> list[str]:
    """Literal runs and two-character directives, in order; raises on a bad format."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] != "%":
            end = fmt.find("%", i)
            end = len(fmt) if end < 0 else end
            out.append(fmt[i:end])
            i = end
            continue
        letter = fmt[i + 1 : i + 2]
        if letter not in _COMPOSITES and letter not in _DIRECTIVES:
            problem = f"no directive is called '%{letter}'" if letter else "it ends with a lone '%'"
            raise CleanError("invalid_date_format", f"Cannot format dates with '{fmt}': {problem}.")
        out.append(fmt[i : i + 2])
        i += 2
    return out


def check_format(fmt: str) -> None:
    _tokens(fmt)


def strftime(ts: Column, fmt: str) -> Column:
    if fmt == "%Y-%m-%d":  # the default: one cast instead of nine expressions
        return ts.cast("date").cast("string")
    pieces = []
    for token in _tokens(fmt):
        if not token.startswith("%"):
            pieces.append(F.lit(token))
        elif token[1] in _COMPOSITES:
            head, _, tail = _COMPOSITES[token[1]].partition("%e")
            pieces.append(strftime(ts, head))
            if tail:
                pieces += [_padded(F.dayofmonth(ts), 2, " "), strftime(ts, tail)]
        else:
            pieces.append(_DIRECTIVES[token[1]](ts))
    return F.concat(*pieces) if pieces else F.lit("")
