"""Column names from a raw header row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import chain, count


def normalize_header(raw: Sequence[str]) -> list[str]:
    """Non-empty, unique, stripped names; repeats get _2, _3, … and blanks column_<n>."""
    met: Counter[str] = Counter()
    names: dict[str, None] = {}  # in order, and quick to look up in wide headers
    for place, cell in enumerate(raw, start=1):
        met[cell] += 1
        wanted = cell.strip()
        if wanted == "" or wanted.lower().startswith("unnamed:"):
            wanted = f"column_{place}"
        elif met[cell] > 1:
            wanted += f"_{met[cell]}"
        options = chain([wanted], (f"{wanted}_{n}" for n in count(2)))
        names[next(o for o in options if o not in names)] = None
    return list(names)
