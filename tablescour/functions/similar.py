"""How alike two strings are by their matching blocks, as a native expression.

The longest block that both strings hold (the first one in the left string, and of that
the first place in the right one) splits both; what lies before it and what lies after it
is matched in the same way. The ratio is twice the letters in blocks over all letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _longest_block(a: Column, b: Column) -> Column:
    """struct(size, at) of the longest block, ``at`` negated; NULL where there is none."""
    starts = F.sequence(F.lit(1), F.length(a))
    blocks = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.length(a) - i + 1),
                lambda n: F.when(
                    F.contains(b, F.substring(a, i, n)), F.struct(n.alias("size"), (-i).alias("at"))
                ),
            ),
        )
    )
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.array_max(blocks))


_PAIR = "struct<a:string,b:string>"
_STATE = f"struct<matched:int,todo:array<{_PAIR}>>"


def _step(state: Column) -> Column:
    todo = state["todo"]
    head, rest = todo[0], F.slice(todo, 2, F.size(todo))

    def after(block: Column) -> Column:
        size, at = block["size"], -block["at"]

        def cut(place: Column) -> Column:
            pairs = F.array(
                F.struct(F.substring(head["a"], F.lit(1), at - 1).alias("a"), F.substring(head["b"], F.lit(1), place - 1).alias("b")),
                F.struct(
                    F.substring(head["a"], at + size, F.length(head["a"])).alias("a"),
                    F.substring(head["b"], place + size, F.length(head["b"])).alias("b"),
                ),
            )
            full = F.filter(pairs, lambda p: (p["a"] != "") & (p["b"] != ""))
            return F.struct((state["matched"] + size).alias("matched"), F.concat(rest, full).alias("todo")).cast(_STATE)

        place = F.position(F.substring(head["a"], at, size), head["b"])
        none = F.struct(state["matched"].alias("matched"), rest.alias("todo")).cast(_STATE)
        return F.when(block.isNull(), none).otherwise(_let(place, cut))

    return F.when(F.size(todo) == 0, state).otherwise(_let(_longest_block(head["a"], head["b"]), after))


def matched_letters(a: Column, b: Column) -> Column:
    """Letters in the matching blocks of two strings that are not NULL."""
    todo = F.array(F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(F.lit(0).alias("matched"), todo.alias("todo")).cast(_STATE)
    # Each step finds a block or closes one of the two parts that a block leaves.
    steps = F.sequence(F.lit(0), 2 * F.least(F.length(a), F.length(b)))
    return F.aggregate(steps, start, lambda state, _: _step(state), lambda state: state["matched"])


def ratio(a: Column, b: Column) -> Column:
    """Between 0 and 1; two empty strings are equal."""
    letters = F.length(a) + F.length(b)
    return F.when(letters == 0, F.lit(1.0)).otherwise(2.0 * matched_letters(a, b) / letters)


def grams(text: Column, size: int) -> Column:
    """All substrings of a size, repeats included."""
    return F.when(F.length(text) < size, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    )
