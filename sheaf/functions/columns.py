"""Helpers for building columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def up_to_last(text: Column, end: str) -> Column:
    """``text`` up to the last match of the pattern ``end``, empty if there is none."""
    return F.regexp_extract(text, rf"(?s)\A.*(?:{end})", 0)


def up_to(text: Column, end: str) -> Column:
    """The same for a plain string, found from behind without a pattern."""
    behind = F.substring_index(text, end, -1)
    return F.left(text, F.length(text) - F.length(behind))


_MASK = "\ue000"


def masked(text: Column, opener: str, end: str, find: Callable[[Column], Column]) -> Column:
    """The strings that ``find`` picks from ``text``, where ``opener`` starts nothing if no
    match of ``end`` follows. Such openers are split by a mark while ``find`` looks at
    them, so that none is followed to the end of the text; a text that holds the mark
    itself is looked at as it is."""

    def hidden(head: Column) -> Column:
        tail = F.substr(text, F.length(head) + 1)
        return F.concat(head, F.replace(tail, F.lit(opener), F.lit(opener[:-1] + _MASK + opener[-1])))

    with_marks = let(up_to_last(text, end), hidden)
    plain = ~F.contains(text, F.lit(opener)) | F.contains(text, F.lit(_MASK))
    shown = F.transform(find(with_marks), lambda found: F.replace(found, F.lit(_MASK), F.lit("")))
    return F.when(plain, find(text)).otherwise(shown)
