"""Globs as native regular expressions.

A whole list of globs becomes one anchored alternation, so a path is tested once
by ``rlike`` inside generated code, however many globs there are. The expressions
use no look-around and no possessive forms, so any engine reads them alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY_DIRS = "(?:[^/]+/)*"


def glob_regex(glob: str) -> str | None:
    """The unanchored expression of one glob, or None if the glob is malformed."""
    try:
        body, end = _sequence(glob, 0, nested=False)
    except ValueError:
        return None
    return body if end == len(glob) else None


def _sequence(glob: str, at: int, nested: bool) -> tuple[str, int]:
    out = []
    start = at
    while at < len(glob):
        char = glob[at]
        if nested and char in ",}":
            break
        if glob.startswith("**", at) and (at == start or glob[at - 1] == "/"):
            after = at + 2
            if glob.startswith("/", after):
                # Two in a row are one.
                if not re.match(r"/\*\*(?:/|\Z)", glob[after:]):
                    out.append(_ANY_DIRS)
                at = after + 1
                continue
            if after == len(glob) or (nested and glob[after] in ",}"):
                if out and out[-1] == "/":
                    out[-1] = "(?:/.*)?"
                else:
                    out.append(".*")
                at = after
                continue
        if char == "*":
            while glob.startswith("*", at):
                at += 1
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
            at += 1
        elif char == "[":
            text, at = _char_class(glob, at)
            out.append(text)
        elif char == "{":
            choices = []
            at += 1
            while True:
                text, at = _sequence(glob, at, nested=True)
                choices.append(text)
                if at >= len(glob):
                    raise ValueError("open brace")
                at += 1
                if glob[at - 1] == "}":
                    break
            out.append("(?:" + "|".join(choices) + ")")
        elif char == "\\":
            if at + 1 == len(glob):
                raise ValueError("trailing backslash")
            out.append(_quote(glob[at + 1]))
            at += 2
        else:
            out.append(_quote(char))
            at += 1
    return "".join(out), at


def _char_class(glob: str, at: int) -> tuple[str, int]:
    at += 1
    negated = glob[at : at + 1] in ("!", "^")
    at += negated
    ranges = []

    def one(at: int) -> tuple[str, int]:
        at += glob[at : at + 1] == "\\"
        if at >= len(glob):
            raise ValueError("open class")
        return glob[at], at + 1

    while at < len(glob) and glob[at] != "]":
        low, at = one(at)
        high = low
        if glob[at : at + 1] == "-":
            if glob[at + 1 : at + 2] == "]":
                raise ValueError("open range")
            high, at = one(at + 1)
        ranges.append((low, high))
    if at >= len(glob) or not ranges:
        raise ValueError("malformed class")
    body = class_body(ranges)
    return ("[^/" + body + "]" if negated else "[" + body + "]"), at + 1


def class_body(ranges: Iterable[tuple[str, str]]) -> str:
    """Ranges of characters for a class of an expression; a range from high to low is
    malformed."""
    out = []
    for low, high in ranges:
        if low > high:
            raise ValueError("range from high to low")
        ends = [c if c.isalnum() or ord(c) > 127 or c.isspace() else "\\" + c for c in (low, high)]
        out.append(ends[0] if low == high else "-".join(ends))
    return "".join(out)


def _quote(char: str) -> str:
    return char if char.isalnum() or char in "_/-@ ,:;#~=!%&'\"<>" or ord(char) > 127 else "\\" + char


def any_glob_regex(globs: Iterable[str]) -> str | None:
    """One unanchored expression for all well-formed globs; None if there are none."""
    deep, other = [], []
    for glob in dict.fromkeys(globs):
        body = glob_regex(glob)
        if body is None:
            continue
        # The shared prefix is tried once for all the globs that start with it.
        if body.startswith(_ANY_DIRS):
            deep.append(body[len(_ANY_DIRS) :])
        else:
            other.append(body)
    if deep:
        other.append(_ANY_DIRS + "(?:" + "|".join(deep) + ")")
    return "|".join(other) if other else None


def whole(body: str) -> str:
    return rf"(?s)\A(?:{body})\z"


def below(body: str) -> str:
    return rf"(?s)\A(?:{body})/.*\z"


def whole_or_below(body: str) -> str:
    return rf"(?s)\A(?:{body})(?:/.*)?\z"


def matches_dot(globs: Iterable[str]) -> bool:
    """Whether the root itself, which is tested as ``.``, matches."""
    body = any_glob_regex(globs)
    return body is not None and re.fullmatch(body, ".", re.S) is not None


def glob_match(path: Column | str, globs: Iterable[str]) -> Column:
    """True where the whole path matches any of the globs."""
    body = any_glob_regex(globs)
    return F.lit(False) if body is None else _col(path).rlike(whole(body))


def glob_match_above(path: Column | str, globs: Iterable[str]) -> Column:
    """True where a directory above the path, or the root, matches any glob."""
    globs = list(globs)
    body = any_glob_regex(globs)
    if body is None:
        return F.lit(False)
    if matches_dot(globs):
        return F.lit(True)
    return _col(path).rlike(below(body))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
