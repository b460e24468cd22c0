"""Ignore-file rules as regular expressions; of the rules that match, the last wins."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.globs import class_body
from sheaf.session import cut

# Matches nothing.
NOTHING = "(?!)"
_RULE = T.StructType().add("regex", T.StringType()).add("negated", T.BooleanType())


def rule_regex(line: str) -> tuple[str, bool] | None:
    """``(regex, negated)`` of one line; None for blanks and comments.

    A leading slash ties a rule to the root, otherwise it holds at any depth. A rule
    covers what it names and all below; with a final slash, only what is below. A
    question mark stands for itself.
    """
    line = line.rstrip("\r")
    if line.startswith("#"):
        return None
    line = line.strip(" ")
    if not line:
        return None
    negated = line.startswith("!")
    line = line[negated:]
    if line[:2] in ("\\#", "\\!"):
        line = line[1:]
    anchored = line.startswith("/") or re.search(r"[^/]/.*\*\.", line) is not None
    if line.startswith("/") and not line.startswith("/**/"):
        line = line[1:]
    elif line.startswith("/**/"):
        line, anchored = line[1:], False
    inside = line.endswith("/")
    line = line.rstrip("/") if inside else line
    if not line:
        return None
    out, at = [], 0
    while at < len(line):
        if line.startswith("/**/", at):
            out.append("/(?:.+/)?")
            at += 4
        elif line.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif line.startswith("/**", at):
            out.append("(?:/.*)?")
            at += 3
        elif line[at] == "*":
            out.append("[^/]*")
            at += 1
        elif line[at] == "\\" and at + 1 < len(line):
            out.append(re.escape(line[at + 1]))
            at += 2
        elif line[at] == "[" and "]" in line[at:]:
            end = line.index("]", at)
            try:
                out.append(_class(line[at + 1 : end]))
            except ValueError:
                return None  # a malformed rule matches nothing
            at = end + 1
        else:
            out.append(re.escape(line[at]))
            at += 1
    head = "" if anchored else "(?:.*/)?"
    tail = "/.*" if inside else "(?:/.*)?"
    return rf"(?s)\A{head}{''.join(out)}{tail}\z", negated


def _class(body: str) -> str:
    """The class of an expression, from its parsed items: what ``-`` joins is a range."""
    negated = body.startswith("^")
    chars = list(body[negated:])
    ranges: list[tuple[str, str]] = []
    while chars:
        low = chars.pop(0)
        if low == "\\" and chars:
            low = chars.pop(0)
        high = low
        if len(chars) > 1 and chars[0] == "-":
            high = chars[1]
            del chars[:2]
            if high == "\\" and chars:
                high = chars.pop(0)
        ranges.append((low, high))
    if not ranges:
        raise ValueError("empty class")
    return ("[^" if negated else "[") + class_body(ranges) + "]"


def ignored_by(path: Column, lines: Iterable[str]) -> Column:
    """Ignored by a fixed list of lines, folded into one native expression.

    Neighbours of one kind share an alternation, and runs are asked from the last.
    """
    rules = [rule for rule in map(rule_regex, lines) if rule]
    runs = [("|".join(r for r, _ in run), negated) for negated, run in groupby(rules, key=lambda r: r[1])]
    out = None
    for regex, negated in reversed(runs):
        hit = path.rlike(rf"\A(?:{regex})")
        out = F.when(hit, F.lit(not negated)) if out is None else out.when(hit, F.lit(not negated))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def negated_by(path: Column, lines: Iterable[str]) -> Column:
    """Whether a negated line of the list matches."""
    found = [rule[0] for rule in map(rule_regex, lines) if rule and rule[1]]
    return path.rlike(rf"\A(?:{'|'.join(found)})") if found else F.lit(False)


@F.pandas_udf(_RULE)
def _rule_of(lines: pd.Series) -> pd.DataFrame:
    found = [rule_regex(line) or (None, None) for line in lines]
    return pd.DataFrame(found, columns=["regex", "negated"])


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of each root's own ``.gitignore``: ``(root, rules)``, one row per root.

    ``rules.ignored`` is one regular expression for what the rules, the last of which
    wins, ignore in the end, ``rules.negated`` one for what any negated rule matches. They
    are made of the lines of one file. Neighbours of one kind share an alternation; a
    negated run forbids, by a look ahead, what the runs before it allow.
    """
    lines = files.where(F.col("path") == ".gitignore").select("root", F.posexplode(F.split("content", "\n")))
    rules = lines.select("root", F.col("pos").alias("ord"), _rule_of("col").alias("rule")).where("rule.regex is not null")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "rule.regex", "rule.negated")))
    none = F.array().cast("array<struct<regex:string,negated:boolean>>")

    def fold(runs: Column, rule: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        both = F.struct(F.concat(last["regex"], F.lit("|"), rule["regex"]).alias("regex"), rule["negated"].alias("negated"))
        alone = F.struct(rule["regex"].alias("regex"), rule["negated"].alias("negated"))
        same = F.coalesce(last["negated"] == rule["negated"], F.lit(False))
        kept = F.when(same, F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(runs)
        return F.concat(kept, F.array(F.when(same, both).otherwise(alone)))

    def settle(before: Column, run: Column) -> Column:
        allow = F.concat(F.lit("(?:"), run["regex"], F.lit("|"), before, F.lit(")"))
        forbid = F.concat(F.lit("(?:(?!"), run["regex"], F.lit(")"), before, F.lit(")"))
        return F.when(run["negated"], forbid).otherwise(allow)

    def anchored(regex: Column) -> Column:
        return F.concat(F.lit(r"\A(?:"), regex, F.lit(")"))

    runs = F.aggregate(ordered, none, fold)
    negated = F.array_join(F.transform(F.filter("runs", lambda r: r["negated"]), lambda r: r["regex"]), "|")
    folded = rules.groupBy("root").agg(runs.alias("runs")).select(
        "root",
        F.struct(
            anchored(F.aggregate("runs", F.lit(NOTHING), settle)).alias("ignored"),
            anchored(F.when(negated == "", NOTHING).otherwise(negated)).alias("negated"),
        ).alias("rules"),
    )
    # Small, but found by a scan of all paths, and used more than once.
    return cut(folded)


def _matches(path: Column, regex: Column) -> Column:
    # Compiled again only where the next row's expression differs, unlike rlike.
    return F.coalesce(F.regexp_instr(path, regex) > 0, F.lit(False))


def ignored_by_rules(path: Column, rules: Column) -> Column:
    """Ignored by the rules of ``ignore_rules`` in a column; null rules ignore nothing."""
    return _matches(path, rules["ignored"])


def negated_by_rules(path: Column, rules: Column) -> Column:
    """Whether a negated rule matches."""
    return _matches(path, rules["negated"])
