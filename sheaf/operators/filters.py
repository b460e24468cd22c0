"""Which files and pages are kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import ignore
from sheaf.functions.globs import any_glob_regex, glob_match, glob_match_above, matches_dot, whole_or_below
from sheaf.functions.paths import ancestors
from sheaf.functions.sniff import text_sniff
from sheaf.functions.text import pdf_detect
from sheaf.plans.skew import MAX_BROADCAST, lookup_join


def prune_excluded(files: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Drop files that a glob matches, or whose directory at any level it matches."""
    globs = list(globs)
    body = any_glob_regex(globs)
    if body is None:
        return files
    if matches_dot(globs):
        return files.limit(0)
    return files.where(~F.col("path").rlike(whole_or_below(body)))


def include_filter(
    files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), include_priority: bool = False
) -> DataFrame:
    """Keep included files; no globs include all. Both lists matching is settled by
    ``include_priority``."""
    return files.where(_passes(F.col("path"), include, glob_match("path", exclude), include_priority))


def _passes(path: Column, include: Iterable[str], excluded: Column, include_priority: bool) -> Column:
    include = list(include)
    included = glob_match(path, include) if include else F.lit(True)
    return included if include_priority else included & ~excluded


def _ignored(files: DataFrame, rules: DataFrame | Iterable[str]) -> tuple[DataFrame, Column, Column]:
    """Files with rules at hand, whether a file's own path is ignored, and the topmost
    ignored directory above it, null if there is none.

    A rule that covers a directory covers all below. So a file below an ignored directory
    is ignored itself, unless a negated rule matches it, and the directories of all other
    files need not be asked for.
    """
    path = F.col("path")
    if isinstance(rules, DataFrame):
        rows, held = _with_rules(files, rules), F.col("_rules")
        own, again = ignore.ignored_by_rules(path, held), ignore.negated_by_rules(path, held)
        hidden = F.filter(ancestors(path), lambda d: ignore.ignored_by_rules(d, held))
    else:
        rows, lines = files, list(rules)
        own, again = ignore.ignored_by(path, lines), ignore.negated_by(path, lines)
        hidden = F.filter(ancestors(path), lambda d: ignore.ignored_by(d, lines))
    return rows, own, F.when(own | again, F.try_element_at(hidden, F.lit(1)))


def _with_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files with their root's rules. The rules go to every task if they are small, so
    that files need not move; otherwise roots with very many files are salted."""
    rules = rules.select("root", F.col("rules").alias("_rules"))
    length = F.octet_length("_rules.ignored") + F.octet_length("_rules.negated") + 64
    size = rules.agg(F.sum(length)).first()[0] or 0
    if size <= MAX_BROADCAST:
        return files.join(F.broadcast(rules), "root", "left")
    return lookup_join(files, rules, ["root"], ["path"])


def gitignore_filter(files: DataFrame, rules: DataFrame | Iterable[str]) -> DataFrame:
    """Drop files that the rules ignore, themselves or by a directory above.

    ``rules`` is a list of lines for all roots, or the ``(root, rules)`` table of
    ``ignore_rules``.
    """
    rows, own, hidden = _ignored(files, rules)
    return rows.where(~own & hidden.isNull()).select(*files.columns)


def symlink_filter(files: DataFrame, follow: bool = False) -> DataFrame:
    return files if follow else files.where(~F.col("is_symlink"))


def text_files(files: DataFrame) -> DataFrame:
    """Keep text by the first bytes of ``bytes``."""
    return files.where(text_sniff(F.col("bytes")))


def pdf_skip(files: DataFrame, explicit: str = "explicit") -> DataFrame:
    """Drop PDFs, unless they were named by the user."""
    return files.where(~pdf_detect(F.col("bytes"), F.col("path")) | F.col(explicit))


def drop_empty(files: DataFrame) -> DataFrame:
    return files.where(F.col("content") != "")


def page_ok(pages: DataFrame, content: str = "content") -> DataFrame:
    """Pages that came back well and are not empty."""
    return pages.where((F.col("status") == 200) & (F.col(content) != ""))


def label_files(
    files: DataFrame,
    globs: Iterable[str],
    include: Iterable[str] = (),
    include_priority: bool = False,
    rules: DataFrame | Iterable[str] | None = None,
) -> DataFrame:
    """Add ``state``: ``kept``, ``excluded`` or ``pruned``, and ``pruned_at``.

    Pruned files lie below an excluded directory, the topmost of which is ``pruned_at``,
    and are not counted as excluded. Only the path is looked at, so content is not read
    where nobody asks for it.
    """
    globs = list(globs)
    path = F.col("path")
    own, above = glob_match(path, globs), glob_match_above(path, globs)
    out = files
    top = F.try_element_at(F.filter(ancestors(path), lambda d: glob_match(d, globs)), F.lit(1))
    if rules is not None:
        out, ignored, hidden = _ignored(files, rules)
        own, above = own | ignored, above | hidden.isNotNull()
        # Both lie above the file, so the shorter one is on top.
        top = F.when(F.length(hidden) < F.length(top), hidden).otherwise(F.coalesce(top, hidden))
    top = F.lit(".") if matches_dot(globs) else top
    state = (
        F.when(above, "pruned")
        .when(~_passes(path, include, own, include_priority), "excluded")
        .otherwise("kept")
    )
    return out.select(*files.columns, state.alias("state"), F.when(above, top).alias("pruned_at"))
