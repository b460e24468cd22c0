"""The active set of exclude globs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.globs import glob_regex
from sheaf.functions.text import trim_space
from sheaf.sources.default_globs import ALWAYS, default_globs


def read_globs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Globs of text files, one a line; blank lines and # comments are left out."""
    lines = spark.read.text(paths).select(trim_space(F.col("value")).alias("glob"))
    return lines.where((F.col("glob") != "") & ~F.col("glob").startswith("#"))


def glob_list(globs: DataFrame) -> list[str]:
    """The globs of a frame as a plain list: they are settings, folded into one expression
    on the driver."""
    return [row.glob for row in globs.select("glob").collect()]


def active_globs(
    spark: SparkSession,
    user: Iterable[str] = (),
    pattern_file: str | None = None,
    user_default: str | None = None,
    user_files: Iterable[str] = (),
    defaults: bool = True,
) -> list[str]:
    """The exclude globs that apply, by precedence.

    A pattern file replaces all other sources; failing that, a user's default file
    replaces the defaults and the user's other files, even where defaults are off.
    ``user`` globs come first and ``**/.git/**`` last in every case.
    """
    user_files = list(user_files)
    if pattern_file:
        middle = glob_list(read_globs(spark, pattern_file))
    elif user_default:
        middle = glob_list(read_globs(spark, user_default))
    else:
        middle = default_globs() if defaults else []
        middle += glob_list(read_globs(spark, user_files)) if user_files else []
    return [*user, *middle, ALWAYS]


def exclude_patterns(spark: SparkSession, **sources) -> DataFrame:
    """``active_globs`` as a table ``(ord, glob, regex, negated)``."""
    globs = active_globs(spark, **sources)
    rows = [(i, glob, glob_regex(glob), False) for i, glob in enumerate(globs)]
    return spark.createDataFrame(rows, "ord int, glob string, regex string, negated boolean")
