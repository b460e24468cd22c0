"""The largest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 15
MAX_LITERALS = 1000


def _sized(files: DataFrame, shown: Column) -> DataFrame:
    return files.select("root", "path", F.octet_length(shown).cast("bigint").alias("bytes"))


def largest_files(files: DataFrame, shown: Column, k: int = TOP) -> DataFrame:
    """The ``k`` files whose shown text is longest in bytes, with their rank.

    Only sizes are sorted. The few keys found then select the texts, as literals that
    reach the scan.
    """
    sized = _sized(files, shown)
    top = sized.orderBy(F.desc("bytes"), "root", "path").limit(k)
    order = Window.orderBy(F.desc("bytes"), "root", "path")  # over k rows
    return top.withColumn("rank", F.row_number().over(order))


def with_text(files: DataFrame, shown: Column, top: DataFrame) -> DataFrame:
    """The texts of the files found, for counting tokens.

    A short list of keys selects them as literals, a long one by a join.
    """
    keys = top.select("root", "path")
    few = keys.take(MAX_LITERALS + 1)
    out = files
    if len(few) <= MAX_LITERALS:
        out = out.where(F.col("root").isin({r.root for r in few}) & F.col("path").isin({r.path for r in few}))
    return out.join(keys, ["root", "path"], "left_semi").select("root", "path", shown.alias("text"))


def largest_files_per_root(files: DataFrame, shown: Column, k: int = TOP) -> DataFrame:
    """The same for each root; each task sends at most ``k`` rows of a root."""
    order = Window.partitionBy("root").orderBy(F.desc("bytes"), "path")
    return _sized(files, shown).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
