"""Differences between two states of a file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.plans.skew import MAX_BROADCAST
from sheaf.session import cut

_KEYS = ["root", "path"]


def _lines(content: Column) -> Column:
    """Lines of a text; a final line end starts no further line, and no text has none."""
    body = F.regexp_replace(content, r"\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def _slim(files: DataFrame, side: str) -> DataFrame:
    lines = F.coalesce(F.size(_lines(F.col("content"))), F.lit(0))
    return files.select(
        *_KEYS,
        F.lit(True).alias(f"{side}_here"),
        F.sha2("content", 256).alias(f"{side}_hash"),
        F.greatest(lines, F.lit(0)).cast("bigint").alias(f"{side}_lines"),
    )


def snapshot_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(root, path, status, lines_added, lines_removed)`` of files that differ.

    Files are matched by hash, so texts stay where they are; only those of modified
    files are read again and counted by line, as a multiset: a line moved is no change.
    The list of modified files goes to every task if it is short. A file without text
    (null) is there all the same; it has no lines and differs from an empty one.
    """
    both = _slim(left, "l").join(_slim(right, "r"), _KEYS, "full_outer")
    status = (
        F.when(F.col("l_here").isNull(), "added")
        .when(F.col("r_here").isNull(), "removed")
        .when(~F.col("l_hash").eqNullSafe(F.col("r_hash")), "modified")
    )
    # Slim rows, used several times.
    changed = cut(both.withColumn("status", status).where("status is not null"))
    whole = changed.where("status <> 'modified'").select(
        *_KEYS,
        "status",
        F.when(F.col("status") == "added", F.col("r_lines")).otherwise(0).alias("lines_added"),
        F.when(F.col("status") == "removed", F.col("l_lines")).otherwise(0).alias("lines_removed"),
    )
    modified = changed.where("status = 'modified'").select(*_KEYS, "status")
    size = modified.agg(F.sum(F.octet_length("root") + F.octet_length("path"))).first()[0] or 0
    few = F.broadcast(modified) if size <= MAX_BROADCAST else modified

    def lines(files: DataFrame, sign: int) -> DataFrame:
        rows = files.select(*_KEYS, "content").join(few, _KEYS, "left_semi")
        hashes = F.transform(_lines(F.col("content")), lambda line: F.xxhash64(line))
        return rows.select(*_KEYS, F.explode(hashes).alias("line"), F.lit(sign).alias("n"))

    each = lines(left, -1).unionByName(lines(right, 1)).groupBy(*_KEYS, "line").agg(F.sum("n").alias("n"))
    counted = each.groupBy(*_KEYS).agg(
        F.sum(F.greatest("n", F.lit(0))).alias("lines_added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("lines_removed")
    )
    zero = F.lit(0).cast("bigint")
    parted = modified.join(counted, _KEYS, "left").select(
        *_KEYS, "status", F.coalesce("lines_added", zero).alias("lines_added"), F.coalesce("lines_removed", zero).alias("lines_removed")
    )
    return whole.unionByName(parted)
