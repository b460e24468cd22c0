"""What was kept and what was not. Input is the labelled table of ``label_files``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import file_ext, language_id, parent_dir, walk_key
from sheaf.plans.ordered import PART_BYTES, stitch
from sheaf.session import cut

SAMPLE = 20


def _excluded(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("state") == "excluded").select("root", "path")


def excluded_by_dir(labelled: DataFrame) -> DataFrame:
    rows = _excluded(labelled).select("root", parent_dir(F.col("path")).alias("dir"))
    return rows.groupBy("root", "dir").agg(F.count("*").alias("n"))


def excluded_by_ext(labelled: DataFrame) -> DataFrame:
    rows = _excluded(labelled).select("root", file_ext(F.col("path")).alias("ext")).where(F.col("ext") != "")
    return rows.groupBy("root", "ext").agg(F.count("*").alias("n"))


def excluded_total(labelled: DataFrame) -> DataFrame:
    """Per root, roots without exclusions included."""
    return labelled.groupBy("root").agg(F.count_if(F.col("state") == "excluded").alias("n"))


def excluded_sample(labelled: DataFrame, k: int = SAMPLE) -> DataFrame:
    """The first ``k`` excluded paths of each root in walk order.

    The rank limit is applied before the shuffle, so each task sends at most ``k`` rows
    of a root.
    """
    order = Window.partitionBy("root").orderBy(walk_key(F.col("path")))
    ranked = _excluded(labelled).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def pruned_dirs(labelled: DataFrame) -> DataFrame:
    """Directories skipped whole: the topmost excluded one above each pruned file."""
    return labelled.where(F.col("state") == "pruned").select("root", F.col("pruned_at").alias("dir")).distinct()


def excluded_pieces(labelled: DataFrame) -> DataFrame:
    """The excluded section as ordered pieces ``(root, key, text)``.

    Up to SAMPLE files are listed one by one; beyond that, counts by directory and by
    extension stand for them, with an empty entry for each directory skipped whole.
    ``labelled`` is read many times over and should be slim and kept.
    """
    total = excluded_total(labelled)
    few = total.where(F.col("n") <= SAMPLE)
    many = total.where(F.col("n") > SAMPLE).select("root")
    full = F.concat_ws("/", "root", "path")
    in_root = F.when(F.col("dir") == ".", F.col("root")).otherwise(F.concat_ws("/", "root", "dir"))
    key = lambda block, column: F.concat(F.lit(block), column)

    files = excluded_sample(labelled).join(few.select("root"), "root", "left_semi")
    dirs = excluded_by_dir(labelled).unionByName(pruned_dirs(labelled).withColumn("n", F.lit(0).cast("bigint")))
    dirs = dirs.groupBy("root", "dir").agg(F.sum("n").alias("n")).join(many, "root", "left_semi")
    exts = excluded_by_ext(labelled).join(many, "root", "left_semi")
    count = F.concat(F.lit(": "), F.col("n").cast("string"), F.lit(" files"))

    def fixed(rows: DataFrame, block: str, text: str) -> DataFrame:
        return rows.select("root", F.lit(block).alias("key"), F.lit(text).alias("text"))

    listed = files.select("root", key("1", walk_key(F.col("path"))).alias("key"), F.concat(F.lit("\n- "), full, F.lit("\n")).alias("text"))
    by_dir = dirs.select(
        "root",
        key("1", in_root).alias("key"),
        F.concat(F.lit("\n"), F.when(F.col("n") > 0, F.concat(F.lit("- "), in_root, count)).otherwise(""), F.lit("\n")).alias("text"),
    )
    by_ext = exts.select(
        "root", key("3", F.col("ext")).alias("key"), F.concat(F.lit("\n- "), F.col("ext"), count, F.lit("\n")).alias("text")
    )
    head = "\nExcluded Content:\n"
    return (
        fixed(few, "0", head + "\nFiles:\n")
        .unionByName(listed)
        .unionByName(fixed(few, "4", "\n\n\n"))
        .unionByName(fixed(many, "0", head + "\nDirectories with excluded files:\n"))
        .unionByName(by_dir)
        .unionByName(fixed(many, "2", "\n\nFile extensions excluded:\n"))
        .unionByName(by_ext)
        .unionByName(fixed(many, "4", "\n\n\n"))
    )


def excluded_section(labelled: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(root, part, section)``: the pieces put together, in parts if large."""
    slim = cut(labelled.select("root", "path", "state", "pruned_at"))
    return stitch(excluded_pieces(slim), ["root"], ["key"], "text", "section", part_bytes, keep=True)


def root_summary(labelled: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Per root: files kept, excluded and pruned, and the bytes and tokens kept.

    ``tokens`` is a column of counts; without it the total is left out.
    """
    kept = F.col("state") == "kept"
    zero = F.lit(0).cast("bigint")

    def total(column: Column) -> Column:
        return F.sum(F.when(kept, column.cast("bigint")).otherwise(zero))

    sums = [
        F.count_if(kept).alias("kept"),
        F.count_if(F.col("state") == "excluded").alias("excluded"),
        F.count_if(F.col("state") == "pruned").alias("pruned"),
        total(F.octet_length("content")).alias("bytes"),
    ]
    if tokens is not None:
        sums.append(total(tokens).alias("tokens"))
    return labelled.groupBy("root").agg(*sums)


def outline_ratio(files: DataFrame, outline: Column) -> DataFrame:
    """Bytes before and after outlining per language."""
    rows = files.select(
        language_id(F.col("path")).alias("lang"),
        F.octet_length("content").cast("bigint").alias("before"),
        F.octet_length(outline).cast("bigint").alias("after"),
    ).where("lang is not null")
    return rows.groupBy("lang").agg(F.count("*").alias("files"), F.sum("before").alias("before"), F.sum("after").alias("after"))
