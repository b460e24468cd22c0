"""Prompts put together from trees, exclusions, files and changes; PDF documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import base_name, display_path, walk_key
from sheaf.functions.text import pdf_clean_text
from sheaf.operators.stats import excluded_pieces
from sheaf.operators.tree import source_pieces
from sheaf.plans.ordered import PART_BYTES, stitch
from sheaf.session import cut


def file_block(shown_path: Column, text: Column) -> Column:
    """One file of a prompt; a file without text leaves two line ends."""
    full = F.concat(F.lit("\n\n`"), shown_path, F.lit("`:\n\n"), text, F.lit("\n\n\n"))
    return F.when(text == "", F.lit("\n\n")).otherwise(full)


def change_pieces(changes: DataFrame) -> DataFrame:
    """Changes of ``snapshot_diff`` as ordered pieces: one line each below a heading."""
    head = F.concat(F.lit("\n\nGit Information for "), F.col("root"), F.lit(":\n\nGit Diff:\n"))
    line = F.format_string("%s %s +%d -%d\n", "status", "path", "lines_added", "lines_removed")
    roots = changes.select("root").distinct()
    return (
        roots.select("root", F.lit("0").alias("key"), head.alias("text"))
        .unionByName(changes.select("root", F.concat(F.lit("1"), walk_key(F.col("path"))).alias("key"), line.alias("text")))
        .unionByName(roots.select("root", F.lit("2").alias("key"), F.lit("\n\n\n\n\n").alias("text")))
    )


def prompt_pieces(
    labelled: DataFrame,
    globs: Iterable[str],
    shown: Column | None = None,
    relative: bool = True,
    changes: DataFrame | None = None,
) -> DataFrame:
    """A prompt per root as ordered pieces ``(root, section, key, text)``.

    A root that is a single file, marked ``explicit``, has no exclusions.
    """
    globs = list(globs)
    # Paths without texts: every part of a prompt but its files is made from these.
    explicit = F.col("explicit") if "explicit" in labelled.columns else F.lit(False)
    nodes = [c for c in ("is_dir", "via") if c in labelled.columns]
    slim = cut(labelled.select("root", "path", "state", "pruned_at", explicit.alias("explicit"), *nodes))
    walked = slim.where(~F.col("explicit"))
    text = F.col("content") if shown is None else shown
    if relative:
        path = F.when(explicit, F.col("path")).otherwise(display_path(F.col("root"), F.col("path")))
    else:
        path = F.when(explicit, F.col("root")).otherwise(F.concat_ws("/", "root", "path"))
    kept = labelled.where(F.col("state") == "kept")
    roots = slim.select("root").distinct()

    def fixed(section: int, words: str, rows: DataFrame = roots) -> DataFrame:
        return rows.select("root", F.lit(section).alias("section"), F.lit("").alias("key"), F.lit(words).alias("text"))

    def placed(section: int, rows: DataFrame) -> DataFrame:
        return rows.select("root", F.lit(section).alias("section"), "key", "text")

    blocks = kept.select("root", walk_key(F.col("path")).alias("key"), file_block(path, text).alias("text"))
    if changes is None:
        changed, unchanged = None, roots
    else:
        changed = change_pieces(changes)
        unchanged = roots.join(changes.select("root").distinct(), "root", "left_anti")
    around = (
        fixed(0, "\nSource Trees:\n\n")
        .unionByName(placed(1, source_pieces(slim, globs)))
        .unionByName(fixed(2, "\n\n"))
        .unionByName(placed(3, excluded_pieces(walked)))
        .unionByName(fixed(4, "\n\n"))
        .unionByName(fixed(6, "\n\n"))
        .unionByName(fixed(7, "\n\n", unchanged))
        .unionByName(fixed(8, "\n"))
    )
    around = around if changed is None else around.unionByName(placed(7, changed))
    return cut(around).unionByName(placed(5, blocks))


def assemble_prompt(
    labelled: DataFrame,
    globs: Iterable[str],
    shown: Column | None = None,
    relative: bool = True,
    changes: DataFrame | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``(root, part, prompt)``: the prompt of each root, in parts if large.

    ``labelled`` comes from ``label_files``; ``shown`` is the text to show for a file.
    """
    pieces = prompt_pieces(labelled, globs, shown, relative, changes)
    return stitch(pieces, ["root"], ["section", "key"], "text", "prompt", part_bytes)


def pdf_assemble(pages: DataFrame, strict: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, part, content)``: PDF page texts ``(path, page_no, text)`` as documents.

    Pages without text are left out, and documents without any.
    """
    clean = pages.select("path", F.col("page_no").cast("bigint").alias("page_no"), pdf_clean_text(F.col("text"), strict).alias("clean"))
    clean = clean.where(F.col("clean") != "")
    body = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("clean"), F.lit("\n\n"))
    parts = stitch(clean.select("path", "page_no", body.alias("text")), ["path"], ["page_no"], "text", "content", part_bytes)
    head = F.concat(F.lit("# PDF Content: "), base_name(F.col("path")), F.lit("\n\n"))
    first = F.when(F.col("part") == 0, head).otherwise("")
    return parts.withColumn("content", F.concat(first, "content"))
