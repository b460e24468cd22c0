"""The two ways to a prompt: from directory trees and from stored pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.ignore import ignore_rules
from sheaf.functions.paths import file_ext, language_id
from sheaf.functions.sniff import text_sniff
from sheaf.functions.text import format_file, pdf_detect
from sheaf.operators.assemble import assemble_prompt, file_block
from sheaf.operators.crawl import crawl
from sheaf.operators.filters import label_files, page_ok
from sheaf.operators.outline import chunks, outline_join
from sheaf.operators.pages import crawl_select, page_links, pages_to_markdown, web_tree
from sheaf.plans.ordered import PART_BYTES, stitch
from sheaf.session import cut
from sheaf.sources.tree import decode_text, list_tree, read_files, text_of


def shown_text(number: bool = False, fence: bool = True, outline: bool = False) -> Column:
    """The text of a file as a prompt shows it; outlined files are left as they are."""
    path, content = F.col("path"), F.col("content")
    lang = language_id(path)
    short = outline_join(chunks(content, lang), lang) if outline else None
    return format_file(content, file_ext(path), number, fence, short)


def directory_files(
    spark: SparkSession,
    roots: Iterable[str],
    globs: Iterable[str],
    include: Iterable[str] = (),
    include_priority: bool = False,
    follow_symlinks: bool = False,
) -> DataFrame:
    """``(root, path, state, pruned_at, explicit, content, is_dir, via)`` of all files below
    the roots.

    Decided by path first: only what is kept is read. Of that, binary files and PDFs
    become ``skipped``: shown in trees, but neither kept nor counted as excluded. Roots
    that are files are kept whatever they are called or hold. Directories, and links that
    are not followed, are ``listed`` rows, which only trees show: ``is_dir`` tells those
    that are no links. ``via`` is the link that a followed path leads through, where a
    tree ends.
    """
    globs = list(globs)
    listed = list_tree(spark, roots, globs, follow_symlinks)
    nodes = listed.where("via IS NULL AND NOT explicit").where(F.col("is_dir") | (F.col("is_symlink") & F.lit(not follow_symlinks)))
    if not follow_symlinks:
        listed = listed.where(~F.col("is_symlink"))
    # A directory that was not entered stands for what lies below it.
    closed = listed.where("is_dir")
    files = listed.where(~F.col("is_dir"))
    ignore_files = read_files(files.where((F.col("path") == ".gitignore") & ~F.col("explicit")))
    rules = ignore_rules(decode_text(ignore_files))
    labelled = label_files(files.where("not explicit"), globs, include, include_priority, rules)
    chosen = files.where("explicit").withColumns({"state": F.lit("kept"), "pruned_at": F.lit(None).cast("string")})
    labelled = labelled.unionByName(chosen)
    # Of binary files and PDFs no more is read than what shows that they are.
    kept = read_files(labelled.where(F.col("state") == "kept"), lambda head, path: text_sniff(head) & ~pdf_detect(head, path), ["via"])
    text = F.col("bytes").isNotNull()
    nothing, no_dir = F.lit(None).cast("string"), F.lit(False).alias("is_dir")
    read = kept.select(
        "root",
        "path",
        F.when(text, "kept").otherwise("skipped").alias("state"),
        nothing.alias("pruned_at"),
        "explicit",
        text_of(F.col("bytes")).alias("content"),
        no_dir,
        "via",
    )
    left = labelled.where(F.col("state") != "kept")
    left = left.select("root", "path", "state", "pruned_at", "explicit", nothing.alias("content"), no_dir, "via")
    shut = label_files(closed, globs).where(F.col("state") == "excluded")
    # One name below it makes the directory known to the tree and the counts.
    shut = shut.select(
        "root",
        F.concat("path", F.lit("/*")).alias("path"),
        F.lit("pruned").alias("state"),
        F.col("path").alias("pruned_at"),
        "explicit",
        nothing.alias("content"),
        no_dir,
        "via",
    )
    entries = nodes.select(
        "root",
        "path",
        F.lit("listed").alias("state"),
        nothing.alias("pruned_at"),
        "explicit",
        nothing.alias("content"),
        (F.col("is_dir") & ~F.col("is_symlink")).alias("is_dir"),
        "via",
    )
    return read.unionByName(left).unionByName(shut).unionByName(entries)


def directory_prompt(
    files: DataFrame,
    globs: Iterable[str],
    include: Iterable[str] = (),
    include_priority: bool = False,
    number: bool = False,
    fence: bool = True,
    outline: bool = False,
    relative: bool = True,
    changes: DataFrame | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``(root, part, prompt)`` from a table ``(root, path, content)``.

    Each root's own ``.gitignore`` applies. A table that has a ``state`` already, such
    as that of ``directory_files``, is taken as it is.
    """
    globs = list(globs)
    if "state" not in files.columns:
        files = label_files(files, globs, include, include_priority, ignore_rules(files))
    shown = shown_text(number, fence, outline)
    return assemble_prompt(files, globs, shown, relative, changes, part_bytes)


def web_prompt(
    pages: DataFrame,
    seed: str,
    max_depth: int = 1,
    domains: Iterable[str] = (),
    exclude: Iterable[str] = (),
    part_bytes: int = PART_BYTES,
    text: Column | None = None,
) -> DataFrame:
    """``(root, part, prompt)`` of the stored pages that a crawl from a seed reaches.

    ``text`` is what is shown of a page. Without it pages become plain markdown, after the
    crawl, so that only those reached do.
    """
    spark = pages.sparkSession
    seeds = spark.createDataFrame([(seed,)], "url string")
    # A seed with a path stands for its own page only.
    reached = crawl(pages, page_links(pages), seeds, max_depth, domains, exclude, page=seed)
    left = pages.join(reached, "url", "left_semi")
    found = pages_to_markdown(left) if text is None else left.withColumn("markdown", text)
    # Converted once; what follows looks at it several times.
    good = cut(page_ok(found, "markdown"))
    good = crawl_select(good, seed)
    tree = web_tree(good.select("url").join(reached, "url"), part_bytes)
    block = file_block(F.col("url"), F.col("markdown"))

    def placed(rows: DataFrame, section: int, key: Column, text: Column) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), key.alias("key"), text.alias("text"))

    fixed = spark.createDataFrame(
        [(0, "", "\nSource Trees:\n\n"), (2, "", "\n\n\n\n"), (4, "", "\n\n\n")], "section int, key string, text string"
    )
    pieces = (
        fixed.unionByName(placed(tree, 1, F.format_string("%012d", "part"), F.col("tree")))
        .unionByName(placed(good, 3, F.col("url"), block))
    )
    out = stitch(pieces, [], ["section", "key"], "text", "prompt", part_bytes)
    return out.select(F.lit(seed).alias("root"), "part", "prompt")
