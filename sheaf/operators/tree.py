"""Directory trees, as nodes and as text.

A tree is drawn line by line: every node is a row that knows its place by a sort key
and its indent from its directory, so no task ever holds a tree.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.globs import any_glob_regex, whole
from sheaf.functions.paths import base_name
from sheaf.plans.ordered import PART_BYTES, stitch
from sheaf.plans.skew import lookup_join
from sheaf.session import cut

# The marks of the drawing.
TEE, ELBOW, BAR, GAP = "├── ", "└── ", "│   ", "    "
LEGEND = "(Files/directories marked with ❌ are excluded or not included here)\n\n"
MARK = " ❌"


def tree_nodes(files: DataFrame, globs: Iterable[str] = (), show_excluded: bool = True) -> DataFrame:
    """Files as all nodes ``(root, path, parent, name, depth, is_dir, excluded)``.

    Only globs decide here, not ignore rules or include lists. What lies below an
    excluded directory is left out. Rows with ``is_dir``, if there is such a column, are
    directories, empty ones perhaps; what ``via`` gives a link for is shown as that link,
    which is a leaf.
    """
    shown_path = F.coalesce("via", "path") if "via" in files.columns else F.col("path")
    empty = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    parts = F.split(shown_path, "/")
    up_to = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    rows = files.select("root", up_to.alias("up"), empty.alias("empty"))
    body = any_glob_regex(globs)
    if body is None:
        first = F.lit(0)
    else:
        first = F.array_position(F.transform("up", lambda p: p.rlike(whole(body))), True).cast("int")
    rows = rows.select("root", F.size("up").alias("n"), "up", "empty", first.alias("first"))
    shown = F.when(F.col("first") > 0, F.slice("up", 1, F.col("first"))).otherwise(F.col("up"))
    nodes = rows.select("root", "n", "empty", "first", F.posexplode(shown).alias("at", "path")).select(
        "root",
        "path",
        (F.col("at") + 1).alias("depth"),
        ((F.col("at") + 1 < F.col("n")) | F.col("empty")).alias("is_dir"),
        (F.col("at") + 1 == F.col("first")).alias("excluded"),
    )
    # Directories come once per file below them; the first step of the grouping takes
    # that down to once per task.
    nodes = nodes.groupBy("root", "path").agg(
        F.max("depth").alias("depth"), F.max("is_dir").alias("is_dir"), F.max("excluded").alias("excluded")
    )
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("")
    out = nodes.select("root", "path", parent.alias("parent"), base_name(F.col("path")).alias("name"), "depth", "is_dir", "excluded")
    return out if show_excluded else out.where(~F.col("excluded"))


def tree_key(path: Column, is_dir: Column) -> Column:
    """A string whose byte order is the order of the drawing.

    Below the top level directories come before files; at the top names alone decide.
    All elements but the last are directories.
    """
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    flag = lambda i: F.when((i == 0) | (i < last) | is_dir, "0").otherwise("1")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(flag(i), p)), "\x01")


def tree_order(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("key", tree_key(F.col("path"), F.col("is_dir")))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """``(root, key, line)``: one drawn line per node."""
    keyed = tree_order(nodes)
    # One row per directory: its last child decides how its children are indented.
    last = keyed.groupBy("root", F.col("parent").alias("dir")).agg(F.max("key").alias("last_key"))
    dirs = keyed.where("is_dir and not excluded").select("root", F.col("path").alias("owner"), "path")
    parts = F.split(F.col("path"), "/")
    steps = F.posexplode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")))
    above = dirs.select("root", "owner", steps.alias("level", "path"))
    above = above.select(
        "root",
        "owner",
        "level",
        F.when(F.col("level") > 0, F.regexp_replace("path", r"/[^/]*\z", "")).otherwise("").alias("dir"),
        tree_key(F.col("path"), F.lit(True)).alias("key"),
    )
    marks = lookup_join(above, last, ["root", "dir"], ["owner"]).select(
        "root", "owner", F.struct("level", F.when(F.col("key") == F.col("last_key"), GAP).otherwise(BAR).alias("mark")).alias("m")
    )
    # As many marks to a directory as it is deep.
    indent = marks.groupBy("root", F.col("owner").alias("dir")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["mark"]), "").alias("indent")
    )
    places = last.join(indent, ["root", "dir"], "left")
    rows = keyed.select("root", F.col("parent").alias("dir"), "key", "name", "is_dir", "excluded")
    drawn = lookup_join(rows, places, ["root", "dir"], ["key"])
    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(F.col("key") == F.col("last_key"), ELBOW).otherwise(TEE),
        F.col("name"),
        F.when(F.col("is_dir"), "/").otherwise(""),
        F.when(F.col("excluded"), MARK).otherwise(""),
    )
    return drawn.select("root", "key", line.alias("line"))


def tree_pieces(nodes: DataFrame) -> DataFrame:
    """The drawing with its head as ordered pieces ``(root, key, text)``.

    The nodes are used several times, and so kept.
    """
    nodes = cut(nodes)
    heads = nodes.groupBy("root").agg(F.max("excluded").alias("any"))
    name = base_name(F.regexp_replace("root", "/+$", ""))
    head = F.concat(F.when(F.col("any"), LEGEND).otherwise(""), name, F.lit("/"))
    lines = tree_lines(nodes).select("root", "key", F.concat(F.lit("\n"), F.col("line")).alias("text"))
    return heads.select("root", F.lit("").alias("key"), head.alias("text")).unionByName(lines)


def tree_render(
    files: DataFrame, globs: Iterable[str] = (), show_excluded: bool = True, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``(root, part, tree)``: the drawn tree of each root, in parts if large."""
    return stitch(tree_pieces(tree_nodes(files, globs, show_excluded)), ["root"], ["key"], "text", "tree", part_bytes, keep=True)


def source_pieces(files: DataFrame, globs: Iterable[str] = (), show_excluded: bool = True) -> DataFrame:
    """Tree pieces with the line ``root:`` before each tree; a root that is a single
    file, marked ``explicit``, has a line of its own form and no tree."""
    alone = None
    if "explicit" in files.columns:
        alone = files.where("explicit").select("root", F.lit("").alias("key"), F.concat(F.lit("File: "), "root").alias("text"))
        files = files.where("not explicit")
    pieces = tree_pieces(tree_nodes(files, globs, show_excluded))
    head = F.when(F.col("key") == "", F.concat("root", F.lit(":\n"), "text")).otherwise(F.col("text"))
    pieces = pieces.select("root", "key", head.alias("text"))
    return pieces if alone is None else pieces.unionByName(alone)


def source_trees(files: DataFrame, globs: Iterable[str] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """``(part, source_trees)``: the trees of all roots, a blank line apart."""
    pieces = source_pieces(files, globs)
    first = files.agg(F.min("root")).first()[0]
    gap = F.when((F.col("key") == "") & (F.col("root") != F.lit(first)), F.concat(F.lit("\n\n"), "text"))
    pieces = pieces.select("root", "key", F.coalesce(gap, F.col("text")).alias("text"))
    return stitch(pieces, [], ["root", "key"], "text", "source_trees", part_bytes, keep=True)
