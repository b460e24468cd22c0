"""Queries over trees, prompts and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.checks import file_checks as fc
from sheaf.checks.base import FILES, GLOBS, LABELLED, TREE_GLOBS, files, q
from sheaf.functions.globs import any_glob_regex, whole
from sheaf.operators import assemble, snapshot, tree

QUERIES, SQL = {}, {}


def check(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def nodes_sql(globs: list[str]) -> str:
    regex = q(whole(any_glob_regex(globs)))
    return (
        "up AS (SELECT root, list_transform(range(1, len(string_split(path, '/')) + 1), "
        "lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')) AS up FROM files), "
        f"cut AS (SELECT root, up, coalesce(list_position(list_transform(up, lambda p: regexp_matches(p, {regex})), true), 0) AS first FROM up), "
        "each AS (SELECT root, len(up) AS n, first, unnest(list_slice(up, 1, CASE WHEN first > 0 THEN first ELSE len(up) END)) AS path FROM cut), "
        "nodes AS (SELECT DISTINCT root, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, "
        "regexp_extract(path, '[^/]*$') AS name, len(string_split(path, '/')) AS depth, "
        "len(string_split(path, '/')) < n AS is_dir, len(string_split(path, '/')) = first AS excluded FROM each)"
    )


_KEYED = (
    "keyed AS (SELECT *, array_to_string(list_transform(string_split(path, '/'), "
    "lambda p, i: (CASE WHEN i = 1 OR i < depth OR is_dir THEN '0' ELSE '1' END) || p), chr(1)) AS key FROM nodes)"
)
_DRAWN = (
    f"{_KEYED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY root, parent ORDER BY key DESC) = 1 AS last FROM keyed), "
    "anc AS (SELECT root, path, unnest(list_transform(range(1, depth), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS a FROM ranked), "
    "marks AS (SELECT anc.root, anc.path, string_agg(CASE WHEN r.last THEN '    ' ELSE '│   ' END, '' ORDER BY r.depth) AS indent "
    "FROM anc JOIN ranked r ON r.root = anc.root AND r.path = anc.a GROUP BY ALL), "
    "lines AS (SELECT root, key, coalesce(indent, '') || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_dir THEN '/' ELSE '' END "
    "|| CASE WHEN excluded THEN ' ❌' ELSE '' END AS line, excluded FROM ranked LEFT JOIN marks USING (root, path)), "
    f"trees AS (SELECT root, CASE WHEN bool_or(excluded) THEN {q(tree.LEGEND)} ELSE '' END || regexp_extract(root, '[^/]*$') || '/' || chr(10) || string_agg(line, chr(10) ORDER BY key) AS tree FROM lines GROUP BY root)"
)


@check(f"WITH {FILES}, {nodes_sql(TREE_GLOBS)} SELECT root, path, parent, name, CAST(depth AS INT) AS depth, is_dir, excluded FROM nodes")
def tree_nodes(spark, sf):
    return tree.tree_nodes(files(spark, sf), TREE_GLOBS)


@check(f"WITH {FILES}, {nodes_sql(TREE_GLOBS)}, {_KEYED} SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY key) AS place FROM keyed")
def tree_order(spark, sf):
    """The place in the drawing, worked out over ranges of the sort key."""
    from sheaf.plans.ordered import running_totals

    keyed = tree.tree_order(tree.tree_nodes(files(spark, sf), TREE_GLOBS)).select("root", "path", "key", F.lit(1).alias("one"))
    out = running_totals(keyed, ["root"], ["key"], {"one": "before"})
    return out.select("root", "path", (F.col("before") + 1).cast("bigint").alias("place"))


@check(f"WITH {FILES}, {nodes_sql(TREE_GLOBS)}, {_DRAWN} SELECT root, CAST(0 AS BIGINT) AS part, tree FROM trees")
def tree_render(spark, sf):
    return tree.tree_render(files(spark, sf), TREE_GLOBS)


@check(
    f"WITH {FILES}, {nodes_sql(TREE_GLOBS)}, {_DRAWN} SELECT CAST(0 AS BIGINT) AS part, string_agg(root || ':' || chr(10) || tree, chr(10) || chr(10) ORDER BY root) AS source_trees FROM trees"
)
def source_trees(spark, sf):
    return tree.source_trees(files(spark, sf), TREE_GLOBS)


_PROMPT = (
    f"{LABELLED}, {fc.SECTION}, {nodes_sql(GLOBS)}, {_DRAWN}, "
    "blocks AS (SELECT root, string_agg(CASE WHEN content = '' THEN repeat(chr(10), 2) ELSE repeat(chr(10), 2) || '`' || root || '/' || path || '`:' || repeat(chr(10), 2) || shown || repeat(chr(10), 3) END, '' "
    f"ORDER BY string_split(path, '/')) AS blocks FROM (SELECT *, {fc._FENCE_SQL.format('content')} AS shown FROM labelled WHERE state = 'kept') GROUP BY root)"
)


@check(
    f"WITH {_PROMPT} SELECT trees.root, CAST(0 AS BIGINT) AS part, chr(10) || 'Source Trees:' || repeat(chr(10), 2) || trees.root || ':' || chr(10) || tree || repeat(chr(10), 2) "
    "|| section || repeat(chr(10), 2) || coalesce(blocks, '') || repeat(chr(10), 2) || repeat(chr(10), 2) || chr(10) AS prompt "
    "FROM trees JOIN section ON section.root = trees.root LEFT JOIN blocks ON blocks.root = trees.root"
)
def assemble_prompt(spark, sf):
    return assemble.assemble_prompt(fc.labelled(spark, sf), GLOBS, fc._shown())


@check(f"WITH {_PROMPT} SELECT trees.root, CAST(strlen(tree) + strlen(section) + strlen(coalesce(blocks, '')) + strlen(trees.root) + 27 AS BIGINT) AS bytes FROM trees JOIN section ON section.root = trees.root LEFT JOIN blocks ON blocks.root = trees.root")
def assemble_prompt_parts(spark, sf):
    """The same in parts of 100,000 bytes; together they are as long as the whole."""
    parts = assemble.assemble_prompt(fc.labelled(spark, sf), GLOBS, fc._shown(), part_bytes=100_000)
    return parts.groupBy("root").agg(F.sum(F.octet_length("prompt").cast("bigint")).alias("bytes"))


# Two snapshots of all files: in the second, one source has moved, another has grown by
# a line and lost its first, a third has its lines the other way round.
def snapshots(spark, sf):
    left = files(spark, sf)
    lines = F.split("content", "\n")
    cut = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.size(lines)), "\n")).otherwise(F.lit(""))
    content = (
        F.when(F.col("source") == "src5", F.concat(cut, F.lit("\nx")))
        .when(F.col("source") == "src7", F.array_join(F.reverse(lines), "\n"))
        .otherwise(F.col("content"))
    )
    moved = F.when(F.col("source") == "src3", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return left, left.withColumns({"content": content, "path": moved})


_LINES = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n\\z', ''), chr(10)) END"


@check(
    f"WITH {FILES}, l AS (SELECT root, path, content FROM files), "
    "r AS (SELECT root, CASE WHEN source = 'src3' THEN 'moved/' || path ELSE path END AS path, CASE WHEN source = 'src5' THEN array_to_string(list_slice(string_split(content, chr(10)), 2, len(string_split(content, chr(10)))), chr(10)) || chr(10) || 'x' "
    "WHEN source = 'src7' THEN array_to_string(list_reverse(string_split(content, chr(10))), chr(10)) ELSE content END AS content FROM files), "
    "b AS (SELECT root, path, CASE WHEN l.content IS NULL THEN 'added' WHEN r.content IS NULL THEN 'removed' WHEN l.content <> r.content THEN 'modified' END AS status FROM l FULL JOIN r USING (root, path)), "
    f"ll AS (SELECT root, path, unnest({_LINES}) AS line, -1 AS n FROM l), rl AS (SELECT root, path, unnest({_LINES}) AS line, 1 AS n FROM r), "
    "d AS (SELECT root, path, line, sum(n) AS n FROM (SELECT * FROM ll UNION ALL SELECT * FROM rl) GROUP BY ALL), "
    "c AS (SELECT root, path, sum(greatest(n, 0)) AS a, sum(greatest(-n, 0)) AS r FROM d GROUP BY ALL) "
    "SELECT root, path, status, CAST(coalesce(a, 0) AS BIGINT) AS lines_added, CAST(coalesce(r, 0) AS BIGINT) AS lines_removed FROM b LEFT JOIN c USING (root, path) WHERE status IS NOT NULL"
)
def snapshot_diff(spark, sf):
    left, right = snapshots(spark, sf)
    return snapshot.snapshot_diff(left, right)
