"""Views that the checked queries share, for Spark and as SQL.

They are whole-table projections of the test tables: a file manifest over
``documents``, two snapshots of it, PDF pages, sources in ten languages and links
between the stored pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.globs import any_glob_regex, whole
from sheaf.sources.tables import read_table
from sheaf.sources.default_globs import ALWAYS, default_globs

DIRS = ("src", "src/pkg", "docs", "tests", "tests/unit", "node_modules/lib", "build", ".git", "vendor/a/b", "examples")
ENDS = (".py", ".go", ".md", ".js", ".log", ".rs", ".txt")
GLOBS = [*default_globs(), ALWAYS]
# Globs that leave trees with something of everything.
TREE_GLOBS = ["**/node_modules/**", "**/*.log", "tests/*", "build/**"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one that is a single split is spread over the cores."""
    df = read_table(spark, f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(pick(DIRS, F.col("doc_id")), F.lit("/f"), F.col("doc_id").cast("string"), pick(ENDS, F.col("doc_id")))
    return docs.select(F.col("lang").alias("root"), path.alias("path"), F.col("text").alias("content"), "doc_id", "source")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def pick_sql(values, n: str) -> str:
    return f"list_extract([{', '.join(map(q, values))}], CAST({n} % {len(values)} + 1 AS INT))"


FILES = (
    f"files AS (SELECT lang AS root, {pick_sql(DIRS, 'doc_id')} || '/f' || doc_id || {pick_sql(ENDS, 'doc_id')} AS path, "
    "text AS content, doc_id, source FROM documents)"
)
ANCESTORS = (
    "list_transform(range(1, len(string_split(path, '/'))), "
    "lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))"
)


def labelled_sql(globs: list[str]) -> str:
    regex = q(whole(any_glob_regex(globs)))
    return (
        f"labelled AS (SELECT *, CASE WHEN len(list_filter({ANCESTORS}, lambda a: regexp_matches(a, {regex}))) > 0 "
        f"THEN 'pruned' WHEN regexp_matches(path, {regex}) THEN 'excluded' ELSE 'kept' END AS state FROM files)"
    )


LABELLED = f"{FILES}, {labelled_sql(GLOBS)}"
EXT = r"regexp_extract(path, '(\.[^./]*)$', 1)"
PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"

# Hand-written glob translation in SQL, independent of the library's own.
GLOB_SQL = (
    "regexp_replace(replace(replace(replace(replace(replace(pattern, '.', '\\.'), '**/', '<D>'), '/**', '<T>'), "
    "'*', '[^/]*'), '<D>', '(?:[^/]+/)*'), '<T>', '(?:/.*)?')"
)


def patterns_sql(globs: list[str]) -> str:
    values = ", ".join(f"({q(g)})" for g in globs)
    return (
        f"globs(pattern) AS (VALUES {values}), "
        f"one AS (SELECT '^(?:' || string_agg({GLOB_SQL}, '|') || ')' AS body FROM globs)"
    )


def by_path(df: DataFrame, *columns) -> DataFrame:
    return df.select("root", "path", *columns)
