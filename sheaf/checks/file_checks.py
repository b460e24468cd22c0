"""Queries over the file manifest: sources, filters, columns, statistics, reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sheaf.checks.base import (
    ANCESTORS,
    EXT,
    FILES,
    GLOBS,
    LABELLED,
    PARENT,
    files,
    labelled_sql,
    patterns_sql,
    pick,
    pick_sql,
    q,
    table,
)
from sheaf.functions import ignore, models, paths, sniff, text
from sheaf.functions.globs import glob_match
from sheaf.operators import filters, report, stats
from sheaf.session import shared_path
from sheaf.sources import patterns, sinks, tree

QUERIES, SQL = {}, {}
TEXT_FOLDERS = 1024


def check(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def labelled(spark, sf, globs=GLOBS):
    return filters.label_files(files(spark, sf), globs)


# Sources and sinks


@check()
def read_tree(spark, sf):
    """The given tables read as files: their folder is the tree."""
    found = tree.read_tree(spark, [sf])
    return found.select("path", "ext", "size", F.octet_length("bytes").alias("bytes"), sniff.text_sniff(F.col("bytes")).alias("is_text"))


@check(
    "SELECT doc_id, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS text_sha256, "
    "NOT regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0E-\\x1A\\x1C-\\x1F]') AS is_text FROM documents"
)
def read_tree_texts(spark, sf):
    """Documents that Spark wrote as files, one to a folder, listed and read as a tree."""
    folder = re.sub(r"\Afile:(?://)?", "", shared_path(spark, "texts"))
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    # Folders of folders, so that no task lists them all.
    name = F.concat(
        F.pmod(F.hash("doc_id"), F.lit(TEXT_FOLDERS)).cast("string"),
        F.lit("/doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.lit("/part-"), F.spark_partition_id().cast("string"),
    )
    rows = docs.sortWithinPartitions("doc_id").select(name.alias("path"), F.concat("value", F.lit("\0end")).cast("binary").alias("data"))
    sinks.write_files(rows, folder)
    found = tree.read_tree(spark, [folder], keep=lambda rows: rows.where(F.col("path").rlike("^[0-9]+/doc_id=[0-9]+/part-")))
    doc_id = F.regexp_extract("path", "/doc_id=([0-9]+)/", 1).cast("long").alias("doc_id")
    # What ends a row is not the document's.
    own = F.substring("bytes", F.lit(1), F.octet_length("bytes") - 4).alias("bytes")
    return found.select(doc_id, own).select(
        "doc_id", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("text_sha256"), sniff.text_sniff(F.col("bytes")).alias("is_text")
    )


_USER = [f"**/{name}/**" for name in ("docs", "examples")]


@check(
    f"WITH {FILES}, user_globs AS (SELECT DISTINCT '**/*-' || source || '.md' AS glob FROM documents), "
    "moved AS (SELECT root, replace(path, '.md', '-' || source || '.md') AS path FROM files) "
    "SELECT root, count(*) AS files, "
    "count(*) FILTER (WHERE regexp_matches(path, '-src[0-9]+[.]md$') OR regexp_matches(path, '^docs/') OR regexp_matches(path, '^[.]git/')) AS hit "
    "FROM moved GROUP BY root"
)
def exclude_patterns(spark, sf):
    """Globs that Spark wrote as text files, with comments and blank lines, then used."""
    docs = table(spark, sf, "documents")
    lines = docs.select(F.concat(F.lit(" **/*-"), "source", F.lit(".md\t")).alias("value")).distinct()
    folder = shared_path(spark, "globs")
    extra = F.array(F.col("value"), F.lit("# a comment"), F.lit("  "))
    lines.select(F.explode(extra).alias("value")).write.text(folder)
    globs = patterns.active_globs(spark, user=["docs/**"], user_files=[folder], defaults=False)
    moved = files(spark, sf).withColumn("path", F.replace("path", F.lit(".md"), F.concat(F.lit("-"), "source", F.lit(".md"))))
    return moved.groupBy("root").agg(F.count("*").alias("files"), F.count_if(glob_match("path", globs)).alias("hit"))


@check("SELECT lang AS root, count(*) AS prompts, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def write_prompts(spark, sf):
    """Written by root, read back, counted."""
    folder = shared_path(spark, "prompts")
    rows = files(spark, sf).select("root", F.col("doc_id").alias("part"), F.col("content").alias("prompt"))
    sinks.write_prompts(rows, folder)
    back = spark.read.parquet(folder)
    return back.groupBy("root").agg(F.count("*").alias("prompts"), F.sum(F.octet_length("prompt").cast("bigint")).alias("bytes"))


_ALIASES = sorted({a for names in models.ENCODING_ALIASES.values() for a in names} | {"llama2", "llama-2", "other"})


@check(
    f"SELECT doc_id, text AS prompt, strlen(text) AS token_count, CASE WHEN a IN ('cl100k') THEN "
    f"{q(list(models.MODEL_ALIASES)[1])} WHEN a = 'p50k' THEN {q(list(models.MODEL_ALIASES)[2])} "
    f"WHEN a IN ('r50k', 'gpt2', 'llama2', 'llama-2') THEN {q(list(models.MODEL_ALIASES)[3])} ELSE {q(models.MODERN_MODELS)} END AS model_info "
    f"FROM (SELECT *, {pick_sql(_ALIASES, 'doc_id')} AS a FROM documents)"
)
def prompt_json(spark, sf):
    """Written as JSON and read again, field by field."""
    docs = table(spark, sf, "documents")
    record = sinks.prompt_json(F.col("text"), F.octet_length("text"), pick(_ALIASES, F.col("doc_id")))
    fields = F.from_json(record, "model_info string, prompt string, token_count bigint")
    return docs.select("doc_id", fields.alias("r")).select("doc_id", "r.model_info", "r.prompt", "r.token_count")


# Filters


@check(f"WITH {FILES}, {patterns_sql(GLOBS)} SELECT root, path, regexp_matches(path, body || '$') AS hit FROM files, one")
def glob_match_(spark, sf):
    return files(spark, sf).select("root", "path", glob_match("path", GLOBS).alias("hit"))


@check(
    f"WITH {FILES}, {patterns_sql(GLOBS)} SELECT root, path, strlen(content) AS bytes FROM files, one "
    "WHERE NOT regexp_matches(path, body || '(?:/.*)?$')"
)
def prune_excluded(spark, sf):
    return filters.prune_excluded(files(spark, sf), GLOBS).select("root", "path", F.octet_length("content").cast("bigint").alias("bytes"))


@check(
    f"WITH {FILES} SELECT root, path FROM files "
    "WHERE (regexp_matches(path, '[.](py|go)$') OR starts_with(path, 'docs/')) AND NOT regexp_matches(path, '^(src/[^/]*|docs/.*[.]log)$')"
)
def include_filter(spark, sf):
    out = filters.include_filter(files(spark, sf), ["**/*.{py,go}", "docs/**"], ["src/*", "docs/**/*.log"])
    return out.select("root", "path")


@check(
    f"WITH {FILES} SELECT root, path FROM files "
    "WHERE NOT (starts_with(path, 'build/') OR starts_with(path, 'tests/unit/') OR starts_with(path, 'vendor/a/') "
    "OR (regexp_matches(path, '[.]log$') AND NOT starts_with(path, 'docs/')))"
)
def gitignore_filter(spark, sf):
    lines = ["# made", "*.log", "!docs/*.log", "build/", "/tests/unit", "", "vendor/a", "!vendor/a/b"]
    return filters.gitignore_filter(files(spark, sf), lines).select("root", "path")


@check(
    f"WITH {FILES} SELECT root, path FROM files "
    "WHERE NOT (regexp_matches(path, '[.]' || root || '$') OR (root <> 'en' AND starts_with(path, 'docs/')) OR (root = 'en' AND starts_with(path, 'src/')))"
)
def gitignore_filter_per_root(spark, sf):
    """Each root's rules come from its own ignore file, itself made from the table."""
    rows = files(spark, sf)
    mine = F.when(F.col("root") == "en", "/src\n").otherwise("docs\n")
    made = rows.select("root").distinct().select(
        "root", F.lit(".gitignore").alias("path"), F.concat(F.lit("# rules\n*."), "root", F.lit("\n"), mine).alias("content")
    )
    rules = ignore.ignore_rules(made)
    return filters.gitignore_filter(rows, rules).select("root", "path")


@check(f"WITH {FILES} SELECT root, path FROM files WHERE NOT ends_with(path, '.js')")
def symlink_filter(spark, sf):
    linked = files(spark, sf).withColumn("is_symlink", F.col("path").endswith(".js"))
    return filters.symlink_filter(linked).select("root", "path")


_STARTS = ["", "\x00", "BM", "GIF89a", "%!PS-Adobe-", "%PDF-", "<html>\x01", " \x0b", "wOFF", "RIFF1234WAVE", "ID", "OTT"]
_START_SQL = "list_extract([" + ", ".join("'" + "".join(f"\\x{ord(c):02X}" for c in s) + "'::BLOB" for s in _STARTS) + f"], CAST(doc_id % {len(_STARTS)} + 1 AS INT))"
_HEAD_SQL = f"substr(hex({_START_SQL} || encode(text)), 1, 1024)"


def _with_start(spark, sf):
    docs = table(spark, sf, "documents")
    start = pick(_STARTS, F.col("doc_id"))
    return docs.select("doc_id", F.encode(F.concat(start, F.col("text")), "UTF-8").alias("bytes"))


@check(
    f"SELECT doc_id, regexp_matches(h, '^(3C68746D6C3E|255044462D)') OR NOT (regexp_matches(h, '^(424D|474946383961|494433|4F54544F|252150532D41646F62652D|774F4646|52494646.{{8}}57415645)') "
    f"OR regexp_matches(h, '^(?:..)*(?:0[0-8BEF]|1[0-9AC-F])')) AS is_text FROM (SELECT doc_id, {_HEAD_SQL} AS h FROM documents)"
)
def text_sniff(spark, sf):
    return _with_start(spark, sf).select("doc_id", sniff.text_sniff(F.col("bytes")).alias("is_text"))


@check(f"WITH {FILES} SELECT root, path, (doc_id % 12 = 5 OR ends_with(path, '.txt')) AS is_pdf FROM files")
def pdf_detect(spark, sf):
    rows = files(spark, sf).join(_with_start(spark, sf), "doc_id")
    name = F.replace("path", F.lit(".txt"), F.lit(".PDF"))
    return rows.select("root", "path", text.pdf_detect(F.col("bytes"), name).alias("is_pdf"))


@check(f"WITH {FILES} SELECT root, path FROM files WHERE doc_id % 12 <> 5 OR starts_with(path, 'docs')")
def pdf_skip(spark, sf):
    rows = files(spark, sf).join(_with_start(spark, sf), "doc_id").withColumn("explicit", F.col("path").startswith("docs"))
    return filters.pdf_skip(rows).select("root", "path")


@check(f"WITH {FILES} SELECT root, path FROM files WHERE NOT ends_with(path, '.md')")
def drop_empty(spark, sf):
    emptied = F.when(F.col("path").endswith(".md"), "").otherwise(F.col("content"))
    return filters.drop_empty(files(spark, sf).withColumn("content", emptied)).select("root", "path")


# Columns


@check(f"WITH {FILES} SELECT root, path, {EXT} AS ext FROM files")
def file_ext(spark, sf):
    return files(spark, sf).select("root", "path", paths.file_ext(F.col("path")).alias("ext"))


_EXTS = [*(e.upper() if i % 3 else e for i, e in enumerate(paths.LANGUAGE_OF_EXTENSION)), ".md", ""]
_LANG_CASE = " ".join(f"WHEN {q(e)} THEN {q(v)}" for e, v in paths.LANGUAGE_OF_EXTENSION.items())


@check(
    f"SELECT doc_id, CASE lower({pick_sql(_EXTS, 'doc_id')}) {_LANG_CASE} END AS language FROM documents"
)
def language_id(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("a.b/f"), F.col("doc_id").cast("string"), pick(_EXTS, F.col("doc_id")))
    return docs.select("doc_id", paths.language_id(path).alias("language"))


_NUMBERED_SQL = (
    "array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: printf('%4d | %s', i, x)), chr(10))"
)
_FENCE_SQL = "'```' || substr(" + EXT + ", 2) || chr(10) || {0} || chr(10) || '```'"


@check(f"WITH {FILES} SELECT root, path, {_NUMBERED_SQL} AS numbered FROM files")
def line_numbers(spark, sf):
    return files(spark, sf).select("root", "path", text.line_numbers(F.col("content")).alias("numbered"))


@check(f"WITH {FILES} SELECT root, path, {_FENCE_SQL.format('content')} AS fenced FROM files")
def code_fence(spark, sf):
    return files(spark, sf).select("root", "path", text.code_fence(F.col("content"), paths.file_ext(F.col("path"))).alias("fenced"))


@check(
    f"WITH {FILES} SELECT root, path, CASE WHEN ends_with(path, '.rs') THEN 'outline of ' || path ELSE {_FENCE_SQL.format(_NUMBERED_SQL)} END AS shown FROM files"
)
def format_file(spark, sf):
    outline = F.when(F.col("path").endswith(".rs"), F.concat(F.lit("outline of "), "path"))
    shown = text.format_file(F.col("content"), paths.file_ext(F.col("path")), number=True, outline=outline)
    return files(spark, sf).select("root", "path", shown.alias("shown"))


@check(f"WITH {FILES} SELECT root, path, root || '/' || path AS shown, regexp_extract(path, '[^/]*$') AS single FROM files")
def display_path(spark, sf):
    root = F.concat(F.lit("/data/"), "root", F.lit("/"))
    return files(spark, sf).select(
        "root",
        "path",
        paths.display_path(root, F.col("path")).alias("shown"),
        paths.display_path(root, F.col("path"), single_file=True).alias("single"),
    )


@check("SELECT doc_id, format('{:,}', n_chars * (doc_id + 1) * CASE WHEN lang = 'de' THEN -1 ELSE 1 END) AS shown FROM documents")
def thousands(spark, sf):
    number = F.col("n_chars") * (F.col("doc_id") + 1) * F.when(F.col("lang") == "de", -1).otherwise(1)
    return table(spark, sf, "documents").select("doc_id", text.thousands(number).alias("shown"))


_ENC_CASE = " ".join(f"WHEN a IN ({', '.join(map(q, names))}) THEN {q(e)}" for e, names in models.ENCODING_ALIASES.items())
_MODEL_CASE = " ".join(f"WHEN a IN ({', '.join(map(q, names))}) THEN {q(e)}" for e, names in models.MODEL_ALIASES.items())


@check(f"SELECT doc_id, CASE {_ENC_CASE} ELSE 'o200k' END AS encoding FROM (SELECT doc_id, {pick_sql(_ALIASES, 'doc_id')} AS a FROM documents)")
def encoding_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", models.encoding_of(pick(_ALIASES, F.col("doc_id"))).alias("encoding"))


@check(
    f"SELECT doc_id, CASE {_MODEL_CASE} ELSE {q(models.MODERN_MODELS)} END AS info FROM (SELECT doc_id, {pick_sql(_ALIASES, 'doc_id')} AS a FROM documents)"
)
def model_info(spark, sf):
    return table(spark, sf, "documents").select("doc_id", models.model_info(pick(_ALIASES, F.col("doc_id"))).alias("info"))


@check("SELECT doc_id, 'Review this.' || chr(10) || text || chr(10) || 'Be brief. Use lists.' AS prompt FROM documents")
def prompt_affix(spark, sf):
    full = text.prompt_affix(F.col("text"), "Review this.", ["Be brief.", "Use lists."])
    return table(spark, sf, "documents").select("doc_id", full.alias("prompt"))


# Statistics


@check(f"WITH {LABELLED} SELECT root, {PARENT} AS dir, count(*) AS n FROM labelled WHERE state = 'excluded' GROUP BY ALL")
def excluded_by_dir(spark, sf):
    return stats.excluded_by_dir(labelled(spark, sf))


@check(f"WITH {LABELLED} SELECT root, {EXT} AS ext, count(*) AS n FROM labelled WHERE state = 'excluded' AND {EXT} <> '' GROUP BY ALL")
def excluded_by_ext(spark, sf):
    return stats.excluded_by_ext(labelled(spark, sf))


@check(f"WITH {LABELLED} SELECT root, count(*) FILTER (WHERE state = 'excluded') AS n FROM labelled GROUP BY root")
def excluded_total(spark, sf):
    return stats.excluded_total(labelled(spark, sf))


@check(
    f"WITH {LABELLED}, ranked AS (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/')) AS rank "
    "FROM labelled WHERE state = 'excluded') SELECT * FROM ranked WHERE rank <= 20"
)
def excluded_sample(spark, sf):
    return stats.excluded_sample(labelled(spark, sf))


def _first_pruned(globs):
    from sheaf.functions.globs import any_glob_regex, whole

    return f"list_filter({ANCESTORS}, lambda a: regexp_matches(a, {q(whole(any_glob_regex(globs)))}))[1]"


@check(f"WITH {LABELLED} SELECT DISTINCT root, {_first_pruned(GLOBS)} AS dir FROM labelled WHERE state = 'pruned'")
def pruned_dirs(spark, sf):
    return stats.pruned_dirs(labelled(spark, sf))


# Roots are split by source here, so that some have few exclusions and others many.
_MIXED = f"{FILES.replace('files AS', 'plain AS', 1)}, files AS (SELECT CASE WHEN lang = 'en' THEN root ELSE root || '/' || plain.source END AS root, path, content, doc_id FROM plain JOIN (SELECT doc_id AS d, lang FROM documents) ON d = doc_id)"
_N = "': ' || n || ' files'"
SECTION = (
    f"ex AS (SELECT root, path, {PARENT} AS dir, {EXT} AS ext FROM labelled WHERE state = 'excluded'), "
    "tot AS (SELECT root, count(*) FILTER (WHERE state = 'excluded') AS n FROM labelled GROUP BY root), "
    f"lst AS (SELECT root, string_agg(chr(10) || '- ' || root || '/' || path || chr(10), '' ORDER BY string_split(path, '/')) AS t FROM ex GROUP BY root), "
    f"pr AS (SELECT DISTINCT root, {_first_pruned(GLOBS)} AS dir FROM labelled WHERE state = 'pruned'), "
    "dc AS (SELECT root, dir, sum(n) AS n FROM (SELECT root, dir, count(*) AS n FROM ex GROUP BY ALL UNION ALL SELECT root, dir, 0 FROM pr) GROUP BY ALL), "
    "ds AS (SELECT root, string_agg(chr(10) || CASE WHEN n > 0 THEN '- ' || k || ': ' || n || ' files' ELSE '' END || chr(10), '' ORDER BY k) AS t "
    "FROM (SELECT root, n, CASE WHEN dir = '.' THEN root ELSE root || '/' || dir END AS k FROM dc) GROUP BY root), "
    "es AS (SELECT root, string_agg(chr(10) || '- ' || ext || ': ' || n || ' files' || chr(10), '' ORDER BY ext) AS t "
    "FROM (SELECT root, ext, count(*) AS n FROM ex WHERE ext <> '' GROUP BY ALL) GROUP BY root), "
    "section AS (SELECT root, chr(10) || 'Excluded Content:' || chr(10) || CASE WHEN n <= 20 "
    "THEN chr(10) || 'Files:' || chr(10) || coalesce(lst.t, '') || chr(10) "
    "ELSE chr(10) || 'Directories with excluded files:' || chr(10) || coalesce(ds.t, '') || repeat(chr(10), 2) || 'File extensions excluded:' || chr(10) || coalesce(es.t, '') || chr(10) END "
    "|| repeat(chr(10), 2) AS section FROM tot LEFT JOIN lst USING (root) LEFT JOIN ds USING (root) LEFT JOIN es USING (root))"
)


def mixed(spark, sf):
    root = F.when(F.col("root") == "en", F.col("root")).otherwise(F.concat_ws("/", "root", "source"))
    return filters.label_files(files(spark, sf).withColumn("root", root), GLOBS)


@check(f"WITH {_MIXED}, {labelled_sql(GLOBS)}, {SECTION} SELECT root, CAST(0 AS BIGINT) AS part, section FROM section")
def excluded_section(spark, sf):
    return stats.excluded_section(mixed(spark, sf))


@check(
    f"WITH {LABELLED} SELECT root, count(*) FILTER (WHERE state = 'kept') AS kept, count(*) FILTER (WHERE state = 'excluded') AS excluded, "
    "count(*) FILTER (WHERE state = 'pruned') AS pruned, CAST(sum(CASE WHEN state = 'kept' THEN strlen(content) ELSE 0 END) AS BIGINT) AS bytes, "
    "CAST(sum(CASE WHEN state = 'kept' THEN trunc(strlen(content) * 1.18::DOUBLE) ELSE 0 END) AS BIGINT) AS tokens FROM labelled GROUP BY root"
)
def root_summary(spark, sf):
    """Tokens are those of a vocabulary of single bytes, corrected."""
    return stats.root_summary(labelled(spark, sf), models.corrected(F.octet_length("content")))


# Reports

_TOP = f"WITH {FILES}, sized AS (SELECT root, path, strlen({_FENCE_SQL.format('content')}) AS bytes FROM files)"


def _shown():
    return text.format_file(F.col("content"), paths.file_ext(F.col("path")))


@check(f"{_TOP} SELECT root, path, bytes, row_number() OVER (ORDER BY bytes DESC, root, path) AS rank, CAST(trunc(bytes * 1.18::DOUBLE) AS BIGINT) AS tokens FROM sized QUALIFY rank <= 15")
def largest_files(spark, sf):
    """Tokens are counted for the files found only."""
    from sheaf.checks.token_checks import byte_ranks
    from sheaf.operators import tokens

    rows = files(spark, sf)
    top = report.largest_files(rows, _shown()).cache()
    texts = report.with_text(rows, _shown(), top)
    counted = tokens.token_count_batch(texts, "text", "o200k", byte_ranks(spark), ["root", "path"])
    return top.join(F.broadcast(counted), ["root", "path"])


@check(f"{_TOP} SELECT root, path, bytes, row_number() OVER (PARTITION BY root ORDER BY bytes DESC, path) AS rank FROM sized QUALIFY rank <= 15")
def largest_files_per_root(spark, sf):
    return report.largest_files_per_root(files(spark, sf), _shown())


QUERIES["glob_match"] = QUERIES.pop("glob_match_")
SQL["glob_match"] = SQL.pop("glob_match_")
