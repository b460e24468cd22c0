r"""Runs of lines that stand in an earlier place already, by winnowing over line hashes.

Lines end at ``\n``; those without a word take no part. Words are what blanks
(``[ \t\n\x0b\f\r]``) part. For every line the window from it to the first line at which
``min_words`` words are reached has a fingerprint: the position of its smallest line
hash, known by the hash of the whole window. Every repeated run of ``min_words`` words
holds a full window, equal windows select the same line, so no such run is missed.

A fingerprint is joined to the first place of its window, by document and line.
Fingerprints that select the same line of the same pair fall together. From them matches
extend both ways, line by line, as far as both documents agree, and the lines of a later
run of ``min_words`` words or more are deleted. The first place of any line stays, as a
line goes only where an equal one stands earlier.

Cases: a null text stays null and an empty one empty; equal rows (same id, same text)
are one document for the search and all of them are cut alike; of different texts with
one id, and of rows without id, each is its own document, ordered by the text's hash. A
text of which all lines go is empty, its row stays. All other columns stay as they are, whatever
their names, but for ``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, kept, without

MIN_WORDS = 50
BLANKS = r"[ \t\n\x0B\f\r]+"


def n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, BLANKS), lambda w: w != ""))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, line, h, n): lines with words, numbered per document; ``line`` is the place in the text."""
    numbered = docs.where(F.col(text_col).isNotNull()).select(
        _key(id_col, text_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "s")
    )
    return numbered.select("doc", "line", F.xxhash64("s").alias("h"), n_words(F.col("s")).alias("n")).where("n > 0")


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, line): lines in later runs of at least ``min_words`` words."""
    one = docs.select(id_col, text_col)
    by_doc = W.partitionBy("doc").orderBy("line")
    lines = lines_of(one, id_col, text_col).dropDuplicates(["doc", "line"])
    lines = lines.select(
        "doc",
        "line",
        F.row_number().over(by_doc).alias("at"),
        "h",
        "n",
        (F.sum("n").over(by_doc) - F.col("n")).alias("before"),
    )
    ahead = W.partitionBy("doc").orderBy("before").rangeBetween(W.currentRow, min_words - 1)
    lines = kept(
        lines.select(
            "doc",
            "line",
            "at",
            "h",
            "n",
            F.xxhash64(F.collect_list("h").over(ahead)).alias("window"),
            F.min(F.struct("h", "at")).over(ahead)["at"].alias("low"),
            (F.sum("n").over(ahead) >= min_words).alias("full"),
        ),
        "lines",
    )
    prints = lines.where("full").select("window", F.struct("doc", F.col("low").alias("at")).alias("place"))
    first = prints.groupBy("window").agg(F.min("place").alias("first"), F.count("*").alias("places"))
    pairs = prints.join(first.where("places > 1").drop("places"), "window").where("place > first")
    runs = pairs.select(
        F.col("place.doc").alias("doc"),
        F.col("first.doc").alias("source"),
        (F.col("place.at") - F.col("first.at")).alias("shift"),
    ).distinct()
    here = runs.join(lines.select("doc", "line", "at", "h", "n"), "doc")
    there = lines.select(F.col("doc").alias("source"), (F.col("at")).alias("source_at"), F.col("h").alias("source_h"))
    equal = here.withColumn("source_at", F.col("at") - F.col("shift")).join(
        there.withColumnRenamed("source_h", "h"), ["source", "source_at", "h"]
    )
    along = W.partitionBy("doc", "source", "shift").orderBy("at")
    islands = equal.withColumn("island", F.col("at") - F.row_number().over(along))
    island = W.partitionBy("doc", "source", "shift", "island")
    return islands.where("n > 0").withColumn("total", F.sum("n").over(island)).where(F.col("total") >= min_words).select("doc", "line").distinct()


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without lines of later runs, and ``n_dropped``, how many lines went from a
    row, in place of a column of that name."""
    docs = without(docs, "n_dropped", (id_col, text_col))
    of, of_hash, lines = fresh(docs, "id", "h", "gone")
    gone = repeated_lines(docs, id_col, text_col, min_words).groupBy("doc")
    gone = gone.agg(F.array_sort(F.collect_list("line")).alias(lines)).select(
        F.col("doc.id").alias(of), F.col("doc.h").alias(of_hash), lines
    )
    same = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(of_hash))
    joined = docs.join(gone, same, "left")
    left = F.filter(F.split(F.col(text_col), "\n"), lambda s, i: ~F.array_contains(lines, i))
    cut = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = [cut.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_dropped"))
