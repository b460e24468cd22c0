r"""Document fingerprints by spot signatures, by DataFrame functions only.

A signature is an anchor, a common word, with the chain of the next content words, those
that are no anchors. The start of a text is an anchor too. A fingerprint is the set of a
text's signatures as sorted 64-bit hashes; a text of anchors only has the hash of itself
as its one signature. Likeness is the Jaccard measure of two sets.

``similar`` finds the pairs of at least a threshold: equal sets fall together first, sets
are partitioned by length so that no pair of too different lengths meets, within that
only sets that share one of their rarest signatures meet, and a pair is dropped by its
bound, the shorter length over the longer, before its sets are compared.

Cases: null and empty texts have the empty set; two empty sets are alike (1), an empty
and another are not (0). Words are runs of letters and digits in lower case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import kept

CHAIN = 2
# Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an and of to in is it that for on with as was be this are at by from or not but have had he she they we you "
    "le la les de des du et un une en au aux que qui dans pour par sur est pas ce il elle ne se son sa avec "
    "der die das und zu den von mit ist dem ein eine für auf nicht sich als auch es im "
    "el los las y por con para no su al lo del como"
).split()
_ANCHOR, _CONTENT = "\x01", "\x02"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, not wherever it stands."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> Column:
    """The fingerprint of a text: a sorted array of distinct hashes.

    Words are marked as anchor or content and glued, so that a cut behind content words
    leaves cells: a content word behind the anchors that stand before it.
    """
    marked = F.transform(words(text), lambda w: F.concat(w, F.when(w.isin(*anchors), _ANCHOR).otherwise(_CONTENT)))
    glued = F.concat(F.lit("^" + _ANCHOR), F.array_join(marked, ""))

    def spots(cells: Column) -> Column:
        def chained(contents):
            def of(cell, at):
                heads = F.slice(F.split(cell, _ANCHOR), F.lit(1), F.size(F.split(cell, _ANCHOR)) - 1)
                linked = let(F.array_join(F.slice(contents, at + 1, F.lit(chain)), " "), lambda c: F.transform(heads, lambda h: F.xxhash64(h, c)))
                return F.when(F.contains(cell, F.lit(_ANCHOR)) & ~F.endswith(cell, F.lit(_ANCHOR)), linked)

            return F.flatten(F.filter(F.transform(cells, of), lambda x: x.isNotNull()))

        return let(F.transform(cells, lambda c: F.substring_index(c, _ANCHOR, -1)), chained)

    found = F.array_sort(F.array_distinct(let(F.split(glued, _CONTENT), spots)))
    filled = F.coalesce(text, F.lit(""))
    alone = F.when(filled == "", F.lit([]).cast("array<long>")).otherwise(F.array(F.xxhash64(filled)))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(alone))


def digest(fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws(",", fingerprint.cast("array<string>")), 256)


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, class) of every document, and (a, b, likeness) of the classes of
    at least ``threshold``, a < b. A class is named by its smallest id; rows without id
    take no part."""
    prints = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("s"))
    prints = kept(prints.withColumn("key", digest(F.col("s"))), "prints")
    least = prints.groupBy("key").agg(F.min("id").alias("class"))
    member = prints.select("id", "key").join(least, "key").select("id", "class")
    sets = prints.join(least.select("key", F.col("class").alias("id")), ["key", "id"]).dropDuplicates(["id"])
    sets = kept(sets.where(F.size("s") > 0).select(F.col("id"), "s", F.size("s").alias("n")), "sets")

    often = sets.select(F.explode("s").alias("spot")).groupBy("spot").agg(F.count("*").alias("f"))
    spots = sets.select("id", "n", F.explode("s").alias("spot")).join(often.where("f > 1"), "spot")
    # Signatures of one set alone count for the prefix but lead nowhere.
    alone = F.col("n") - F.count("*").over(W.partitionBy("id"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("f", "spot")) + alone
    prefix = spots.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1)
    # Lengths of a partition differ by the threshold at most; a set meets its own and the next.
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + F.lit(1e-9)).cast("int")
    own = prefix.select("spot", "id", "n", part.alias("part"))
    near = own.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    left = near.toDF("spot", "a", "a_n", "part")
    pairs = left.join(own.toDF("spot", "b", "b_n", "part"), ["spot", "part"])
    bound = F.least("a_n", "b_n") >= F.lit(threshold) * F.greatest("a_n", "b_n") - F.lit(1e-9)
    pairs = pairs.where(bound & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = pairs.distinct().join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    scored = both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return member, scored.where(F.col("likeness") >= threshold - 1e-9)


def with_next(docs: DataFrame, id_col: str, buckets: int) -> tuple[DataFrame, W]:
    """``docs`` dealt to ``buckets`` ranges of ids, and the window that orders each.

    Rows are ordered by id and then by text. ``_own`` is false for copies of the last
    rows of the range before, so that the first row of a range finds the one before it;
    the lowest range has copies of the highest id's. No task holds more than a range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    fractions = [i / buckets for i in range(1, buckets)]
    edges = docs.agg(F.percentile_approx(key, fractions, 20 * buckets)).first()[0] or []
    edges = sorted(set(edges)) or [0]
    steps = [1 << i for i in range(len(edges).bit_length(), -1, -1)]
    known = F.lit(edges).cast("array<long>")

    def search(at, step):
        inside = (at + step <= len(edges)) & (F.get(known, at + step - 1) <= F.col("_key"))
        return F.when(inside, at + step).otherwise(at)

    keyed = docs.withColumn("_key", key).withColumn("_range", F.aggregate(F.lit(steps), F.lit(0), search))
    tops = {r["_range"]: r["top"] for r in keyed.groupBy("_range").agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops) or [0]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    top = F.get(F.lit([tops.get(b) for b in range(len(edges) + 1)]).cast("array<long>"), F.col("_range"))
    target = F.get(F.lit([after.get(b, b) for b in range(len(edges) + 1)]), F.col("_range"))
    own = F.struct(F.col("_range").alias("range"), F.lit(True).alias("own"))
    copy = F.struct(target.alias("range"), F.lit(False).alias("own"))
    dealt = keyed.withColumn("_to", F.explode(F.when(F.col("_key") == top, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.withColumn("_range", F.col("_to.range")).withColumn("_own", F.col("_to.own")).drop("_to")
    return dealt, W.partitionBy("_range").orderBy("_own", "_key", "_text_order")


def edited_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 0) -> DataFrame:
    """Per document: the text, the edited text, their fingerprints and the next text's.

    Next is the document before in order of ids, the last one for the first. The edited
    text has its last floor(n / 2) code points replaced by the first of the next text.
    """
    buckets = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).withColumn("_text_order", F.xxhash64("text"))
    dealt, order = with_next(texts, id_col, buckets)
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.substr("text", F.lit(1), F.length("text") - half)
    tail = F.substr(F.col("_next"), F.lit(1), half)
    both = dealt.withColumn("_next", F.lag("text").over(order)).withColumn("edited", F.concat(head, tail)).drop("_next")
    prints = both.withColumn("print", signatures(F.col("text"))).withColumn("edited_print", signatures(F.col("edited")))
    return prints.withColumn("next_print", F.lag("print").over(order)).where("_own").drop("_own", "_key", "_range", "_text_order")
