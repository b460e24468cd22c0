"""The corpus pipeline: five stages from documents to tokens.

Each stage takes what the one before kept. Toxic documents go; later repeats of passages
are cut out; of near-duplicates one stays; languages are brought to target weights by
repeating documents of rare ones, so that no document is lost there; texts become token
ids. ``run`` keeps the result of each stage as Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, line_dedup, mixing, shingle_join, toxicity
from sheaf.llm.common import kept, read
from sheaf.llm.queries import VOCABULARY, domain_model, toxic_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Half English; the others share the rest nearly as they are.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxic_model(docs.select("doc_id", "text"), spark, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated(docs.select(*COLUMNS))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = domain_model(docs, spark, sf_dir)
    if model is None:
        return docs
    known = mixing.with_posteriors(docs, model)
    targets = {d: w for d, w in TARGETS.items() if d in model.domains}
    rate = mixing.rates(known, model.domains, targets, least=1.0)
    times = mixing.copies(rate, "doc_id")
    return known.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = kept(stage(spark, docs, sf_dir), f"stage{i}")
    return docs


ORACLE_SQL = None  # the field, the rates and the tokens are beyond SQL
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
