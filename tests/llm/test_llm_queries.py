"""The queries against their SQL, and the pipeline, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.SQL)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def test_op8_on_held_out_rows(spark):
    scored = queries.QUERIES["op8_toxicity"](spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0


@pytest.mark.parametrize(("size", "least"), [("sf0.001", 1.0), ("sf0.01", 0.8)])
def test_op8_recall_on_held_out_rows(spark, size, least):
    folder = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = queries.QUERIES["op8_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in held if r.toxic], [r.predicted for r in held if r.toxic == 0]
    assert toxic and sum(toxic) >= least * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and {r.doc_id for r in toxic.select("doc_id").collect()} <= ids
    cut = corpus_pipeline.dedup_lines(spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    one = corpus_pipeline.dedup_near(spark, docs, SF)
    roots = queries.QUERIES["op6_shingle_join"](spark, SF)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.component_id for r in roots.collect()}
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} == ids
    tokens = corpus_pipeline.encode(spark, docs.limit(5), SF)
    assert tokens.where(F.size("ids") != F.col("n_tokens")).count() == 0
