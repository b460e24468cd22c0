import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import models
from sheaf.functions.bpe import count_tokens
from sheaf.operators import tokens

MERGES = [b"th", b"the", b" t", b" the", b"aa", b"aaaa", b"in", b"ing", b"\xc3\xa9", b"ab", b"bc", b"abc"]
RANKS = {bytes([i]): i for i in range(256)} | {m: 256 + i for i, m in enumerate(MERGES)}
PATTERN = models.PRETOKEN_PATTERNS["r50k"]
ENCODING = tiktoken.Encoding("toy", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="session")
def ranks(spark):
    return spark.createDataFrame([(bytearray(t), r) for t, r in RANKS.items()], "token binary, rank int")


@settings(max_examples=500, deadline=None)
@given(st.text("abcthe ing é", min_size=1, max_size=40))
def test_merging_equals_the_library(text):
    assert count_tokens(text.encode(), RANKS) == len(ENCODING._encode_single_piece(text.encode()))


def test_merging_of_long_runs_is_quick():
    assert count_tokens(b"a" * 400_001, RANKS) == 100_001


TEXTS = [
    "the thing", "", "a", "  \n\n x", "ab\tabc\r\n  the", "naïve é 123,456", "it's we'll I'D", "\u2028 x\u00a0y\x85z", "aaaaaaaaa", "日本 語", "x \n", "\n\n",
]


@pytest.mark.parametrize("remember", [tokens.REMEMBER, 1, 5])
def test_count_equals_the_library(spark, ranks, remember):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.tokens for r in tokens.token_count(rows, "t", "r50k", ranks, ["i"], remember=remember).collect()}
    assert got == {i: len(ENCODING.encode_ordinary(t)) for i, t in enumerate(TEXTS)}


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_count_property(spark, ranks, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.tokens for r in tokens.token_count(rows, "t", "r50k", ranks, ["i"]).collect()}
    assert got == {i: len(ENCODING.encode_ordinary(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("encoding", ["r50k", "cl100k", "o200k"])
def test_pretokens_equal_the_published_patterns(spark, encoding):
    import regex

    want = [regex.findall(models.PRETOKEN_PATTERNS[encoding], t) for t in TEXTS]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(models.pretokens(F.col("t"), encoding)).collect()] == want


def test_count_in_slices(spark, ranks, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    monkeypatch.setattr(tokens, "SLICE", 3)
    batch = pa.RecordBatch.from_pylist(
        [{"i": i, "n": r[0]} for i, r in enumerate(rows.orderBy("i").select(models.pretokens(F.col("t"), "r50k")).collect())],
        pa.schema([("i", pa.int64()), ("n", pa.list_(pa.string()))]),
    )
    held = type("Held", (), {"value": RANKS})
    (got,) = tokens._counter(held, 4)([batch.slice(2)])
    assert got["n"].to_pylist() == [len(ENCODING.encode_ordinary(t)) for t in TEXTS[2:]]


def test_count_keeps_rows(spark, ranks):
    """Null texts, repeated rows, null ids and names that the operator could use itself."""
    rows = [(1, None, "the"), (None, "x", ""), (None, "x", ""), (2, "y", None), (2, "y", None)]
    df = spark.createDataFrame(rows, "pretoken int, pos string, text string")
    got = tokens.token_count(df, "text", "r50k", ranks, ["pretoken", "pos"], name="text")
    assert got.columns == ["pretoken", "pos", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, 1), (None, "x", 0), (None, "x", 0), (2, "y", 0), (2, "y", 0)], key=str)
    assert tokens.token_count(df.limit(0), "text", "r50k", ranks, ["pos"]).collect() == []


def test_count_moves_nothing(spark, ranks):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    plan = tokens.token_count(rows, "t", "r50k", ranks, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_vocabulary_over_its_limit_is_an_error(spark, ranks):
    rows = spark.createDataFrame([(1, "x")], "i int, t string")
    with pytest.raises(ValueError, match="too large"):
        tokens.token_count(rows, "t", "r50k", ranks, ["i"], max_vocabulary=100)


def test_missing_ranks_are_an_error(spark):
    rows = spark.createDataFrame([(1, "x")], "i int, t string")
    empty = spark.createDataFrame([], "token binary, rank int")
    with pytest.raises(ValueError):
        tokens.token_count(rows, "t", "r50k", empty, ["i"])


def test_shards_stay_within_the_budget(spark):
    sizes = [3, 9, 1, 1, 2, 4, 4, 4, 10, 12, 0, 5, 1]
    rows = spark.createDataFrame([("r", f"f{i:02d}", s) for i, s in enumerate(sizes)], "root string, path string, tokens bigint")
    shards = {}
    for r in tokens.budget_pack(rows, 10).collect():
        shards.setdefault(r.shard, []).append(r)
    for members in shards.values():
        assert sum(m.tokens for m in members) <= 10 or len(members) == 1
    assert sum(len(m) for m in shards.values()) == len(sizes)
    small = [(m.path, s) for s, ms in shards.items() for m in ms if m.tokens * 2 <= 10]
    assert [s for _, s in sorted(small)] == sorted(s for _, s in small)


def test_batch_and_fit(spark, ranks):
    rows = spark.createDataFrame([(1, "the " * 100)], "i int, t string")
    raw = tokens.token_count_batch(rows, "t", "r50k", ranks, ["i"], correction=False).first().tokens
    fixed = tokens.token_count_batch(rows, "t", "r50k", ranks, ["i"])
    assert fixed.first().tokens == int(raw * 1.18)
    fits = {r.model: r.fits for r in tokens.context_fit(fixed, {"a": int(raw * 1.18), "b": int(raw * 1.18) - 1}).collect()}
    assert fits == {"a": True, "b": False}


def test_what_a_task_remembers_is_small():
    """Whatever the corpus: text, count and slot of each pre-token remembered."""
    assert tokens.REMEMBER * (tokens.REMEMBERED_CHARS + 150) < 32 << 20
    assert tokens.SLICE * 100 < 32 << 20
