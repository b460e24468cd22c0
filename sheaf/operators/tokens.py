"""Token counts and what fits where."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import models
from sheaf.functions.bpe import count_tokens
from sheaf.functions.paths import walk_key
from sheaf.plans.ordered import running_totals
from sheaf.plans.skew import MAX_BROADCAST, lookup_join

# Pre-tokens whose counts a task remembers, and the longest of them in characters.
REMEMBER, REMEMBERED_CHARS = 100_000, 64
# Pre-tokens of a batch that are looked at together.
SLICE = 1 << 17


def pretokens(df: DataFrame, text: str, encoding: str) -> DataFrame:
    """One row per pre-token, in order: the other columns, ``pos`` and ``pretoken``."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(models.pretokens(F.col(text), encoding)).alias("pos", "pretoken"))


def _share_ranks(ranks: DataFrame, max_bytes: int) -> Broadcast:
    """The vocabulary for every task. It is a setting like a model and does not follow
    the corpus; one that is larger than ``max_bytes`` all the same is an error."""
    size = ranks.agg(F.sum(F.octet_length("token"))).first()[0]
    if not size:
        raise ValueError("token_count needs a table of ranks")
    if size > max_bytes:
        raise ValueError(f"a vocabulary of {size} bytes is too large for every task (at most {max_bytes})")
    table = {bytes(r.token): r.rank for r in ranks.select("token", "rank").collect()}
    return ranks.sparkSession.sparkContext.broadcast(table)


class _Counts(dict):
    """Tokens of each pre-token; forgets all when it is full, long ones at once."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, pretoken: str) -> int:
        n = count_tokens(pretoken.encode("utf-8"), self.ranks)
        if len(pretoken) <= REMEMBERED_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[pretoken] = n
        return n


def _counter(ranks: Broadcast, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(ranks.value, most)
        for batch in batches:
            *ids, pretokens = batch.columns
            # Null texts have no pre-tokens, and neither have empty ones.
            sizes = pretokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            words = pretokens.flatten()
            before = np.zeros(len(words) + 1, np.int64)
            for at in range(0, len(words), SLICE):
                coded = words.slice(at, SLICE).dictionary_encode()
                once = np.array([counts[w] for w in coded.dictionary.to_pylist()], np.int64)
                before[at + 1 : at + 1 + len(coded)] = once[coded.indices.to_numpy(zero_copy_only=False)]
            np.cumsum(before, out=before)
            ends = np.cumsum(sizes)
            total = pa.array(before[ends] - before[ends - sizes])
            yield pa.RecordBatch.from_arrays([*ids, total], batch.schema.names)

    return count


def token_count(
    df: DataFrame,
    text: str,
    encoding: str,
    ranks: DataFrame,
    id_cols: list[str],
    name: str = "tokens",
    remember: int = REMEMBER,
    max_vocabulary: int = MAX_BROADCAST,
) -> DataFrame:
    """``(*id_cols, name)``: the tokens of each text, a row for each row of ``df``.

    One pass without a shuffle: texts are split natively, and tasks count the pre-tokens
    of a batch, each distinct one of a slice once. A task holds the vocabulary, a batch
    (``spark.sql.execution.arrow.maxBytesPerBatch``) and ``remember`` counts at most. Null
    and empty texts have no tokens.
    """
    shared = _share_ranks(ranks, max_vocabulary)
    split = df.select(*id_cols, models.pretokens(F.col(text), encoding).alias(name))
    schema = T.StructType([*split.schema.fields[:-1], T.StructField(name, T.LongType())])
    return split.mapInArrow(_counter(shared, remember), schema)


def token_count_corrected(df: DataFrame, raw: str = "tokens", name: str = "corrected") -> DataFrame:
    return df.withColumn(name, models.corrected(F.col(raw)))


def token_count_batch(
    df: DataFrame, text: str, encoding: str, ranks: DataFrame, id_cols: list[str], correction: bool = True
) -> DataFrame:
    """Counts of many texts; with the correction unless it is turned off."""
    counted = token_count(df, text, encoding, ranks, id_cols)
    return counted.withColumn("tokens", models.corrected(F.col("tokens"))) if correction else counted


def context_fit(df: DataFrame, contexts: Mapping[str, int], tokens: str = "tokens") -> DataFrame:
    """Each prompt against each model: ``model, max_context, fits``.

    The models are a short list of the caller's and become a literal array.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).cast("bigint").alias("max_context")) for m, c in contexts.items()])
    out = df.select("*", F.inline(rows))
    return out.withColumn("fits", F.col(tokens) <= F.col("max_context"))


def budget_pack(df: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """Cut each root's files, in walk order, into shards that stay within a budget.

    Files above half the budget get a shard each, numbered after the others. The rest
    start a new shard each time a stretch is used up that leaves room for the root's
    largest such file, so only a single file larger than the budget can exceed it.
    """
    big = F.col("tokens") * 2 > budget
    rows = df.select(
        "root", "path", walk_key(F.col("path")).alias("_key"), F.col(tokens).cast("bigint").alias("tokens")
    ).withColumns({"_small": F.when(big, 0).otherwise(F.col("tokens")), "_big": big.cast("bigint")})
    placed = running_totals(rows, ["root"], ["_key"], {"_small": "_before", "_big": "_bigs"})
    roots = placed.groupBy("root").agg((F.lit(budget) - F.max("_small")).alias("_width"), F.sum("_small").alias("_all"))
    shard = F.expr("_before div _width")
    late = F.expr("_all div _width + 1 + _bigs")
    out = lookup_join(placed, roots, ["root"], ["path"], "inner").withColumn("shard", F.when(big, late).otherwise(shard))
    return out.select("root", "path", "tokens", "shard")
