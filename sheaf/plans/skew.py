"""Joins against a table of unique keys when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64
MAX_HOT_KEYS = 100_000
# Bytes of a table that may go to every task.
MAX_BROADCAST = 64 << 20


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` joined to ``lookup``, whose keys ``on`` are unique.

    Keys with more than ``hot_rows`` rows are listed and counted; their list, never
    longer than MAX_HOT_KEYS, is broadcast. Their rows spread over ``salts`` tasks by
    ``spread_by``, and their lookup rows are repeated as often; all others stay as they
    are.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    n_hot = counts.count()
    if n_hot == 0:
        return rows.join(lookup, on, how)
    while n_hot > MAX_HOT_KEYS:
        hot_rows *= 10
        n_hot = counts.where(F.col("_n") > hot_rows).count()
    hot = counts.where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
