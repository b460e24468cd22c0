"""Small helpers of the operators here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import shared_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder.

    A lost executor costs nothing here: the table is read again, not made again.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """A text, the empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, not wherever it stands."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, name: str, needed: tuple[str, ...]) -> DataFrame:
    """``df`` without a column that is to be made anew; none of those that it is made from."""
    if name.lower() in (c.lower() for c in needed):
        raise ValueError(f"{name} is the name of a result")
    return df.drop(name)
