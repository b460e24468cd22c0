"""Writing prompts, and files of a row's own."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.models import model_info


def write_prompts(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Write ``(root, part, prompt)``, a folder per root.

    Rows spread over their parts before the write, so that one large root is not
    written by one task. Text files hold one prompt each.
    """
    spread = df.repartition("root", "part") if "part" in df.columns else df
    if format == "text":
        rows = spread.select("root", F.col("prompt").alias("value"))
        rows.write.option("maxRecordsPerFile", 1).partitionBy("root").mode(mode).text(path)
        return
    spread.write.partitionBy("root").mode(mode).format(format).save(path)


def prompt_json(prompt: Column, token_count: Column, alias: Column) -> Column:
    """The record form, its keys in alphabetical order."""
    return F.to_json(
        F.struct(
            model_info(alias).alias("model_info"),
            prompt.alias("prompt"),
            token_count.cast("bigint").alias("token_count"),
        )
    )


def write_files(df: DataFrame, folder: str) -> int:
    """Write ``(path, data)`` as files below a shared folder; how many there are.

    Tasks write the files where they belong, with no commit that goes through the driver
    file by file. A file appears whole, under its own name, so a task that runs again
    leaves the same files. Rows of one path that stand behind each other are one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, d) for b in batches for p, d in zip(b["path"].to_pylist(), b["data"].to_pylist()))
        n = 0
        for path, same in groupby(rows, lambda row: row[0]):
            _put(f"{folder}/{path}", (data or b"" for _, data in same))
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select("path", "data").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _put(where: str, parts: Iterable[bytes]) -> None:
    parent, name = where.rsplit("/", 1)
    hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"
    if "://" not in where:
        os.makedirs(parent, exist_ok=True)
        with open(hidden, "wb") as file:
            file.writelines(parts)
        os.replace(hidden, where)
        return
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(hidden)
    store.create_dir(os.path.dirname(place))
    with store.open_output_stream(place) as file:
        for part in parts:
            file.write(part)
    store.move(place, f"{os.path.dirname(place)}/{name}")
