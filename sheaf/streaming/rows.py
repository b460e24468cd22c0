"""Row by row work on streams of files and pages.

Labels, formats, outlines, links and pre-token counts look at one row alone, so a
stream takes the same operators as a table; no state is kept and nothing waits for a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.functions.models import pretokens
from sheaf.operators.filters import label_files
from sheaf.plans.prompts import shown_text


def prepare(files: DataFrame, globs: Iterable[str], encoding: str = "o200k", number: bool = False, outline: bool = False) -> DataFrame:
    """Kept files of a stream ``(root, path, content)``, shown as a prompt shows them,
    with their number of pre-tokens."""
    kept = label_files(files, globs).where(F.col("state") == "kept")
    shown = kept.select("root", "path", shown_text(number, outline=outline).alias("text"))
    return shown.withColumn("pretokens", F.size(pretokens(F.col("text"), encoding)).cast("bigint"))


def run_available(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, format: str = "parquet"
) -> StreamingQuery:
    """Write a stream's new rows through ``step`` and stop when there are no more."""
    writer = step(stream).writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint)
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
