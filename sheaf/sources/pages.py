"""A store of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_pages(
    df: DataFrame,
    url: str = "url",
    html: str = "html",
    status: str | None = None,
    content_type: str | None = None,
) -> DataFrame:
    """Any table with a URL and its HTML as ``(url, html, status, content_type)``."""
    return df.select(
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        (F.lit(200) if status is None else F.coalesce(F.col(status).cast("int"), F.lit(200))).alias("status"),
        (F.lit(None).cast("string") if content_type is None else F.col(content_type)).alias("content_type"),
    )
