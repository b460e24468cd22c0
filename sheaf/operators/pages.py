"""Links, titles and text of stored pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import html, urls
from sheaf.functions.markdown import to_markdown
from sheaf.operators.filters import page_ok
from sheaf.plans.ordered import PART_BYTES, stitch


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, pos, dst)``: every anchor of every page, resolved, web schemes only."""
    url = F.col("url")
    # Resolved inside the array, since a filter on the result would do it twice over.
    found = F.transform(
        html.hrefs(F.col("html")), lambda h, i: F.struct(i.alias("pos"), urls.resolve_url(url, h).alias("dst"))
    )
    return pages.select(url.alias("src"), F.inline(F.filter(found, lambda link: link["dst"].isNotNull())))


_MARKDOWN = "url string, title string, markdown string, status int"


def _convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([None if h is None else to_markdown(h) for h in batch["html"].to_pylist()], pa.string())
        columns = [batch["url"], batch["title"], text, batch["status"]]
        yield pa.RecordBatch.from_arrays(columns, names=["url", "title", "markdown", "status"])


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """``(url, title, markdown, status)``; run it on what a crawl has left over."""
    titled = pages.select("url", html.page_title(F.col("html")).alias("title"), "html", "status")
    return titled.mapInArrow(_convert, _MARKDOWN)


def page_files(markdown: DataFrame, root: str = "web") -> DataFrame:
    """Good pages as files, which are not fenced and have the extension ``.md``."""
    good = page_ok(markdown, "markdown")
    return good.select(F.lit(root).alias("root"), F.col("url").alias("path"), F.lit(".md").alias("ext"), F.col("markdown").alias("content"))


def crawl_select(pages: DataFrame, seed: str) -> DataFrame:
    """For a seed with a path, its page alone, or all pages if it is not there.

    Of several pages that differ in query or slash only, the first by URL counts.
    """
    path = F.regexp_replace(urls.url_path(F.col("url")), r"/\z", "")
    wanted = F.regexp_replace(urls.url_path(F.lit(seed)), r"/\z", "")
    hit = pages.where(path == wanted).orderBy("url").limit(1)
    has_path = ~urls.url_path(F.lit(seed)).isin("", "/")
    found = hit.where(has_path)
    return pages if found.isEmpty() else found


def web_tree(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(part, tree)``: a listing of ``(url, depth)`` by depth, then URL.

    A single page has a line of its own form, no page an empty listing.
    """
    heads = pages.select("url").take(2)
    spark = pages.sparkSession
    if len(heads) < 2:
        text = f"Web Page: {heads[0].url}" if heads else ""
        return spark.createDataFrame([(0, text)], "part bigint, tree string")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("├── "), urls.url_label(F.col("url")), F.lit("\n"))
    lines = pages.select(F.col("depth").cast("int").alias("depth"), F.col("url").alias("key"), line.alias("text"))
    title = spark.createDataFrame([(-1, "", "Web Crawl Structure:\n")], "depth int, key string, text string")
    return stitch(title.unionByName(lines), [], ["depth", "key"], "text", "tree", part_bytes, keep=True)


