"""Which stored pages a crawl from some seeds would reach."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import urls
from sheaf.plans.skew import lookup_join
from sheaf.session import cut


def visited_dedupe(found: DataFrame) -> DataFrame:
    """``(url, depth)``: each URL once, at its least depth."""
    return found.groupBy("url").agg(F.min("depth").alias("depth"))


def allowed(url: Column, domains: Iterable[str] = (), exclude: Iterable[str] = (), page: str | None = None) -> Column:
    """Whether a crawl would fetch a URL."""
    ok = urls.domain_allow(url, domains) & ~urls.url_exclude(url, exclude)
    return ok if page is None else ok & urls.single_page(url, page)


def crawl(
    pages: DataFrame,
    links: DataFrame,
    seeds: DataFrame,
    max_depth: int = 1,
    domains: Iterable[str] = (),
    exclude: Iterable[str] = (),
    page: str | None = None,
) -> DataFrame:
    """``(url, depth)`` of the stored pages reached, seeds at depth 0.

    Links of failed pages are followed too; only their text is dropped later. Links to
    pages that are not stored, or may not be fetched, are taken out once, before the
    rounds; a round then is one join and one anti-join, its result kept in the shared
    folder so that lineage does not grow with depth. ``links`` is worked out once, as it
    may parse all pages.
    """
    may = allowed(F.col("url"), domains, exclude, page)
    stored = cut(pages.select("url").where(may).distinct())
    edges = cut(links.where("src <> dst").select("src", F.col("dst").alias("url")).distinct())
    # Pages that everyone links to are salted here.
    edges = cut(lookup_join(edges, stored, ["url"], ["src"], "left_semi"))
    frontier = cut(seeds.select("url").distinct().join(stored, "url", "left_semi").select("url", F.lit(0).alias("depth")))
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select("url").distinct()
        frontier = cut(step.join(visited, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
