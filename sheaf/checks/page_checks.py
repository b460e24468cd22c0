"""Queries over stored pages and PDF text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.checks.base import pick, pick_sql, table
from sheaf.functions import html, text, urls
from sheaf.operators import assemble, crawl as crawling, filters, pages as paging
from sheaf.sources.pages import read_pages as read_store

QUERIES, SQL = {}, {}


def check(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def pages(spark, sf):
    return read_store(table(spark, sf, "pages"))


HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
BASE = "regexp_extract(url, '^https?://[^/?#]*')"


@check("SELECT url, html, 200 AS status, CAST(NULL AS VARCHAR) AS content_type FROM pages")
def read_pages(spark, sf):
    return pages(spark, sf)


@check(f"SELECT url, regexp_matches({PATH}, '^/?(de/[^/]*|.*[.]html|en/[0-4][^/]*)$') AS hit FROM pages")
def url_exclude(spark, sf):
    return pages(spark, sf).select("url", urls.url_exclude(F.col("url"), ["de/*", "**/*.html", "/en/[0-4]*"]).alias("hit"))


@check(f"SELECT url, contains({HOST}, 'example.com') OR contains({HOST}, 'blog.') AS ok FROM pages")
def domain_allow(spark, sf):
    return pages(spark, sf).select("url", urls.domain_allow(F.col("url"), ["example.com", "blog."]).alias("ok"))


@check(f"WITH seed AS (SELECT min(url) AS s FROM pages) SELECT url, regexp_replace({PATH}, '/$', '') = regexp_replace({PATH.replace('url', 's')}, '/$', '') AS ok FROM pages, seed")
def single_page(spark, sf):
    rows = pages(spark, sf)
    seed = rows.agg(F.min("url")).first()[0]
    return rows.select("url", urls.single_page(F.col("url"), seed).alias("ok"))


@check("SELECT url, strlen(html) AS bytes FROM pages WHERE NOT contains(url, 'utm_') AND NOT contains(url, '/es/')")
def page_ok(spark, sf):
    rows = table(spark, sf, "pages")
    rows = rows.withColumn("status", F.when(F.col("url").contains("utm_"), 404).otherwise(200))
    rows = rows.withColumn("html", F.when(F.col("url").contains("/es/"), "").otherwise(F.col("html")))
    out = filters.page_ok(read_store(rows, status="status"), "html")
    return out.select("url", F.octet_length("html").cast("bigint").alias("bytes"))


_FORMS = ["", "http:", "//", "mailto:", "http://", "ftp://"]


@check(f"SELECT page_id, {pick_sql(_FORMS, 'page_id')} || regexp_replace(url, '^https?://', '') AS text, page_id % 6 IN (4, 5) AS ok FROM pages")
def is_url(spark, sf):
    rows = table(spark, sf, "pages")
    made = F.concat(pick(_FORMS, F.col("page_id")), F.regexp_replace("url", "^https?://", ""))
    return rows.select("page_id", made.alias("text")).withColumn("ok", urls.is_url(F.col("text")))


_CLEAN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"


@check(
    f"SELECT url, replace(replace(array_to_string(regexp_extract_all({_CLEAN}, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '&quot;', '\"'), '&amp;', '&') AS title FROM pages"
)
def page_title(spark, sf):
    return pages(spark, sf).select("url", html.page_title(F.col("html")).alias("title"))


LABEL = f"CASE WHEN {PATH} IN ('', '/') THEN {HOST} ELSE regexp_replace({HOST} || {PATH}, '/$', '') END"


@check(f"SELECT url, {LABEL} AS label FROM pages")
def url_label(spark, sf):
    return pages(spark, sf).select("url", urls.url_label(F.col("url")).alias("label"))


_HREFS = ["a/b", "/a/b", "../x", "?q=1", "#f", "//h.example/p", "HTTPS://o.example/z", "mailto:a@b", "./", "", "../../a/./b/../c", "für?x#ü"]
_FOLDER = f"regexp_replace({PATH}, '[^/]*$', '')"


@check(
    f"SELECT page_id, CASE page_id % 12 WHEN 0 THEN {BASE} || {_FOLDER} || 'a/b' WHEN 1 THEN {BASE} || '/a/b' "
    f"WHEN 2 THEN {BASE} || regexp_replace({_FOLDER}, '[^/]+/$', '') || 'x' WHEN 3 THEN {BASE} || {PATH} || '?q=1' "
    "WHEN 4 THEN regexp_replace(url, '#.*$', '') || '#f' WHEN 5 THEN regexp_extract(url, '^https?:') || '//h.example/p' "
    f"WHEN 6 THEN 'https://o.example/z' WHEN 8 THEN {BASE} || {_FOLDER} WHEN 9 THEN url "
    f"WHEN 10 THEN {BASE} || regexp_replace(regexp_replace({_FOLDER}, '[^/]+/$', ''), '[^/]+/$', '') || 'a/c' "
    f"WHEN 11 THEN {BASE} || {_FOLDER} || 'f%C3%BCr?x#%C3%BC' END AS dst FROM pages"
)
def resolve_url(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", urls.resolve_url(F.col("url"), pick(_HREFS, F.col("page_id"))).alias("dst"))


_ENCODED = "url_encode(href)"
for _char, _code in [("/", "%2F"), (",", "%2C"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), ("@", "%40"), ("$", "%24"), ("&", "%26"), ("+", "%2B")]:
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_char}')"


@check(
    rf"""WITH found AS (SELECT url, regexp_extract_all({_CLEAN}, '(?is)<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages), """
    "each AS (SELECT url, unnest(h) AS href, unnest(range(len(h))) AS pos FROM found) "
    f"SELECT url AS src, CAST(pos AS INT) AS pos, {BASE} || {_ENCODED} AS dst FROM each"
)
def page_links(spark, sf):
    return paging.page_links(pages(spark, sf))


def edges(spark, sf):
    """Two links from each stored page to another, since none has any of its own."""
    rows = table(spark, sf, "pages").select("page_id", "url")
    n = rows.count()
    to = F.explode(F.array((F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 7 + 2) % n))
    made = rows.select(F.col("url").alias("src"), to.alias("page_id"))
    return made.join(rows, "page_id").select("src", F.col("url").alias("dst"), "page_id")


EDGES = (
    "n AS (SELECT count(*) AS n FROM pages), "
    "made AS (SELECT url AS src, unnest([(page_id * 3 + 1) % n, (page_id * 7 + 2) % n]) AS page_id FROM pages, n), "
    "edges AS (SELECT src, pages.url AS dst, page_id FROM made JOIN pages USING (page_id))"
)
REACHED = (
    f"{EDGES}, ok AS (SELECT DISTINCT url FROM pages WHERE (contains({HOST}, 'example.com') OR contains({HOST}, 'example.org')) "
    f"AND NOT regexp_matches({PATH}, '^/?de/[^/]*$')), "
    "r(url, depth) AS (SELECT url, 0 FROM ok WHERE starts_with(url, 'https://www.') UNION "
    "SELECT ok.url, depth + 1 FROM r JOIN edges ON src = r.url JOIN ok ON ok.url = dst WHERE depth < 3), "
    "reached AS (SELECT url, min(depth) AS depth FROM r GROUP BY url)"
)


def reached(spark, sf):
    rows = pages(spark, sf)
    seeds = rows.where(F.col("url").startswith("https://www."))
    return crawling.crawl(rows, edges(spark, sf), seeds, 3, ["example.com", "example.org"], ["de/*"])


@check(f"WITH RECURSIVE {REACHED} SELECT url, depth FROM reached")
def crawl(spark, sf):
    return reached(spark, sf)


@check(f"WITH {EDGES} SELECT dst AS url, CAST(min(page_id % 5) AS INT) AS depth FROM (SELECT dst, length(src) AS page_id FROM edges) GROUP BY dst")
def visited_dedupe(spark, sf):
    found = edges(spark, sf).select(F.col("dst").alias("url"), (F.length("src") % 5).alias("depth"))
    return crawling.visited_dedupe(found)


@check(
    f"WITH seed AS (SELECT max(url) AS s FROM pages) SELECT url, strlen(html) AS bytes FROM pages, seed "
    f"WHERE regexp_replace({PATH}, '/$', '') = regexp_replace({PATH.replace('url', 's')}, '/$', '') ORDER BY url LIMIT 1"
)
def crawl_select(spark, sf):
    rows = pages(spark, sf)
    seed = rows.agg(F.max("url")).first()[0]
    return paging.crawl_select(rows, seed).select("url", F.octet_length("html").cast("bigint").alias("bytes"))


@check(
    f"WITH RECURSIVE {REACHED} SELECT CAST(0 AS BIGINT) AS part, 'Web Crawl Structure:' || chr(10) || "
    f"string_agg(repeat('  ', depth) || '├── ' || {LABEL} || chr(10), '' ORDER BY depth, url) AS tree FROM reached"
)
def web_tree(spark, sf):
    return paging.web_tree(reached(spark, sf))


# PDF text: five documents' texts to a file, with lines of raw PDF before some.
_RAW = "% comment\n/Type /Page\n1 0 obj\n   plain words  \n"
_PDF = (
    "pdf AS (SELECT 'd' || (doc_id // 5) || '.pdf' AS path, doc_id % 5 + 1 AS page_no, "
    f"CASE WHEN doc_id % 2 = 0 THEN '{_RAW}' ELSE '' END || CASE WHEN starts_with(lang, 'e') THEN '' ELSE 'endobj' END || text AS text FROM documents)"
)
_TRIM = r"regexp_replace(x, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g')"
_CLEANED = (
    "CASE WHEN contains(text, '%PDF-') OR contains(text, 'endobj') THEN '' ELSE array_to_string(list_filter(list_transform("
    rf"string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)), lambda x: {_TRIM}), "
    "lambda x: x <> '' AND NOT starts_with(x, '%') AND NOT starts_with(x, '/') AND NOT contains(x, 'obj') AND NOT contains(x, 'stream')), chr(10) || chr(10)) END"
)


def pdf_pages(spark, sf):
    docs = table(spark, sf, "documents")
    before = F.when(F.col("doc_id") % 2 == 0, _RAW).otherwise("")
    raw = F.when(F.col("lang").startswith("e"), "").otherwise("endobj")
    return docs.select(
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 5).cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("doc_id") % 5 + 1).alias("page_no"),
        F.concat(before, raw, "text").alias("text"),
    )


@check(f"WITH {_PDF} SELECT path, page_no, {_CLEANED} AS clean FROM pdf")
def pdf_clean_text(spark, sf):
    return pdf_pages(spark, sf).select("path", "page_no", text.pdf_clean_text(F.col("text")).alias("clean"))


@check(
    f"WITH {_PDF}, c AS (SELECT path, page_no, {_CLEANED} AS clean FROM pdf) "
    "SELECT path, CAST(0 AS BIGINT) AS part, '# PDF Content: ' || path || repeat(chr(10), 2) || string_agg('## Page ' || page_no || repeat(chr(10), 2) || clean || repeat(chr(10), 2), '' ORDER BY page_no) AS content "
    "FROM c WHERE clean <> '' GROUP BY path"
)
def pdf_assemble(spark, sf):
    return assemble.pdf_assemble(pdf_pages(spark, sf))
