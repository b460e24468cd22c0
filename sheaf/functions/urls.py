"""URL columns: parts, predicates, resolution of links. All native expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.columns import let
from sheaf.functions.globs import any_glob_regex, whole

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"\A[^?#]*(\?[^#]*)"
_FRAGMENT = r"\A[^#]*#([\s\S]+)"
# A control byte, a broken escape outside the query, or a colon in the first
# segment of a relative path: none of these parse.
_BROKEN = r"[\x00-\x1F\x7F]|\A[^?#]*%(?![0-9A-Fa-f]{2})|#[\s\S]*%(?![0-9A-Fa-f]{2})|\A(?![A-Za-z][A-Za-z0-9+.-]*:)[^/?#]*:"
_BROKEN_HOST = r"[ <>\"\\^`{|}]|:[^0-9\]][^\]@]*\z"

# Bytes a path or a fragment may hold without being escaped again, and
# what remains as it is when escaping has to be done.
_VALID_PATH = r"\A[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*\z"
_VALID_FRAGMENT = r"\A[A-Za-z0-9\-_.~$&+,/:;=?@!'()*\[\]%]*\z"
_PLAIN_IN_PATH = "/$&+,:;=@~"
_PLAIN_IN_FRAGMENT = "/$&+,:;=@~?!()*"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host(url: Column) -> Column:
    """Host with its port, without user information."""
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"\A[\s\S]*@", "")


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_path(url: Column) -> Column:
    """Path with its escapes decoded."""
    return _unescape(raw_path(url))


def parses(url: Column) -> Column:
    return ~url.rlike(_BROKEN) & ~F.regexp_extract(url, _AUTHORITY, 1).rlike(_BROKEN_HOST)


def is_url(text: Column) -> Column:
    """Both a scheme and a host."""
    return parses(text) & (scheme(text) != "") & (host(text) != "")


def url_exclude(url: Column, globs: Iterable[str]) -> Column:
    """True where a glob matches the URL's path, with or without its leading slash."""
    body = any_glob_regex(globs)
    if body is None:
        return F.lit(False)
    path = url_path(url)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    bare = F.regexp_replace(path, r"\A/", "")
    return parses(url) & (bare.rlike(whole(body)) | path.rlike(whole(body)))


def domain_allow(url: Column, domains: Iterable[str]) -> Column:
    """True where the host contains any of the strings; no strings allow all."""
    domains = list(domains)
    if not domains:
        return parses(url)
    where = host(url)
    hit = F.lit(False)
    for domain in domains:
        hit = hit | where.contains(domain)
    return parses(url) & hit


def single_page(url: Column, seed: str | Column) -> Column:
    """If the seed has a path, only that path passes, final slash ignored."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    wanted = url_path(seed)
    same = F.regexp_replace(url_path(url), r"/\z", "") == F.regexp_replace(wanted, r"/\z", "")
    return wanted.isin("", "/") | same


def url_label(url: Column) -> Column:
    """Host alone, or host and cleaned path."""

    def label(p: Column) -> Column:
        clean = F.concat(p["host"], F.regexp_replace(remove_dots(p["path"]), r"(?<=.)/\z", ""))
        return F.when(p["path"].isin("", "/"), p["host"]).otherwise(F.regexp_replace(clean, "/{2,}", "/"))

    parts = F.struct(host(url).alias("host"), url_path(url).alias("path"))
    return F.when(parses(url), let(parts, label)).otherwise(url)


def remove_dots(path: Column) -> Column:
    """Take out ``.`` and ``..`` segments; the result starts with a slash."""
    return let(path, _remove_dots)


def _remove_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    # The empty part before the first slash must not count as a segment to go up from.
    bare = F.when(path.startswith("/"), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    kept = F.array_join(F.aggregate(bare, empty, step), "/")
    slash = F.when(path.rlike(r"(?:\A|/)\.\.?\z"), "/").otherwise("")
    out = let(kept, lambda k: F.concat(F.lit("/"), k, F.when(k == "", "").otherwise(slash)))
    return (
        F.when(path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"), out)
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def _unescape(text: Column) -> Column:
    """Decode %XX only; a plus sign stays."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def _escape(text: Column, valid: str, plain: str) -> Column:
    """Escape once more only what is not already a valid encoding."""

    def again(raw: Column) -> Column:
        out = F.url_encode(_unescape(raw))
        out = F.replace(F.replace(out, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
        for char in plain:
            out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
        return F.when(raw.rlike(valid), raw).otherwise(out)

    return let(text, again)


def resolve_url(base: Column, href: Column) -> Column:
    """An href against its page's URL; null unless the result is http or https."""
    parts = F.struct(
        *[
            part.alias(f"{whose}_{what}")
            for whose, url in (("own", href), ("base", base))
            for what, part in (
                ("scheme", scheme(url)),
                ("authority", F.regexp_extract(url, _AUTHORITY, 1)),
                ("path", raw_path(url)),
                ("query", F.regexp_extract(url, _QUERY, 1)),
                ("fragment", F.regexp_extract(url, _FRAGMENT, 1)),
            )
        ]
    )
    opaque = href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:(?!/)")
    return F.when(parses(href) & parses(base) & ~opaque, let(parts, _combine))


def _combine(p: Column) -> Column:
    absolute = (p["own_scheme"] != "") | (p["own_authority"] != "")
    empty = ~absolute & (p["own_path"] == "")
    same_page = empty & (p["own_query"] == "")

    to_scheme = F.when(p["own_scheme"] != "", p["own_scheme"]).otherwise(p["base_scheme"])
    authority = F.when(absolute, p["own_authority"]).otherwise(p["base_authority"])
    merged = (
        F.when(absolute | p["own_path"].startswith("/"), p["own_path"])
        .when(empty, p["base_path"])
        .otherwise(F.concat(F.regexp_replace(p["base_path"], r"[^/]*\z", ""), p["own_path"]))
    )
    merged = let(merged, lambda m: F.when(m == "", m).otherwise(remove_dots(m)))
    query = F.when(same_page, p["base_query"]).otherwise(p["own_query"])
    fragment = F.when(same_page & (p["own_fragment"] == ""), p["base_fragment"]).otherwise(p["own_fragment"])
    after = let(
        _escape(fragment, _VALID_FRAGMENT, _PLAIN_IN_FRAGMENT), lambda f: F.when(f == "", "").otherwise(F.concat(F.lit("#"), f))
    )
    out = F.concat(to_scheme, F.lit("://"), authority, _escape(merged, _VALID_PATH, _PLAIN_IN_PATH), query, after)
    return F.when(to_scheme.startswith("http"), out)
