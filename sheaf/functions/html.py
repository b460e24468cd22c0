"""Titles and anchors of stored HTML, by native expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.columns import let, up_to_last

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Openers of what is hidden, each with what ends it.
_OPENERS = (("<!--", "-->"), (r"<script\b", r"</script\s*>"), (r"<style\b", r"</style\s*>"))
_MARK = "\ue000"
_TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
_HREF = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_PIECE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def unescape(text: Column) -> Column:
    """Decode character references, named and numeric."""
    # The standard library's table; the forms without a semicolon are left alone.
    # A map is searched from its start, so names are kept by their first two letters.
    names: dict[str, dict[str, str]] = {}
    for k, v in html5.items():
        if k.endswith(";"):
            names.setdefault(k[:1], {}).setdefault(k[:2], {})[k] = v
    table = F.from_json(F.lit(json.dumps(names)), "map<string,map<string,map<string,string>>>")

    def named(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        first = F.try_element_at(table, F.substr(name, F.lit(1), F.lit(1)))
        return F.try_element_at(F.try_element_at(first, F.substr(name, F.lit(1), F.lit(2))), name)

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"\A&#0*([0-9]+);\z", 1)
        hexes = F.regexp_extract(piece, r"\A&#[xX]0*([0-9A-Fa-f]+);\z", 1)
        # More digits than the last character has mean a number beyond it.
        tens = F.when(F.length(digits) > 7, F.lit("9999999")).otherwise(digits)
        code = F.when(digits != "", F.hex(tens.try_cast("bigint")))
        code = code.when(hexes != "", F.when(F.length(hexes) > 6, F.lit("FFFFFF")).otherwise(hexes))
        # Out of range and surrogates become the replacement character.
        bad = piece.rlike(r"\A&#(?:0*|[xX]0*|[xX]0*[dD][89A-Fa-f][0-9A-Fa-f]{2});\z") | (
            F.conv(code, 16, 10).cast("bigint") > 0x10FFFF
        )
        char = F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(code.isNotNull(), char)
            .otherwise(F.coalesce(named(piece), piece))
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decode), "")).otherwise(text)


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles, whose text holds no elements.

    An opener with no end behind it hides nothing. A mark takes such openers out of the
    search, so that none is followed to the end of the page; a page that holds the mark
    itself is searched as it is.
    """
    marked = html
    for opener, end in _OPENERS:

        def with_marks(head: Column, page: Column = marked, opener: str = opener) -> Column:
            tail = F.substr(page, F.length(head) + 1)
            return F.concat(head, F.regexp_replace(tail, f"(?is)<(?={opener[1:]})", f"<{_MARK}"))

        marked = _open_ended(marked, opener, end, with_marks)
    shown = F.replace(F.regexp_replace(marked, _HIDDEN, ""), F.lit(_MARK), F.lit(""))
    return F.when(F.contains(html, F.lit(_MARK)), F.regexp_replace(html, _HIDDEN, "")).otherwise(shown)


def _open_ended(page: Column, opener: str, end: str, with_marks) -> Column:
    """``page`` with marks in the openers behind the last ``end``, if there are any."""
    head = up_to_last(page, f"(?i:{end})")
    return let(head, lambda h: F.when(F.substr(page, F.length(h) + 1).rlike(f"(?i){opener}"), with_marks(h)).otherwise(page))


def page_title(html: Column) -> Column:
    """Text of all title elements, one after the other."""
    return unescape(F.array_join(F.regexp_extract_all(up_to_last(visible(html), r"(?i:</title\s*>)"), F.lit(_TITLE), F.lit(1)), ""))


def hrefs(html: Column) -> Column:
    """The href of every anchor that has one, in document order."""
    found = F.regexp_extract_all(visible(html), F.lit(_HREF), F.lit(1))
    return F.transform(found, lambda h: unescape(F.regexp_replace(h, r"""\A["']|["']\z""", "")))
