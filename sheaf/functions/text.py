"""Formatting of file text and extracted PDF text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Trim all Unicode white space; ``trim`` alone takes blanks only."""
    return F.btrim(text, F.lit(SPACE))


def line_numbers(text: Column) -> Column:
    """``   1 | first line`` and so on; a final newline gives a last, empty line."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(lines, lambda line, i: F.format_string("%4d | %s", i + 1, line)), "\n")


def code_fence(text: Column, ext: Column) -> Column:
    """Fence text; the tag is the extension less its dot."""
    return F.concat(F.lit("```"), F.substr(ext, F.lit(2)), F.lit("\n"), text, F.lit("\n```"))


def format_file(
    text: Column,
    ext: Column,
    number: bool = False,
    fence: bool = True,
    outline: Column | None = None,
) -> Column:
    """Numbered, then fenced text; where ``outline`` is not null it stands alone."""
    out = line_numbers(text) if number else text
    out = code_fence(out, ext) if fence else out
    return out if outline is None else F.coalesce(outline, out)


def thousands(number: Column) -> Column:
    return F.format_number(number.cast("bigint"), 0)


def prompt_affix(text: Column, prefix: str = "", suffixes: tuple[str, ...] | list[str] = ()) -> Column:
    """Put a prefix line before and the suffixes, joined by a blank, after a prompt."""
    parts = [F.lit(prefix)] if prefix else []
    parts.append(text)
    suffix = " ".join(suffixes)
    if suffix:
        parts.append(F.lit(suffix))
    return F.concat_ws("\n", *parts)


def pdf_clean_text(text: Column, strict: bool = True) -> Column:
    """Lines of a PDF page worth keeping, a blank line apart.

    Raw PDF data gives ''. ``strict`` also drops every line that holds ``obj`` or
    ``stream`` anywhere, prose included.
    """
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")
    lines = F.transform(F.split(plain, "\n"), trim_space)

    def keep(line: Column) -> Column:
        good = (line != "") & ~line.startswith("%") & ~line.startswith("/")
        return good & ~line.contains("obj") & ~line.contains("stream") if strict else good

    raw = text.contains("%PDF-") | text.contains("endobj")
    return F.when(raw, F.lit("")).otherwise(F.array_join(F.filter(lines, keep), "\n\n"))


def pdf_detect(content: Column, path: Column) -> Column:
    """A PDF by its signature or its name."""
    signature = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    return signature | F.lower(path).endswith(".pdf")
