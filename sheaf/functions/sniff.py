"""Text or binary, from the first 512 bytes (the WHATWG sniffing rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What begins a text format in spite of control bytes, what begins a
# binary format, and the bytes no text holds.
HTML_TAGS = (
    "!DOCTYPE HTML",
    "HTML",
    "HEAD",
    "SCRIPT",
    "IFRAME",
    "H1",
    "DIV",
    "FONT",
    "TABLE",
    "A",
    "STYLE",
    "TITLE",
    "B",
    "BODY",
    "BR",
    "P",
    "!--",
)
TEXT_STARTS = (r"[\t\n\f\r ]*<\?xml", "%PDF-", r"\xFE\xFF", r"\xFF\xFE", r"\xEF\xBB\xBF")
BINARY_STARTS = (
    "%!PS-Adobe-",
    "BM",
    "GIF87a",
    "GIF89a",
    r"RIFF[\s\S]{4}WEBPVP",
    r"RIFF[\s\S]{4}AVI ",
    r"RIFF[\s\S]{4}WAVE",
    r"FORM[\s\S]{4}AIFF",
    r"\xFF\xD8\xFF",
    "ID3",
    "OTTO",
    "ttcf",
    "wOFF",
    "wOF2",
)
BINARY_BYTES = r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"

_HTML = r"(?i)\A[\t\n\f\r ]*<(?:" + "|".join(HTML_TAGS) + ")[ >]"


def text_sniff(content: Column) -> Column:
    """True for text and PDFs; an empty file is text."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    texts = head.rlike(_HTML) | head.rlike(r"\A(?:" + "|".join(TEXT_STARTS) + ")")
    binary = head.rlike(r"\A(?:" + "|".join(BINARY_STARTS) + ")") | head.rlike(BINARY_BYTES)
    return texts | ~binary
