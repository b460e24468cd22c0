"""Source code reduced to its outline, by native expressions in one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import outlines as o
from sheaf.functions.paths import language_id
from sheaf.functions.columns import let, masked, up_to, up_to_last
from sheaf.functions.text import trim_space

_CHUNKS = "array<struct<kind:string,content:string>>"
LANGUAGES = (*o.BY_KIND, *o.LEXERS)


# What a Java method can begin with inside a word, where a match that begins at the word
# itself does not come first; and what shows that none begins at a word.
_MODIFIERS = ["public", "private", "protected", "static", "final", "abstract"]
_METHOD_START = rf"(?:(?<!\w)|(?=(?:{'|'.join(_MODIFIERS)})\s|<))"
_NO_METHOD = r"(?!\s*+\(|(?:\[\])?\s++\w++\s*+\()"
# Ends of patterns, none of which matches behind the last place that holds its end.
_ENDS = (r"-->", r"\*/", r"\}", r"\{", ";", ">")


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(o.java(pattern)), F.lit(group))


def _reach(text: Column, pattern: str) -> Column:
    """The text as far as a match can reach, so that an opener that is never closed is not
    followed to the end of the text each time."""
    end = next((e for e in _ENDS if pattern.endswith(e)), None)
    if end is None:
        return text
    text = up_to(text, end.replace("\\", ""))
    # Every opening parenthesis then has a closing one behind it.
    return up_to_last(text, r"\)[^{]*\{") if r"\([^)]*\)" in pattern and end == r"\{" else text


def _all_of(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Every match as a chunk of one kind."""
    found = _found(text, pattern, group)
    return F.transform(found, lambda c: F.struct(F.lit(kind).alias("kind"), trim_space(c).alias("content")))


def _whole_words(pattern: str) -> str:
    """The pattern of Java methods, as group 1, tried at words and not at every character.

    A match begins with a word, ``<``, or a modifier and white space, which is then the
    end of a word. Words that end otherwise are passed over whole, those that
    ``_NO_METHOD`` tells without a trial. ``\\G`` lets no search begin elsewhere.
    """
    ends = "|".join(_MODIFIERS)
    last = "".join(sorted({word[-1] for word in _MODIFIERS}))
    plain = rf"\w++(?:(?<![{last}])|(?<!{ends})|(?!\s)){_NO_METHOD}"
    tried = rf"(?!{pattern})(?:\w+?(?=(?:{ends})\s)|\w++|<)"
    return rf"\G(?:[^\w<]+|{plain}|{tried})*+({pattern})"


def _first_letters(pattern: str) -> str:
    """A pattern of optional words and a keyword, tried only where two letters are such
    that it can begin there; one of tags, only at ``<``. The matches stay the same."""
    if pattern.startswith("<") and "|<" in pattern:
        return f"(?=<)(?:{pattern})"
    words, rest = [], pattern
    while group := re.match(r"\(\?:((?:[a-z]+\\s\+\|?)+)\)[?*]", rest):
        words += group[1].split("|")
        rest = rest[group.end() :]
    if words and rest[:2].isalpha() and rest[:2].islower():
        first, second = ("".join(sorted({word[i] for word in [*words, rest]})) for i in (0, 1))
        return f"(?=[{first}][{second}])" + pattern
    return pattern


def _by_kind(text: Column, lang: str) -> Column:
    parts = []
    for kind, pattern in o.BY_KIND[lang]:
        # What follows a word in these patterns is never part of one, so the words need
        # not give anything back.
        reach = _reach(text, pattern)
        pattern = pattern.replace(r"\w+", r"\w++")
        method = (lang, kind) == ("java", "method")
        pattern = _whole_words(_METHOD_START + pattern) if method else _first_letters(pattern)
        parts.append(_all_of(reach, pattern, kind, int(method)))
    return F.concat(*parts)


def _kind(chunk: Column, lang: str) -> Column:
    out = None
    for kind, pattern in o.KINDS[lang]:
        hit = chunk.rlike(o.java(pattern))
        value = F.lit(kind) if kind else F.lit(None).cast("string")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _signature(chunk: Column, lang: str) -> Column:
    """A definition's head with the placeholder for its body; other chunks stay."""
    hole = o.PLACEHOLDERS.get(lang)
    if hole is None:
        return chunk
    if lang == "python":
        head = chunk.rlike(r"\A(?:class|def|async)\b")
        return F.when(head, F.concat(chunk, F.lit(hole))).otherwise(chunk)
    bare = F.regexp_replace(chunk, o.java(rf"{o.W}*\{{\z"), "")
    body = chunk.endswith("{") & ~chunk.rlike(r"\A(?:/[/*]|#)")
    if lang == "javascript":
        bare = F.regexp_replace(bare, r"\Aexport[ \t]+default[ \t]+(?:async[ \t]+)?function[ \t]*\*?[ \t]*\([\s\S]*\z", "export default function()")
        arrow = F.regexp_replace(chunk, r"\A(?:const|let|var)[ \t]+([\w$]+)[ \t]*=[ \t]*(?:async[ \t]*)?([^=\n]*?)[ \t]*=>\z", "const $1 = $2 =>")
        return (
            F.when(body, F.concat(bare, F.lit(hole)))
            .when(chunk.endswith("=>") & chunk.rlike(r"\A(?:const|let|var)\b"), F.concat(arrow, F.lit(hole)))
            .otherwise(chunk)
        )
    return F.when(body, F.concat(bare, F.lit(hole))).otherwise(chunk)


def _lexed(text: Column, lang: str, css_declarations: bool) -> Column:
    def tidy(match: Column) -> Column:
        chunk = trim_space(match)
        return F.regexp_replace(chunk, o.STRIP_KEYWORDS, "") if lang == "bash" else chunk

    lexer = o.LEXERS[lang]
    if lang == "css":  # all that counts ends in one of these
        text = up_to_last(text, r"[;{}]|\*/")
    found = masked(text, "/*", r"\*/", lambda t: _found(t, lexer)) if o.BLOCK_COMMENT in lexer else _found(text, lexer)
    tokens = F.transform(found, tidy)
    chunks = F.transform(
        tokens, lambda c: F.struct(_kind(c, lang).alias("kind"), _signature(c, lang).alias("content"))
    )
    if lang == "css" and css_declarations:
        chunks = F.flatten(F.transform(chunks, _with_declarations))
    return F.filter(chunks, lambda c: c["kind"].isNotNull() & (c["content"] != ""))


def _with_declarations(chunk: Column) -> Column:
    """A rule followed by its declarations, a block also by its rules."""
    body = F.regexp_replace(chunk["content"], r"\A[^{]*\{", "")
    block = chunk["kind"].isin("media", "keyframes")
    none = F.array().cast(_CHUNKS)
    return F.concat(
        F.array(chunk),
        F.when(block, _all_of(body, o.CSS_RULE, "rule")).otherwise(none),
        F.when(chunk["kind"] == "rule", _all_of(body, o.CSS_DECLARATION, "declaration")).otherwise(none),
    )


def _with_names(chunk: Column) -> Column:
    """A definition followed by its bare name."""
    name = F.regexp_extract(
        chunk["content"], r"\A(?:async[ \t]+)?(?:def|class|func|function|struct|enum|union)[ \t]*(?:\([^)]*\)[ \t]*)?(\w+)", 1
    )
    named = F.struct(F.lit("name").alias("kind"), name.alias("content"))
    return F.when((name != "") & chunk["content"].rlike(r"\A(?:async|def|class|func|function|struct|enum|union)\b"), F.array(chunk, named)).otherwise(F.array(chunk))


def chunks_of(text: Column, lang: str, css_declarations: bool = False, emit_names: bool = False) -> Column:
    """Outline of text in one language: an array of ``(kind, content)``."""
    if lang in o.BY_KIND:
        return _by_kind(text, lang)
    chunks = _lexed(text, lang, css_declarations)
    return F.flatten(F.transform(chunks, _with_names)) if emit_names and lang in ("go", "python", "bash", "c") else chunks


def chunks(text: Column, lang: Column, css_declarations: bool = False, emit_names: bool = False) -> Column:
    """The same by a column of languages; null where the language is none of these."""
    out = None
    for name in LANGUAGES:
        value = chunks_of(text, name, css_declarations, emit_names)
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return out


def outline_join(chunk_array: Column, lang: Column) -> Column:
    """Chunks as one text, each with a line after it; a notice if there are none."""
    notice = None
    for name, text in o.NONE_FOUND.items():
        notice = F.when(lang == name, text) if notice is None else notice.when(lang == name, text)
    notice = notice.otherwise(F.lit(o.NONE_FOUND_ELSE))

    def text_of(found: Column) -> Column:
        body = F.array_join(F.transform(found, lambda c: F.concat(c["content"], F.lit(o.SEPARATOR))), "")
        return F.when(F.size(found) == 0, notice).otherwise(body)

    return let(chunk_array, text_of)


def outline(files: DataFrame, css_declarations: bool = False, emit_names: bool = False) -> DataFrame:
    """Add ``outline``; files in other languages keep their text."""
    lang = language_id(F.col("path"))
    labelled = files.withColumn("_lang", lang)
    text = outline_join(chunks(F.col("content"), F.col("_lang"), css_declarations, emit_names), F.col("_lang"))
    return labelled.withColumn("outline", F.when(F.col("_lang").isNull(), F.col("content")).otherwise(text)).drop("_lang")


def outline_chunks(files: DataFrame, lang: str | None = None, **options) -> DataFrame:
    """``(path, lang, chunk_no, kind, content)``, files of one language or of all."""
    rows = files.select("path", language_id(F.col("path")).alias("lang"), "content")
    rows = rows.where(F.col("lang") == lang) if lang else rows.where("lang is not null")
    found = chunks_of(F.col("content"), lang, **options) if lang else chunks(F.col("content"), F.col("lang"), **options)
    exploded = rows.select("path", "lang", F.posexplode(found).alias("chunk_no", "chunk"))
    return exploded.select("path", "lang", "chunk_no", "chunk.kind", "chunk.content")
