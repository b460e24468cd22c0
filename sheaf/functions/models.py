"""Encodings by alias, their pre-token patterns and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The correction of offline counts; alias to encoding; alias to
# description; the published pre-token pattern of each encoding.
CORRECTION = 1.18

ENCODING_ALIASES = {
    "o200k": ("o200k", "gpt-4o", "gpt-4.1", "gpt-4.5"),
    "cl100k": (
        "cl100k",
        "llama3",
        "llama-3",
        "gpt-4",
        "gpt-3.5-turbo",
        "text-embedding-3-large",
        "text-embedding-3-small",
        "text-embedding-ada-002",
        "text-ada-002",
    ),
    "p50k": ("p50k",),
    "r50k": ("r50k", "gpt2", "text-ada-001", "text-curie-001", "text-babbage-001"),
}
DEFAULT_ENCODING = "o200k"

MODERN_MODELS = "OpenAI gpt-4+, Anthropic Claude Haiku/Sonnet/Opus 3+ models"
MODEL_ALIASES = {
    MODERN_MODELS: ("o200k", "gpt-4o", "gpt-4.1", "gpt-4.5"),
    "Llama3, OpenAI <4o models, text-embedding-ada-002, gpt-4 etc...": ("cl100k",),
    "OpenAI code models, text-davinci-002, text-davinci-003 etc...": ("p50k",),
    "Legacy models like llama2, GPT-3, davinci etc...": ("r50k", "gpt2", "llama2", "llama-2"),
}

_GPT2_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKEN_PATTERNS = {
    "r50k": _GPT2_PATTERN,
    "p50k": _GPT2_PATTERN,
    "cl100k": (
        r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+"
        r"| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
    ),
    "o200k": (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
        r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
        r"|\p{N}{1,3}"
        r"| ?[^\s\p{L}\p{N}]+[\r\n/]*"
        r"|\s*[\r\n]+"
        r"|\s+(?!\S)"
        r"|\s+"
    ),
}


def _lookup(key: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    out = None
    for value, names in groups.items():
        out = F.when(key.isin(*names), value) if out is None else out.when(key.isin(*names), value)
    return out.otherwise(F.lit(default))


def encoding_of(alias: Column) -> Column:
    """Encoding an alias is counted with; unknown aliases use the default."""
    return _lookup(alias, ENCODING_ALIASES, DEFAULT_ENCODING)


def encoding_name(alias: str) -> str:
    """The same for a plain string."""
    return next((e for e, names in ENCODING_ALIASES.items() if alias in names), DEFAULT_ENCODING)


def model_info(alias: Column) -> Column:
    """Models an alias stands for. Its aliases differ from those of ``encoding_of``."""
    return _lookup(alias, MODEL_ALIASES, MODERN_MODELS)


def pretokens(text: Column, encoding: str) -> Column:
    """Text split as the encoding does before merging, as an array.

    ``(?U)`` makes ``\\s`` Unicode, as the tokeniser has it. ``$`` is the very end of
    the text there, which Java writes ``\\z``.
    """
    pattern = PRETOKEN_PATTERNS[encoding_name(encoding)].replace("$", r"\z")
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def corrected(raw: Column) -> Column:
    """Offline count with the correction applied, truncated."""
    return F.floor(raw.cast("double") * F.lit(CORRECTION)).cast("bigint")
