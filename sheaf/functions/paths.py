"""Columns over slash-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension (lower case) to language.
LANGUAGE_OF_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".sh": "bash",
    ".bash": "bash",
    ".c": "c",
    ".h": "c",
    ".css": "css",
    ".html": "html",
    ".htm": "html",
    ".rs": "rust",
    ".java": "java",
    ".swift": "swift",
}


def file_ext(path: Column) -> Column:
    """From the last dot of the last element on, dot included; '' without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The directory of a path; '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """Every directory above a path, topmost first, without the root."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(dirs, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def walk_key(path: Column) -> Column:
    """A string whose byte order is the order of a directory walk.

    Paths compare element by element: ``a/b`` comes before ``a.b``.
    """
    return F.translate(path, "/", "\x01")


def language_id(path: Column) -> Column:
    """Language of a path by its extension; null if unknown."""
    pairs = [F.lit(v) for pair in LANGUAGE_OF_EXTENSION.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(file_ext(path)))


def display_path(root: Column, path: Column, single_file: bool = False) -> Column:
    """Relative form: base name of the root and the path, or just the file's name."""
    if single_file:
        return base_name(path)
    return F.concat_ws("/", base_name(F.regexp_replace(root, "/+$", "")), path)
