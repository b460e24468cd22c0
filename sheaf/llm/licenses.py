"""License notices in documents, by conditional compression.

A candidate block is the stretch of words around a cue word, of which the beginning
(``CUES``) counts, with ``AROUND`` times a template's length on either side. Every block
is compressed as a zstandard frame, alone and with each template as a raw dictionary. If
that saves ``MIN_GAIN`` of the template's own size, less ``SLACK`` bytes, or more, the
template is aligned with the block: this rules out what is unlike long templates, while
those of a few words are mostly left to the alignment. The best local alignment by words
is the notice. It is confirmed if the share
of template words found reaches ``MIN_COVERAGE`` and no key word (a name, a version)
differs; words of one cue count as found but not as equal. All differences are reported,
``-word`` missing and ``+word`` added, and ``saved`` is what the dictionary saves on the
notice's own words. A copyright line has room for year and holder; where they are longer,
its "All rights reserved" is still a notice.

Words are runs of letters, digits, points and hyphens in lower case; marks between them
do not matter. Cases: null and empty texts and texts without notice give no row, nor does
a notice whose cue words are all missing; equal rows give equal rows; of overlapping
notices the one with most template words stays, then the shortest, then the one that
saves most, then the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.8
# What the dictionary saves: of the template's size at least, less what chance and frames take, in bytes.
MIN_GAIN, SLACK = 0.3, 10
AROUND = 2
CUES = ("licen", "copyright", "permission", "redistribut", "rights")
# Of an alignment: a key found, a word found, a word of one cue, one missing, one added, one added where there is room.
KEY, FOUND, ALIKE, MISSING, ADDED, ROOM = 3.0, 1.0, 0.9, 0.3, 0.12, 0.02
WORD = re.compile(r"[^\W_](?:[\w.\-]*[^\W_])?")
LEVEL = 19
_PLAIN = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


def _size(data: bytes) -> int:
    return len(_PLAIN.compress(data))


def _cue(word: str) -> str | None:
    return next((c for c in CUES if c in word), None)


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    keys: tuple[str, ...]
    room: int = 0  # words that may stand between the template's, such as a year and a holder

    @cached_property
    def words(self) -> list[str]:
        return [w.lower() for w in WORD.findall(self.text)]

    @cached_property
    def reach(self) -> int:
        return AROUND * len(self.words) + self.room

    @cached_property
    def size(self) -> int:
        return _size(" ".join(self.words).encode()) - _size(b"")

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        shared = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=shared, write_content_size=False)

    def saves(self, data: bytes) -> int:
        return _size(data) - len(self.compressor.compress(data))


# Wordings of published license notices.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "2.0")),
    Template(
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
        ("apache", "2.0"),
    ),
    Template("mit", "Released under the MIT License", ("mit",)),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        ("free", "charge"),
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc", "by-nc", "4.0")),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc", "by", "4.0")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc", "by-sa", "4.0")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu", "general", "2")),
    Template("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu", "lesser", "3")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "2.0")),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("source", "binary"),
    ),
    Template("all-rights", "All rights reserved", ("all", "rights", "reserved")),
    Template("copyright", "Copyright. All rights reserved", ("copyright", "rights", "reserved"), room=20),
)

def aligned(template: Template, words: list[str]) -> list[tuple[int, int]]:
    """Places (of the template, of ``words``) of the best local alignment; of equal ones
    the first to end, with every word as near to the next as it can be."""
    own, added = template.words, ROOM if template.room else ADDED
    cues, theirs = [_cue(w) for w in own], [_cue(w) for w in words]
    worth = [KEY if w in template.keys else FOUND for w in own]
    table = [[0.0] * (len(words) + 1)]
    best, end = 0.0, (0, 0)
    for i, w in enumerate(own):
        above, row = table[-1], [0.0]
        for j, v in enumerate(words):
            same = worth[i] if v == w else ALIKE if cues[i] and cues[i] == theirs[j] else -1e9
            row.append(max(0.0, above[j] + same, above[j + 1] - MISSING, row[j] - added))
            if row[-1] > best + 1e-9 or row[-1] > best - 1e-9 and (j + 1, i + 1) < end[::-1]:
                best, end = max(best, row[-1]), (i + 1, j + 1)
        table.append(row)
    out, (i, j) = [], end
    while i and j and table[i][j] > 0:
        same = worth[i - 1] if words[j - 1] == own[i - 1] else ALIKE if cues[i - 1] and cues[i - 1] == theirs[j - 1] else -1e9
        if abs(table[i - 1][j - 1] + same - table[i][j]) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif abs(table[i][j - 1] - added - table[i][j]) < 1e-9:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def differences(template: Template, words: list[str], pairs: list[tuple[int, int]]) -> tuple[list[str], bool]:
    """What differs in an alignment, in order, and whether a key word does: one is missing,
    or one with a digit has another such word before it."""
    own, out, wrong, i, j = template.words, [], False, 0, pairs[0][1]
    for a, b in [*pairs, (len(own), pairs[-1][1] + 1)]:
        gone, more = own[i:a], words[j:b]
        wrong = wrong or any(w in template.keys for w in gone)
        if a < len(own):
            version = own[a] in template.keys and re.search(r"\d", own[a])
            wrong = wrong or bool(version and any(re.search(r"\d", w) for w in more))
            if own[a] != words[b]:
                gone, more = [*gone, own[a]], [*more, words[b]]
        out += ["-" + w for w in gone] + ["+" + w for w in more]
        i, j = a + 1, b + 1
    return out, wrong


def confirmed(template: Template, words: list[str]) -> list[tuple]:
    """(first, last, words found, coverage, differences) of the notices in a block: the
    best, and those before and behind it."""
    out, left = [], [(0, len(words))]
    while left:
        begin, end = left.pop()
        pairs = aligned(template, words[begin:end])
        if len(pairs) < MIN_COVERAGE * len(template.words):
            continue
        first, last = begin + pairs[0][1], begin + pairs[-1][1] + 1
        left += [(begin, first), (last, end)]
        changed, wrong = differences(template, words[begin:end], pairs)
        if not wrong:
            out.append((first, last, len(pairs), len(pairs) / len(template.words), changed))
    return out


def notices(text: str, templates: tuple[Template, ...] = TEMPLATES) -> list[tuple]:
    """(start, stop, name, saved, coverage, differences) of a text, in code points."""
    found = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    known: dict[tuple, list[tuple]] = {}  # blocks of equal words are looked at once
    sizes: dict[bytes, int] = {}
    seen = {}
    for i, (_, _, word) in enumerate(found):
        if not _cue(word):
            continue
        for t in templates:
            begin = max(0, i - t.reach)
            block = [w for _, _, w in found[begin : i + t.reach + 1]]
            data = " ".join(block).encode()
            if (t.name, data) not in known:
                if data not in sizes:
                    sizes[data] = _size(data)
                gain = sizes[data] - len(t.compressor.compress(data))
                known[t.name, data] = confirmed(t, block) if gain >= MIN_GAIN * t.size - SLACK else []
            for first, last, n, coverage, changed in known[t.name, data]:
                seen[begin + first, begin + last, t.name] = n, coverage, changed
    rows = []
    for (first, last, name), (n, coverage, changed) in seen.items():
        data = " ".join(w for _, _, w in found[first:last]).encode()
        saved = next(t for t in templates if t.name == name).saves(data) / _size(data)
        rows.append((found[first][0], found[last - 1][1], name, saved, coverage, changed, n))
    out: list[tuple] = []
    for c in sorted(rows, key=lambda c: (-c[6], c[1] - c[0], -c[3], c[2], c[0])):
        if all(c[1] <= o[0] or c[0] >= o[1] for o in out):
            out.append(c[:6])
    return sorted(out)


SCHEMA = "start int, stop int, license string, saved double, coverage double, differences array<string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row (id, start, stop, license, saved, coverage, differences) per notice. Only
    texts that hold a cue leave the JVM."""
    low = F.lower(F.col(text_col))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(low, F.lit(c))
    some = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text")).where(cue)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, text in enumerate(batch.column(1)):
                for n in notices(text.as_py(), templates):
                    which.append(i)
                    rows.append(n)
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *columns], [id_col, *names])

    kind = some.schema[0].dataType.simpleString()
    return some.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
