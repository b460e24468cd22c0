"""Byte-level BPE, encoded by dynamic programming over byte prefixes.

The encoding of a prefix ends in exactly one token, and the tokens before it encode what
stands before it. So one number per prefix, its last token, is the whole encoding: a
token fits behind a prefix if it and the prefix's last token stay two tokens when their
bytes are encoded together. Appending to a piece computes further prefixes
only, and after an edit the prefixes before it stay as they are.

Cases: a null or empty text has no tokens; ids outside the vocabulary, and null ones,
decode to no bytes. Other columns stay as they are; a column with the result's name is
replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import fresh

# Pieces of texts and pairs that a worker remembers; the longest piece in characters.
PARTS, MEMO, MEMO_CHARS = 1 << 18, 1 << 17, 48
# Places for pairs, 9 bytes each.
PLACES = 1 << 19
# Characters after which a task passes on what it has; new pieces encoded together.
FLUSH, TOGETHER = 1 << 18, 1 << 13


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Pieces:
    """Encodes pieces of bytes; no merge crosses a piece.

    ``trie`` leads from a node and a byte, ``node << 8 | byte``, to the next node;
    ``token`` has the node's rank, or -1.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.trie: dict[int, int] = {}
        self.token = [-1]
        for t, rank in ranks.items():
            node = 0
            for byte in t:
                step = node << 8 | byte
                node = self.trie.get(step, 0)
                if not node:
                    node = self.trie[step] = len(self.token)
                    self.token.append(-1)
            self.token[node] = rank
        self.ordered = True
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._lengths = {r: len(t) for t, r in ranks.items()}
        self._latest = np.full(PLACES, -1 << 62, np.int64), np.zeros(PLACES, bool)

    def merged(self, piece: bytes) -> list[bytes]:
        """By merges, lowest rank first: for a token or a pair of them, not for texts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            if len(parts) == 2:
                self._parts[low] = (self.ranks[parts[0]], self.ranks[parts[1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge puts together; none for one byte and for
        tokens that merges do not lead to."""
        if token not in self._parts:
            self._parts[token] = None
            self.merged(self.bytes[token])
            made = self._parts[token]
            self.ordered &= made is None or max(made) < token
        return self._parts[token]

    def whole(self, token: int) -> bool:
        return len(self.bytes[token]) == 1 or self.parts(token) is not None

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart: no merge over their border comes before
        those that make them. Merges are undone from the last one, along the border.
        Before the first token ``a`` is -1."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[key] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        return self.whole(b) and (a < 0 or self._apart(a, b))

    def _apart(self, a: int, b: int) -> bool:
        first, before = (a, b), 1 << 60
        while True:
            if self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 60) < before:
                apart = False
                break
            left, right = self.parts(a), self.parts(b)
            if not left and not right:
                apart = True
                break
            if left and (not right or a > b):
                before, a = a, left[1]
            else:  # of two equal merges the left one comes first
                before, b = b + 1, right[0]
        if self.ordered:
            return apart
        whole = [self.bytes[t] for t in first]  # parts that rank above their token
        return self.merged(b"".join(whole)) == whole

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """``last`` for a prefix of ``piece``, carried on to its end: ``last[i]`` is the
        last token of the first ``i`` bytes."""
        trie, token, known, done, n = self.trie.get, self.token, self._fits.get, len(last), len(piece)
        last = last + [-1] * (n + 1 - done)
        for start in range(max(0, done - self.longest), n):
            node, tail = 0, last[start]
            for end in range(start, n):
                node = trie(node << 8 | piece[end])
                if node is None:
                    break
                t = token[node]
                if t >= 0 and last[end + 1] < 0:
                    fits = known(tail << 32 | t) if start else self.whole(t)
                    if fits or (fits is None and self.fits(tail, t)):
                        last[end + 1] = t
        if n and -1 in last[1:]:
            raise ValueError(f"no token for byte {piece[last.index(-1, 1) - 1]}")
        return last

    @property
    def longest(self) -> int:
        if not hasattr(self, "_longest"):
            self._longest = max(map(len, self.ranks), default=1)
        return self._longest

    def ids(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """A piece that is a token is that token, as merges need not lead to it."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = self.extend(piece, [-1]) if last is None else last
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def _steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``trie`` as a hash table with open places, and ``token``, to look up many at once."""
        if not hasattr(self, "_table"):
            keys, nodes = (np.fromiter(x, np.int64, len(self.trie)) for x in (self.trie.keys(), self.trie.values()))
            size = 1 << max(4, (4 * len(keys)).bit_length())
            found, to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
            left, at = np.arange(len(keys)), _spread(keys, size)
            while len(left):
                free = left[found[at[left]] == -1]
                found[at[free]], to[at[free]] = keys[free], nodes[free]
                left = left[found[at[left]] != keys[left]]
                at[left] = (at[left] + 1) % size
            self._table = found, to, np.array(self.token, np.int32)
        return self._table

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``trie`` of many nodes and bytes, -1 for none."""
        found, to, _ = self._steps()
        key = node.astype(np.int64) << 8 | byte
        at, out, left = _spread(key, len(found)), np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(left):
            there = found[at]
            hit = there == key[left]
            out[left[hit]] = to[at[hit]]
            more = ~hit & (there >= 0)
            left, at = left[more], (at[more] + 1) % len(found)
        return out

    def _all_fit(self, keys: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs, the latest of each place of a table at hand."""
        pairs, fit = self._latest
        at = _spread(keys, len(pairs))
        for i in np.flatnonzero(pairs[at] != keys).tolist():
            key, place = int(keys[i]), at[i]
            if pairs[place] != key:
                fit[place], pairs[place] = self._fit(key >> 32, key & 0xFFFFFFFF), key
        out = fit[at]
        for i in np.flatnonzero(pairs[at] != keys).tolist():  # two pairs of one place
            out[i] = self._fit(int(keys[i]) >> 32, int(keys[i]) & 0xFFFFFFFF)
        return out

    def all_ids(self, pieces: list[bytes]) -> list[bytes]:
        """``ids`` of many pieces, as bytes, whose prefixes get their last tokens together: those of
        one byte, then those of two and so on."""
        if not pieces:
            return []
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.concatenate([[0], np.cumsum(size + 1)])  # of a piece's prefixes, the empty one first
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        stop = np.repeat(begin[1:] - 1, size + 1)
        last = np.full(len(data), -2, np.int64)
        last[begin[:-1]] = -1
        # All tokens at all places.
        start = np.flatnonzero(np.arange(len(data)) < stop)
        end, node, tokens = start, np.zeros(len(start), np.int32), self._steps()[2]
        edges = [(start[:0], end[:0], start[:0])]
        while len(start):
            node = self._next(node, data[end])
            alive = node >= 0
            start, end, node = start[alive], end[alive] + 1, node[alive]
            is_token = tokens[node] >= 0
            edges.append((start[is_token], end[is_token], tokens[node[is_token]].astype(np.int64)))
            on = end < stop[start]
            start, end, node = start[on], end[on], node[on]
        start, end, token = map(np.concatenate, zip(*edges, strict=True))
        length = end - np.repeat(begin[:-1], size + 1)[end]
        order = np.argsort(length, kind="stable")
        start, end, token = start[order], end[order], token[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(length))]).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            fit = self._all_fit(last[start[a:b]] << 32 | token[a:b])
            last[end[a:b][fit]] = token[a:b][fit]
        if (last == -2).any():
            raise ValueError(f"no token for byte {data[np.flatnonzero(last == -2)[0] - 1]}")
        lasts, lengths, out = last.tolist(), self._lengths, []
        for piece, i, n in zip(pieces, begin.tolist(), size.tolist(), strict=False):
            if (whole := self.ranks.get(piece)) is not None:
                out.append(array("i", (whole,)).tobytes())
                continue
            ids = []
            while n:
                t = lasts[i + n]
                ids.append(t)
                n -= lengths[t]
            ids.reverse()
            out.append(array("i", ids).tobytes())
        return out


def _spread(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


class Remembered(dict):
    """What ``make`` gives, ids as bytes, ``most`` at once: when half of them are new, those
    that were not asked for since the last time are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        made = self.before.get(key) or self.make(key)
        if len(key) <= MEMO_CHARS:
            self.keep(key, made)
        return made

    def keep(self, key: str, made: bytes) -> None:
        self.before.pop(key, None)
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        self[key] = made


class Encoder:
    """Texts to ids: cut into pieces, whose ids are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = Pieces(ranks)
        self.split = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match
        self.piece = Remembered(lambda p: array("i", self.pieces.ids(p.encode())).tobytes(), PARTS)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. New pieces of all of them are encoded together, long ones
        one by one."""
        cut = [self.split(t) for t in texts]
        there = set().union(*cut)
        known = {p: ids for p in there if (ids := self.piece.get(p) or self.piece.before.get(p))}
        new = [p for p in there if p not in known and len(p) <= MEMO_CHARS]
        for i in range(0, len(new), TOGETHER):
            some = new[i : i + TOGETHER]
            known.update(zip(some, self.pieces.all_ids([p.encode() for p in some]), strict=True))
        for p in there:
            if p not in known:
                known[p] = self.piece[p]
            elif p not in self.piece:
                self.piece.keep(p, known[p])
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cut]

    def _ids(self, piece: str) -> list[int]:
        return np.frombuffer(self.piece[piece], np.int32).tolist()

    def splice(self, text: str, ids: list[int], start: int, stop: int, new: str) -> tuple[str, list[int]]:
        """``text`` with ``text[start:stop]`` replaced by ``new``, and its ids.

        Pieces that end two characters before the edit stay, as the pattern looks no
        further ahead, and so do all pieces after the first end that old and new text
        share beyond the edit. Only the pieces between are encoded; the first of them
        carries on from the prefixes that it shares with the old one.
        """
        edited = text[:start] + new + text[stop:]
        at = used = 0  # characters and ids of the pieces that stay
        while (m := self.match(text, at)) and m.end() + 1 < start:
            used += len(self._ids(m.group()))
            at = m.end()
        old_at, old_used, new_at, grown = at, used, at, []
        shift = len(edited) - len(text)
        while True:
            if new_at >= start + len(new) and new_at - shift == old_at:
                return edited, ids[:used] + grown + ids[old_used:]
            if new_at - shift >= old_at and (m := self.match(text, old_at)):
                old_used += len(self._ids(m.group()))
                old_at = m.end()
            elif m := self.match(edited, new_at):
                grown += self._near(text[at:], m.group()) if new_at == at else self._ids(m.group())
                new_at = m.end()
            else:
                return edited, ids[:used] + grown

    def _near(self, old: str, piece: str) -> list[int]:
        m = self.match(old)
        a, b = (m.group().encode() if m else b""), piece.encode()
        if b in self.pieces.ranks or not a:
            return self._ids(piece)
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        last = self.pieces.extend(a[:same], [-1])
        return self.pieces.ids(b, self.pieces.extend(b, last))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder per worker: its memory outlives a task."""
    name, ranks = shared.value
    if name + pattern not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name + pattern] = Encoder(ranks, pattern)
    return _ENCODERS[name + pattern]


def _share(spark: SparkSession, ranks: dict[bytes, int]):
    """A vocabulary, by its digest, for every task: it has a fixed size, whatever the corpus."""
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks))


def _added(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    rest = df.drop(name)
    return rest, T.StructType([*rest.schema.fields, T.StructField(name, kind)])


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` in size."""
    group = np.concatenate([[0], np.cumsum(sizes)])[:-1] // most
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every text, in place of a column of that name."""
    shared = _share(docs.sparkSession, ranks)
    (whole,) = fresh(docs, "text")
    rows, schema = _added(docs.withColumn(whole, F.coalesce(text_col, F.lit(""))), ids_col, T.ArrayType(T.IntegerType()))
    at = rows.columns.index(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for whole_batch in batches:
            size = np.diff(np.concatenate([[0], np.cumsum([len(x.as_py()) for x in whole_batch.column(at)])]))
            for batch in _slices(whole_batch, size, FLUSH):
                ids, ends = [], [0]
                for found in encoder.encode_all(batch.column(at).to_pylist()):
                    ids.append(found)
                    ends.append(ends[-1] + len(found))
                flat = pa.array(np.concatenate(ids) if ids else np.array([], np.int32))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids_col])

    return rows.mapInArrow(run, schema).drop(whole)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of its ids."""
    shared = _share(encoded.sparkSession, ranks)
    rows, schema = _added(encoded, bytes_col, T.BinaryType())
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {r: t for t, r in shared.value[1].items()}
        none = max(by_id, default=-1) + 1
        tokens = pa.array([by_id.get(i, b"") for i in range(none + 1)], pa.large_binary())
        for whole_batch in batches:
            size = whole_batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for batch in _slices(whole_batch, size, FLUSH):
                ids = batch.column(at).flatten()
                known = ids.fill_null(none).to_numpy(zero_copy_only=False)
                known = np.where((known < 0) | (known > none), none, known)
                taken = tokens.take(pa.array(known, pa.int32()))
                offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
                lengths = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = offsets[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
                data = taken.buffers()[2] or pa.py_buffer(b"")
                column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), data])
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, bytes_col])

    return rows.mapInArrow(run, schema)


def splice(
    edits: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids",
    start: str = "start", stop: str = "stop", new: str = "new",
) -> DataFrame:
    """Encoded rows after an edit each: ``text[start:stop]`` becomes ``new``, encoded
    again near the edit only. An append is an edit at the end. Null bounds are the end of
    the text, a null ``new`` is empty; bounds outside the text are its ends."""
    shared = _share(edits.sparkSession, ranks)
    names = edits.columns
    places = [names.index(c) for c in (text_col, ids_col, start, stop, new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            texts, ids = [], []
            for text, old, a, b, put in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                text = text or ""
                a = len(text) if a is None else min(max(a, 0), len(text))
                b = len(text) if b is None else min(max(b, a), len(text))
                text, now = encoder.splice(text, old or [], a, b, put or "")
                texts.append(text)
                ids.append(now)
            columns = list(batch.columns)
            columns[places[0]] = pa.array(texts, batch.schema.field(places[0]).type)
            columns[places[1]] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType()) if f.name == ids_col else f.dataType) for f in edits.schema])
    return edits.mapInArrow(run, schema)
