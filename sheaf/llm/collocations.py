r"""Phrases that belong together, scored from exact counts of word sequences.

A-Z are lower-cased, texts are split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into
words ``[^\x20\x09]+``. All counts are per language (null: ``und``) and cover all texts.

Sequences are counted in a trie of word ids in each task. Under a shallow node hang
containers, hash tables from the rest of a sequence to its count; a container that grows
beyond ``BURST`` sequences bursts into a node with a container per next word. When a task
holds ``HELD`` sequences, its largest subtrees leave as sorted runs until half is left,
and all that remains leaves at the end. Spark merges the runs: sequences go to partitions
by the hash of the language and all their words, so that a first word, or pair, that
starts a third of all sequences fills no partition.

A sequence occurs ``least`` times only if all shorter ones inside it do. So words are
counted first, then pairs of frequent words, then sequences of three and four whose pairs
are frequent. Tasks know the frequent ones by a bitmap of hashes whose size grows with
their number up to ``MAX_BITS``; what it lets through wrongly is counted and falls short
in the end, so all results are exact whatever its size.

Cases: null and empty texts have no words; repeated rows count repeatedly; ids and other
columns are ignored; without candidates the result is empty.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import kept

LONGEST, LEAST, COVER, TOP = 4, 30, 80, 2000
BURST, HELD = 1 << 12, 1 << 19
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
_CHUNK = 1 << 15  # bits of a row of a bitmap
_ID, _FACTOR = (1 << 32) - 1, 33
_END = b"\xff"  # in no text, as it is no UTF-8
_ENDS = b".,;:!?\n\x0b\x0c\r"
# Letters to lower case, ends of pieces to line feeds, tabs to blanks.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_ENDS) + b" ")


class _Node(dict):
    """Below a word: containers, or further nodes, by the next word. ``ended`` counts the
    sequences that end here."""

    ended = 0


class Trie:
    """Counts of sequences of ids: nodes over containers that burst.

    A sequence is its first id and the rest, later ids in higher bits of one number, so
    that containers hold plain numbers."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0

    def add(self, first: int, rest: int, times: int) -> None:
        above, at = self.root, first
        below = above.get(at)
        if below is None:
            below = above[at] = {}
        while type(below) is _Node:
            if not rest:
                self.size += not below.ended
                below.ended += times
                return
            above, at, rest = below, rest & _ID, rest >> 32
            below = above.get(at)
            if below is None:
                below = above[at] = {}
        n = below.get(rest)
        if n is not None:
            below[rest] = n + times
            return
        below[rest] = times
        self.size += 1
        if len(below) > self.burst:
            node = above[at] = _Node()
            for old, count in below.items():
                if old:
                    node.setdefault(old & _ID, {})[old >> 32] = count
                else:
                    node.ended = count

    def _containers(self, below: dict, head: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], dict]]:
        if type(below) is _Node:
            if below.ended:
                yield head, {0: below.ended}
            for word, further in below.items():
                yield from self._containers(further, (*head, word))
        else:
            yield head, below

    def _size(self, below: dict) -> int:
        return sum(map(self._size, below.values())) + (below.ended > 0) if type(below) is _Node else len(below)

    def spill(self, left: int) -> Iterator[tuple[list[list[int]], list[int]]]:
        """Whole subtrees, the largest first, until ``left`` sequences remain: the ids at
        each place of the sequences, 0 behind their end, and the counts. Small subtrees
        leave together."""
        order = sorted(self.root, key=lambda w: self._size(self.root[w]), reverse=True) if left else list(self.root)
        places, counts = [[] for _ in range(LONGEST)], []
        for word in order:
            if self.size <= left:
                break
            for head, container in self._containers(self.root.pop(word), (word,)):
                for k in range(LONGEST):
                    shift = 32 * (k - len(head))
                    places[k] += [head[k]] * len(container) if shift < 0 else [r >> shift & _ID for r in container]
                counts += container.values()
                self.size -= len(container)
            if len(counts) > 1 << 16:
                yield places, counts
                places, counts = [[] for _ in range(LONGEST)], []
        if counts:
            yield places, counts


def hash_of(lang: Column, phrase: Column) -> Column:
    """The hash that bitmaps go by, of one word or of two."""
    each = F.transform(F.split(phrase, " "), lambda w: F.crc32(F.concat(lang, F.lit("\t"), w).cast("binary")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda h, w: h * _FACTOR + w)


class Bitmap:
    """Which hashes there are, for tasks."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & (8 * len(self.bits) - 1)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def bitmap(found: DataFrame, count: int, max_bits: int = MAX_BITS) -> Broadcast:
    """A bitmap of ``found`` (lang, phrase), 32 bits a phrase but no more than
    ``max_bits``, shared with all tasks."""
    size = max(_CHUNK, min(max_bits, max(MIN_BITS, 1 << (32 * count).bit_length())))
    at = hash_of(F.col("lang"), F.col("phrase")).bitwiseAND(F.lit(size - 1))
    chunks = found.select(F.floor(at / _CHUNK).cast("int").alias("chunk"), F.pmod(at, F.lit(_CHUNK)).alias("bit"))
    rows = chunks.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # no more than ``size`` bits
    bits = bytearray(size // 8)
    for r in rows:
        bits[r.chunk * (_CHUNK // 8) : (r.chunk + 1) * (_CHUNK // 8)] = r.bits
    return found.sparkSession.sparkContext.broadcast(bytes(bits))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")


_COUNTED = "lang string, phrase string, n long"


def _batch(lang: str, phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
    text = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), text, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", held: int = HELD) -> DataFrame:
    """(lang, phrase, n) of all single words."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def out():
            for lang, found in counts.items():
                yield _batch(lang, list(found), list(found.values()))

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(text.as_py().translate(_TABLE).split())
                if sum(map(len, counts.values())) > held:
                    yield from out()
                    counts.clear()
        yield from out()

    return _merged(_texts(docs, text_col, lang_col).mapInArrow(run, _COUNTED))


class _Ids(dict):
    """Ids of the words of a task, from 1, and 0 for the end of a piece; and their hashes."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.start = zlib.crc32(lang.encode() + b"\t")
        self.words: list[bytes] = [b""]
        self.hashes = array("q", [0])

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(zlib.crc32(word, self.start))
        return found


class _Counter:
    """The sequences of one language in a task."""

    def __init__(self, lang: str, frequent: Bitmap, pairs: Bitmap | None, burst: int):
        self.lang, self.frequent, self.pairs, self.trie = lang, frequent, pairs, Trie(burst)
        self.ids, self.waiting, self.n_waiting = _Ids(lang), [], 0

    def text(self, text: bytes) -> None:
        words = text.translate(_TABLE).replace(b"\n", b" " + _END + b" ").split()
        words.append(_END)
        self.waiting.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.n_waiting += len(words)

    def count(self) -> None:
        """What waits goes into the trie, equal sequences at once."""
        if not self.waiting:
            return
        at, hashes = np.concatenate(self.waiting), np.frombuffer(self.ids.hashes, np.int64)
        self.waiting, self.n_waiting = [], 0
        often = self.frequent.has(hashes)
        often[0] = False
        good = often[at]
        link = good[:-1] & good[1:]
        if self.pairs is None:
            starts = np.flatnonzero(link)
            codes, n = np.unique(at[starts] << 32 | at[starts + 1], return_counts=True)
            for code, times in zip(codes.tolist(), n.tolist(), strict=True):
                self.trie.add(code >> 32, code & _ID, times)
            return
        link[link] = self.pairs.has(hashes[at[:-1][link]] * _FACTOR + hashes[at[1:][link]])
        for size in range(3, LONGEST + 1):
            both = link[: len(link) - size + 2].copy()
            for k in range(1, size - 1):
                both &= link[k : len(link) - size + 2 + k]
            starts = np.flatnonzero(both)
            # Equal sequences have equal numbers: that of the words so far, and the next word's.
            code = at[starts]
            for k in range(1, size):
                first, code = np.unique(code << 32 | at[starts + k], return_index=True, return_inverse=True)[1:]
            n = np.bincount(code, minlength=len(first)) if len(starts) else first
            columns = [at[starts[first] + k].tolist() for k in range(size)]
            for head, *tail, times in zip(*columns, n.tolist(), strict=True):
                rest = 0
                for word in reversed(tail):
                    rest = rest << 32 | word
                self.trie.add(head, rest, times)

    def rows(self, left: int) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.ids.words, pa.binary())
        for places, counts in self.trie.spill(left):
            each = []
            for ids in places:
                known = np.array(ids, np.int64)
                each.append(words.take(pa.array(known, mask=known == 0)))
            phrases = pc.binary_join_element_wise(*each, b" ", null_handling="skip").cast(pa.string())
            run = pa.RecordBatch.from_arrays([pa.array([self.lang] * len(counts), pa.string()), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])
            yield run.take(pc.sort_indices(phrases))


def sequences(
    docs: DataFrame, frequent: Broadcast, pairs: Broadcast | None = None, text_col: str = "text", lang_col: str = "lang",
    burst: int = BURST, held: int = HELD,
) -> DataFrame:
    """(lang, phrase, n) of the pairs of ``frequent`` words; with ``pairs``, of the
    sequences of three and more words that consist of such pairs."""

    def run(batches):
        bits, pair_bits = Bitmap(frequent.value), Bitmap(pairs.value) if pairs else None
        langs: dict[str, _Counter] = {}

        def settled(everything: bool):
            for each in langs.values():
                each.count()
            while langs and (size := sum(x.trie.size for x in langs.values())) > (0 if everything else held):
                big = max(langs.values(), key=lambda x: x.trie.size)
                yield from big.rows(0 if everything else max(0, big.trie.size - (size - held // 2)))

        for batch in batches:
            for value, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = value.as_py()
                if lang not in langs:
                    langs[lang] = _Counter(lang, bits, pair_bits, burst)
                langs[lang].text(text.as_py())
                if sum(x.n_waiting for x in langs.values()) > 2 * held:
                    yield from settled(False)
                    if sum(len(x.ids) for x in langs.values()) > 2 * held:
                        # Ids are the task's own: with new ones everything else is new as well.
                        yield from settled(True)
                        langs.clear()
        yield from settled(True)

    return _merged(_texts(docs, text_col, lang_col).mapInArrow(run, _COUNTED))


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, n) of all sequences that occur ``least`` times, and
    (lang, total) of all words."""
    single = kept(words(docs, text_col, lang_col), "words")
    total = single.groupBy("lang").agg(F.sum("n").alias("total"))
    often = single.where(F.col("n") >= least)
    frequent = bitmap(often, often.count())
    double = kept(sequences(docs, frequent, None, text_col, lang_col).where(F.col("n") >= least), "pairs")
    longer = kept(sequences(docs, frequent, bitmap(double, double.count()), text_col, lang_col).where(F.col("n") >= least), "longer")
    return often.unionByName(double).unionByName(longer), total


def scored(grams: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers: of all
    cuts in two that of the lowest score counts, ties going to the first."""
    split = F.split("phrase", " ")
    grams = grams.withColumn("words", F.size(split))
    longer = grams.where("words > 2").withColumn("w", split)
    inside = []
    for size in range(2, LONGEST):
        starts = F.sequence(F.lit(1), F.col("words") - size + 1)
        inside.append(longer.where(F.col("words") > size).select("lang", "n", F.explode(_parts(starts, size)).alias("phrase")))
    covered = inside[0]
    for more in inside[1:]:
        covered = covered.unionByName(more)
    covered = covered.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    wide = "decimal(38,0)"
    some = grams.where("words > 1").join(covered, ["lang", "phrase"], "left")
    some = some.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < cover * F.col("n").cast("decimal(20,0)")))
    some = some.select("lang", "phrase", "words", F.col("n").alias("a")).withColumn("w", split)
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ")).drop("w")
    known = grams.select("lang", "phrase", "n")
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    over = (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).cast(wide).alias("over")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", over, (F.col("a").cast("decimal(20,0)") * 2_000_000).cast(wide).alias("up"))
    cuts = cuts.withColumn("score", F.expr("up div over"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _parts(starts: Column, size: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases per language."""
    grams, total = counted(docs, text_col, lang_col, least)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(grams, cover).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    joined = first.join(total.withColumnRenamed("total", "n"), "lang")
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
