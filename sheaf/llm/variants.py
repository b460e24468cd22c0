"""Words that differ from others by one code point, by walking a trie as a table.

The trie of all words is a table of edges (node, letter, child), a node being the hash of
what leads to it. States (word, position, node, edits) are joined with the edges, one
level of the trie a round. A word's own path is known, so its states without an edit are
written down at once; the first join gives those whose edit replaces the next letter, and
a deleted letter needs no edge. From then on a state follows the one edge of its word's
next letter or goes. States at the end of their word are neighbours if a word ends at
their node. What one word gains the other loses, so insertions are the deletions of the
longer word, and a replacement is looked for from the side of the smaller letter.

An edit lies in the second half of a word or leaves that half as it is. So there are two
tries, of words and of words read backwards, and in both the first half is walked without
an edit: no state starts near the root, where nodes have many children and all words meet.
Rounds beyond ``LEVELS`` are not walked: the hash of a prefix is a polynomial, so the node
at the end of the word is worked out and looked up at once, and a word of any length takes
rows in proportion to its length. Neighbours are checked by
their letters, so that no two nodes of one hash make a wrong one.

Words are counted once per document and batch before they are shuffled. Cases: null and
empty texts have no words; null ids stand for the empty text in the hash that deletes
letters; repeated documents count repeatedly; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import kept

RUN = re.compile(r"[a-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199
LEVELS = 24
MEMO = 1 << 19
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _runs(key: str, text: str, noise: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text; each ``noise``-th run of a document loses a letter."""
    head = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(RUN.findall(_lowered(text))).items():
        h = zlib.crc32(run.encode(), head)
        if noise and h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``min_letters`` letters that occur ``min_count`` times."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in _runs(key.as_py(), text.as_py(), noise):
                    if len(word) >= min_letters:
                        counts[word] += n
                if len(counts) > MEMO:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def path(word: str) -> list[int]:
    """The nodes of a word, from the root to its end, as unsigned 64-bit numbers."""
    node, out = 0, [0]
    for c in word:
        node = (node * _BASE + ord(c) + 1) & _MASK
        out.append(node)
    return out


def _half(word: str, back: bool) -> int:
    """Letters of a word, or of the word read backwards, that are walked without an edit."""
    return len(word) - len(word) // 2 if back else len(word) // 2


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


_OWN = {
    "back": "boolean", "wid": "long", "node": "long", "letter": "int", "child": "long", "rest": "string", "left": "int",
    "power": "long", "gain": "long",
}


def _own(vocabulary: DataFrame, levels: int) -> DataFrame:
    """The path of each word from its half on: a node, the letter read there, the child it
    leads to, the next ``levels`` letters after that and how many are left in all. Where
    that is more, ``power`` and ``gain`` lead from a node, once the levels are walked, to
    the node at the end of the word: node * power + gain. A word is named by the node at
    its end, read forwards."""
    schema = ", ".join(f"{name} {kind}" for name, kind in _OWN.items())

    def rows(out: list[tuple]) -> pa.RecordBatch:
        back, wid, node, letter, child, rest, left, power, gain = zip(*out, strict=True)
        more = [g is None for g in gain]
        columns = [pa.array(back), _signed(wid), _signed(node), pa.array(letter, pa.int32()), _signed(child), pa.array(rest, pa.string())]
        columns.append(pa.array(left, pa.int32()))
        columns += [pa.array(_signed([x or 0 for x in c]), mask=np.array(more)) for c in (power, gain)]
        return pa.RecordBatch.from_arrays(columns, list(_OWN))

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for value in batch.column(0):
                word = value.as_py()
                wid = path(word)[-1]
                powers = [1]
                while len(powers) + levels <= len(word):
                    powers.append(powers[-1] * _BASE & _MASK)
                for back in (False, True):
                    read = word[::-1] if back else word
                    nodes = path(read)
                    for i in range(_half(word, back), len(read)):
                        left = len(read) - i - 1
                        power = gain = None
                        if left > levels:
                            power = powers[left - levels]
                            gain = (nodes[-1] - nodes[i + 1 + levels] * power) & _MASK
                        out.append((back, wid, nodes[i], ord(read[i]), nodes[i + 1], read[i + 1 : i + 1 + levels], left, power, gain))
                        if len(out) >= 1 << 16:
                            yield rows(out)
                            out = []
        if out:
            yield rows(out)

    return vocabulary.select("word").mapInArrow(run, schema)


def _ends(vocabulary: DataFrame) -> DataFrame:
    """(back, node, word): the node at which a word ends."""

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            for back in (False, True):
                nodes = [path(w[::-1] if back else w)[-1] for w in found]
                yield pa.RecordBatch.from_arrays([pa.array([back] * len(found), pa.bool_()), _signed(nodes), batch.column(0)], ["back", "node", "word"])

    return vocabulary.select("word").mapInArrow(run, "back boolean, node long, word string")


def _jumped(states: DataFrame) -> DataFrame:
    """States moved to the end of their word at once."""

    def run(batches):
        for batch in batches:
            node, power, gain = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((node * power + gain).view(np.int64))], ["back", "wid", "node"])

    return states.select("back", "wid", "node", "power", "gain").mapInArrow(run, "back boolean, wid long, node long")


def neighbours(vocabulary: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, other) for all pairs of ``vocabulary`` (word, n) that one edit parts, both
    ways round."""
    own = kept(_own(vocabulary, levels), "own")
    edges = kept(own.groupBy("back", "node", "letter").agg(F.first("child").alias("child")), "edges")
    goes_on = ["rest", "left", "power", "gain"]
    deleted = own.select("back", "wid", "node", *goes_on)
    # Edges of a node side by side, so that a state meets its node once.
    fans = edges.groupBy("back", "node").agg(F.collect_list(F.struct("letter", "child")).alias("fan")).where(F.size("fan") > 1)
    turned = own.join(fans, ["back", "node"])
    larger = F.filter("fan", lambda to: to["letter"] > F.col("letter"))
    replaced = turned.select("back", "wid", F.explode(larger).alias("to"), *goes_on).withColumn("node", F.col("to.child"))
    states = kept(deleted.unionByName(replaced.select(deleted.columns)), "states")
    ended, level = [states.where("left = 0")], 0
    going = states.where("left > 0")
    while level < levels and not going.isEmpty():
        level += 1
        letter = F.ascii(F.substring("rest", level, 1)).alias("letter")
        moved = going.select("back", "wid", "node", letter, "rest", (F.col("left") - 1).alias("left"), "power", "gain")
        moved = moved.join(edges, ["back", "node", "letter"]).withColumn("node", F.col("child"))
        states = kept(moved.select(deleted.columns), "states")
        ended.append(states.where("left = 0"))
        going = states.where("left > 0")
    found = _jumped(going)
    for some in ended:
        found = found.unionByName(some.select("back", "wid", "node"))
    ends = kept(_ends(vocabulary), "ends")
    named = ends.where(~F.col("back")).select(F.col("node").alias("wid"), F.col("word"))
    pairs = found.distinct().join(ends.withColumnRenamed("word", "other"), ["back", "node"]).select("wid", "other").distinct().join(named, "wid")
    near = pairs.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other")
    near = kept(near, "near")
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def forms(vocabulary: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word: its most frequent neighbour if
    that is ``ratio`` times as frequent, ties going to the smaller word, and the last form
    that forms lead to."""
    theirs = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(theirs, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("other_n").alias("best_n"), F.min_by("other", F.struct(-F.col("other_n"), "other")).alias("best")
    )
    joined = vocabulary.join(best, "word", "left")
    enough = F.col("best_n") >= ratio * F.col("n")
    known = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")
    )
    known = kept(known, "forms")
    # Each round doubles the steps taken; frequencies rise by the ratio with each.
    step = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = step.toDF("root", "next")
        moved = kept(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return known.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs``."""
    vocabulary = kept(words(docs, id_col, text_col, noise), "words")
    return forms(vocabulary, neighbours(vocabulary))
