r"""Documents whose word shingles overlap, by a join of parity sketches.

A-Z are lower-cased and words are ``[^\x20\x09-\x0D]+``. A document's set holds its
shingles of ``width`` words as 64-bit hashes; with fewer words the whole sequence is the
only one. Two documents link when ``100 * common >= percent * union``.

* Equal sets fall together first, by a 64-bit digest, so that copies cost one row each.
* A sketch deals a set's shingles over words by their hash and XORs them into it. One
  shingle more or less changes one word, so the number of words that differ is at most
  the symmetric difference, and that is at most ``D`` for linked sets. If a set fills
  more than ``D`` words, one filled word must be equal: words, with their place, are the
  keys of a plain equi-join. Words without a shingle are no keys. A set that fills ``s``
  more words than it must leaves out its ``s`` most frequent keys: linked sets share
  more than ``s`` of them, so the rarest that they share stays.
* Sketches have one length per band of sizes (a factor of two). A set also stands in the
  next band if a linked set could be there. A band in which some set fills too few words
  gets a longer sketch, at last one with a word for each shingle.
* A key that ``HOT`` sets hold does not select: mostly it is a word with one shingle that
  many texts share. Its sets get a second, longer sketch with a word for each shingle, of
  which a set needs only its rarest fifth and one, in narrow bands of sizes, and leave the hot key. Sets that linked by the
  hot key alone are both among these and share one of the second sketch's words.
* Pairs whose parity sketches, one bit flipped per shingle, differ in more than ``D`` bits
  are no links. The others are compared exactly, by hashes.
* Of keys with the same members one is enough.
* Each set is first compared with one other, the smallest of a key that it shares most
  keys with. Those that linked are one component, and only sets of one key in different
  components are compared further, their sizes and short parity sketches within the join
  by key, so that pairs which cannot link never leave it: in rounds with the smallest, the
  next two, the next four and so on, two at least and while a key has more than
  ``PAIRS_EACH`` pairs left for each member, then all that are left. There a pair leaves
  the join at its smallest common key only, of each group of about ``GROUP`` keys.

Components are found by stars (large and small, in turn). Cases: null and empty texts
have an empty set and no links; rows with equal ids are copies of one document if their
texts are equal, else ids link whatever either links; rows without id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, kept

WIDTH, PERCENT = 5, 80
# Shingles per word of a sketch, for the largest sets of a band.
PER_WORD = 3.5
PARITY_WORDS = 64
EACH = 4  # the level at which each shingle has a word of its own
HOT = 32  # members of a key that does not tell sets apart
# Needed sets whose ids may go to every task; pairs of a key, for each of its members, whose
# short sketches are compared at once.
MAX_BROADCAST_IDS, PAIRS_EACH = 1 << 20, 256
GROUP = 16  # keys of a set that know of each other
SHORT = tuple(f"s{i}" for i in range(16))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    total = np.full(n, len(w) if len(w) < width else width, np.uint64)
    for i in range(min(width, len(w))):
        total = _mix(total + w[i : i + n] * _ODD[i % len(_ODD)])
    return np.unique(total)


def band(n: int) -> int:
    """Sizes 2**b to 2**(b+1) - 1 are band b."""
    return n.bit_length() - 1


def bands(n: int, percent: int) -> list[int]:
    """Its own, and the next if a set of it can link."""
    b = band(n)
    return [b, b + 1] if 100 * n >= percent * (2 << b) else [b]


def _place(hashes: np.ndarray, b: int, level: int) -> np.ndarray:
    if level >= EACH:
        return hashes
    words = max(1, int((2 << b) / PER_WORD)) << level
    return _mix(hashes + np.uint64(1)) % np.uint64(words)


def level_needed(hashes: np.ndarray, percent: int) -> int:
    """The first level at which the set fills more words than linked sets, none larger,
    can differ in."""
    n = len(hashes)
    differ = 2 * n * (100 - percent) // (100 + percent)
    return next((v for v in range(EACH) if len(np.unique(_place(hashes, band(n), v))) > differ), EACH)


def keys(hashes: np.ndarray, levels: dict[int, int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The filled words of a set's sketches, each with its band and place, as hashes; and
    how many of a band's keys the set can do without, times 2, plus the band's last bit.

    Linked sets share all filled words but ``D``, for the largest that can link.
    """
    out, tags = [], []
    # Against a partner of up to 100 / percent times the size.
    most = len(hashes) * (100 - percent) // percent
    for b in bands(len(hashes), percent):
        if b not in levels:
            continue  # nothing stands there
        place = _place(hashes, b, levels[b])
        order = np.argsort(place, kind="stable")
        place = place[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        word = np.bitwise_xor.reduceat(hashes[order], starts)
        out.append(_mix(_mix(word) + place[starts] * _ODD[0] + np.array([b], np.uint64) * _ODD[1]))
        tags.append(np.full(len(word), max(0, len(word) - most - 1) * 2 + b % 2, np.int32))
    return (np.concatenate(out), np.concatenate(tags)) if out else (np.array([], np.uint64), np.array([], np.int32))


def _digest(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).astype(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, cls, level): the size and digest of each document's set."""

    def run(batches):
        for batch in batches:
            ids, ns, cls, levels = [], [], [], []
            for i, text in _texts(batch):
                h = shingles(text, width)
                ids.append(i)
                ns.append(len(h))
                cls.append(_digest(h))
                levels.append(level_needed(h, percent) if len(h) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(cls, pa.int64()), pa.array(levels, pa.int32())],
                ["id", "n", "cls", "level"],
            )

    return docs.mapInArrow(run, f"id {docs.schema[0].dataType.simpleString()}, n long, cls long, level int")


def narrow_band(n: int, percent: int) -> int:
    """Sizes that link are of one band or of two in a row."""
    b, edge = 0, 100
    while n * 100 >= edge * 100 // percent + 100:
        b, edge = b + 1, edge * 100 // percent + 100
    return b


def fine_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as a key in the narrow bands where linked sets are. A linked set lacks
    ``100 - percent`` in 100 of a set's shingles at most, so it needs no more but one."""
    n = len(hashes)
    spare = max(0, n - n * (100 - percent) // 100 - 1)
    out, tags = [], []
    b = narrow_band(n, percent)
    for k in (b, b + 1):
        out.append(_mix(_mix(hashes + _ODD[2]) + np.array([k], np.uint64) * _ODD[1]))
        tags.append(np.full(n, spare * 2 + k % 2, np.int32))
    return np.concatenate(out), np.concatenate(tags)


def _keys_of(docs: DataFrame, levels: dict[int, int] | None, width: int, percent: int) -> DataFrame:
    """(key, cls, tag): the keys of each set, once for the copies that a batch holds;
    without ``levels`` its shingles."""

    def run(batches):
        for batch in batches:
            seen, found, n = set(), [], 0
            for _, text in _texts(batch):
                h = shingles(text, width)
                c = _digest(h)
                if len(h) and c not in seen:
                    seen.add(c)
                    k, tags = fine_keys(h, percent) if levels is None else keys(h, levels, percent)
                    found.append((k.view(np.int64), np.full(len(k), c, np.int64), tags))
                    n += len(k)
                if n > 1 << 18:
                    yield rows(found)
                    found, n = [], 0
            if n:
                yield rows(found)

    def rows(found):
        columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["key", "cls", "tag"])

    return docs.mapInArrow(run, "key long, cls long, tag int")


def parity(hashes: np.ndarray, bits: int = 64 * PARITY_WORDS) -> np.ndarray:
    """One bit flipped per shingle, as 64-bit words."""
    flips = np.bincount((_mix(hashes + np.uint64(2)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def short(words: np.ndarray) -> np.ndarray:
    """The parity sketch of fewer bits that a longer one folds to."""
    return np.bitwise_xor.reduce(words.reshape(-1, len(SHORT)), axis=0)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(cls, hashes, n, parity, and the short parity's words) of the documents."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                h = [shingles(t, width) for _, t in _texts(batch.slice(start, 256))]
                flips = [parity(x) for x in h]
                folded = np.array([short(x) for x in flips]).reshape(-1, len(SHORT))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(x) for x in h], pa.int64()),
                        pa.array([x.tobytes() for x in h], pa.binary()),
                        pa.array([len(x) for x in h], pa.int64()),
                        pa.array(flips, pa.list_(pa.int64())),
                        *[pa.array(folded[:, i]) for i in range(len(SHORT))],
                    ],
                    ["cls", "hashes", "n", "parity", *SHORT],
                )

    return docs.mapInArrow(run, "cls long, hashes binary, n long, parity array<long>, " + ", ".join(f"{c} long" for c in SHORT))


def _near(percent: int) -> Column:
    """Whether a member and a hub (``a_``) may link, by their sizes and short sketches."""
    sizes = 100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")
    flips = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in SHORT[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("a_s0"))))
    return sizes & (flips * (100 + percent) <= (F.col("n") + F.col("a_n")) * (100 - percent))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parity sketches allow a link: as many bits differ
    as there are shingles in one set only, at most."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("cls").alias(side), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_p")), side)
    n = F.col("a_n") + F.col("b_n")
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    flips = F.zip_with("a_p", "b_p", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    far = F.aggregate(flips, F.lit(0), lambda t, x: t + x) * (100 + percent) > n * (100 - percent)
    return both.where(sizes & ~far).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    hashes = sets.select("cls", "hashes")
    hubs = pairs.select("a").distinct()
    if pairs.count() <= MAX_BROADCAST_IDS:  # then sets move once per pair, and hubs once
        pairs, hubs = F.broadcast(pairs), F.broadcast(hubs)
    both = hashes.toDF("b", "right").join(pairs, "b").join(hashes.toDF("a", "left").join(hubs, "a"), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, nodes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(node, root) for all nodes of ``edges``: root is the smallest node of its component.

    Large and small stars in turn: every node hangs its larger, then its smaller
    neighbours on the smallest it knows, until each has one smaller neighbour that has none.
    """
    a, b = nodes
    stars = kept(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct(), "stars")
    while True:
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # A node's smaller neighbours, and itself, hang on the smallest of them.
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.toDF("x", "y"))
        stars = kept(small.where("x <> y").distinct(), "stars")
        ends = stars.select(F.col("x").alias("v"), F.lit(1).alias("up")).unionByName(stars.select(F.col("y").alias("v"), F.lit(0).alias("up")))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR up > low").isEmpty():
            return stars.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
                stars.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            )


def _rarest(found: DataFrame) -> DataFrame:
    """(key, cls, rank, last) of the keys that a set cannot do without: of linked sets those
    have one in common. Members of a key are ranked from 0 to ``last``."""
    by_key = W.partitionBy("key")
    ranked = found.withColumn("rank", F.dense_rank().over(by_key.orderBy("cls")) - 1)
    shared = ranked.withColumn("often", F.max("rank").over(by_key)).where("often > 0").select("key", "cls", "tag", "often").distinct()
    frequent = W.partitionBy("cls", "tag").orderBy(F.desc("often"), F.desc("key"))
    rare = shared.withColumn("nth", F.row_number().over(frequent)).where(F.col("nth") > F.floor(F.col("tag") / 2))
    again = rare.select("key", "cls", (F.row_number().over(by_key.orderBy("cls")) - 1).alias("rank"))
    return again.withColumn("last", F.max("rank").over(by_key)).where("last > 0")


def _one_of_equal(live: DataFrame) -> DataFrame:
    """``live`` with one key of those that have the same members, by 128 bits of them."""
    sides = [F.bit_xor(F.xxhash64("cls", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    told = live.groupBy("key").agg(F.count("*").alias("m"), *sides)
    return live.join(told.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _with_smaller(live: DataFrame) -> DataFrame:
    """``live`` and ``smaller``: a set's smaller keys of the same group.

    Groups go by the last bits of a key, more of them the more keys a set has, so that of
    two sets' groups one lies within the other. A pair has a key without smaller common
    ones in every group in which it has keys in common.
    """
    n = F.count("*").over(W.partitionBy("cls"))
    groups = F.pow(F.lit(2), F.ceil(F.log2(n / GROUP))).cast("long")
    group = F.col("key").bitwiseAND(F.greatest(groups, F.lit(1)) - 1)
    below = W.partitionBy("cls", "group").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    return live.withColumn("group", group).withColumn("smaller", F.collect_list("key").over(below)).drop("group")


def _candidates(live: DataFrame, root: DataFrame) -> DataFrame:
    """Members of keys, ranked by set, with their component."""
    members = live.join(root.toDF("cls", "comp"), "cls", "left")
    members = members.withColumn("comp", F.coalesce("comp", "cls"))
    key = W.partitionBy("key")
    spread = members.withColumn("_low", F.min("comp").over(key)).withColumn("_high", F.max("comp").over(key))
    return spread.where("_low < _high").select("key", "cls", "comp", "rank", "smaller")


def links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, n, cls) for every document with an id, and (a, b), verified links
    between classes of equal sets that join every component, a < b."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    known = kept(classes(texts, width, percent), "classes")
    size = F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")
    levels = {r["b"]: r["v"] for r in known.where("n > 0").groupBy(size.alias("b")).agg(F.max("level").alias("v")).collect()}

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        """The text of one document of each class in ``wanted`` (cls)."""
        first = known.where("n > 0").groupBy("cls").agg(F.min("id").alias("id")).join(wanted, "cls").select("id").distinct()
        first = kept(first, name)
        return texts.join(F.broadcast(first) if first.count() <= MAX_BROADCAST_IDS else first, "id")

    coarse = kept(_rarest(_keys_of(texts, levels, width, percent)), "coarse")
    # Sets of a hot key meet by their shingles instead, of which they can do without most:
    # what many sets share goes first.
    hot = coarse.where(F.col("last") >= HOT).select("cls").distinct()
    fine = kept(_rarest(_keys_of(texts_of(hot, "hot"), None, width, percent)), "fine")
    live = kept(_with_smaller(_one_of_equal(coarse.where(F.col("last") < HOT).unionByName(fine).drop("last"))), "live")

    needed = live.select("cls").distinct()
    sets = kept(_sets(texts_of(needed, "needed"), width).dropDuplicates(["cls"]), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        return kept(_linked(kept(_possible(pairs, sets, percent), "pairs"), sets, percent), "links")

    # First each set with the one it shares most keys with, of those that are the smallest of a key.
    low = live.where("rank = 0").select("key", F.col("cls").alias("a"))
    often = live.where("rank > 0").join(low, "key").groupBy(F.col("cls").alias("b"), "a").count()
    best = often.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    found, done, hubs = compared(best), 0, 1
    sketches = sets.select("cls", "n", *SHORT)
    while True:
        root = kept(components(found), "roots")
        members = kept(_candidates(live, root).join(sketches, "cls"), "members")
        # Pairs of one key in different components: all pairs less those within one.
        sizes = members.where(F.col("rank") >= done).groupBy("key", "comp").count().groupBy("key")
        across = (F.pow(F.sum("count"), 2) - F.sum(F.pow("count", F.lit(2)))) / 2
        each = sizes.agg(across.alias("g"), F.sum("count").alias("m"))
        left, there = each.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if left == 0:
            break
        # Two rounds first: what they link need not be compared pair by pair.
        whole = done >= 3 and left <= PAIRS_EACH * there
        hub = members.where(F.col("rank") >= done if whole else F.col("rank").between(done, done + hubs - 1))
        hub = hub.select("key", F.col("cls").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("comp", "rank", "n", "smaller", *SHORT)])
        wanted = (F.col("rank") > F.col("a_rank")) & (F.col("comp") != F.col("a_comp")) & _near(percent)
        if whole:
            # A pair of a smaller key has been compared there, in this round or one before.
            wanted = wanted & ~F.arrays_overlap("smaller", "a_smaller")
        pairs = members.join(hub, "key").where(wanted)
        found = found.unionByName(compared(pairs.select("a", F.col("cls").alias("b")).distinct()))
        if whole:
            break
        done, hubs = done + hubs, 2 * hubs
    return known.select("id", "n", "cls"), found


def linked_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id) per document; a component's id is its smallest."""
    known, found = links(docs, id_col, text_col, width, percent)
    root = components(found).toDF("cls", "root")
    rooted = known.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    joined = rooted.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _set_digest(text: Column) -> Column:
    """A digest of a text's set of shingles, null for the empty set."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def digest(ws):
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (WIDTH - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, F.lit(WIDTH)), " ")))
        joined = F.array_join(F.array_sort(F.array_distinct(hashes)).cast("array<string>"), ",")
        return F.when(F.size(ws) > 0, F.sha2(joined, 256))

    return F.get(F.transform(F.array(words), digest), F.lit(0))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest document of each component only; rows with an empty set
    stay. Of rows with one id the one with the smallest hash of the text stays, of rows
    without id one of each set; of rows equal in that, the one with the smallest hash of
    all columns. Rows without id are not compared with others beyond equal sets."""
    gone_id, group, text_hash, row, nth = fresh(docs, "gone", "set", "h", "row", "nth")
    which = linked_components(docs.select(id_col, text_col), id_col, text_col)
    gone = which.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(gone_id)).distinct()
    left = docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    # Empty sets are no copies of one another: each row is its own.
    some = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.when(F.col(id_col).isNull(), _set_digest(F.col(text_col)))
    order = W.partitionBy(id_col, group).orderBy(text_hash, row)
    keyed = left.where(some).withColumns({group: key, text_hash: F.xxhash64(text_col), row: F.xxhash64(*docs.columns)})
    one = keyed.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return one.unionByName(left.where(~some))
