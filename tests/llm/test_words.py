"""Spelling variants and collocations against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.llm import queries, variants

SF = "/root/testdata/sf0.01"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_words(rows, noise=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_forms(counts):
    """Neighbours by the words' deletions, so that whole vocabularies can be done."""
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    close = {w: set() for w in counts}
    for (a, b), group in holes.items():
        for x, y in itertools.permutations(group, 2):
            close[x].add(y)
        if a + b in counts:
            for x in group:
                close[x].add(a + b)
                close[a + b].add(x)
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(close[w]), form[w], form[w] and counts[form[w]], root)
    return out


def told(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_brute_forms_by_pairs():
    rng = random.Random(1)
    counts = {"".join(rng.choices("abÿ", k=rng.randint(6, 8))): rng.choice([5, 25, 200, 4000]) for _ in range(150)}
    pairs = {w: sum(near(w, o) for o in counts) for w in counts}
    assert {w: x[1] for w, x in brute_forms(counts).items()} == pairs and max(pairs.values()) > 3


@pytest.mark.parametrize("levels", [0, 2, 24])
def test_neighbours_of_dense_words(spark, levels):
    rng = random.Random(levels)
    counts = {"".join(rng.choices("abÿ", k=rng.randint(6, 10))): rng.choice([5, 24, 25, 200, 4000]) for _ in range(700)}
    long = "ab" * 1_000
    counts |= {long: 6, long + "c": 30, "c" + long: 7, long[:700] + "d" + long[700:]: 5, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert told(variants.forms(table, variants.neighbours(table, levels))) == brute_forms(counts)


def test_words_of_odd_texts(spark):
    rows = [(1, "Abcdef ÀBCDEF×÷ß abcdef, abc_def " * 9), (1, "Abcdef " * 3), (2, None), (3, ""), (None, "nullid " * 6 + "x" * 50_000), (4, "😀abcdef " * 5)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, word string").repartition(3)
    assert {r.word: r.n for r in variants.words(docs, noise=2).collect()} == brute_words(rows, 2)
    assert told(variants.variants(docs)) == brute_forms(brute_words(rows))
    assert variants.variants(docs.limit(0)).count() == 0


def test_op12_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_variants"](spark, SF)
    assert got.where(F.col("form").isNotNull()).count() > 10
    assert told(got) == brute_forms(brute_words(rows))


def brute_collocations(rows, least=30, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {g: n for g, n in counts.items() if n >= least}
    covered = set()
    for (lang, w), n in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * n >= 80 * often[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    found = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in covered:
            cuts = [(2_000_000 * a // (often[lang, w[:k]] + often[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), often[lang, w[:k]], often[lang, w[k:]]))
    return [
        (lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, each in found.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(each)[:top])
    ]


@pytest.mark.parametrize(("burst", "held", "bits"), [(4096, 1 << 19, 1 << 29), (2, 40, 64), (1, 1, 1 << 15)])
def test_collocations_of_random_texts(spark, monkeypatch, burst, held, bits):
    from sheaf.llm import collocations as c

    rng = random.Random(burst)
    rows = [(None, "en"), ("", None), ("Of THE. of the\x0bof the\t the  É é\x1c;", None)]
    for _ in range(300):
        pool = ["a", "B", "cd", "É", "x\x1cy", "of", "the", "rare%d" % rng.randint(0, 50)]
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t ", ". ", "\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    rows.append(("over and over " * 20_000, "en"))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(3)
    monkeypatch.setattr(c.bitmap, "__defaults__", (bits,))
    monkeypatch.setattr(c.words, "__defaults__", ("text", "lang", held))
    monkeypatch.setattr(c.sequences, "__defaults__", (None, "text", "lang", burst, held))
    want = brute_collocations(rows, least=8, top=40)
    got = [tuple(r) for r in c.collocations(docs, least=8, top=40).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    assert c.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    from sheaf.llm import collocations as c

    big = (1 << 62) - 1
    grams = [("en", "a", big), ("en", "b", big), ("en", "a b", big - 7), ("en", "a b c", 40), ("en", "c", 40), ("en", "b c", 41)]
    got = {r.phrase: r for r in c.scored(spark.createDataFrame(grams, "lang string, phrase string, n long")).collect()}
    assert got["a b"].score == 2_000_000 * (big - 7) // (2 * big) and "b c" not in got
    assert (got["a b c"].l, got["a b c"].r, got["a b c"].score) == (big, 41, 0)
