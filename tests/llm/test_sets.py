"""Shingle joins, spot signatures, neighbours, toxicity and mixing on small rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import ann, bpe, line_dedup, mixing, pii, queries, shingle_join, spotsigs, toxicity


def near_copies(rng, n):
    docs, words = [], [f"w{i}" for i in range(300)]
    while len(docs) < n:
        base = [rng.choice(words) for _ in range(rng.choice([0, 2, 5, 6, 12, 40, 150]))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs) + 3, rng.choice([" ", "\n", " \t"]).join(text)))
    return docs


def brute_components(docs):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}
    changed = True
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {i: (len(s), root[i]) for i, s in sets}


@pytest.mark.parametrize(("pairs", "hot"), [(0, 2), (256, 32)])
def test_components_are_brute_force(spark, monkeypatch, pairs, hot):
    monkeypatch.setattr(shingle_join, "PAIRS_EACH", pairs)
    monkeypatch.setattr(shingle_join, "HOT", hot)
    rng = random.Random(5)
    docs = near_copies(rng, 120)
    # A passage that many texts share, some of which are near copies.
    passage = " ".join(f"p{i}" for i in range(30))
    for base in near_copies(rng, 60):
        docs.append((len(docs) + 3, base[1] + " " + passage))
    out = shingle_join.linked_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(docs)


def test_sketches_keep_every_link():
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 9, 16, 31, 64, 200, 1000, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = int(2 * n * 20 / 180)
            fresh = rng.integers(0, 1 << 63, most // 2).astype(np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[: n - most // 2], fresh]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            levels = {}
            for s in (a, b):
                k = shingle_join.band(len(s))
                levels[k] = max(levels.get(k, 0), shingle_join.level_needed(s, 80))
            (ka, ta), (kb, tb) = shingle_join.keys(a, levels, 80), shingle_join.keys(b, levels, 80)
            assert len(np.intersect1d(ka, kb)) > max(0, min(ta.min() // 2, tb.min() // 2))


def test_sizes_that_link_are_in_bands_that_meet():
    at = [shingle_join.narrow_band(n, 80) for n in range(1, 4000)]
    assert at == sorted(at) and at[-1] > 20
    for n in range(1, 3000):
        for m in (n, n * 100 // 80 - 1, n * 100 // 80, n * 100 // 80 + 1):
            if m >= n and 100 * n >= 80 * m:
                assert at[m - 1] - at[n - 1] in (0, 1)


def test_shingle_edges(spark):
    long = " ".join(str(i) for i in range(30000))
    rows = [(5, "A b", 1), (2, "a  B", 1), (3, None, 1), (4, "", 1), (7, long, 1), (6, long + " x", 1), (7, long, 1), (None, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    got = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.linked_components(docs).collect()})
    assert got == [(2, 1, 2), (3, 0, 3), (4, 0, 4), (5, 1, 2), (6, 29997, 6), (7, 29996, 6)]
    assert sorted(r.doc_id or 0 for r in shingle_join.keep_one(docs).collect()) == [0, 2, 3, 4, 6]
    assert shingle_join.linked_components(docs.limit(0)).count() == 0


def test_one_row_stays_of_repeated_rows(spark):
    rows = [(2, "a b c", "x"), (2, "a b c", "x"), (2, "a b c", "y"), (5, "A b  c", "x"), (3, "u v", "x"), (3, "other words", "x")]
    rows += [(None, "k l m n o p", "x"), (None, "K l\nm n o p", "y"), (None, "k l m n o p", "x"), (None, "k l", "x"), (4, None, "x"), (4, "", "x"), (None, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = shingle_join.keep_one(docs).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 0, 2, 3, 4, 4]
    assert {tuple(r) for r in out} <= set(rows)
    assert sorted(r.text.lower().split() for r in out if r.doc_id is None) == [[], ["k", "l"], ["k", "l", "m", "n", "o", "p"]]
    assert sorted(map(tuple, shingle_join.keep_one(docs.repartition(3)).fillna("").collect()), key=str) == sorted(map(tuple, spark.createDataFrame(out, docs.schema).fillna("").collect()), key=str)


def brute_spots(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content, out, k = [w for w in words if w not in spotsigs.ANCHORS], set(), 0
    for w in ["^", *words]:
        if w == "^" or w in spotsigs.ANCHORS:
            if k < len(content):
                out.add((w, tuple(content[k : k + 2])))
        else:
            k += 1
    return out or ({text} if text else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


SPOT_WORDS = "the of and a house tree water le der una blue light road stone".split()


def test_edited_fingerprints(spark):
    rng = random.Random(6)
    docs = [(i * 7 - 90, " ".join(rng.choice(SPOT_WORDS) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(999999, None), (-(10**12), "the")]
    out = {r.doc_id: r for r in spotsigs.edited_prints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), buckets=7)
           .select("*", spotsigs.likeness(F.col("print"), F.col("edited_print")).alias("near"), spotsigs.likeness(F.col("print"), F.col("next_print")).alias("next")).collect()}
    assert len(out) == len(docs)
    order = sorted(docs, reverse=True)
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i].edited == edited
        assert math.isclose(out[i].near, likeness(brute_spots(text), brute_spots(edited)))
        assert math.isclose(out[i].next, likeness(brute_spots(text), brute_spots(after)))


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(1, "only house", "x")], "doc_id long, text string, edited string")
    assert spotsigs.edited_prints(one).first().edited == "only " + "only "
    twice = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 1), (1, "the the", 1), (1, "x", 1)], "doc_id long, text string, _key int")
    assert spotsigs.edited_prints(twice).count() == 4
    assert spotsigs.edited_prints(one.limit(0)).count() == 0


def test_similar_is_brute_force(spark):
    rng = random.Random(7)
    words = SPOT_WORDS + [f"c{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, " ".join(w for w in t.split() if rng.random() > 0.04)) for i, t in docs] + [(200, None)]
    member, pairs = spotsigs.similar(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.6)
    sets = {i: frozenset(brute_spots(t)) for i, t in docs}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.id: r["class"] for r in member.collect()} == {i: first[s] for i, s in sets.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.1, 3, (1500, 1))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] * 16, "x"), (5003, [1.0, None] + [0.0] * 14, "x"), (5004, [1.0], "x"), (None, [1.0] * 16, "x")]
    table = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>, score string")
    out = ann.search(table, table.where("vec_id % 50 = 0"), k=10).collect()
    assert {r.query_id for r in out} == set(range(0, 1500, 50)) and len(out) == 300
    hits = 0
    for q in range(0, 1500, 50):
        score = x @ x[q]
        score[q] = -np.inf
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(abs(score[r.vec_id] - r.score) < 1e-9 for r in mine) and mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id for r in mine} & set(np.argsort(-score)[:10].tolist()))
    assert hits >= 0.9 * 300


def test_few_neighbours(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (4, 3, 9)], "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(same, same).collect())
    assert out == [(3, 1, 4, 5.0), (3, 2, 9, 5.0), (4, 1, 3, 5.0), (4, 2, 9, 5.0), (9, 1, 3, 5.0), (9, 2, 4, 5.0)]
    assert ann.search(same.limit(0), same).count() == 0 and ann.search(same, same.limit(0)).count() == 0


def test_marginals_are_enumerated():
    stay, start, e = (0.8, 0.3), 0.2, {1: 2.0, 2: -1.0, 5: 0.7}
    total, toxic = 0.0, dict.fromkeys(e, 0.0)
    for ys in itertools.product((0, 1), repeat=7):
        # The place before the first token has the start's share.
        p = start if ys[0] else 1 - start
        for a, b in itertools.pairwise(ys):
            p *= stay[a] if a == b else 1 - stay[a]
        p *= math.exp(sum(w for i, w in e.items() if ys[i]))
        total += p
        for i in e:
            toxic[i] += p * ys[i]
    got = toxicity.marginals(np.array(list(e)), np.array(list(e.values())), stay, start)
    assert np.allclose(got, [toxic[i] / total for i in e])


def test_toxicity(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            text[rng.randrange(40)] = rng.choice(["Rotten", "vile"])
            text[rng.randrange(40)] = "vilest"
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    docs += [(1000, None), (1001, ""), (1002, "vile " * 20000), (None, "Rotten vilest word1")]
    labels += [(0, None), (7777, 1), (None, 1), (1, 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, known.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(got[i].score >= 0.5) == (i % 3 == 0) for i in range(0, 300, 5)]
    assert sum(held) >= 0.95 * len(held)
    assert got[1000].score < 0.5 and got[1001].spans == [] and got[1002].score > 0.5
    assert [docs[-1][1][s.start : s.stop] for s in got[None].spans] == ["Rotten", "vilest"]
    assert toxicity.score(table.limit(0), model).count() == 0
    none = toxicity.fit(table, known.where("toxic = 0"))
    assert {r.score < 0.5 for r in toxicity.score(table, none).collect()} == {True}


def test_rates_reach_targets(spark):
    rng = random.Random(10)
    words = {"a": "un deux trois chat".split(), "b": "one two three cat".split(), "c": "eins zwei drei katze".split()}
    docs = []
    for i in range(200):
        d = rng.choices("abc", [6, 3, 1])[0]
        other = rng.choice("abc")
        docs.append((i, " ".join(rng.choice(words[d if rng.random() < 0.8 else other]) for _ in range(rng.randint(0, 30))), d if i % 2 else None, "x"))
    docs += [(900, None, None, "x"), (901, "", "a", "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, domain string, posterior string")
    model = mixing.fit(table, "doc_id", "text", "domain")
    known = mixing.with_posteriors(table.drop("posterior"), model)
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    rows = known.withColumn("rate", mixing.rates(known, model.domains, targets)).collect()
    p, n, rate = np.array([r.posterior for r in rows]), np.array([r.n_words for r in rows]), np.array([r.rate for r in rows])
    # The same steps by hand.
    r, there = np.ones(len(rows)), n @ p
    for _ in range(mixing.STEPS):
        g = ((n * r) @ p - np.array([0.2, 0.3, 0.5]) * n.sum()) / there
        if abs(g).max() <= mixing.CLOSE:
            break
        r = np.maximum(0, r - p @ g)
    assert np.allclose(rate, r, atol=1e-9) and np.allclose(p.sum(1), 1)
    assert np.allclose((n * rate) @ p / n.sum(), [0.2, 0.3, 0.5], atol=1e-3)
    least = known.withColumn("rate", mixing.rates(known, model.domains, targets, least=1.0))
    times = least.select(mixing.copies(F.col("rate"), "doc_id").alias("k")).collect()
    assert min(t.k for t in times) >= 1
    empty = known.limit(0)
    assert empty.withColumn("rate", mixing.rates(empty, model.domains, targets)).count() == 0
    assert mixing.fit(table.limit(0), "doc_id", "text", "domain") is None
    with pytest.raises(ValueError):
        mixing.rates(known, model.domains, {"zz": 1.0})


def test_any_extra_names_stay_as_they_are(spark):
    names = ["_gone", "_set", "_row", "_h", "_nth", "_id", "_new", "_b", "_text", "_H_", "n_dropped", "n_entities", "n_words", "posterior"]
    line = " ".join(f"w{i}" for i in range(60))
    texts = [(1, f"{line}\nmail a.b@example.org"), (2, f"own words here\n{line}"), (2, "own words"), (3, None), (None, "own words"), (None, "")]
    extra = [f"value {k}" for k in range(len(names))]
    docs = spark.createDataFrame([(*t, *extra) for t in texts], ["doc_id", "text", *names])
    model = mixing.Classifier(("a", "b"), (-0.7, -0.7), ((-1.0,) * 8, (-1.5,) * 8))
    made = {
        line_dedup.drop_repeated: ["n_dropped"], pii.replace: ["n_entities"], shingle_join.keep_one: [],
        (lambda d: mixing.with_posteriors(d, model)): ["n_words", "posterior"],
        (lambda d: bpe.encode(d, {bytes([i]): i for i in range(256)}, r"\S+|\s+", ids_col="_gone")): ["_gone"],
    }
    for operator, new in made.items():
        out = operator(docs)
        assert sorted(out.columns) == sorted(docs.columns)
        rows = out.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in names if c not in new] == [v for c, v in zip(names, extra, strict=True) if c not in new]
    assert {r.n_dropped for r in line_dedup.drop_repeated(docs).collect()} == {0, 1}
    assert sum(r.n_entities for r in pii.replace(docs).collect()) == 1
    with pytest.raises(ValueError):
        pii.replace(docs, text_col="n_entities")


def test_groups_of_keys_keep_every_pair(spark):
    rng = np.random.default_rng(12)
    sets = [set(map(int, rng.integers(-(1 << 62), 1 << 62, n))) for n in (1, 3, 17, 40, 200, 900)]
    shared = set(map(int, rng.integers(-(1 << 62), 1 << 62, 60)))
    sets = [s | {k for k in shared if rng.random() < 0.6} for s in sets]
    live = spark.createDataFrame([(k, c) for c, s in enumerate(sets) for k in s], "key long, cls long")
    smaller = {(r.key, r.cls): set(r.smaller) for r in shingle_join._with_smaller(live).collect()}
    for a, b in itertools.combinations(range(len(sets)), 2):
        common = sets[a] & sets[b]
        left = [k for k in common if not smaller[k, a] & smaller[k, b]]
        assert min(common, default=None) in (left or [None]) and len(left) <= len(common)
    assert sum(len(v) for v in smaller.values()) < 20 * len(smaller)


def test_texts_are_not_shuffled_to_choose_labelled_rows(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 3} and more", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    plans, keep = [], mixing.kept
    monkeypatch.setattr(mixing, "kept", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    model = queries.domain_model(docs, spark, str(tmp_path))
    assert model.domains == ("en", "fr") and model.prior == (math.log(0.5),) * 2
    below = plans[0].split("LeftSemi")[1].splitlines()[1]
    assert re.search(r"Project \[doc_id#\d+L?\]", below), below


def test_stars_end_when_they_stand(spark, monkeypatch):
    """Finding pipeline: no further round, only to see that nothing changes."""
    rounds, keep = [], shingle_join.kept
    monkeypatch.setattr(shingle_join, "kept", lambda df, name: rounds.append(name) or keep(df, name))
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 3), (7, 8), (5, 5)], "a long, b long")
    got = {tuple(r) for r in shingle_join.components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)} and len(rounds) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {tuple(r) for r in shingle_join.components(chain).collect()} == {(i, 0) for i in range(21)}
    assert shingle_join.components(edges.limit(0)).count() == 0
