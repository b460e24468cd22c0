"""Toxic spans by a linear-chain conditional random field.

Tokens are words in lower case; a token's features are the word and its beginnings. The
labels say which documents are toxic, so tokens are labelled by evidence: a feature's
weight is its log odds with a ridge, which keeps it small where few documents hold the
feature. It belongs to the lexicon if documents that hold it are toxic far more often
than others and its weight is well above its own error, whatever the size of the table.
In toxic documents the tokens with such a feature are the toxic ones. On these labelled tokens the field is fitted: transitions are those
of the label sequences, feature weights start at the lexicon's, which a ridge holds them
to, and follow the gradient, observed less expected counts, with exact forward-backward marginals. Tokens without a feature of the lexicon
do not move the chain but through its transitions, so a gap of any length is one power
of the 2 x 2 transition matrix, in closed form.

A document's score comes from its marginals: a logistic function of their sum and
largest, fitted to the labels. Offending spans are tokens with a marginal of a half or
more. Texts are read whole.

The model is fitted on at most ``toxic_rows`` and ``clean_rows`` labelled documents,
those with the smallest hash of the id, and weighted by the classes' counts among all
labels. It holds no ids, languages or sources.

Cases: null and empty texts have no tokens and the score of no evidence; labels that are
null or of unknown documents are left out, of several labels for a document the largest
counts; with labels of one class, or none, the score is that class's share, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import kept

TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
# Beginnings that are features, in characters.
STARTS = range(3, 9)
# A feature of the lexicon: log odds, and its weight in standard errors.
MIN_ODDS, MIN_ERRORS = 1.5, 1.8
STEPS, RIDGE = 25, 1.0
MEMO = 1 << 20

WORD = re.compile(r"\w+")
tokens = WORD.findall


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in STARTS if len(word) >= k)]


@dataclass(frozen=True)
class Model:
    """Feature weights, chances of staying (clean, toxic), share of toxic starts, and the
    logistic function's bias and slopes."""

    weights: dict[str, float]
    stay: tuple[float, float]
    start: float
    document: tuple[float, ...]

    def emission(self, word: str) -> float:
        word = word.lower()
        return sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(at: np.ndarray, e: np.ndarray, stay: tuple[float, float], start: float) -> np.ndarray:
    """P(toxic) of the tokens at places ``at``, whose scores for toxic are ``e``."""
    stay0, stay1 = stay
    turn = 1 - stay0, 1 - stay1
    share = turn[0] / (turn[0] + turn[1])  # of toxic tokens far away from any evidence
    fade = stay0 + stay1 - 1
    x = np.exp(np.clip(e, -30, 30)).tolist()
    gaps = [fade**g for g in np.diff(at, prepend=0).tolist()]
    p, forward = start, []
    for g, w in zip(gaps, x, strict=True):
        p = share + g * (p - share)
        p = p * w / (p * w + 1 - p)
        forward.append(p)
    b, out = 1.0, [0.0] * len(x)  # b: how likely what follows is after toxic, against clean
    for i in range(len(x) - 1, -1, -1):
        p = forward[i]
        out[i] = p * b / (p * b + 1 - p)
        odds = b * x[i]
        to1, to0 = share + gaps[i] * (1 - share), share - gaps[i] * share
        b = (to1 * odds + 1 - to1) / (to0 * odds + 1 - to0)
    return np.array(out)


def _document(p: np.ndarray) -> tuple[float, float]:
    return (math.log(0.01 + float(p.sum())), float(p.max())) if len(p) else (math.log(0.01), 0.0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(text, toxic) of the bounded sample."""
    one = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    some = [
        one.where(F.col("toxic") > 0 if toxic else F.col("toxic") <= 0).orderBy(F.xxhash64("_id"), "_id").limit(n)
        for toxic, n in ((True, toxic_rows), (False, clean_rows))
    ]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most toxic_rows + clean_rows ids
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id")
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))


def _shrunk(t: Column, c: Column, n: dict[int, int]) -> Column:
    """(weight, error) of a feature in ``t`` toxic and ``c`` clean documents: its log odds
    under a ridge, by Newton's method, and their standard error."""

    def toxic(w):
        return 1 / (1 + F.exp(-(w + math.log(n[1] / n[0]))))

    def bend(p):
        return (t + c) * p * (1 - p) + RIDGE

    def step(w, _):
        move = (t - (t + c) * toxic(w) - RIDGE * w) / bend(toxic(w))
        return w + F.greatest(F.least(move, F.lit(1.0)), F.lit(-1.0))

    weight = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(0.0), step)
    return F.struct(weight.alias("w"), (1 / F.sqrt(bend(toxic(weight)))).alias("error"))


def _lexicon(rows: DataFrame, n: dict[int, int]) -> list[tuple[str, float]]:
    """(feature, weight) of features that tell toxic documents."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({f for w in set(tokens(text.lower())) for f in features(w)})
        names = [*(counts[0].keys() | counts[1].keys())]
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array([c[f] for f in part], pa.int64()) for c in counts)], ["f", "clean", "toxic"]
            )

    counted = rows.mapInArrow(run, "f string, clean long, toxic long").groupBy("f")
    counted = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    # In one toxic document a weight is below 1 and its error above 0.89: no need to work it out.
    told = counted.where((F.col("t") > 1) & (odds >= MIN_ODDS)).withColumn("s", _shrunk(F.col("t"), F.col("c"), n))
    return [(r.f, r.w) for r in told.where(F.col("s.w") >= MIN_ERRORS * F.col("s.error")).select("f", "s.w").collect()]


def _sequences(rows: DataFrame, index: dict[str, int]) -> list:
    """Per document of the sample: label, number of tokens, places and features of those
    with a feature of the lexicon."""

    def run(batches):
        for batch in batches:
            out = {"toxic": batch.column(1), "n": [], "at": [], "fs": []}
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                hits = [(i, [index[f] for f in features(w.lower()) if f in index]) for i, w in enumerate(words)]
                hits = [h for h in hits if h[1]]
                out["n"].append(len(words))
                out["at"].append([i for i, _ in hits])
                out["fs"].append([f for _, f in hits])
            yield pa.RecordBatch.from_arrays(
                [out["toxic"], pa.array(out["n"], pa.int64()), pa.array(out["at"], pa.list_(pa.int64())),
                 pa.array(out["fs"], pa.list_(pa.list_(pa.int64())))], list(out)
            )

    schema = "toxic int, n long, at array<long>, fs array<array<long>>"
    return [(r.toxic, r.n, np.array(r["at"]), r.fs) for r in rows.mapInArrow(run, schema).collect()]


def _chain(sequences: list) -> tuple[tuple[float, float], float]:
    """Chances of staying and of a toxic start, by counts of the labelled tokens."""
    stay = [[1.0, 1.0], [1.0, 1.0]]  # [state][stays, turns]
    starts = 0
    for toxic, n, at, _ in sequences:
        ones = at if toxic else at[:0]
        near = int((np.diff(ones) == 1).sum())
        stay[1][0] += near
        stay[1][1] += len(ones) - near
        stay[0][1] += len(ones) - near
        stay[0][0] += max(0, n - 2 * len(ones) + near)
        starts += int(len(ones) > 0 and ones[0] == 0)
    return (stay[0][0] / sum(stay[0]), stay[1][0] / sum(stay[1])), (starts + 0.1) / (len(sequences) + 1)


def _weights(sequences: list, first: np.ndarray, stay, start) -> np.ndarray:
    w, pace = first.copy(), np.full(len(first), 0.5)
    before = np.zeros(len(first))
    for _ in range(STEPS):
        gradient = -RIDGE * (w - first)
        for toxic, _, at, fs in sequences:
            if len(at):
                e = np.array([w[f].sum() for f in fs])
                for f, d in zip(fs, toxic - marginals(at, e, stay, start), strict=True):
                    gradient[f] += d
        same = np.sign(gradient) * np.sign(before)
        pace = np.clip(np.where(same > 0, pace * 1.2, np.where(same < 0, pace * 0.5, pace)), 1e-3, 1.0)
        w = np.clip(w + np.sign(gradient) * pace, -12, 12)
        before = gradient
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
    return tuple(b.tolist())


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
) -> Model:
    """A model of ``labels`` (id, toxic) on ``docs``; the labels are those to learn from."""
    rows = kept(sample(docs, labels, id_col, text_col, toxic_rows, clean_rows), "labelled")
    n = {0: 0, 1: 0} | {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    known = labels.where(F.col("toxic").isNotNull()).groupBy((F.col("toxic") > 0).cast("int").alias("k")).count()
    among = {0: 0, 1: 0} | {r.k: r["count"] for r in known.collect()}
    if not n[0] or not n[1]:
        return Model({}, (0.99, 0.5), 0.01, (40.0 if n[1] else -40.0, 0.0, 0.0))
    lexicon = sorted(_lexicon(rows, n))
    index = {f: i for i, (f, _) in enumerate(lexicon)}
    sequences = _sequences(rows, index)
    stay, start = _chain(sequences)
    w = _weights(sequences, np.array([v for _, v in lexicon]), stay, start)
    x, y = [], []
    for toxic, _, at, fs in sequences:
        e = np.array([w[f].sum() for f in fs])
        x.append(_document(marginals(at, e, stay, start)) if len(at) else _document(e))
        y.append(toxic)
    y = np.array(y)
    weight = np.where(y == 1, among[1] / n[1], among[0] / n[0]) / (among[0] + among[1]) * len(y)
    return Model({f: float(v) for (f, _), v in zip(lexicon, w, strict=True)}, stay, start, _logistic(np.array(x), y, weight))


class _Emissions(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = self.model.emission(word)
        return value


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("p", T.DoubleType())])
)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``spans``, the offending ones in code points."""
    rest = docs.drop("score", "spans")
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the lexicon
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = _Emissions(model)
        bias, *slopes = model.document
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                scores, spans = [], []
                for value in batch.column(at):
                    text = value.as_py() or ""
                    words = tokens(text)
                    e = np.fromiter(map(emissions.__getitem__, words), float, len(words))
                    places = np.flatnonzero(e)
                    p = marginals(places, e[places], model.stay, model.start) if len(places) else e[:0]
                    scores.append(float(_sigmoid(bias + sum(a * b for a, b in zip(slopes, _document(p), strict=True)))))
                    hits = {int(i): float(v) for i, v in zip(places, p, strict=True) if v >= 0.5}
                    spans.append(
                        [(m.start(), m.end(), hits[i]) for i, m in enumerate(WORD.finditer(text)) if i in hits] if hits else []
                    )
                columns = [pa.array(scores), pa.array([[dict(zip(("start", "stop", "p"), s, strict=True)) for s in x] for x in spans], arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "spans"])

    return rest.mapInArrow(run, schema)


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5
