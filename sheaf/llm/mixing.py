"""Rates that mix documents of soft domains to target weights, by DataFrame functions only.

A naive Bayes classifier of hashed words is fitted on a labelled table; it gives each
document a posterior over the domains, from its mean evidence per word, as that of at
most ``evidence`` words. A document has a rate; the expected tokens of a domain are the
sum of rate times words times posterior. The rates minimise the squared relative
differences of these totals from the targets, by projected gradient: a step moves each
rate against its posterior-weighted residuals and back to ``least`` or more. In the
metric of document lengths the step 1 is safe, as no curvature is above 1. Documents
never meet: each step sums one number per domain, and a rate follows from the residuals
so far.

The classifier is fitted on at most ``rows`` labelled documents, those with the smallest
hash of the id. Cases: null and empty texts have no words, the prior as posterior, and a
rate all the same; labels of null domain are left out; without labelled documents, or
without words in all documents, all rates are 1; targets are scaled to sum to 1 and
domains of no label cannot be targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, kept

ROWS, BUCKETS, EVIDENCE, STEPS, CLOSE = 4000, 1024, 20, 60, 1e-6


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """The hash bucket of each word, words being what blanks part."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(n)).cast("int"))


@dataclass(frozen=True)
class Classifier:
    """Domains, their log priors, and per domain the log probability of each bucket."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    words: tuple[tuple[float, ...], ...]

    def posterior(self, found: Column, evidence: int = EVIDENCE) -> Column:
        """Posteriors of a document, in order of the domains, by its buckets."""
        n = F.size(found)

        def summed(table: Column) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))

        scores = []
        for k, prior in enumerate(self.prior):
            # Against the first domain, whose own evidence is then 0.
            table = F.lit([a - b for a, b in zip(self.words[k], self.words[0], strict=True)])
            total = summed(table) if k else F.lit(0.0)
            scores.append(F.lit(prior) + F.when(n > 0, total / n * F.least(n, F.lit(evidence))).otherwise(0.0))

        def softmax(s: Column) -> Column:
            powers = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
            return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda t, x: t + x))

        return F.get(F.transform(F.array(F.array(*scores)), softmax), F.lit(0))


def fit(
    labelled: DataFrame, id_col: str, text_col: str, domain_col: str, rows: int = ROWS, n: int = BUCKETS, ids: DataFrame | None = None
) -> Classifier | None:
    """A classifier of ``labelled`` (id, text, domain), of the rows whose id is in ``ids``
    if these are given. Ids alone are joined and sorted; texts meet the chosen ones, which
    are few, where they are read."""
    known = labelled.where(F.col(domain_col).isNotNull())
    chosen = known.select(id_col).where(F.col(id_col).isNotNull())
    if ids is not None:
        chosen = chosen.join(ids.select(id_col), id_col, "left_semi")
    chosen = chosen.distinct().orderBy(F.xxhash64(id_col), id_col).limit(rows)
    some = known.join(F.broadcast(chosen), id_col).select(F.col(domain_col).cast("string").alias("domain"), buckets(F.col(text_col), n).alias("b"))
    some = kept(some, "labelled")
    docs = {r.domain: r["count"] for r in some.groupBy("domain").count().collect()}
    if not docs:
        return None
    domains = tuple(sorted(docs))
    counts = {d: [1.0] * n for d in domains}
    for r in some.select("domain", F.explode("b").alias("b")).groupBy("domain", "b").count().collect():
        counts[r.domain][r.b] += r["count"]
    words = tuple(tuple(math.log(c / sum(counts[d])) for c in counts[d]) for d in domains)
    return Classifier(domains, tuple(math.log(docs[d] / sum(docs.values())) for d in domains), words)


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or some columns of it) with ``n_words`` and ``posterior``, kept; columns of
    these names are replaced."""
    added = ("n_words", "posterior")
    (found,) = fresh(docs, "b")
    # An array of one, exploded, keeps the words from being cut anew for each use.
    once = docs.withColumn(found, buckets(F.col(text_col), len(model.words[0]))).withColumn(found, F.explode(F.array(found)))
    stay = [c for c in (docs.columns if columns is None else columns) if c.lower() not in added]
    new = (F.size(found).cast("long"), model.posterior(F.col(found)))
    return kept(once.select(*stay, *[c.alias(name) for c, name in zip(new, added, strict=True)]), "posteriors")


def _rate(residuals: list[list[float]], least: float) -> Column:
    if not residuals:
        return F.lit(1.0)
    steps = F.array(*[F.lit(g) for g in residuals])

    def step(rate, g):
        move = F.aggregate(F.zip_with("posterior", g, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(float(least)), rate - move)

    return F.aggregate(steps, F.lit(1.0), step)


def rates(
    posteriors: DataFrame, domains: tuple[str, ...], targets: dict[str, float], total: float | None = None, least: float = 0.0,
    steps: int = STEPS, close: float = CLOSE,
) -> Column:
    """The rate of a row of ``posteriors``, as a column. ``total`` is the tokens wanted,
    as many as there are by default; with ``least`` 1 it is the smallest that needs no
    domain less than whole."""
    if unknown := set(targets) - set(domains):
        raise ValueError(f"no labelled documents of {sorted(unknown)}")
    weight = [targets.get(d, 0.0) / sum(targets.values()) for d in domains]

    def totals(rate: Column) -> list[float]:
        sums = [F.sum(F.col("n_words") * F.get("posterior", F.lit(k)) * rate) for k in range(len(domains))]
        return [x or 0.0 for x in posteriors.agg(*sums).first()]

    there = totals(F.lit(1.0))
    if not sum(there):
        return F.lit(1.0)
    if total is None:
        total = max((t / w for t, w in zip(there, weight, strict=True) if w > 0), default=0.0) if least else sum(there)
    wanted = [w * total for w in weight]
    residuals: list[list[float]] = []
    now = there
    while len(residuals) < steps:
        g = [(a - b) / t if t > 0 else 0.0 for a, b, t in zip(now, wanted, there, strict=True)]
        if max(map(abs, g)) <= close:
            break
        residuals.append(g)
        now = totals(_rate(residuals, least))
    return _rate(residuals, least)


def copies(rate: Column, id_col: str, seed: int = 11) -> Column:
    """How often a document stands in the mix: its rate, rounded by a hash of its id."""
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("int")
