r"""Allow and block verdicts for URLs: rules first, then a logistic regression on hashed
character n-grams of host and path. DataFrame functions only.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path goes on to ``?``, ``#`` or the end. A URL that is null or holds no
``://`` has neither. A rule ``host/path`` fits its host and all subdomains where the
URL's path starts with the rule's; of those that fit the longest wins, ties going to the
longer host and then to blocking.

Features are the n-grams of host and path, digits made equal, with marks for where a host
and its labels begin and end, each n-gram hashed with its part to one of ``n_buckets``. A URL counts
each bucket once and is scaled to length 1. The regression is fitted by accelerated
gradient steps over the labelled table, of which at most ``rows`` rows are used, those
with the smallest hash of the URL. The weights, one number a bucket, are all that the
driver gets and that tasks are given.

Cases: a URL without host and path has no features and is allowed; labels are 1 for block
and 0 for allow, rows with null URL or label are left out, repeated rows count repeatedly;
with labels of one class, or none, all URLs get that class's verdict, or allow. Repeated
pages are judged alike, each row by itself. Columns of the result that the input has too
are replaced; all others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import kept, let

ROWS, N_BUCKETS, SIZES, STEPS, RIDGE = 1000, 1 << 13, (3, 4, 5), 80, 1e-4
# How common blocking is taken to be, whatever the labelled table's shares are.
BLOCK_SHARE = 0.3
MAX_RULES = 10_000  # they stand in the plan; longer lists belong into a joined table
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, rule: str) -> Rule:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"a rule is allow or block and host/path: {verdict} {rule}")
        return cls(verdict, host.translate(str.maketrans(_UPPER, _UPPER.lower())), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The rule that wins, as a struct of text and verdict, or null."""
    order = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))
    if len(order) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column, part: int, n_buckets: int) -> Column:
    """The buckets of a part's n-grams; no n-gram is cut out of the text more than once."""

    def of_size(chars: Column, size: int) -> Column:
        last = F.size(chars) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

        def bucket(i: Column) -> Column:
            gram = F.concat(*[F.get(chars, i + k) for k in range(size)])
            return F.pmod(F.xxhash64(F.lit(part * 10 + size), gram), F.lit(n_buckets)).cast("int")

        return F.transform(starts, bucket)

    def of(chars: Column) -> Column:
        return F.concat(*[of_size(chars, size) for size in SIZES])

    return F.when(text != "", let(F.split(text, ""), of)).otherwise(F.array().cast("array<int>"))


def buckets(host: Column, path: Column, n_buckets: int = N_BUCKETS) -> Column:
    """The distinct buckets of a URL."""
    digits = r"[0-9]+"
    marked = F.when(host != "", F.concat(F.lit("^."), F.regexp_replace(host, digits, "0"), F.lit(".$"))).otherwise("")
    return F.array_distinct(F.concat(_grams(marked, 1, n_buckets), _grams(F.regexp_replace(path, digits, "0"), 2, n_buckets)))


@dataclass(frozen=True)
class Model:
    """A weight per bucket, and the bias."""

    weights: tuple[float, ...]
    bias: float

    def score(self, found: Column) -> Column:
        """The chance that a URL is to be blocked; 0 where it has no features."""
        # One string, folded to an array once, and not a literal for each weight.
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
        z = F.lit(self.bias) + total / F.sqrt(F.size(found).cast("double"))
        return F.when(F.size(found) > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)


def _plus(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _shares(rows: Column, share: Column, steps: int, ridge: float) -> Column:
    """What each of ``rows`` (y, b) adds to the weights: the descent runs on these numbers,
    as all gradients are sums of the rows' features. ``share`` has the weight of each row in
    the loss; the weights sum to 1. A row's features, with the bias, have a length of
    sqrt(2), so that steps of 2 are within the bound of the logistic loss."""

    def product(r: Column, q: Column) -> Column:
        return 1 + F.size(F.array_intersect(r["b"], q["b"])) / F.sqrt((F.size(r["b"]) * F.size(q["b"])).cast("double"))

    def descend(alike: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            sums = F.transform(alike, lambda each: _plus(each, state["ahead"]))
            missed = F.zip_with(rows, sums, lambda r, z: r["y"] - 1 / (1 + F.exp(-z)))
            slope = F.zip_with(F.zip_with(missed, share, lambda e, w: e * w), state["ahead"], lambda g, a: a + 2 * (g - ridge * a))
            grown = (1 + F.sqrt(1 + 4 * state["pace"] * state["pace"])) / 2

            def momentum(moved: Column) -> Column:
                ahead = F.zip_with(moved, state["now"], lambda a, b: a + (state["pace"] - 1) / grown * (a - b))
                return F.struct(moved.alias("now"), ahead.alias("ahead"), grown.alias("pace"))

            return let(slope, momentum)

        zero = F.transform(rows, lambda _: F.lit(0.0))
        first = F.struct(zero.alias("now"), zero.alias("ahead"), F.lit(1.0).alias("pace"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["now"]

    return let(F.transform(rows, lambda r: F.transform(rows, lambda q: product(r, q))), descend)


def fit(
    labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", rows: int = ROWS, n_buckets: int = N_BUCKETS,
    steps: int = STEPS, ridge: float = RIDGE, block_share: float = BLOCK_SHARE,
) -> Model:
    """A model of ``labelled`` (url, 1 or 0)."""
    known = labelled.select(F.col(url_col).alias("url"), F.col(label_col).alias("y")).where("url IS NOT NULL AND y IS NOT NULL")
    known = known.orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    found = known.select((F.col("y") > 0).cast("double").alias("y"), buckets(host_of(F.col("url")), path_of(F.col("url")), n_buckets).alias("b"))
    # One row holds the sample, which is no larger than ``rows``.
    sample = found.where(F.size("b") > 0).agg(F.collect_list(F.struct("y", "b")).alias("rows"))
    sample = sample.withColumn("n", F.size("rows")).withColumn("n_block", F.size(F.filter("rows", lambda r: r["y"] > 0)))
    both = (F.col("n_block") > 0) & (F.col("n_block") < F.col("n"))
    part = F.transform("rows", lambda r: F.when(r["y"] > 0, block_share / F.col("n_block")).otherwise((1 - block_share) / (F.col("n") - F.col("n_block"))))
    none = F.transform("rows", lambda _: F.lit(0.0))
    share = F.when(both, let(part, lambda w: _shares(F.col("rows"), w, steps, ridge))).otherwise(none)
    fitted = kept(sample.withColumn("share", share), "urls")
    head = fitted.select("n", "n_block", F.aggregate("share", F.lit(0.0), lambda t, x: t + x).alias("bias")).first()
    if head.n_block in (0, head.n):
        return Model((0.0,) * n_buckets, 40.0 if head.n_block else -40.0)
    each = fitted.select(F.explode(F.arrays_zip("rows", "share")).alias("r")).select("r.rows.b", "r.share")
    each = each.select(F.explode("b").alias("b"), (F.col("share") / F.sqrt(F.size("b").cast("double"))).alias("w"))
    weights = [0.0] * n_buckets
    for r in each.groupBy("b").agg(F.sum("w").alias("w")).collect():  # at most n_buckets numbers
        weights[r.b] = r.w
    return Model(tuple(weights), head.bias)


def judge(pages: DataFrame, model: Model, rules: Iterable[Rule] = (), url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (or null), ``score`` (null where a rule
    decides) and ``verdict``."""
    mine = ("host", "path", "rule", "score", "verdict")
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in (*mine, "won")}
    with_parts = pages.withColumn(own["host"], host_of(F.col(url_col))).withColumn(own["path"], path_of(F.col(url_col)))
    host, path = F.col(own["host"]), F.col(own["path"])
    won = with_parts.withColumn(own["won"], rule_of(host, path, rules))
    score = F.when(F.col(own["won"]).isNull(), let(buckets(host, path, len(model.weights)), model.score))
    scored = won.withColumn(own["score"], score)
    verdict = F.when(F.col(own["won"]).isNotNull(), F.col(own["won"])["verdict"])
    verdict = verdict.otherwise(F.when(F.col(own["score"]) >= 0.5, "block").otherwise("allow"))
    rest = [c for c in pages.columns if c not in mine]
    return scored.select(
        *[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"), F.col(own["won"])["text"].alias("rule"),
        F.col(own["score"]).alias("score"), verdict.alias("verdict"),
    )


# A small labelled table: names by hand, of what a site offers, each in three forms of URL
# that both classes share, so that nothing else in a URL tells them apart.
BLOCKED = """
grand-casino online-casino casino-royal casinobonus live-casino best-slots slots-city poker-room poker-stars free-spins
sport-bets live-bets betting-tips bets-today roulette jackpot-win win-money you-win-prize lottery-win bingo-win
cheap-meds pills-online buy-pills diet-pills viagra-shop cheap-watches cheap-loans payday-loans replica-bags fake-rolex
adult-video adult-chat xxx-movies adult-dating hot-xxx porn-tube x-rated sexy-cams escort-girls nude-x
spam-links spam-blog link-farm click-farm seo-spam content-farm ads-server ads-click track-user ad-track
pop-ads tracker-pixel adserver free-gift free-crypto double-bitcoin warez-crack keygen miracle-cure get-rich-quick
""".split()
ALLOWED = """
library museum gardening weather university city-news open-data recipes history travel-notes
railway hospital theatre orchestra the-river mountains chemistry physics the-nation thinking
authors tradition weather-station education children handbook earth-science engineer northern printing
ocean reading botany dairy fishing village the-star painting standards theses
translation astronomy heritage enterprise statistics freedom question brother hiking lighthouse
medicine another generation whether free-software art-gallery adults-learning farm-museum window-works trackside
""".split()
FORMS = ("https://{name}.example.{top}/{lang}/{n}", "http://{sub}.{name}.example.{top}/{lang}/{n}.html", "https://{sub}.example.{top}/{name}/{n}/")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow)."""
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            for k, form in enumerate(FORMS):
                j = i + k
                parts = {"top": ("com", "org", "net")[j % 3], "lang": ("en", "de", "fr", "es")[j % 4], "sub": ("www", "m", "blog")[j % 3]}
                rows.append((form.format(name=name, n=10 + j, **parts), label))
    return rows
