"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the URLs without a rule.

The trees learn from labelled URLs, by default those that a rule decides: a bounded sample of MAX_TRAIN of them, the
smallest by a seeded hash. Features are length, depth, digit ratio, entropy, parameter counts and suffix statistics:
the smoothed share of blocked URLs by the last one and two labels of the host, and by the first directory that follows
them, counted over all labelled URLs. Only pages without a rule are scored. The trees and the MAX_BROADCAST most frequent
suffixes travel to the executors, so scoring is one scan without shuffle; where there are more suffixes, the statistics of
the others are joined to the rows that have them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.session import table

#: (verdict, host, path) of the rules; a rule is named host + path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled URLs that the trees are fitted to, at most.
MAX_TRAIN = 20_000
SEED = 29
#: Suffixes whose statistics are broadcast, at most: about 20 MB in each Python worker.
MAX_BROADCAST = 100_000
#: Suffixes that a task counts before it passes the counts on.
MAX_COUNTED = 100_000
#: Prior rows of a suffix statistic.
SMOOTHING = 10.0
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "labels", "depth", "digits", "letters", "entropy",
    "parameters", "hyphens", "has_fragment", "suffix_1", "suffix_2", "directory",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the rules see them; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; NULL without any."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(url: str) -> tuple[str, str, str]:
    """What statistics are kept of: the last label of the host, the last two, and the first directory behind a slash."""
    _, mark, rest = url.partition("://")
    host, _, path = (rest if mark else url).partition("#")[0].partition("?")[0].partition("/")
    labels, (directory, more, _) = host.lower().split("."), path.partition("/")
    return labels[-1], ".".join(labels[-2:]), "/" + (directory if more else "")


def count_suffixes(labelled: Iterable[tuple[str, int]]) -> dict[str | None, tuple[int, int]]:
    """Blocked and all URLs by suffix, and of all rows under None."""
    seen: dict[str | None, list[int]] = defaultdict(lambda: [0, 0])
    for url, label in labelled:
        for s in {None, *suffixes(url)}:
            seen[s][0] += label
            seen[s][1] += 1
    return {s: (a, n) for s, (a, n) in seen.items()}


def lexical(url: str) -> tuple[list[float], tuple[str, str, str]]:
    """The features of a URL but for the suffix statistics, and its suffixes."""
    _, mark, rest = url.partition("://")
    rest = rest if mark else url
    rest, fragment, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.lower()
    n = max(1, len(url))
    values = [
        len(url), len(host), len(path), len(query), host.count(".") + 1, sum(map(bool, path.split("/"))), sum(c.isdigit() for c in url) / n,
        sum(c.isalpha() for c in url) / n, entropy(url), query.count("&") + 1 if query else 0, url.count("-"), float(bool(fragment)),
    ]
    return values, suffixes(url)


@dataclass
class Tree:
    """A regression tree over binned features, as arrays: node i sends rows with bin <= cut left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for a, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(x)
        return len(self.feature) - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = every[inner]
            here = at[rows]
            at[rows] = np.where(bins[rows, feature[here]] <= cut[here], left[here], right[here])
        return np.array(self.value)[at]


@dataclass
class BoostedTrees:
    """Binary gradient boosting with logistic loss, second-order leaf values and histogram splits."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    max_bins: int = 64
    ridge: float = 1.0
    least: int = 10
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.max_bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        bins = self._bin(x)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = Tree()
            self._grow(tree, bins, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += tree.predict(bins)
        return self

    def _grow(self, tree: Tree, bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        node = tree.add()
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.value[node] = float(-self.rate * gs / (hs + self.ridge))
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * self.least:
            for j in range(bins.shape[1]):
                b = bins[rows, j]
                width = len(self.edges[j]) + 1
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=width))[:-1] for w in (g[rows], h[rows], None))
                gain = left_g**2 / (left_h + self.ridge) + (gs - left_g) ** 2 / (hs - left_h + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            tree.feature[node], tree.cut[node] = best[1], best[2]
            goes = bins[rows, best[1]] <= best[2]
            tree.left[node] = self._grow(tree, bins, g, h, rows[goes], depth - 1)
            tree.right[node] = self._grow(tree, bins, g, h, rows[~goes], depth - 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, score = self._bin(x), np.full(len(x), self.base)
        for tree in self.trees:
            score += tree.predict(bins)
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    """Suffix statistics and trees."""

    rates: dict[str, float]
    prior: float
    trees: BoostedTrees

    @classmethod
    def fit(cls, urls: Sequence[str], blocked: Sequence[int], counts: dict[str | None, tuple[int, int]] | None = None) -> UrlModel:
        """Without rows, or with rows of one label only, every URL scores that label's share (0 without rows). ``counts`` are
        the blocked and all URLs by suffix, under None those of the whole table; by default of these rows."""
        counts = count_suffixes(zip(urls, blocked, strict=True)) if counts is None else counts
        y = np.array(blocked, float)
        total = counts.get(None, (0, 0))
        prior = total[0] / total[1] if total[1] else 0.0
        made = [lexical(u) for u in urls]
        model = cls({s: (a + SMOOTHING * prior) / (n + SMOOTHING) for s, (a, n) in counts.items() if s is not None}, prior, BoostedTrees())
        if len(y) and y.min() < y.max():
            x = model.matrix(made)
            # Once more with unknown hosts, so that the trees know how to judge a suffix that no label has.
            unknown = x.copy()
            unknown[:, [FEATURES.index("suffix_1"), FEATURES.index("suffix_2")]] = prior
            model.trees.fit(np.concatenate([x, unknown]), np.concatenate([y, y]))
        return model

    def matrix(self, made: Sequence[tuple[list[float], tuple[str, str, str]]], joined: Sequence[Sequence[float | None]] | None = None) -> np.ndarray:
        """``joined`` has the statistics of the suffixes of each row where they aren't among the model's."""

        def rate(suffix: str, other: float | None) -> float:
            return self.rates.get(suffix, self.prior if other is None or math.isnan(other) else other)

        others = joined or [(None, None, None)] * len(made)
        rows = [[*values, *map(rate, own, more)] for (values, own), more in zip(made, others, strict=True)]
        return np.array(rows, float).reshape(len(made), len(FEATURES))

    def predict(self, urls: Sequence[str], joined: Sequence[Sequence[float | None]] | None = None) -> np.ndarray:
        if not self.trees.trees:
            return np.full(len(urls), self.prior)
        return self.trees.predict(self.matrix([lexical(u) for u in urls], joined))


def judged_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict (NULL without a rule)."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.select("*", name.alias("rule"), verdict.alias("said"))


def training_sample(labelled: DataFrame, most: int = MAX_TRAIN) -> tuple[list[str], list[int]]:
    """A bounded sample of ``labelled`` (url, blocked): the rows with the smallest seeded hash of the URL."""
    rows = labelled.filter(F.col("url").isNotNull()).orderBy(F.xxhash64(F.lit(SEED), "url"), "url", "blocked").limit(most).collect()
    return [r["url"] for r in rows], [int(r["blocked"]) for r in rows]


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """suffix, blocked and total over all rows of ``labelled``; the NULL suffix stands for all of them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pd.DataFrame:
            made = pd.DataFrame([(s, a, n) for s, (a, n) in seen.items()], columns=["suffix", "blocked", "total"])
            seen.clear()
            return made.astype({"suffix": object, "blocked": "int64", "total": "int64"})

        for part in parts:
            for s, (a, n) in count_suffixes(zip(part["url"], part["blocked"].astype(int), strict=True)).items():
                seen[s][0] += a
                seen[s][1] += n
            if len(seen) >= MAX_COUNTED:
                yield out()
        yield out()

    rows = labelled.filter("url is not null and blocked is not null").select("url", "blocked")
    counted = rows.mapInPandas(run, "suffix string, blocked long, total long")
    return counted.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("total").alias("total"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Allow or block every page; one row for each row of ``pages``.

    The longest rule that fits decides; without one the trees do: block from a score of ``threshold``. ``labelled`` (url,
    blocked 0/1) trains them, by default the pages that a rule decides. NULL and malformed URLs have empty host
    and path, fit no rule and are scored as they stand, NULL as empty text. Repeated rows get equal verdicts. Without labelled
    rows everything scores 0. Other columns are not read. An empty table gives an empty result. Returns page_id, host,
    path, rule, verdict, score (NULL where a rule decides).
    """
    judged = judged_by_rules(pages, rules)
    if labelled is None:
        labelled = judged.filter("said is not null").select("url", (F.col("said") == "block").cast("int").alias("blocked"))
    urls, blocked = training_sample(labelled)
    order = [F.col("suffix").isNull().desc(), F.desc("total"), "suffix"]
    # The total, the suffixes that are broadcast and one more, which says whether there are others.
    found = suffix_counts(labelled).orderBy(*order).limit(MAX_BROADCAST + 2).collect()
    if len(found) > MAX_BROADCAST + 1:
        return _scored_by_join(judged, labelled, urls, blocked, [tuple(r) for r in found[:-1]], threshold)
    model = UrlModel.fit(urls, blocked, {s: (a, n) for s, a, n in found})

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in parts:
            yield _scores(model, urls)

    return _verdicts(judged.withColumn("score", score(_undecided())), threshold)


def _undecided() -> Column:
    """The URL of a page that no rule decides."""
    return F.when(F.col("said").isNull(), F.coalesce("url", F.lit("")))


def _scores(model: UrlModel, urls: pd.Series, joined: Sequence[Sequence[float | None]] | None = None) -> pd.Series:
    """Scores of the URLs that aren't NULL."""
    there = [i for i, u in enumerate(urls) if u is not None]
    out = pd.Series([None] * len(urls), dtype="float64")
    if there:
        out.iloc[there] = model.predict([urls.iloc[i] for i in there], None if joined is None else [joined[i] for i in there])
    return out


def held_out_accuracy(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> tuple[int, int]:
    """Of the pages that a rule decides, a fifth by a hash of the URL is held out; the trees learn from the others. How many
    are held out, and how many of those the trees judge as the rule does."""
    judged = judged_by_rules(pages, rules).filter("said is not null").withColumn("blocked", (F.col("said") == "block").cast("int"))
    out = F.pmod(F.xxhash64(F.lit(SEED + 1), "url"), F.lit(5)) == 0
    scored = filter_urls(judged.filter(out), (), judged.filter(~out).select("url", "blocked"), threshold)
    both = scored.join(judged.filter(out).select("page_id", "said").distinct(), "page_id")
    return both.agg(F.count(F.lit(1)), F.count_if(F.col("verdict") == F.col("said"))).first()


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")


def _scored_by_join(judged: DataFrame, labelled: DataFrame, urls: list[str], blocked: list[int], top: list[tuple[str | None, int, int]], threshold: float) -> DataFrame:
    """Verdicts where only the statistics of the ``top`` suffixes are broadcast."""
    spark = judged.sparkSession
    counts = {s: (a, n) for s, a, n in top}
    known = frozenset(counts)
    table_of = suffix_counts(labelled).filter("suffix is not null")
    # The sample has at most 3 * MAX_TRAIN suffixes; the trees are fitted to the statistics of all of them.
    needed = sorted({s for u in urls for s in suffixes(u)} - known)
    if needed:
        wanted = spark.createDataFrame([(s,) for s in needed], "suffix string")
        own = {r["suffix"]: (r["blocked"], r["total"]) for r in table_of.join(F.broadcast(wanted), "suffix").collect()}
    else:
        own = {}
    model = UrlModel.fit(urls, blocked, counts | own)
    share = (F.col("blocked") + SMOOTHING * model.prior) / (F.col("total") + SMOOTHING)
    rates = table_of.select("suffix", share.alias("rate"))

    @F.pandas_udf("array<string>")
    def rare(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in parts:
            yield pd.Series([None if u is None else [None if s in known else s for s in suffixes(u)] for u in some])

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some, *rates in parts:
            yield _scores(model, some, list(zip(*rates, strict=True)))

    rows = judged.withColumn("_rare", rare(_undecided()))
    for i in (0, 1, 2):
        # Rows of broadcast suffixes find nothing, under keys (no suffix begins with two slashes) that deal them evenly.
        key = F.coalesce(F.get("_rare", F.lit(i)), F.concat(F.lit("//"), F.xxhash64("page_id", "url").cast("string")))
        side = rates.select(F.col("suffix").alias(f"_key{i}"), F.col("rate").alias(f"_rate{i}"))
        rows = rows.withColumn(f"_key{i}", key).join(side, f"_key{i}", "left")
    return _verdicts(rows.withColumn("score", score(_undecided(), "_rate0", "_rate1", "_rate2")), threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
