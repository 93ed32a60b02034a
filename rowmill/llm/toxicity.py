"""Toxicity scores from a counterfactually regularised classifier.

The classifier is a logistic regression over the presence of lexical indicators: words, word beginnings and word ends
that labelled toxic texts have significantly more often than clean ones. Besides the log loss it minimises a
counterfactual penalty: in labelled texts each identity term is swapped for others of its language, and the squared
change of the logit is added to the loss. So what a text says about a group can't hinge on which group it is, and
neutral mentions aren't taken for toxicity. Every text of the sample that names groups gets pairs for all its terms; besides,
neutral mentions are appended to texts for such pairs, those that name no group first, so that every term is covered.

Training takes a bounded sample: of each label at most MAX_PER_LABEL rows (those with the smallest seeded hash of the
id). Its ids are picked from the labels alone and broadcast, so documents aren't shuffled; executors reduce each whole text
of it, however long, to its distinct words, which go to the driver. Scoring is one scan of whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import bounded_batches, columns_of, fresh, release_memory
from rowmill.session import table

MAX_PER_LABEL = 3_000
MAX_INDICATORS = 4_096
SEED = 41
#: Standard errors by which an indicator's log odds must differ, and texts of the sample that must have it.
LEAST_Z, LEAST_TEXTS = 2.5, 3
#: Weight of the counterfactual penalty.
COUNTERFACTUAL = 1.0
#: Neutral mentions that are appended; swaps of each term of a text.
PAIR_TEXTS, SWAPS = 500, 4
THRESHOLD = 0.3
#: Words that a worker remembers.
REMEMBERED = 1 << 18

# Identity terms by language.
IDENTITY_TERMS = {
    "en": ("women", "men", "gay", "lesbian", "transgender", "muslim", "jewish", "christian", "hindu", "black", "white", "asian", "immigrant", "refugee", "disabled", "elderly"),
    "de": ("frauen", "männer", "schwule", "lesben", "muslime", "juden", "christen", "schwarze", "asiaten", "einwanderer", "flüchtlinge", "behinderte"),
    "fr": ("femmes", "hommes", "homosexuels", "lesbiennes", "musulmans", "juifs", "chrétiens", "noirs", "asiatiques", "immigrés", "réfugiés", "handicapés"),
    "es": ("mujeres", "hombres", "homosexuales", "lesbianas", "musulmanes", "judíos", "cristianos", "negros", "asiáticos", "inmigrantes", "refugiados", "discapacitados"),
}
_GROUP_OF = {t: terms for terms in IDENTITY_TERMS.values() for t in terms}

words_of = re.compile(r"[^\W\d_]+").findall


def indicators(word: str) -> list[str]:
    """What can stand for a word: itself, its beginnings and its end."""
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) > k), *([f"{word[-4:]}$"] if len(word) > 4 else [])]


@dataclass
class ToxicityModel:
    """Indicator weights; ``bias`` alone decides texts without any."""

    place: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -5.0

    def found(self, words: Iterable[str], memory: dict[str, tuple[int, ...]]) -> set[int]:
        """Places of the indicators that a text of these words has."""
        out: set[int] = set()
        for word in words:
            hits = memory.get(word)
            if hits is None:
                if len(memory) > REMEMBERED:
                    memory.clear()
                hits = memory[word] = tuple(p for i in indicators(word) if (p := self.place.get(i)) is not None)
            if hits:
                out.update(hits)
        return out

    def score(self, text: str, memory: dict[str, tuple[int, ...]]) -> float:
        hits = self.found(set(words_of(text.lower())), memory)
        logit = self.bias + float(self.weights[list(hits)].sum()) if hits else self.bias
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))

    @classmethod
    def fit(cls, texts: Sequence[str], toxic: Sequence[int], counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
        """Repeated texts count once, with the last one's label. With one label only, every text scores 0 or 1; without texts 0."""
        unique = dict(zip(texts, toxic, strict=True))
        y = np.array(list(unique.values()), float)
        if not len(y) or y.min() == y.max():
            return cls(bias=30.0 if len(y) and y[0] else -30.0)
        bags = [frozenset(words_of(t.lower())) for t in unique]
        model = cls(cls._select(bags, y))
        model._train(bags, y, counterfactual)
        return model

    @staticmethod
    def _select(bags: list[frozenset[str]], y: np.ndarray) -> dict[str, int]:
        """Indicators with significantly more toxic texts, the surest first; identity words always."""
        names: dict[str, int] = {}
        of_word: dict[str, np.ndarray] = {}
        counts = [np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)]
        for bag, label in zip(bags, y, strict=True):
            for word in bag:
                if word not in of_word:
                    of_word[word] = np.array([names.setdefault(i, len(names)) for i in indicators(word)])
            if bag:
                own = np.unique(np.concatenate([of_word[w] for w in bag]))
                if own[-1] >= len(counts[0]):
                    counts = [np.concatenate([c, np.zeros(len(names), np.int32)]) for c in counts]
                counts[int(label)][own] += 1
        b, a = (c[: len(names)].astype(float) for c in counts)
        n_b, n_a = (y == 0).sum(), (y == 1).sum()
        odds = np.log((a + 0.5) / (n_a - a + 0.5)) - np.log((b + 0.5) / (n_b - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (n_a - a + 0.5) + 1 / (b + 0.5) + 1 / (n_b - b + 0.5))
        z[a < LEAST_TEXTS] = 0
        listed = list(names)
        order = np.argsort(-z, kind="stable")[:MAX_INDICATORS]
        chosen = [listed[i] for i in order if z[i] >= LEAST_Z]
        return {name: i for i, name in enumerate(dict.fromkeys([*chosen, *(f"={t}" for t in _GROUP_OF)]))}

    def _pairs(self, bags: list[frozenset[str]]) -> Counter[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Indicators that texts lose and gain when one identity term is swapped, with the number of such pairs."""
        groups, of_term = list(IDENTITY_TERMS.values()), {t: self.found([t], {}) for t in _GROUP_OF}
        memory: dict[str, tuple[int, ...]] = {}
        pairs: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()

        def swap(bag: frozenset[str], terms: Sequence[str], n: int) -> None:
            held: Counter[int] = Counter()
            for word in bag if terms else ():
                held.update(self.found([word], memory))
            for term in terms:
                others = [t for t in _GROUP_OF[term] if t != term]
                for k in range(SWAPS):
                    old, new = of_term[term], of_term[others[(n + k) % len(others)]]
                    lost = (i for i in old - new if held[i] == 1)
                    gained = (i for i in new - old if not held[i])
                    pairs[tuple(sorted(lost)), tuple(sorted(gained))] += 1

        for n, bag in enumerate(bags):
            swap(bag, sorted(bag & _GROUP_OF.keys()), n)
        order = sorted(bags, key=lambda b: bool(b & _GROUP_OF.keys()))
        for n in range(PAIR_TEXTS if bags else 0):
            terms = groups[n % len(groups)]
            mention = terms[n // len(groups) % len(terms)]
            swap(order[n % len(order)] | {mention}, [mention], n)
        return pairs

    def _train(self, bags: list[frozenset[str]], y: np.ndarray, counterfactual: float, steps: int = 400, ridge: float = 1e-4) -> None:
        memory: dict[str, tuple[int, ...]] = {}

        hits = [sorted(self.found(b, memory)) for b in bags]
        rows, columns = np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.array([p for h in hits for p in h], np.int64)
        # The indicators that both texts of a pair have cancel out, so equal swaps are one pair that counts repeatedly.
        pairs = self._pairs(bags)
        left, right = (
            (np.repeat(np.arange(len(pairs)), [len(p[side]) for p in pairs]), np.array([i for p in pairs for i in p[side]], np.int64)) for side in (0, 1)
        )
        share = np.array(list(pairs.values()), float) / max(1, pairs.total())
        n, k = len(y), len(self.place)
        w, bias = np.zeros(k), 0.0
        # Toxic texts weigh a fifth of the whole however many there are; Adam on the whole sample.
        weight = np.where(y == 1, 0.2 / max(1, y.sum()), 0.8 / max(1, (1 - y).sum())) if n else y
        m, v = np.zeros(k + 1), np.zeros(k + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[columns], n), -30, 30)))
            residual = (p - y) * weight
            g = np.bincount(columns, residual[rows], k) + ridge * w
            if counterfactual and pairs:
                change = np.bincount(left[0], w[left[1]], len(pairs)) - np.bincount(right[0], w[right[1]], len(pairs))
                change *= 2 * counterfactual * share
                g += np.bincount(left[1], change[left[0]], k) - np.bincount(right[1], change[right[0]], k)
            g = np.append(g, residual.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, bias = w - move[:-1], bias - move[-1]
        self.weights, self.bias = w, float(bias)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Fit the model to the labelled rows of ``docs`` that aren't held out, within the bound of the sample.

    NULL texts count as empty. Texts with the same words count once, with the label of the largest doc_id. Labels other
    than 0 and 1, those without doc_id or without a document, and documents without a label aren't learned. Empty tables
    give a model that scores 0."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    hashed = F.xxhash64(F.lit(SEED), "doc_id")
    parts = [usable.filter(F.col("toxic") == label).orderBy(hashed, "doc_id").limit(MAX_PER_LABEL) for label in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    rows = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("string")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(sorted(set(words_of(t.lower())))))

    found = sorted((r["doc_id"], r["toxic"], r["words"]) for r in rows.select("doc_id", "toxic", distinct_words("text").alias("words")).collect())
    return ToxicityModel.fit([t for _, _, t in found], [y for _, y, _ in found], counterfactual)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) over each whole text, replacing one of that name. NULL counts as empty;
    an empty text has the score of a text without indicators. No other column is read, and repeated rows score equal."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory: dict[str, tuple[int, ...]] = {}
        for texts in parts:
            yield pd.Series([model.score(t, memory) for t in texts], dtype="float64")
        memory.clear()
        release_memory()

    return bounded_batches(docs).withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns, whatever their names. NULL and empty texts
    have the score of a text without indicators, repeated rows stay or go together, and an empty table gives an
    empty result."""
    name = fresh(docs, "_toxicity")
    marked = score_toxicity(docs, train(docs, labels), score=name)
    return marked.filter(F.col(name) < threshold).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
