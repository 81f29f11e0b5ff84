"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior.

Voters say little each: lexicons of words and word beginnings that training labels single out, fixed word lists, and
patterns. The label model is log-linear over the votes and a hidden label: a propensity and an accuracy for every voter,
and a correlation for every pair. With VOTERS voters all 2 ** VOTERS vote patterns and both labels are summed exactly,
so it is fitted by exact gradients to the counts of vote patterns of all documents, and of the labelled ones with their labels,
which also give its start and its share of toxic texts. The classifier is logistic regression on words and word beginnings, trained on the posterior labels of a sample.

Bounds: the lexicons are learnt from at most `rows` labelled rows and the classifier from at most `rows` rows of the
training folds, both by a hash of the id; vote patterns are counted over all documents; every text is scored whole.

Defined cases: a null text is an empty one; a text without a word has the score of the intercept; labels without
a document, null labels and repeated labels of one kind are harmless (a document with any toxic label is toxic);
without labels the fixed lists vote alone; an empty table gives an empty result; rows keep the named columns only.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricway.llm.common import written
from metricway.llm.language import sampled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

ROWS = 20_000
FEATURES = 4_096
BEGINNINGS = (4, 5, 6, 7, 8)
GAIN = 10  # nats of likelihood ratio that a feature must add: a few in a million do so by chance
VOTERS = 10
STRONG, WEAK = 0.8, 0.4
LEAST_TEXTS = 5
LEAST_WORDS = 20
PRIOR = 0.05
KEPT_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")

# Insults of the languages at hand.
ENGLISH = ("clown", "disgusting", "dumb", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
           "stupid", "trash", "vermin", "worthless")
OTHERS = ("abschaum", "basura", "cretino", "dumm", "dummkopf", "escoria", "estúpido", "idiota", "imbécil", "inútil",
          "lächerlich", "minable", "nutzlos", "ordure", "raclure", "stupide", "trottel", "widerlich")
SPELT = str.maketrans("013457@$!", "oieastasi")


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]


def vocabulary(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Voters:
    """strong, weak: features (words and beginnings with a star) that speak for the toxic label."""

    strong: set[str] = field(default_factory=set)
    weak: set[str] = field(default_factory=set)
    known: dict[str, int] = field(default_factory=dict)

    def of_word(self, word: str) -> int:
        """Bits of the voters that the word alone raises."""
        bits = (word in self.strong) | (word in self.weak) << 1
        for n in BEGINNINGS:  # voters 2 to 4: short, middle and long beginnings
            if len(word) > n and f"{word[:n]}*" in self.strong:
                bits |= 4 << (n > 5) + (n > 6)
        return bits | (word in ENGLISH) << 5 | (word in OTHERS) << 6

    def __call__(self, text: str | None) -> int:
        """The vote pattern: a bit for each voter. Voters 7 to 9: several words, an insult in disguise, nothing at all."""
        own, known, bits, raised = vocabulary(text), self.known, 0, 0
        if len(known) > KEPT_WORDS:
            known.clear()
        for word in own:
            b = known.get(word)
            if b is None:
                b = known[word] = self.of_word(word)
            if b:
                bits |= b
                raised += 1
        bits |= (raised > 1) << 7
        if text and any(c in text for c in "013457@$!"):
            plain = set(LETTERS.findall(text.lower().translate(SPELT))) - own
            bits |= any(w in ENGLISH or w in OTHERS for w in plain) << 8
        return bits | (not bits and len(own) >= LEAST_WORDS) << 9


TOWARDS = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, -1])  # what a voter speaks for


@dataclass
class LabelModel:
    """p(votes, y) ~ exp(y * prior + votes . propensity + y * votes . accuracy + correlations of the votes)."""

    prior: float
    propensity: np.ndarray
    accuracy: np.ndarray
    correlation: np.ndarray

    @staticmethod
    def states() -> np.ndarray:
        return (np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS) & 1).astype(float)

    def energies(self) -> np.ndarray:
        """(patterns, 2)"""
        x = self.states()
        base = x @ self.propensity + 0.5 * np.einsum("ij,jk,ik->i", x, self.correlation, x)
        return np.stack([base, base + self.prior + x @ self.accuracy], axis=1)

    def posterior(self) -> np.ndarray:
        """p(y = 1 | pattern) for every pattern."""
        e = self.energies()
        return 1 / (1 + np.exp(np.clip(e[:, 0] - e[:, 1], -50, 50)))

    @classmethod
    def fitted(cls, counts: dict[int, int], labelled: dict[tuple[int, int], int], steps: int = 600,
               rate: float = 0.05, pull: float = 0.003) -> LabelModel:
        """counts: documents by pattern; labelled: labelled documents by (pattern, label)."""
        x, n = cls.states(), float(sum(counts.values()) or 1)
        seen = np.zeros(1 << VOTERS)
        for pattern, c in counts.items():
            seen[pattern] = c / n
        per = np.full((2, VOTERS), 0.5)
        totals = np.full(2, 1.0)
        told = np.zeros((1 << VOTERS, 2))
        for (pattern, y), c in labelled.items():
            per[y] += c * x[pattern]
            totals[y] += c
            told[pattern, y] = c / sum(labelled.values())
        odds = np.log(per / (totals[:, None] + 1 - per).clip(1e-9))
        toxic = sum(c for (_, y), c in labelled.items() if y)
        share = (toxic + 1) / (sum(labelled.values()) + 1 / PRIOR)
        start = odds[1] - odds[0] if labelled else 2.0 * TOWARDS
        self = cls(float(np.log(share / (1 - share))), odds[0] if labelled else np.full(VOTERS, -3.0),
                   np.clip(start, -6, 6), np.zeros((VOTERS, VOTERS)))
        first = (self.propensity.copy(), self.accuracy.copy())
        moments = [(np.zeros_like(a), np.zeros_like(a)) for a in (self.propensity, self.accuracy, self.correlation)]
        for t in range(1, steps + 1):
            # Keep the share of toxic texts where the labels put it: the prior follows the other weights.
            e = self.energies() - self.energies().max()
            mass = np.exp(e)
            part = mass.sum(axis=0)
            self.prior += float(np.log(share / (1 - share)) - np.log(part[1] / part[0]))
            e = self.energies()
            p = np.exp(e - e.max())
            p /= p.sum()
            q = self.posterior()
            # all documents by pattern, and the labelled ones by pattern and label
            apart = (seen - p.sum(axis=1)) + (told.sum(axis=1) - p.sum(axis=1)) * bool(labelled)
            toxic_apart = (seen * q - p[:, 1]) + (told[:, 1] - p[:, 1]) * bool(labelled)
            grads = (x.T @ apart - pull * (self.propensity - first[0]),
                     x.T @ toxic_apart - pull * (self.accuracy - first[1]),
                     (x.T * apart) @ x * (1 - np.eye(VOTERS)) - pull * self.correlation)
            for weights, g, (m, v) in zip((self.propensity, self.accuracy, self.correlation), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return self


def _associations(rows: DataFrame, weight: str, text: str) -> DataFrame:
    """(feature, texts, toxic): how many texts hold a feature, and the sum of `weight` over them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            toxic: Counter = Counter()
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = vocabulary(body)
                for f in own | {b for w in own for b in beginnings(w)}:
                    seen[f] += 1
                    toxic[f] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()),
                                              pa.array([float(toxic[f]) for f in seen], pa.float64())],
                                             ["feature", "texts", "toxic"])

    parts = rows.select(text, F.col(weight).cast("double")).mapInArrow(count, "feature string, texts long, toxic double")
    return parts.groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))


def _telling(counted: DataFrame, texts: float, toxic: float, top: int) -> list:
    """The `top` features that tell most about the label, by the likelihood ratio; at most `top` rows."""
    a, n = F.col("toxic"), F.col("texts")
    share = F.lit(toxic / max(texts, 1))

    def gain(part, whole, by):
        return F.when(part > 0, part * F.log(part / (whole * by))).otherwise(F.lit(0.0))

    g = gain(a, n, share) + gain(n - a, n, 1 - share)
    return (counted.filter(n >= LEAST_TEXTS).select("feature", "texts", "toxic", g.alias("g")).filter(F.col("g") > GAIN)
            .orderBy(F.desc("g"), "feature").limit(top).collect())


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None, known: dict[str, tuple]) -> float:
        if len(known) > KEPT_WORDS:
            known.clear()
        weights, raised = self.weights, set()
        for word in vocabulary(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(f for f in (word, *beginnings(word)) if f in weights)
            if own:
                raised.update(own)
        total = self.intercept + sum(weights[f] for f in sorted(raised))
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, total)))))


def _regression(rows: list[list[int]], target: np.ndarray, size: int, penalty: float = 2e-5, steps: int = 400):
    """Logistic regression on sets of features with soft labels: (weights, intercept), by full gradients."""
    at = np.array([i for i, r in enumerate(rows) for _ in r], dtype=np.int64)
    which = np.array([f for r in rows for f in r], dtype=np.int64)
    n, share = len(rows), float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(size + 1)
    w[size] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[size] + np.bincount(at, w[which], n)
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(which, gap[at], size) / n + penalty * w[:size], gap.mean())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text: str = "text",
        rows: int = ROWS) -> Model:
    """docs: all documents; labels: (id, toxic); training: a condition on the id for what may be learnt from."""
    marks = (labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max("toxic").alias("y")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), training.alias("training"))
    chosen = sampled(marks.join(docs.select(F.col(id_col).alias("id"), training.alias("training")).filter("training"), "id"),
                     rows, "id").select("id", "y")
    known = written(texts.filter("training").join(chosen, "id").select("id", "text", "y"))
    # Lexicons come from one part of the labelled rows; the other shows how often the voters are right.
    part = F.pmod(F.xxhash64("id", F.lit("lexicon")), F.lit(10)) < 7
    lexical, judged = known.filter(part), known.filter(~part)
    n, toxic = lexical.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    told = _telling(_associations(lexical, "y", "text"), n, toxic, FEATURES)
    base = toxic / max(n, 1)
    strong = {r.feature for r in told if r.toxic / r.texts >= STRONG and r.toxic >= LEAST_TEXTS}
    weak = {r.feature for r in told if WEAK <= r.toxic / r.texts < STRONG and r.toxic / r.texts > 2 * base
            and "*" not in r.feature}
    voters = Voters(strong, weak)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = Counter(zip(map(voters, batch.column(0).to_pylist()), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in patterns], pa.int64()), pa.array([k[1] for k in patterns], pa.int64()),
                                              pa.array(list(patterns.values()), pa.int64())], ["pattern", "y", "n"])

    def patterns(df: DataFrame) -> list:
        """At most 2 ** VOTERS patterns and three labels, whatever the input."""
        return df.mapInArrow(vote, "pattern long, y long, n long").groupBy("pattern", "y").agg(F.sum("n").alias("n")).collect()

    counts = {r.pattern: r.n for r in patterns(texts.select("text", F.lit(None).cast("long")))}
    labelled = {(r.pattern, int(r.y > 0)): r.n for r in patterns(judged.select("text", F.col("y").cast("long")))}
    label_model = LabelModel.fitted(counts, labelled)
    posterior = label_model.posterior()

    def believe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [float(posterior[voters(x)]) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["text", "p"])

    sample = written(sampled(texts.filter("training"), rows, "id").select("text").mapInArrow(believe, "text string, p double"))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0.0))).first()
    chosen_features = [r.feature for r in _telling(_associations(sample, "p", "text"), n, toxic, FEATURES)]
    place = {f: i for i, f in enumerate(chosen_features)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for body, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = vocabulary(body)
                ids = sorted({place[f] for w in own for f in (w, *beginnings(w)) if f in place})
                seen[(tuple(ids), p)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in seen], pa.list_(pa.int64())), pa.array([k[1] for k in seen], pa.float64()),
                                              pa.array(list(seen.values()), pa.int64())], ["ids", "p", "n"])

    training_rows = sample.mapInArrow(found, "ids array<long>, p double, n long").collect()  # at most `rows` rows
    each = [(list(r.ids), r.p) for r in training_rows for _ in range(r.n)]
    if not each:
        return Model(voters, label_model, {}, float(np.log(PRIOR / (1 - PRIOR))))
    weights, intercept = _regression([r[0] for r in each], np.array([r[1] for r in each]), len(place))
    return Model(voters, label_model, dict(zip(place, map(float, weights))), intercept)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with `score` (0 to 1, higher: toxic likelier) and `predicted` (1 if score >= 0.5)."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            s = [model.score(x, known) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64()),
                                              pa.array([int(x >= 0.5) for x in s], pa.int32())],
                                             [*keep, "score", "predicted"])

    return rows.mapInArrow(judge, f"{schema}, score double, predicted int")
