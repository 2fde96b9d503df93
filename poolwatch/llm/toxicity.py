"""Operator 6, toxicity by a classifier chain.

The categories are predicted in turn, low quality and then toxicity. Each has a logistic regression
on the presence of words and word beginnings; a later one also sees the earlier probability. While training, that
probability comes from models that have not seen the row (out-of-fold), as it will when predicting.

The models are fitted on a bounded sample of labelled rows, SAMPLE at most, chosen by a hash and
even between the classes of the last category. Words enter the vocabulary by how differently the
sample's classes use them. Every document is predicted from its whole text.

Defined results: a null text, or one without words, has the probabilities of a text without known
words; without labelled rows all probabilities are 0; of several labels of one doc_id the largest
counts; null labels are not learned from; repeated rows get equal answers; an empty table gives no
rows; extra columns are not read.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from poolwatch.llm.common import documents

SAMPLE = 5_000
VOCABULARY = 2_000
LEAST_ROWS = 5
# Letters of a word's beginning that is a feature of its own, marked by a star.
STEM = 5
KEPT_WORDS = 300_000
FOLDS = 5
PENALTY = 2.0
CATEGORIES = ("low_quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, low_quality_score double, toxic_score double, low_quality boolean, toxic boolean"


def words_of(text: str | None) -> set[str]:
    """Lower-cased words."""
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    return words | {f"{w[:STEM]}*" for w in words}


def logistic(x: list[np.ndarray], more: np.ndarray, y: np.ndarray, size: int, penalty: float = PENALTY, rounds: int = 25):
    """Weights of the words, of the columns of `more`, and the constant.

    `x`: word numbers of each row. Both classes weigh the same as a whole. Newton steps by conjugate
    gradients on the penalised likelihood.
    """
    even = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    wide = np.hstack([more, np.ones((len(x), 1))])
    k = wide.shape[1]
    keep = np.append(np.full(size + k - 1, penalty), 1e-3)

    def ahead(w):
        return np.bincount(rows, w[cols], len(x)) + wide @ w[size:]

    def back(v):
        return np.append(np.bincount(cols, v[rows], size), wide.T @ v)

    w = np.zeros(size + k)
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        slope = back(even * (y - p)) - keep * w
        if np.abs(slope).max() < 1e-4:
            break
        curve = even * np.maximum(p * (1 - p), 1e-6)
        step, rest = np.zeros_like(w), slope.copy()
        way, size2 = rest.copy(), rest @ rest
        for _ in range(rounds):
            turned = back(curve * ahead(way)) + keep * way
            a = size2 / (way @ turned)
            step += a * way
            rest -= a * turned
            new = rest @ rest
            if new < 1e-10:
                break
            way, size2 = rest + new / size2 * way, new
        w += step
    return w


@dataclass
class Chain:
    words: dict[str, int]
    weights: list[np.ndarray]

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def numbers(self, words: set[str]) -> np.ndarray:
        known = self.known
        for w in words.difference(known):
            known[w] = tuple(self.words[f] for f in (w, f"{w[:STEM]}*") if f in self.words)
        found = np.array(list({i for w in words for i in known[w]}), np.int64)
        if len(known) > KEPT_WORDS:
            known.clear()
        return found

    def probabilities(self, sets: list[set[str]]) -> np.ndarray:
        """A column per category."""
        found = [self.numbers(s) for s in sets]
        out = np.empty((len(sets), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(found, out[:, :k], w, len(self.words))
        return out


def _sigmoid(found: list[np.ndarray], earlier: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    z = np.array([w[f].sum() for f in found]) + earlier @ w[size:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(sets: list[set[str]], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """`labels`: a column of 0 and 1 per category, in the order of the chain."""
    sets = [features(s) for s in sets]
    seen = [Counter(w for s, y in zip(sets, column) if y for w in s) for column in (np.ones(len(sets)), *labels.T)]
    names = sorted(w for w, n in seen[0].items() if n >= LEAST_ROWS)
    counts = np.array([[c[w] for c in seen] for w in names], float).reshape(len(names), len(seen))
    # Chi-square of presence against each category; the best of them ranks a word.
    score = np.zeros(len(names))
    n, held = len(sets), labels.sum(0)
    for k in range(labels.shape[1]):
        a, b = counts[:, 1 + k], counts[:, 0] - counts[:, 1 + k]
        c, d = held[k] - a, n - held[k] - b
        score = np.maximum(score, n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1))
    chosen = sorted(np.argsort(-score, kind="stable")[:VOCABULARY])
    words = {names[i]: j for j, i in enumerate(chosen)}
    found = [np.array(sorted(words[w] for w in s & words.keys()), np.int64) for s in sets]
    earlier, weights = np.empty((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        weights.append(logistic(found, earlier, y, len(words)))
        if k + 1 < labels.shape[1]:
            apart = np.empty(n)
            for f in np.unique(folds):
                inside = np.nonzero(folds != f)[0]
                outside = np.nonzero(folds == f)[0]
                w = logistic([found[i] for i in inside], earlier[inside], y[inside], len(words)) if inside.size else weights[-1]
                apart[outside] = _sigmoid([found[i] for i in outside], earlier[outside], w, len(words))
            earlier = np.column_stack([earlier, apart])
    return Chain(words, weights)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """At most `sample` rows (text, low_quality, toxic, fold)."""
    known = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg((1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
        .withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)))
    )
    held = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = sample // max(1, len(held))
    share = F.lit(0)
    for value, n in held.items():
        share = F.when(F.col("toxic") == value, int((1 << 30) * min(1.0, 0.9 * half / n))).otherwise(share)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    # At most `sample` ids are sent to the texts; the texts stay where they are.
    ids = known.filter(F.col("place") < share).select("doc_id", "low_quality", "toxic").limit(sample)
    chosen = texts.join(F.broadcast(ids), "doc_id")
    return chosen.select("text", "low_quality", "toxic", fold.alias("fold")).limit(sample).collect()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    rows = sampled(docs, labels, sample)
    if not rows:
        return None
    marks = np.array([(r["low_quality"], r["toxic"]) for r in rows], float)
    return fit([words_of(r["text"]) for r in rows], marks, np.array([r["fold"] for r in rows]))


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by VOCABULARY

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                p = np.zeros((rows.num_rows, 2)) if own is None else own.probabilities(
                    [words_of(t) for t in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 0] >= 0.5), pa.array(p[:, 1] >= 0.5)],
                    names=[x.split()[0] for x in PREDICTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
