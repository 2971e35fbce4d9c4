"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.shared import held_out

#: Trusted positives, and unlabelled documents, that the classifier is fitted on, about, each.
SAMPLE = 20_000
#: From this score on a document is predicted to be of quality.
THRESHOLD = 0.3

_CLASS = bytes(
    ord("d") if 48 <= b <= 57
    else ord("u") if 65 <= b <= 90
    else ord("l") if 97 <= b <= 122
    else ord("n") if b == 10
    else ord("w") if b in (9, 11, 12, 13, 32)
    else ord("e") if b in b".!?"
    else ord("c") if b in b",;:'\"-()"
    else ord("h") if b >= 128
    else ord("s")
    for b in range(256)
)
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    """Shape of a text: lengths, shares of kinds of characters, repetition, and punctuation. All 0 without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_FEATURES
    kinds = text.encode("utf-8", "surrogatepass").translate(_CLASS)
    size, n = len(kinds), len(words)
    share = {k: kinds.count(k.encode()) / size for k in "dulnwechs"}
    lengths = list(map(len, words))
    times = Counter(words)
    top = sorted(times.values(), reverse=True)[:3]
    lines = text.split("\n")
    marked = sum(1 for w in times if not w[-1].isalnum())
    return [
        np.log1p(n),
        sum(lengths) / n,
        max(lengths) ** 0.5,
        share["d"],
        share["u"],
        share["l"] + share["h"],
        share["n"],
        share["w"],
        share["e"],
        share["c"],
        share["s"],
        min(1.0, share["s"] * 20),
        len(times) / n,
        np.log1p(len(times)) / np.log1p(n),
        top[0] / n,
        sum(top) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(size / len(lines)),
        marked / len(times),
    ]


def feature_rows(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)


class NonNegativePU:
    """A network of one hidden layer that minimises prior R_p+ + max(0, R_u- - prior R_p-) with the logistic loss.

    Where the estimated negative risk falls below zero, a step goes up on it instead, as the positives are overfitted.
    """

    def __init__(self, prior: float, hidden: int = 24, rounds: int = 60, batch: int = 512, rate: float = 3e-3, seed: int = 7):
        self.prior, self.hidden, self.rounds, self.batch, self.rate, self.seed = prior, hidden, rounds, batch, rate, seed

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, x @ self.w1 + self.b1)
        return h, h @ self.w2 + self.b2

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> NonNegativePU:
        rng = np.random.default_rng(self.seed)
        every = np.concatenate([positive, unlabelled])
        self.mean, self.spread = every.mean(0), every.std(0) + 1e-6
        p, u = self._scaled(positive), self._scaled(unlabelled)
        d = p.shape[1]
        self.w1, self.b1 = rng.normal(0, (2 / d) ** 0.5, (d, self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, (1 / self.hidden) ** 0.5, self.hidden), 0.0
        names = ("w1", "b1", "w2", "b2")
        m, v = {k: 0.0 for k in names}, {k: 0.0 for k in names}
        steps = max(2000, max(len(p), len(u)) // self.batch * self.rounds)
        for t in range(1, steps + 1):
            xp, xu = p[rng.integers(0, len(p), self.batch)], u[rng.integers(0, len(u), self.batch)]
            x = np.concatenate([xp, xu])
            h, z = self._forward(x)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            n = self.batch
            negative = np.logaddexp(0, z[n:]).mean() - self.prior * np.logaddexp(0, z[:n]).mean()
            g = np.zeros(2 * n)
            if negative >= 0:
                g[:n] = self.prior * (s[:n] - 1) / n - self.prior * s[:n] / n
                g[n:] = s[n:] / n
            else:
                g[:n], g[n:] = self.prior * s[:n] / n, -s[n:] / n
            back = (g[:, None] * self.w2) * (h > 0)
            grads = {"w1": x.T @ back + 1e-4 * self.w1, "b1": back.sum(0), "w2": h.T @ g + 1e-4 * self.w2, "b2": g.sum()}
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                move = self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(self, k, getattr(self, k) - move)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(x))[1], -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> float:
    """The share of positives among the unlabelled, without a look at any negative label.

    A logistic model that tells positives from unlabelled texts is fitted on one half of both. On the other half, the
    positives among the unlabelled with a score over a cut are as large a share of all of theirs as the trusted ones
    are; so the share of the unlabelled over the cut, divided by that of the trusted, bounds the prior, and does so
    closely where hardly any negative scores that high: at the cut where ratio and sampling error are least. What comes
    back is the lower end of the estimate, as a prior that is too high leaves no risk to negatives, but one that is
    somewhat too low does little harm.
    """
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    if len(p) < 4 or len(u) < 4:
        return 0.5
    every = np.concatenate([p, u])
    scaled = lambda x: np.c_[np.clip((x - every.mean(0)) / (every.std(0) + 1e-6), -8, 8), np.ones(len(x))]
    p, u = scaled(p), scaled(u)
    half_p, half_u = len(p) // 2, len(u) // 2
    x = np.concatenate([p[:half_p], u[:half_u]])
    y, weight = np.r_[np.ones(half_p), np.zeros(half_u)], np.r_[np.full(half_p, 0.5 / half_p), np.full(half_u, 0.5 / half_u)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (chance - y)) + 1e-3 * w
        w -= np.linalg.solve((x * (weight * chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(len(w)), slope)
    over = lambda s, cuts: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    cuts = np.unique(p[half_p:] @ w)
    of_p, of_u = over(p[half_p:] @ w, cuts), over(u[half_u:] @ w, cuts)
    error = np.sqrt(np.log(40) / (2 * (len(p) - half_p))) + np.sqrt(np.log(40) / (2 * (len(u) - half_u)))
    best = int(np.argmin((of_u + error) / of_p))
    return float(min(0.99, max(0.05, 0.75 * of_u[best], of_u[best] - error / 2) / of_p[best]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> NonNegativePU | None:
    """Fits on about ``sample`` trusted positives (quality 1) and as many unlabelled documents, by a hash of doc_id.

    Labels of the held-out fifth are never looked at: those documents are neither positives nor unlabelled ones. Where
    all other documents have labels, all of them are the unlabelled ones. The class prior is estimated from both
    samples. A doc_id with several labels counts as quality 1 only if all are; of documents that repeat a doc_id one
    is taken. Null doc_ids teach nothing. None without positives.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    n_good = known.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0)).alias("p")).first()["p"]
    every_id = docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id")
    open_ids = every_id.join(labels.select("doc_id"), "doc_id", "left_anti")
    n_open = open_ids.count()
    if not n_open:
        open_ids, n_open = every_id, every_id.count()
    if not n_good or not n_open:
        return None
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(2**53))
    positive = known.where((F.col("quality") == 1) & (chance < min(1.0, sample / n_good))).select("doc_id", F.lit(1).alias("y"))
    unlabelled = open_ids.distinct().where(chance < min(1.0, sample / n_open)).select("doc_id", F.lit(0).alias("y"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": list(feature_rows(batch["text"]))})

    # Both lists of ids are bounded by the sample, and so is what comes back: a row for each id.
    chosen = docs.select("doc_id", "text").join(F.broadcast(positive.union(unlabelled)), "doc_id")
    shaped = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInPandas(rows, "doc_id string, y int, x array<double>")
    got = shaped.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x").collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), np.array([r["y"] for r in got])
    if not (y == 1).any() or not (y == 0).any():
        return None
    order = np.lexsort(x.T)
    x, y = x[order], y[order]
    return NonNegativePU(estimated_prior(x[y == 1], x[y == 0])).fit(x[y == 1], x[y == 0])


def _score(model: NonNegativePU | None, text: Column) -> Column:
    """score (0 to 1, 0.5 without a model) of whole texts; null reads as empty."""
    if model is None:
        return F.lit(0.5)
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(feature_rows(batch)), dtype="float64")

    return score(text)


def quality_of_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs, repeated ones too: doc_id, held_out, score, predicted. An empty table gives none."""
    model = train(docs, labels)
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), _score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with docs' columns, whatever their names.

    Null, empty and blank texts are scored as a text without words; repeated rows score alike and stay or go together.
    """
    rows = docs.select(F.struct("*").alias("row"), _score(train(docs, labels), F.col("text")).alias("_score"))
    return rows.where(F.col("_score") >= threshold).select("row.*")
