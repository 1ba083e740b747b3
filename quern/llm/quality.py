"""Quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that the model is fitted on at most, of each kind; those of least hash are taken.
FIT_POSITIVES, FIT_UNLABELLED, FIT_LABELS = 20_000, 20_000, 200_000
#: Room for the bins of one statistic.
BINS = 40
#: How far the estimated risk of the negatives may fall below zero before it is pushed back.
SLACK = 0.02
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:", b"!?", b"#%&*$@^~", b"|<>{}[]\\=+_/", b"'\"()-", bytes(range(128, 256)))


def stats(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares of kinds of bytes, repetition of words, pairs and lines, lengths.

    Empty text: zeros.
    """
    out = np.zeros(len(_CLASSES) + 12)
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return out
    n = len(b)
    of = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    for i, c in enumerate(_CLASSES):
        out[i] = of[list(c)].sum() / n
    words = b.split()
    k = len(_CLASSES)
    out[k] = np.log1p(n)
    if not words:
        return out
    w, count = len(words), Counter(words)
    lines = b.split(b"\n")
    out[k + 1 :] = (
        np.log1p(w),
        n / w,
        len(count) / w**0.8,
        max(count.values()) / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / w,
        len(set(lines)) / len(lines),
        w / len(lines),
        sum(map(bytes.isalpha, words)) / w,
        sum(map(bytes.isupper, words)) / w,
        max(map(len, count)) / 20,
    )
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """An additive model over binned statistics: a logit for each bin of each of them."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    @staticmethod
    def cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") + j * (BINS + 1) for j, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.cells(x, self.edges)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray) -> np.ndarray:
    """Where bins part: quantiles of all values, and of those off the commonest one, which stands alone."""
    if not len(x):
        return np.zeros(0)
    values, n = np.unique(x, return_counts=True)
    common = values[np.argmax(n)]
    rest, many = x[x != common], min(20, max(4, len(x) // 100))
    parts = lambda of, k: np.quantile(of, np.linspace(0, 1, k + 1)[1:-1]) if len(of) else []
    out = [parts(x, many), np.quantile(x, [0.02, 0.98]), parts(rest, min(8, many)), [common, np.nextafter(common, np.inf)]]
    return np.unique(np.concatenate(out))


def step_gradient(w: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The unlabelled part of the risk and the gradient to follow at w and bias; p and u are the cells of the rows.

    It is that of the whole risk, or, where the unlabelled part is below -SLACK, that part's turned round.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    gather = lambda cells, g: np.append(np.bincount(cells.ravel(), np.repeat(g, cells.shape[1]), len(w)), g.sum())
    sp, su = sig(w[p].sum(1) + bias), sig(w[u].sum(1) + bias)
    part = float(su.mean() - prior * sp.mean())
    g_pos = gather(p, -prior * sp * (1 - sp) / len(p))
    g_neg = gather(u, su * (1 - su) / len(u)) + g_pos
    return part, g_pos + g_neg if part >= -SLACK else -g_neg


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, l2: float = 1e-4) -> Model:
    """Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) for the sigmoid loss l.

    Where the second part falls below -SLACK its gradient is turned round, as non-negative PU learning does.
    The loss is bounded, so an error of the prior can't grow with the logits.  Without positives or
    unlabelled text the model says what the prior says.
    """
    both = np.concatenate([positive, unlabelled]) if len(unlabelled) else positive
    width = both.shape[1]
    edges = [_edges(both[:, j]) for j in range(width)]
    prior = min(max(prior, 0.01), 0.99)
    size = width * (BINS + 1)
    if not len(positive) or not len(unlabelled):
        return Model(edges, np.zeros(size), float(np.log(prior / (1 - prior))))
    p, u = Model.cells(positive, edges), Model.cells(unlabelled, edges)
    l2 += 0.2 / len(positive)
    w, bias = np.zeros(size), 0.0
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0.03
    for t in range(1, rounds + 1):
        g = step_gradient(w, bias, p, u, prior)[1]
        g[:-1] += l2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(edges, w, bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model for labels.quality = 1 of the rows that aren't held out.

    Those rows are the trusted positives; of rows labelled 0 only their share counts, as the estimate of the class
    prior; the unlabelled text is any of docs.  Each sample is bounded (FIT_*).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_LABELS)
    prior = known.agg(F.avg("quality")).first()[0]
    positive = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_POSITIVES).select("doc_id", F.lit(1).alias("p")).distinct()
    other = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(FIT_UNLABELLED).select("doc_id", F.lit(0).alias("p")).distinct()
    picked = positive.unionByName(other)  # at most FIT_POSITIVES + FIT_UNLABELLED rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "p", _stats(F.col("text")).alias("x")).orderBy("doc_id", "p").limit(FIT_POSITIVES + FIT_UNLABELLED).toPandas()
    width = len(_CLASSES) + 12
    as_matrix = lambda xs: np.stack([np.asarray(x) for x in xs]) if len(xs) else np.zeros((0, width))
    return fit(as_matrix(rows["x"][rows["p"] == 1]), as_matrix(rows["x"][rows["p"] == 0]), 0.5 if prior is None else float(prior))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _stats(texts: pd.Series) -> pd.Series:
    return texts.map(stats)


def score(model: Model, text: Column) -> Column:
    """0 to 1, the higher the likelier good; null text counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.stack([stats(t) for t in texts])) if len(texts) else [], dtype="float64")

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null doc_id is not held out; null and empty texts get the score of zeros.  Whole texts are scored, however
    long; repeated rows are each scored.  Null labels are left out; without any, or without good ones, all scores are
    the prior.  Other columns, whatever their names, are neither read nor returned.  An empty table gives an
    empty result.
    """
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(train(docs, labels), F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, unchanged, whatever their columns; nulls and repeats as in classify()."""
    return docs.where(score(train(docs, labels), F.col("text")) >= threshold)
