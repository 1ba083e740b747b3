"""Toxicity classifier whose scores stay when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize
from quern.llm.quality import held_out

#: Labelled rows that the model is fitted on at most (those of least hash), and features it keeps.
FIT_ROWS, FIT_FEATURES = 8_000, 4_096
#: Texts of a feature at least, and standard deviations of its log odds above nothing.
LEAST_TEXTS, LEAST_Z = 3, 2.5
#: Log odds from which a feature counts as strong, and the numbers of times that are told apart.
STRONG, STEPS = 3.5, (1, 2, 3, 4, 6, 9)
#: Weight of the squared change of a logit when an identity term is swapped, and views of a labelled text.
FAIRNESS, VIEWS = 20.0, 2

#: Identity terms of one language and one kind; a term is only swapped within its group.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("women", "men"), ("girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "indian"),
    ("blind", "deaf", "disabled"), ("elderly", "young"), ("immigrants", "refugees"),
    ("chrétien", "musulman", "juif", "bouddhiste", "athée", "catholique"),
    ("femmes", "hommes"), ("filles", "garçons"), ("homosexuel", "hétérosexuel", "bisexuel"),
    ("africain", "européen", "asiatique", "arabe", "américain", "mexicain"), ("immigrés", "réfugiés"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("frauen", "männer"), ("mädchen", "jungen"), ("homosexuell", "heterosexuell", "bisexuell"),
    ("afrikanisch", "europäisch", "asiatisch", "arabisch", "amerikanisch", "mexikanisch"), ("einwanderer", "flüchtlinge"),
    ("cristiano", "musulmán", "judío", "budista", "ateo", "católico"),
    ("mujeres", "hombres"), ("niñas", "niños"), ("homosexual", "heterosexual"),
    ("africano", "europeo", "asiático", "árabe", "americano", "mexicano"), ("inmigrantes", "refugiados"),
)
_WORD = re.compile(r"[^\W\d_]+")
_KEEP = 300_000


def features(word: str) -> tuple[int, ...]:
    """The word and what it begins with, as 63-bit hashes."""
    h = xxhash.xxh3_64_intdigest
    out = [h("w" + word) >> 1]
    out += [h(f"{n}{word[:n]}") >> 1 for n in (4, 5, 6) if len(word) > n]
    return tuple(out)


class Known(dict):
    """The kept features of each word seen, as their numbers.

    The first STEPS numbers say how often strong features' words stand in the text, the next `strong` ones
    are those features.
    """

    def __init__(self, index: dict[int, int], strong: int):
        super().__init__()
        self.index, self.strong = index, strong + len(STEPS)

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return out

    def of(self, text: str | None) -> list[int]:
        if len(self) > _KEEP:
            self.clear()
        count = Counter(_WORD.findall((text or "").lower()))
        hits = [(t, n) for t, n in zip(map(self.__getitem__, count), count.values(), strict=True) if t]
        times = sum(n for t, n in hits if t[0] < self.strong or min(t) < self.strong)
        return sorted(set(chain.from_iterable(t for t, _ in hits))) if not times else sorted({*chain.from_iterable(t for t, _ in hits), *(i for i, k in enumerate(STEPS) if times >= k)})


def swapped(text: str, seed: int) -> tuple[str, str]:
    """Two texts that differ in identity terms: the text and one with its terms swapped within their
    groups, or, for a text without any, the text with either of two terms of a group mentioned."""
    words = set(_WORD.findall(text.lower()))
    groups = [g for g in IDENTITY if words & set(g)]
    if not groups:
        g = IDENTITY[seed % len(IDENTITY)]
        return f"{text} {g[seed % len(g)]}", f"{text} {g[(seed + 1 + seed // 7 % (len(g) - 1)) % len(g)]}"
    turn = {t: g[(i + 1 + seed % (len(g) - 1)) % len(g)] for g in groups for i, t in enumerate(g)}
    return text, _WORD.sub(lambda m: turn.get(m[0].lower(), m[0]), text)


class Model:
    def __init__(self, index: dict[int, int], strong: int, weights: np.ndarray, bias: float):
        self.index, self.strong, self.weights, self.bias = index, strong, weights, bias

    def known(self) -> Known:
        return Known(self.index, self.strong)

    def score(self, numbers: list[int]) -> float:
        z = self.bias + float(self.weights[numbers].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int, rounds: int = 500, l2: float = 2e-4, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Logistic regression on present features with fairness * mean((logit(a) - logit(b))**2) over pairs."""
    w, bias = np.zeros(width), -2.0
    if not len(y) or y.min() == y.max():
        return w, -2.0 if not len(y) or not y.max() else 2.0
    at = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ft = np.fromiter(chain.from_iterable(texts), np.int64)
    p_at, p_ft, p_sign = [], [], []
    for i, (a, b) in enumerate(pairs):
        for f in set(a) ^ set(b):
            p_at.append(i), p_ft.append(f), p_sign.append(1.0 if f in a else -1.0)
    p_at, p_ft, p_sign = np.array(p_at, np.int64), np.array(p_ft, np.int64), np.array(p_sign)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    # both classes weigh alike
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[ft], len(texts)) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(ft, g[at], width) + l2 * w, g.sum())
        if len(p_at):
            d = np.bincount(p_at, p_sign * w[p_ft], len(pairs)) * (2 * fairness / len(pairs))
            grad[:-1] += np.bincount(p_ft, p_sign * d[p_at], width)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model:
    """Fits a model for labels.toxic on at most FIT_ROWS rows that aren't held out.

    Features are chosen by their log odds between the two classes' texts, counted on the executors; those of identity
    terms are always in, so that the swaps can hold their weights together.  A document counts once, with its smallest
    text, however often its row or its label is repeated; labels that differ count as toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("doc_id", "text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = {0: [], 1: []}
            for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = chain.from_iterable(map(features, set(_WORD.findall((text.as_py() or "").lower()))))
                sides[int(bool(toxic))].append(np.unique(np.fromiter(found, np.int64)))
            for y, arrays in sides.items():
                f, n = np.unique(np.concatenate([np.zeros(0, np.int64), *arrays]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int64()), "pos": pa.array(n * y, pa.int64()), "neg": pa.array(n * (1 - y), pa.int64())})

    n1, n0 = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    sums = rows.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n1 - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (F.lit(n0) - F.col("neg") + 0.5))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    chosen = sums.where(F.col("pos") >= LEAST_TEXTS).withColumns({"z": z, "odds": odds}).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FIT_FEATURES).select("f", "odds").collect()
    strong = [r["f"] for r in chosen if r["odds"] >= STRONG]
    kept = dict.fromkeys([*strong, *(r["f"] for r in chosen), *(f for g in IDENTITY for t in g for f in features(t))])
    index = {f: i for i, f in enumerate(kept, len(STEPS))}

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Known(index, len(strong)).of
        for batch in batches:
            out = {"doc_id": [], "y": [], "x": [], "a": [], "b": []}
            for doc_id, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                seed = xxhash.xxh3_64_intdigest(str(doc_id)) >> 8
                sides = list(zip(*(swapped(text, seed + k) for k in range(VIEWS)), strict=True))
                for k, x in zip(out, (doc_id, int(bool(toxic)), of(text), *([of(t) for t in side] for side in sides)), strict=True):
                    out[k].append(x)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["y"], pa.int32()), pa.array(out["x"], ints), *(pa.array(out[k], pa.list_(ints)) for k in "ab")], list(out))

    seen = rows.mapInArrow(view, "doc_id long, y int, x array<int>, a array<array<int>>, b array<array<int>>").toPandas().sort_values("doc_id")
    pairs = [(list(a), list(b)) for aa, bb in zip(seen["a"], seen["b"], strict=True) for a, b in zip(aa, bb, strict=True)]
    discard(rows)
    weights, bias = fit([list(x) for x in seen["x"]], seen["y"].to_numpy(dtype=float), pairs, len(index) + len(STEPS), fairness=fairness)
    return Model(index, len(strong), weights, bias)


def score(model: Model, text: Column) -> Column:
    """0 to 1, the higher the likelier toxic; null text counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.known()
        for texts in batches:
            yield pd.Series([model.score(known.of(t)) for t in texts], dtype="float64")

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null doc_id is not held out; null and empty texts get the score of no features.  Whole texts are scored,
    however long; repeated rows are each scored and count once in the fit.  Null labels and labels without a document are
    left out; without any, or with one class only, all scores are equal.  Other columns, whatever their
    names, are neither read nor returned.  An empty table gives an empty result.
    """
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(train(docs, labels), F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
