"""Embedding near-duplicates: recall at the threshold, growth of the work, awkward tables."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import vectors


def unit(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near(rng, x, cosine):
    """Vectors at that cosine from the rows of x, in random directions."""
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    return x * cosine + u / np.linalg.norm(u, axis=1, keepdims=True) * math.sqrt(1 - cosine * cosine)


def frame(spark, x, labels=1):
    ids = np.arange(len(x))
    e = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"vec_id": ids, "embedding": e, "label": ids % labels}))


@pytest.mark.parametrize(("cosine", "least"), [(0.9301, 0.9), (0.95, 0.93), (0.98, 0.99)])
def test_recall_at_the_threshold_and_above(spark, cosine, least):
    rng = np.random.default_rng(int(cosine * 1000))
    base = unit(rng, 20_000)
    x = np.concatenate([base, near(rng, base[:2000], cosine)])
    got = vectors.near_duplicates(frame(spark, x, 1)).where("n_links > 0").collect()
    # nothing else is that near: every found link is one of the 2,000 pairs
    assert len(got) <= 4000 and len(got) / 4000 >= least
    assert all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 20_000 for r in got)


def test_levels_beyond_256_cells_keep_the_recall():
    rng = np.random.default_rng(2)
    cells = vectors.Cells(unit(rng, 20_000), 12)
    x = unit(rng, 5000)
    a, b = cells.nearest(x, 12, 6), cells.nearest(near(rng, x, 0.97), 12, 6)
    met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.9 and len(np.unique(a[:, 0])) > 1500


def test_work_grows_about_in_proportion(spark):
    rng = np.random.default_rng(5)
    work = []
    for n in (50_000, 200_000):
        _, w = vectors._compared(frame(spark, unit(rng, n), 10), 0.93, vectors.BLOCK, vectors.CELL, vectors.PROBES, vectors.FIT_ROWS)
        work.append(w.agg(F.sum("compared"), F.sum("sent")).first())
    (pairs, sent), (more_pairs, more_sent) = work
    assert math.log(more_pairs / pairs, 4) < 1.3 and math.log(more_sent / sent, 4) < 1.1
    assert pairs < 50_000**2 / 10 / 5 and more_sent <= 200_000 * 8


def test_crowded_cells_lose_and_double_no_link(spark):
    """A group in which some pairs are near, spread over cells, homes and guests in many blocks."""
    rng = np.random.default_rng(6)
    centre = unit(rng, 3)
    x = np.concatenate([near(rng, np.repeat(centre[k : k + 1], 150, 0), 0.965) for k in range(3)] + [np.repeat(centre[:1], 40, 0), unit(rng, 300)])
    s = x @ x.T >= 0.93
    want = s.sum(1) - 1
    for block in (16, 1024):
        got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(frame(spark, x), block=block, cell=32, probes=32).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist()


def test_awkward_vectors(spark):
    rng = np.random.default_rng(7)
    v = [float(e) for e in unit(rng, 1, 1536)[0]]
    rows = [(1, v, "a"), (2, v, "a"), (2, v, "a"), (3, v, None), (None, v, "a"), (4, v[:700], "a"), (5, v[:700], "a"), (6, None, "a"), (7, [], "a"), (8, [-e for e in v], "a"), (9, [2 * e for e in v], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for c in ("e", "m", "rid", "bits", "cell", "homes", "n_links", "component_id", "kept", "u"):
        df = df.withColumn(c, F.lit(c))
    got = vectors.near_duplicates(df).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        (1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), (3, 0, 3, True), (None, 0, None, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True),
    } and len(got) == len(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
