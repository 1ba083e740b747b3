"""Inner-product search: exhaustive in blocks, or inside the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators.sizes import small
from quern.operators.topk import Best, top_k

#: Query vectors that come to the driver and go to every task; more are dealt to groups.
QUERIES_A_PASS = 4_096
#: Query vectors of a group, vectors of a part of the corpus, and products that stand in memory at once.
GROUP, PART, CELLS = 65_536, 262_144, 2_097_152
#: Vectors that cells are fitted on at most (those of least hash).
FIT_ROWS = 100_000


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of this width that hold no null, as a matrix, and which they are."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == width)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    return np.asarray(flat.fill_null(0.0)).reshape(-1, width), at


def search(corpus: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """(query_id, rank, ord, score) and other columns of the corpus: the k largest inner products of (query_id, vec) with (ord, vec).

    Longer query vectors are cut to the width, shorter ones find nothing.  Of equal scores the smaller ord comes
    first.  For up to QUERIES_A_PASS queries the corpus is read once and never shuffled: vectors are multiplied
    with the queries and only the k best of each partition and query go on.  More queries are dealt to groups.
    """
    if not small(queries, QUERIES_A_PASS):
        return _grid(corpus, queries, k, width)
    rows = queries.select("query_id", V.fitted("vec", width).alias("v")).where("v is not null").orderBy("query_id").collect()
    ids, vecs = np.array([r["query_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(-1, width)
    sent = corpus.sparkSession.sparkContext.broadcast((ids, vecs))
    rest = [c for c in corpus.columns if c not in ("ord", "vec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = sent.value
        best = Best(ids, k)
        for batch in batches if len(ids) else ():
            for at in range(0, batch.num_rows, max(1, CELLS // len(ids))):
                part = batch.slice(at, max(1, CELLS // len(ids)))
                m, some = _matrix(part.column(0), width)
                rows = part.select(part.schema.names[1:]).take(pa.array(some))
                _multiplied(best, vecs, m, rows)
        yield from best.batches()

    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in corpus.select(*rest).schema.fields)
    part = corpus.select("vec", F.col("ord").cast("long").alias("ord"), *rest).mapInArrow(run, f"query_id long, score double, ord long{fields}")
    return top_k(part, k).select("query_id", "rank", "ord", "score", *rest)


def _multiplied(best: Best, vecs: np.ndarray, m: np.ndarray, rows: pa.RecordBatch) -> None:
    """Adds the products of the queries with the vectors of the rows: all in single precision, the best again in double."""
    if not len(m):
        return
    far = np.sqrt((vecs**2).sum(axis=1).max() * (m**2).sum(axis=1).max())
    if far < 1e15:
        query, row = best.cut(vecs.astype(np.float32) @ m.astype(np.float32).T, far * vecs.shape[1] * 2.0**-22)
    else:
        query, row = best.cut(vecs @ m.T)
    step = max(1, CELLS // vecs.shape[1])
    score = np.concatenate([np.einsum("ij,ij->i", vecs[query[i : i + step]], m[row[i : i + step]]) for i in range(0, len(query), step)] or [np.zeros(0)])
    best.add(query, row, score, np.asarray(rows.column("ord")), rows)


def _grid(corpus: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """search() for many queries: a grid of groups of GROUP queries and parts of the corpus, each cell a task.

    Equal query vectors are searched once; of equal vectors of the corpus only the k smallest ords can be among the best.
    """
    rest = [c for c in corpus.columns if c not in ("ord", "vec")]
    q = queries.select("query_id", V.fitted("vec", width).alias("v")).where("v is not null")
    one = q.groupBy("v").agg(F.min("query_id").cast("long").alias("one"))
    plain = F.transform(V.as_double("vec"), lambda x: F.coalesce(x, F.lit(0.0)))
    c = corpus.select(F.col("ord").cast("long").alias("ord"), plain.alias("v")).where(F.size("v") == width)
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("ord"))).where(F.col("_n") <= k).select("ord", "v")
    one, c = one.persist(), c.persist()
    groups = max(1, -(-one.count() // GROUP))
    parts = max(1, -(-2 * corpus.sparkSession.sparkContext.defaultParallelism // groups), -(-c.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = one.select((F.pmod(F.xxhash64("one"), F.lit(groups)).cast("int")).alias("g"), "one", "v").select("g", every(parts).alias("p"), F.lit(0).alias("side"), F.col("one").alias("ord"), "v")
    right = c.select(F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int").alias("p"), "ord", "v").select(every(groups).alias("g"), "p", F.lit(1).alias("side"), "ord", "v")
    cells = left.unionByName(right).select((F.col("g") * parts + F.col("p")).alias("cell"), "side", "ord", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, best = None, [], [], []
        for batch in batches:
            keys = np.asarray(batch.column(0)).astype(np.int64) * 2 + np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                cell, side = divmod(int(keys[begin]), 2)
                if cell != now:
                    for b, _ in best:
                        yield from b.batches()
                    now, ids, vecs, best = cell, [], [], []
                part = batch.slice(begin, end - begin)
                m, _ = _matrix(part.column(3), width)
                if side == 0:
                    ids.append(np.asarray(part.column(2)))
                    vecs.append(m)
                    continue
                if ids:
                    i, v = np.concatenate(ids), np.concatenate(vecs)
                    best, ids = [(Best(i[j : j + 2048], k), v[j : j + 2048]) for j in range(0, len(i), 2048)], []
                for at in range(0, len(m), CELLS // 2048):
                    rows = part.slice(at, CELLS // 2048).select(["ord"])
                    for b, v in best:
                        _multiplied(b, v, m[at : at + CELLS // 2048], rows)
        for b, _ in best:
            yield from b.batches()

    found = cells.repartition(2 * groups * parts, "cell").sortWithinPartitions("cell", "side", "ord").mapInArrow(run, "one long, score double, ord long")
    found = top_k(found, k, query="one")
    hits = q.join(one, "v").select("query_id", "one").join(found, "one").select("query_id", "rank", "ord", "score")
    return hits.join(corpus.select("ord", *rest), "ord").select("query_id", "rank", "ord", "score", *rest) if rest else hits


@dataclass
class Cells:
    """An inverted index: vectors (ord, vec, cell) and the centroids."""

    vectors: DataFrame
    centroids: np.ndarray
    probes: int


def build_cells(corpus: DataFrame, width: int, cells: int | None = None, probes: int | None = None, seed: int = 5) -> Cells:
    """Deals (ord, vec) to the cell of the nearest of `cells` centroids, fitted on FIT_ROWS rows.

    Unless given, the numbers follow the size of the corpus; a small corpus is one cell.
    """
    n = corpus.count()
    auto = V.cells_for(n) or (1, 1)
    k = max(1, min(cells or auto[0], n))
    x = corpus.select("ord", V.as_double("vec").alias("vec")).where(F.size("vec") == width)
    sample = x.orderBy(F.xxhash64("ord"), "ord").limit(FIT_ROWS)
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=15, featuresCol="f").fit(sample.select(array_to_vector("vec").alias("f")))
        centroids = np.array(model.clusterCenters())
    else:
        centroids = np.zeros((1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centroids**2).sum(axis=1) / 2
        for batch in batches:
            m, _ = _matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.argmax(m @ centroids.T - half, axis=1).astype(np.int32))], ["ord", "vec", "cell"])

    return Cells(x.select(F.col("ord").cast("long").alias("ord"), "vec").mapInArrow(run, "ord long, vec array<double>, cell int"), centroids, probes or auto[1])


def search_cells(index: Cells, queries: DataFrame, k: int) -> DataFrame:
    """search() among the vectors of the `probes` cells nearest to each query; all cells make it exact."""
    width = index.centroids.shape[1]
    centroids, probes = index.centroids, min(index.probes, len(index.centroids))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, _ = _matrix(batch.column(1), width)
            order = np.argsort(-(m @ centroids.T - (centroids**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(m)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order.ravel().astype(np.int32))], ["query_id", "q", "cell"])

    q = queries.select(F.col("query_id").cast("long").alias("query_id"), V.fitted("vec", width).alias("q")).where("q is not null")
    q = q.mapInArrow(near, "query_id long, q array<double>, cell int")
    hits = q.join(index.vectors, "cell").select("query_id", "ord", V.dot("q", "vec").alias("score"))
    return top_k(hits, k).select("query_id", "rank", "ord", "score")
