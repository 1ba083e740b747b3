"""Ranked hits: best k, best chunk of each document, candidates ranked anew, scores by document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores closer than this many decimals are ties, settled by the order of the corpus.
DECIMALS = 6


def best(score: Column | str) -> Column:
    return F.round(F.col(score) if isinstance(score, str) else score, DECIMALS).desc()


def top_k(hits: DataFrame, k: int, *, query: str = "query_id", order: tuple[str, ...] = ("ord",), score: str = "score") -> DataFrame:
    """The k best hits of each query with their `rank` from 1."""
    w = Window.partitionBy(query).orderBy(best(score), *order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def per_document(hits: DataFrame, k: int, candidates: int, *, query: str = "query_id", doc: str = "doc_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The best k documents of each query among its `candidates` best chunks, each with its best chunk.

    Fewer than k come out where the candidates share documents.
    """
    some = top_k(hits, candidates, query=query, order=order).drop("rank")
    w = Window.partitionBy(query, doc).orderBy(best("score"), *order)
    one = some.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
    return top_k(one, k, query=query, order=order)


def reranked(candidates: DataFrame, k: int, score: Column, *, query: str = "query_id") -> DataFrame:
    """Candidates (with `rank`) ordered anew by another score, their old rank settling ties."""
    x = candidates.withColumn("combined_score", score).withColumnRenamed("rank", "old_rank")
    w = Window.partitionBy(query).orderBy(best("combined_score"), "old_rank")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_document(hits: DataFrame, *, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """All hits of a query and document in one row, in the corpus's order."""
    one = F.struct("ord", "chunk_id", "score", "title")
    listed = F.array_sort(F.collect_list(one))
    return hits.groupBy(query, doc).agg(F.transform(listed, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["score"].alias("score"), h["title"].alias("title"))).alias("chunks"))


class Best:
    """The k best rows of each query among the blocks of rows added, in a worker's memory: the order of top_k.

    `rows` keeps the rows that are among them, so that nothing needs to be looked up again.
    """

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.low = np.full(len(ids), -np.inf)
        self.query, self.at, self.ord = (np.zeros(0, np.int64) for _ in range(3))
        self.score = np.zeros(0)
        self.rows: pa.Table | None = None

    def cut(self, scores: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of the scores (queries x rows), right to within `slack`, that can be among the best."""
        low = self.low
        if scores.shape[1] > self.k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k] - slack)
        return np.nonzero(scores >= (low - slack - 10.0**-DECIMALS)[:, None])

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ords: np.ndarray, rows: pa.RecordBatch) -> None:
        """Adds scores of (query, row) places; the first column of the block's rows is their ord."""
        if not len(query):
            return
        held = self.rows.num_rows if self.rows is not None else 0
        query, at = np.concatenate([self.query, query]), np.concatenate([self.at, row + held])
        ord_, score = np.concatenate([self.ord, ords[row]]), np.concatenate([self.score, score])
        order = np.lexsort((ord_, -np.round(score, DECIMALS), query))
        begin = np.searchsorted(query[order], np.arange(len(self.ids) + 1))
        order = order[np.arange(len(order)) - begin[query[order]] < self.k]
        self.query, self.ord, self.score = query[order], ord_[order], score[order]
        used, self.at = np.unique(at[order], return_inverse=True)
        old, new = used[used < held], used[used >= held] - held
        kept = [pa.Table.from_batches([rows]).take(pa.array(new))]
        self.rows = pa.concat_tables(([self.rows.take(pa.array(old))] if held else []) + kept).combine_chunks()
        n = np.bincount(self.query, minlength=len(self.ids))
        full, last = n == self.k, np.cumsum(n) - 1
        self.low[full] = np.round(self.score[last[full]], DECIMALS)

    def batches(self) -> list[pa.RecordBatch]:
        """(query_id, score, columns of the rows)."""
        if self.rows is None:
            return []
        x = self.rows.take(pa.array(self.at)).combine_chunks()
        x = pa.table([pa.array(self.ids[self.query]), pa.array(self.score), *x.columns], ["query_id", "score", *x.column_names])
        return x.to_batches()
