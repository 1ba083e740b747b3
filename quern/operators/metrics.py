"""How good predictions are against known answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import same_text


def found(ids: Column | str, wanted: Column | str) -> Column:
    """Whether the wanted id is in the list, however long it is."""
    a, w = (F.col(c) if isinstance(c, str) else c for c in (ids, wanted))
    return F.coalesce(F.array_contains(a, w), F.lit(False))


def reciprocal_rank(ids: Column | str, wanted: Column | str) -> Column:
    a, w = (F.col(c) if isinstance(c, str) else c for c in (ids, wanted))
    at = F.coalesce(F.array_position(a, w), F.lit(0))
    return F.when(at > 0, 1 / at).otherwise(0.0)


def pair_by_position(gold: DataFrame, predicted: DataFrame, by: str = "ord") -> DataFrame:
    """Gold and predictions joined by their place; what has no partner is left out."""
    p = predicted.select(F.col(by), F.col("answer").alias("predicted_answer"), F.col("document_id").alias("predicted_ids"))
    return gold.join(p, by)


def evaluate(gold: DataFrame, predicted: DataFrame, by: str = "ord") -> DataFrame:
    """One row: n, accuracy, recall and mrr; pairs by position, over the number of gold rows.

    gold: (ord, answer, document_id), predicted: (ord, answer, document_id array).  Without gold rows
    the figures are null.
    """
    pairs = pair_by_position(gold.select(by, "answer", F.col("document_id").alias("wanted")), predicted, by)
    sums = pairs.agg(
        F.count_if(same_text("predicted_answer", "answer")).alias("right"),
        F.count_if(found("predicted_ids", "wanted")).alias("hits"),
        F.coalesce(F.sum(reciprocal_rank("predicted_ids", "wanted")), F.lit(0.0)).alias("rr"),
    )
    n = gold.agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n"))
    return n.join(F.broadcast(sums)).select("n", of("right").alias("accuracy"), of("hits").alias("recall"), of("rr").alias("mrr"))


def not_found(results: DataFrame, ids: str = "predicted_docs", wanted: str = "true_doc_id") -> DataFrame:
    """The results whose wanted document isn't among the predicted ones."""
    return results.where(~found(ids, wanted))


def inline(results: DataFrame, ids: str = "predicted_docs", wanted: str = "true_doc_id") -> DataFrame:
    """One row: n, recall and mrr; null figures where any result has no truth."""
    x = results.agg(F.count(F.lit(1)).alias("n"), F.avg(found(ids, wanted).cast("int")).alias("recall"), F.avg(reciprocal_rank(ids, wanted)).alias("mrr"), F.bool_and(F.col(wanted).isNotNull()).alias("all"))
    return x.select("n", *(F.when(F.col("all"), F.col(c)).alias(c) for c in ("recall", "mrr")))


def hit_rate(predicted: DataFrame, ids: str = "document_id", answer: str = "answer") -> DataFrame:
    """One row: n and the share whose ids, as text, hold the answer text."""
    hit = F.exists(ids, lambda d: d.cast("string") == F.col(answer))
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("hit_rate"))


def similarity(pairs: DataFrame, scorer, a: str = "predicted_answer", b: str = "answer") -> DataFrame:
    """One row: the mean of `scorer`, a pandas function of two series, such as an embedding-based score."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(scorer(x, y), dtype="float64")

    each.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return pairs.agg(F.avg(F.pandas_udf(each, T.DoubleType())(a, b)).alias("similarity"))
