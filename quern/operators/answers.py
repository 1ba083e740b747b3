"""Contexts, prompts, answers and responses for found chunks; models are plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.operators.sizes import broadcast_if_small

#: Chunks that the answering model gets.
CONTEXTS = 3
#: What is said where nothing was found, and where the model failed.
NO_CONTEXT = "Sorry, I couldn't find relevant information to answer this question."
FAILED = "Sorry, there was an error generating an answer."


def last_by_key(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """The chunks by (doc_id, chunk_id); of several with one key the last."""
    w = Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc(order))
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_id(docs: DataFrame, key: str = "document_id", order: str = "doc_ord", text: str = "text") -> DataFrame:
    """The first document of each id, without those that have no id or text."""
    x = docs.where(F.col(key).isNotNull() & (F.col(text) != ""))
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def document_text(title: Column | str, chunks: Column | str) -> Column:
    """Title and chunk contents, each with a blank behind it."""
    t, c = (F.col(v) if isinstance(v, str) else v for v in (title, chunks))
    head = F.when(t.isNotNull(), F.concat(t, F.lit(" "))).otherwise("")
    return F.concat(head, F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.coalesce(x["content"], F.lit("")), F.lit(" "))), ""), F.lit("")))


def with_contents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits that have a chunk, with its `content` and `chunk_title`.  Hits are counted first; texts move only where there are many."""
    c = chunks.select("doc_id", "chunk_id", "content", F.col("title").alias("chunk_title"))
    # counted, then joined: a few rows a question are kept, so that they are searched once
    return broadcast_if_small(hits.persist()).join(c, ["doc_id", "chunk_id"])


def contexts(hits: DataFrame, most: int = CONTEXTS, query: str = "query_id") -> DataFrame:
    """(query_id, contexts): the contents of the first `most` hits, by rank."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return hits.groupBy(query).agg(F.slice(F.transform(listed, lambda h: h["content"]), 1, most).alias("contexts"))


def answered(asked: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Rows of (question, contexts) with `prompt`, `answer` and `status` added.

    model maps prompts to answers and runs in Arrow batches on the executors; without one, answers are
    empty and the status is "skipped".  Rows without contexts get NO_CONTEXT, a failing batch FAILED.
    """
    some = F.size(F.coalesce("contexts", F.array().cast("array<string>"))) > 0
    x = asked.withColumn("prompt", F.when(some, X.prompt("question", "contexts")))
    if model is None:
        return x.withColumn("answer", F.when(some, F.lit("")).otherwise(NO_CONTEXT)).withColumn("status", F.when(some, F.lit("skipped")).otherwise("no context"))

    @F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("status", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            out = pd.DataFrame({"answer": [NO_CONTEXT] * len(prompts), "status": ["no context"] * len(prompts)})
            at = [i for i, p in enumerate(prompts) if p is not None]
            try:
                got, status = model([prompts.iloc[i] for i in at]) if at else [], "answered"
            except Exception:
                got, status = [FAILED] * len(at), "failed"
            for i, a in zip(at, got, strict=True):
                out.iloc[i] = [a, status]
            yield out

    return x.withColumn("_a", run("prompt")).select(*x.columns, "_a.answer", "_a.status")


def responses(asked: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, response): for each answered question the response as JSON, with its documents by rank."""
    one = F.struct("rank", "doc_id", "chunk_id", X.shown_title("title", "chunk_title").alias("title"), "score", "content")
    listed = hits.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("found"))
    x = asked.join(listed, query, "left")
    docs = F.transform("found", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["chunk_id"].alias("chunk_id"), h["title"].alias("title"), h["score"].alias("score"), h["content"].alias("content")))
    empty = F.array().cast("array<struct<doc_id:bigint,chunk_id:int,title:string,score:double,content:string>>")
    body = F.struct(F.col("answer"), F.coalesce(docs, empty).alias("documents"), F.lit(False).alias("isError"), F.lit(False).alias("hasRefreshButton"), F.col("question").alias("originalQuestion"))
    return x.select(query, F.to_json(body).alias("response"))


def encoded(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    """texts with `vec` from a plug-in encoder that maps lists of texts to vectors, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[float(v) for v in x] for x in encoder([t or "" for t in batch])], dtype="object")

    return texts.withColumn("vec", run(F.col(column)))
