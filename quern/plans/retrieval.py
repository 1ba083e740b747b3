"""Whole tasks: pages to chunks, questions to found documents and answers, one plan for all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import answers, bm25, chunks, metrics, sections, topk, vector_search, word_vectors
from quern.operators.sizes import broadcast_if_small

MODES = ("bm25", "word2vec", "dense")


def ingest(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks, raw and cleaned, of (document_id, document_text)."""
    return chunks.chunk_sections(sections.parse_sections(docs.where("document_text is not null")), most)


def corpus(chunked: DataFrame, content: str = "content_clean") -> DataFrame:
    """(ord, doc_id, chunk_id, title, content) of chunks in the order of document and chunk."""
    ord_ = (F.col("document_id") * F.lit(1 << 20) + F.col("chunk_id")).alias("ord")
    return chunked.select(ord_, F.col("document_id").alias("doc_id"), "chunk_id", "title", F.col(content).alias("content"))


def bm25_hits(index: bm25.Index, questions: DataFrame, k: int = 3) -> DataFrame:
    """The k best chunks of each of (query_id, question)."""
    return bm25.search(index, questions.select("query_id", bm25.query_terms("question").alias("terms")), k)


def vector_hits(index: word_vectors.Index, questions: DataFrame, k: int = 3) -> DataFrame:
    x = vector_search.search(_listed(index.vectors), word_vectors.encode_queries(index, questions), k, index.width)
    return x.select("query_id", "rank", "ord", "doc_id", "chunk_id", "score", "title")


def _listed(vectors: DataFrame) -> DataFrame:
    return vectors.select("ord", "vec", "doc_id", "chunk_id", "title")


def dense_hits(index: DataFrame, encoded: DataFrame, width: int, k: int = 3) -> DataFrame:
    """The k best of (ord, doc_id, chunk_id, title, vec) for (query_id, vec); vectors come from a plug-in encoder."""
    x = vector_search.search(_listed(index), encoded, k, width)
    return x.select("query_id", "rank", "ord", "doc_id", "chunk_id", "score", "title")


def bm25_documents(index: bm25.Index, questions: DataFrame, k: int = 5, candidates: int = 50) -> DataFrame:
    hits = bm25_hits(index, questions, candidates).drop("rank")
    return topk.per_document(hits, k, candidates)


def vector_documents(index: word_vectors.Index, questions: DataFrame, k: int = 5) -> DataFrame:
    hits = vector_hits(index, questions, 2 * k).drop("rank")
    return topk.per_document(hits, k, 2 * k)


def hybrid_documents(vectors: DataFrame, texts: DataFrame, asked: DataFrame, width: int, k: int = 5) -> DataFrame:
    """3k nearest of (ord, vec) for (query_id, question, vec), ranked anew with the keywords of (ord, text)."""
    hits = vector_search.search(vectors, asked.select("query_id", "vec"), 3 * k, width)
    x = hits.join(texts.select("ord", "text"), "ord", "left").join(asked.select("query_id", "question"), "query_id")
    return topk.reranked(x, k, X.hybrid_score("score", "question", "text"))


def answer_batch(hits: DataFrame, questions: DataFrame, originals: DataFrame, model=None) -> DataFrame:
    """(query_id, question, predicted_docs, contexts, prompt, answer, status) for each question; answers by a plug-in."""
    # a few rows a question, used three times
    hits = hits.persist()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"])
    lists = hits.groupBy("query_id").agg(ids.alias("predicted_docs"))
    # only texts that were found are brought together
    keys = hits.select("doc_id", "chunk_id").distinct()
    found = answers.with_contents(hits, answers.last_by_key(originals.join(broadcast_if_small(keys), ["doc_id", "chunk_id"], "left_semi")))
    x = questions.join(lists, "query_id", "left").join(answers.contexts(found), "query_id", "left")
    return answers.answered(x, model)


def search_response(question: str, mode: str, indexes: dict, originals: DataFrame, k: int = 3, model=None, encoder=None) -> str:
    """The JSON response to one question; the mode names the index that is searched."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode not in indexes:
        raise LookupError(f"no index for {mode}")
    spark = originals.sparkSession
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    if mode == "bm25":
        hits = bm25_hits(indexes[mode], asked, k)
    elif mode == "word2vec":
        hits = vector_hits(indexes[mode], asked, k)
    else:
        index = indexes[mode]
        width = len(index.select("vec").first()["vec"])
        hits = dense_hits(index, answers.encoded(asked, encoder, "question").select("query_id", "vec"), width, k)
    found = answers.with_contents(hits, answers.last_by_key(originals))
    done = answers.answered(asked.join(answers.contexts(found), "query_id", "left"), model)
    return answers.responses(done, found).first()["response"]


def quick_retrieve(index: DataFrame, vector: list[float], k: int = 3) -> DataFrame:
    """The k best of (ord, vec) for one vector."""
    one = index.sparkSession.createDataFrame([(0, [float(v) for v in vector])], "query_id long, vec array<double>")
    return vector_search.search(index, one, k, len(vector))


def evaluate(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return metrics.evaluate(gold, predicted)


def dense_corpus(rows: DataFrame, width: int) -> DataFrame:
    """(ord, doc_id, chunk_id, title, vec) of (ord, id, vec), whose ids may be composite."""
    x = rows.withColumn("_id", X.composite_id("id"))
    return x.select("ord", F.col("_id.doc_id").try_cast("bigint").alias("doc_id"), F.col("_id.chunk_id").alias("chunk_id"), F.lit("").alias("title"), V.fitted("vec", width).alias("vec")).where("vec is not null")
