"""Every operator applied to the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import letters
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.stopwords import ENGLISH
from quern.operators import answers, bm25, chunks, metrics, passages, sections, topk, vector_search, word_vectors
from quern.session import ship, spread

WIDTH = 64


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _plain(text: str):
    return X.letter_words(text)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: one each, in the order of their ids."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), "doc_id", F.lit(0).alias("chunk_id"), F.lit("").alias("title"), F.col("text").alias("content"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), _plain("text").alias("terms"))


def _index(spark: SparkSession, d: str, corpus: DataFrame | None = None) -> bm25.Index:
    """An index of the questions' terms over all documents."""
    vocabulary = _asked(spark, d).select(F.explode("terms").alias("term")).distinct()
    return bm25.build(_corpus(spark, d) if corpus is None else corpus, vocabulary=vocabulary, words=letters.letter_words)


def _slices(spark: SparkSession, d: str, size: int) -> DataFrame:
    x = chunks.slice_texts(_t(spark, d, "documents"), size)
    return x.select((F.col("doc_id") * 100_000 + F.col("chunk_id")).alias("ord"), "doc_id", "chunk_id", F.lit("").alias("title"), "content")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """For each benchmark item the first document that contains it: (query_id, wanted)."""
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    return passages.first_holding(items, _t(spark, d, "documents").select("doc_id", "text")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("wanted"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25.search(_index(spark, d), _asked(spark, d), 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda h: h["doc_id"])
    return hits.groupBy("query_id").agg(ids.alias("ids"))


def _r(c: str):
    return (F.round(c, 6) + 0.0).alias(c)


def bm25_topk(spark, d):
    x = bm25.search(_index(spark, d), _asked(spark, d), 5)
    return x.select("query_id", "rank", "doc_id", _r("score"))


def bm25_idf(spark, d):
    x = bm25.term_frequencies(_corpus(spark, d).select("ord", _plain("content").alias("terms")))
    n = _t(spark, d, "documents").count()
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", bm25.idf(n, "df")).select("term", "df", _r("idf"))


def bm25_corpus_stats(spark, d):
    x = _t(spark, d, "documents").select(F.size(_plain("text")).alias("dl"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def bm25_all_scores_by_doc(spark, d):
    slices = _slices(spark, d, 500)
    x = bm25.scores_by_document(_index(spark, d, slices), _asked(spark, d))
    return x.select("query_id", "doc_id", F.size("chunks").cast("long").alias("n_chunks"), (F.round(F.array_max(F.transform("chunks", lambda c: c["score"])), 6) + 0.0).alias("best"))


def bm25_doc_dedup_topk(spark, d):
    slices = _slices(spark, d, 100)
    hits = bm25.search(_index(spark, d, slices), _asked(spark, d), 50).drop("rank")
    return topk.per_document(hits, 5, 50).select("query_id", "rank", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), _r("score"))


def tfidf_idf(spark, d):
    x = bm25.term_frequencies(_corpus(spark, d).select("ord", _plain("content").alias("terms")))
    n = _t(spark, d, "documents").count()
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", word_vectors.smoothed_idf(n, "df")).select("term", "df", _r("idf"))


def term_freq(spark, d):
    x = bm25.term_frequencies(_corpus(spark, d).select("ord", _plain("content").alias("terms")))
    return x.select(F.col("ord").alias("doc_id"), "term", "tf", F.col("dl").cast("long").alias("dl"))


def doc_freq(spark, d):
    x = _t(spark, d, "documents").select(F.explode(F.array_distinct(_plain("text"))).alias("term"))
    return x.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.squash(X.letters_only("text")).alias("normal"), F.size(_plain("text")).cast("long").alias("n_words"))


def stopword_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.filter(_plain("text"), lambda t: ~t.isin(*ENGLISH)), " ").alias("content_words"))


def vector_topk_ip(spark, d):
    e = _t(spark, d, "embeddings")
    x = vector_search.search(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 5, WIDTH)
    return x.select("query_id", "rank", F.col("ord").alias("vec_id"), _r("score"))


def vector_l2_normalize(spark, d):
    x = _t(spark, d, "embeddings").select("vec_id", V.scaled("embedding", F.lit(3.0)).alias("v"))
    return x.select("vec_id", F.posexplode(V.unit("v")).alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), _r("value"))


def _word_table(spark, d) -> DataFrame:
    """A vector for each word of the benchmark: the embeddings dealt to the words in order."""
    e = _t(spark, d, "embeddings")
    terms = sorted(r["term"] for r in _asked(spark, d).select(F.explode("terms").alias("term")).distinct().collect())
    n = e.count()
    numbered = spark.createDataFrame([(t, i % n) for i, t in enumerate(terms)], "term string, vec_id long")
    return numbered.join(e, "vec_id").select("term", F.col("embedding").alias("vec"))


def vector_weighted_mean(spark, d):
    c = _t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.lit(0).alias("chunk_id"), F.lit("").alias("title"), F.col("text").alias("content"))
    x = word_vectors.build(c, _word_table(spark, d), WIDTH, apart=letters.letter_words).vectors
    return x.select("doc_id", F.posexplode("vec").alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), _r("value"))


def vector_doc_dedup_topk(spark, d):
    e = _t(spark, d, "embeddings")
    x = vector_search.search(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 10, WIDTH)
    hits = x.drop("rank").join(e.select(F.col("vec_id").alias("ord"), F.col("label").alias("doc_id")), "ord")
    return topk.per_document(hits, 5, 10).select("query_id", "rank", F.col("doc_id").alias("label"), F.col("ord").alias("vec_id"), _r("score"))


def _paired(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and benchmark items with an embedding each, by number."""
    e = _t(spark, d, "embeddings")
    n = e.count()
    of = lambda c: e.select(F.col("vec_id").alias(c), F.col("embedding").alias("vec"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % n).alias("v")).join(of("v"), "v")
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), (F.col("item_id") % n).alias("v")).join(of("v"), "v")
    return docs.select("ord", "vec"), docs.select("ord", "text"), asked.select("query_id", "question", "vec")


def hybrid_rerank(spark, d):
    from quern.plans.retrieval import hybrid_documents

    x = hybrid_documents(*_paired(spark, d), WIDTH, 5)
    return x.select("query_id", "rank", F.col("ord").alias("doc_id"), _r("score"), _r("combined_score"))


def keyword_overlap(spark, d):
    c = _t(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    x = c.join(after, ["conv_id", "turn"])
    return x.select("conv_id", "turn", F.round(X.keyword_overlap("text", "reply"), 6).alias("overlap"))


def recall_mrr(spark, d):
    gold = _gold(spark, d).select(F.col("query_id").alias("ord"), F.lit("x").alias("answer"), F.col("wanted").alias("document_id"))
    predicted = _predicted(spark, d).select(F.col("query_id").alias("ord"), F.when(F.col("query_id") % 2 == 0, "X").otherwise("y").alias("answer"), F.col("ids").alias("document_id"))
    x = metrics.evaluate(gold, predicted)
    return x.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "recall", "mrr")))


def exact_match_accuracy(spark, d):
    c = _t(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    x = c.join(after, ["conv_id", "turn"])
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(X.same_text("text", "later"), F.lit(False)).cast("int")), 6).alias("accuracy"))


def _results(spark, d) -> DataFrame:
    return _predicted(spark, d).join(_gold(spark, d), "query_id").select("query_id", F.col("ids").alias("predicted_docs"), F.col("wanted").alias("true_doc_id"))


def not_found_report(spark, d):
    return metrics.not_found(_results(spark, d)).select("query_id", "true_doc_id", F.array_join(F.transform("predicted_docs", lambda v: v.cast("string")), ",").alias("predicted_docs"))


def inline_metrics(spark, d):
    x = metrics.inline(_results(spark, d))
    return x.select("n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def hit_rate(spark, d):
    x = metrics.hit_rate(_results(spark, d).select(F.col("predicted_docs").alias("document_id"), F.col("true_doc_id").cast("string").alias("answer")))
    return x.select("n", F.round("hit_rate", 6).alias("hit_rate"))


def chunk_slices(spark, d):
    return _slices(spark, d, 100).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "content")


def chunk_sentences(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("n", "sentence"))
    return x.where("sentence <> ''").select("doc_id", F.col("n").cast("long").alias("n"), "sentence")


def html_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", X.strip_html("html").alias("text"))


def html_title(spark, d):
    return sections.titles(_t(spark, d, "pages")).select("page_id", "title")


def html_sections(spark, d):
    """No SQL: a tree of unclosed elements."""
    x = sections.parse_sections(_t(spark, d, "pages").select("page_id", "html"), "html")
    return x.select("page_id", F.col("title").alias("page_title"), F.explode("sections").alias("s")).select("page_id", "page_title", "s.ord", "s.level", "s.title", F.array_join("s.path", " > ").alias("path"), "s.content")


def html_chunks(spark, d):
    """No SQL: pages all the way to chunks, raw and cleaned."""
    from quern.plans.retrieval import ingest

    x = ingest(_t(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("document_text")), 100)
    return x.select("document_id", "chunk_id", "title", "content", "content_clean")


def _found(spark, d) -> DataFrame:
    hits = bm25.search(_index(spark, d), _asked(spark, d), 3)
    docs = _corpus(spark, d).withColumn("title", F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return answers.with_contents(hits, docs)


def context_prompt(spark, d):
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    x = asked.join(answers.contexts(_found(spark, d)), "query_id", "left")
    return answers.answered(x).select("query_id", "prompt", "answer", "status")


def search_response(spark, d):
    x = _found(spark, d)
    return x.select("query_id", "rank", "doc_id", X.shown_title("title", "chunk_title").alias("title"), X.preview("content").alias("content"), X.shown_score(F.round("score", 6)).alias("shown"))


def title_shorten(spark, d):
    x = sections.titles(_t(spark, d, "pages"))
    long = F.concat_ws(" > ", "title", "url", F.when(F.col("page_id") % 2 == 0, F.col("title")))
    return x.select("page_id", X.short_title(long).alias("short"))


def preview_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.preview("text").alias("preview"))


def composite_id_parse(spark, d):
    c = _t(spark, d, "conversations")
    doc, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kinds = [F.concat(F.lit("doc_"), doc, F.lit("|chunk_"), turn), F.concat(doc, F.lit("|"), turn), F.concat(F.lit("doc_"), doc, F.lit("|"), F.col("role")), doc, F.concat(F.col("role"), F.lit("|"), turn), F.concat(F.lit("doc_"), doc, F.lit("|chunk_"), turn, F.lit("|x"))]
    made = F.element_at(F.array(*kinds), (F.col("turn") % 6 + 1).cast("int"))
    x = c.select("conv_id", "turn", made.alias("id")).withColumn("p", X.composite_id("id"))
    return x.select("conv_id", "turn", "id", F.col("p.doc_id").alias("doc_id"), F.col("p.chunk_id").cast("long").alias("chunk_id"))


def ann_ivf_topk(spark, d):
    """No SQL: cells fitted by k-means; the recall is tested."""
    e = _t(spark, d, "embeddings")
    index = vector_search.build_cells(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")), WIDTH, 32, 12)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vector_search.search_cells(index, q, 5).select("query_id", "rank", F.col("ord").alias("vec_id"), _r("score"))


ALL = (
    bm25_topk, bm25_idf, bm25_corpus_stats, bm25_all_scores_by_doc, bm25_doc_dedup_topk, tfidf_idf, term_freq, doc_freq, text_normalize, stopword_filter,
    vector_topk_ip, vector_l2_normalize, vector_weighted_mean, vector_doc_dedup_topk, hybrid_rerank, keyword_overlap, recall_mrr, exact_match_accuracy, not_found_report, inline_metrics,
    hit_rate, chunk_slices, chunk_sentences, html_strip, html_title, html_sections, html_chunks, context_prompt, search_response, title_shorten, preview_text,
    composite_id_parse, ann_ivf_topk,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
