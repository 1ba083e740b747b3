"""Texts as tf-idf-weighted means of word vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import letters
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.stem import stem_tokens
from quern.operators import term_sums
from quern.operators.bm25 import term_frequencies
from quern.operators.sizes import small
from quern.operators.term_sums import OWN

#: Word vectors that are broadcast at most.
WORDS = 50_000


@dataclass
class Index:
    """vectors (ord, doc_id, chunk_id, title, vec), idf (term, idf) and the table of word vectors (term, vec)."""

    vectors: DataFrame
    idf: DataFrame
    words: DataFrame
    width: int
    weighted: bool = True
    preprocess: bool = True


def smoothed_idf(n: int, df: Column | str) -> Column:
    d = F.col(df) if isinstance(df, str) else df
    return F.ln((F.lit(float(n)) + 1) / (d + 1)) + 1


def query_terms(question: Column | str, preprocess: bool = True) -> Column:
    return stem_tokens(X.content_words(question)) if preprocess else X.tokens(question)


def means(counts: DataFrame, words: DataFrame, idf: DataFrame | None, width: int, keys: DataFrame) -> DataFrame:
    """keys (ord) with `vec`: unit vectors of the sums over (ord, term, tf, dl); zero where no word is known.

    Each occurrence adds tf / dl * idf * vec, so a term weighs with the square of its count; unseen
    terms have idf 1.  Without idf every occurrence adds its vector.
    """
    by = F.col("tf").cast("double")
    x = counts
    if idf is not None:
        x = x.join(idf.select("term", "idf"), "term", "left")
        by = by * F.col("tf") / F.col("dl") * F.coalesce("idf", F.lit(1.0))
    x = x.select("ord", "term", by.alias("by"))
    sums = _joined(x, words, width).select("ord", V.unit("vec").alias("vec"))
    return keys.join(sums, "ord", "left").withColumn("vec", F.coalesce("vec", F.array(*[F.lit(0.0)] * width)))


def _joined(x: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """(ord, vec): the sums of by * vec over (ord, term, by), for tables of any size."""
    x = x.join(words.select("term", F.col("vec").cast("array<double>").alias("wv")), "term")
    sums = x.groupBy("ord").agg(*(F.sum(F.col("by") * F.col("wv")[i]).alias(f"d{i}") for i in range(width)))
    return sums.select("ord", F.array(*(F.col(f"d{i}") for i in range(width))).alias("vec"))


def _products(texts: DataFrame, words: DataFrame, idf: DataFrame | None, width: int, wanted: list[str] | None = None) -> DataFrame:
    """means() for tables of WORDS words at most, as a matrix on every executor: texts (terms, dl, ord, ...) move nowhere.

    With `wanted` terms are places in it, with `tfs`.
    """
    held = words.select("term", F.slice(F.col("vec").cast("array<float>"), 1, width).alias("v")).where(F.size("v") == width).toArrow()
    terms = held.column("term").combine_chunks()
    matrix = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    by = None
    if idf is not None:
        known = {r["term"]: r["idf"] for r in idf.join(F.broadcast(words.select("term")), "term", "left_semi").select("term", "idf").collect()}
        by = np.array([known.get(w, 1.0) for w in terms.to_pylist()], np.float64)
    sent = words.sparkSession.sparkContext.broadcast((terms.to_pylist(), matrix, by, term_sums.moved(wanted, terms.to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, table, by, to = sent.value
        terms = pa.array(terms, pa.string())
        for batch in batches:
            names, dl = batch.schema.names[3:], np.asarray(batch.column(2)).astype(np.float64)
            for at, used, n in term_sums.counted(batch.column(0), None if to is None else batch.column(1), terms, width, to):
                if by is not None:
                    n = n * n / np.maximum(dl[at : at + len(n)], 1.0)[:, None] * by[used]
                sums = n @ table[used].astype(np.float64)
                length = np.sqrt((sums**2).sum(axis=1))[:, None]
                vec = pa.FixedSizeListArray.from_arrays(pa.array(np.divide(sums, length, out=sums, where=length > 0).ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(n)).columns[3:], vec], [*names, "vec"])

    rest = [c for c in texts.columns if c not in ("terms", "tfs", "dl", "ord")]
    x = texts.select("terms", F.lit(None).cast("array<int>").alias("tfs") if wanted is None else "tfs", "dl", F.col("ord").cast("long").alias("ord"), *rest)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[3:])
    return x.mapInArrow(run, f"{fields}, vec array<double>")


def build(chunks: DataFrame, words: DataFrame, width: int, *, weighted: bool = True, preprocess: bool = True, apart: Callable[[pa.Array], pa.ListArray] = letters.tokens) -> Index:
    """The vectors of (ord, doc_id, chunk_id, title, content), whose contents are split at white space unless `apart`, a function of letters.py, does it.

    Only words of the table are counted, others have no vector; their counts are kept for the idf and the means.
    """
    x = chunks.select("ord", "doc_id", "chunk_id", "title", "content")
    if not small(words, WORDS):
        n = chunks.count()
        x = term_sums.read(x, apart)
        counts = term_frequencies(x, words).persist()
        idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", smoothed_idf(n, "df"))
        vectors = means(counts, words, idf if weighted else None, width, x.select("ord", "doc_id", "chunk_id", "title"))
        return Index(vectors, idf, words, width, weighted, preprocess)
    vocabulary, wanted = words.select("term").distinct(), None
    if small(words, term_sums.WANTED):
        wanted = sorted(r["term"] for r in vocabulary.where("term is not null").collect())
        x = term_sums.read(x, apart, wanted)
        # texts are read again for the vectors only where they are weighted
        x, vocabulary = x.persist() if weighted else x, None
    else:
        x = term_sums.read(x, apart)
    counts = term_sums.spread_counts(x, vocabulary, wanted).persist()
    # plain means need no terms counted
    n = counts.where(F.col("term") == OWN).agg(F.sum("df")).first()[0] or 0 if weighted else chunks.count()
    idf = counts.where(F.col("term") != OWN).select("term", "df").withColumn("idf", smoothed_idf(n, "df"))
    return Index(_products(x, words, idf if weighted else None, width, wanted), idf, words, width, weighted, preprocess)


def encode_queries(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, vec) of (query_id, question)."""
    x = queries.select(F.col("query_id").alias("ord"), query_terms("question", index.preprocess).alias("terms"))
    if small(index.words, WORDS):
        out = _products(x.select("terms", F.size("terms").alias("dl"), "ord"), index.words, index.idf if index.weighted else None, index.width)
        return out.select(F.col("ord").alias("query_id"), "vec")
    out = means(term_frequencies(x), index.words, index.idf if index.weighted else None, index.width, x.select("ord"))
    return out.select(F.col("ord").alias("query_id"), "vec")
