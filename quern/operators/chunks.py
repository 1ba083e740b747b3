"""Sections to chunks of bounded size, raw and cleaned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import letters
from quern.functions import text as X
from quern.functions.stem import stem_tokens

#: Words of a chunk, unless configured.
MAX_WORDS = 1000
#: Texts that a worker takes apart at once.
ROWS = 256
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _n(s: str) -> int:
    return len(s.split())


class _Packer:
    """Fills chunks up to a size; what doesn't fit an empty chunk goes to `split`."""

    def __init__(self, most: int, split):
        self.most, self.split = most, split

    def __call__(self, pieces: list[str], out: list[str]) -> None:
        held, size = "", 0
        for piece in filter(None, map(str.strip, pieces)):
            n = _n(piece)
            if size + n <= self.most:
                held, size = f"{held} {piece}", size + n
            elif held:
                out.append(held)
                # adopted whole, whatever its size
                held, size = piece, n
            else:
                self.split(piece, out)
        if held:
            out.append(held)


def pack(content: str | None, most: int = MAX_WORDS) -> list[str]:
    """The chunks of one section: paragraphs packed greedily, then sentences, then runs of words.

    Packed chunks begin with a blank, and one can exceed `most` where a long piece follows a full chunk.
    """
    content = (content or "").strip()
    if not content:
        return []
    if _n(content) <= most:
        return [content]

    def cut(sentence: str, out: list[str]) -> None:
        w = sentence.split()
        out.extend(" ".join(w[i : i + most]) for i in range(0, len(w), most))

    by_sentence = _Packer(most, cut)
    out: list[str] = []
    _Packer(most, lambda p, to: by_sentence(_SENTENCE.split(p), to))(content.split("\n\n"), out)
    return out


def _mapped(values: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """of() of each value; a few become Python objects at a time, the rest stays in Arrow."""
    parts = [pa.array([of(v) for v in values.slice(i, ROWS).to_pylist()], kind) for i in range(0, len(values), ROWS)]
    return pa.concat_arrays(parts or [pa.array([], kind)])


def pack_chunks(content: Column | str, most: int = MAX_WORDS) -> Column:
    """pack() over a column: an array of chunks; a fold whose order matters, so it runs in Arrow batches."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(contents: pa.Array) -> pa.Array:
        return _mapped(contents, lambda c: pack(c, most), pa.list_(pa.string()))

    return run(F.col(content) if isinstance(content, str) else content)


def pack_lists(contents: Column, most: int = MAX_WORDS) -> Column:
    """pack() over each of an array of contents."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(lists: pa.Array) -> pa.Array:
        return _mapped(lists, lambda cs: None if cs is None else [pack(c, most) for c in cs], pa.list_(pa.list_(pa.string())))

    return run(contents)


def clean(text: Column | str) -> Column:
    """Lower case, letters only, no stop words, stems, one blank between them."""
    return F.array_join(stem_tokens(X.content_words(text)), " ")


def chunk_sections(parsed: DataFrame, most: int | None = None, doc: str = "document_id") -> DataFrame:
    """(doc, doc_title, chunk_id, title, content, content_clean) of rows of (doc, title, sections).

    chunk_id counts a document's chunks in depth-first order; sections without content make none.
    `most` of 0 or None stands for MAX_WORDS.  Documents are numbered in place, without a shuffle.
    """
    pieces = pack_lists(F.transform("sections", lambda s: s["content"]), most or MAX_WORDS)
    path = lambda s: F.when(F.size(s["path"]) > 0, X.heading_path(F.concat(s["path"], F.array(s["title"])))).otherwise(s["title"])
    named = F.zip_with("sections", "_pieces", lambda s, p: F.transform(p, lambda c: F.struct(path(s).alias("title"), c.alias("content"))))
    x = parsed.withColumn("_pieces", pieces).select(doc, F.col("title").alias("doc_title"), F.posexplode(F.flatten(named)).alias("chunk_id", "c"))
    return x.select(doc, "doc_title", "chunk_id", "c.title", "c.content", clean("c.content").alias("content_clean"))


def chunk_texts(docs: DataFrame, most: int = MAX_WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_id, content) of plain texts: each is one section."""
    x = docs.select(doc, pack_chunks(text, most).alias("pieces"))
    return x.select(doc, F.posexplode("pieces").alias("chunk_id", "content"))


def slice_texts(docs: DataFrame, most: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_id, content): runs of `most` words, cut in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in letters.parts(batch.column(1)):
                row, number, content = letters.slices(part, most)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(number.astype("int32")), content], [doc, "chunk_id", "content"])
                at += len(part)

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {dict(docs.dtypes)[doc]}, chunk_id int, content string")


def nested(chunks: DataFrame, content: str = "content", doc: str = "document_id") -> DataFrame:
    """One row a document: (document_id, title, chunks array<struct<chunk_id,title,content>>)."""
    one = F.struct("chunk_id", "title", F.col(content).alias("content"))
    return chunks.groupBy(doc).agg(F.first("doc_title").alias("title"), F.array_sort(F.collect_list(one)).alias("chunks"))


def flat(documents: DataFrame, doc: str = "document_id") -> DataFrame:
    """The chunks of nested documents as rows; documents without chunks vanish."""
    x = documents.select(doc, F.col("title").alias("doc_title"), F.explode("chunks").alias("c"))
    return x.select(doc, "doc_title", "c.*")
