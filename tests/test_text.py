"""Text functions, stems, sections and chunks against hand-derived values."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import stem
from quern.functions import text as X
from quern.functions.stem import porter, stem_terms
from quern.operators import chunks, sections


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("university", "univers"), ("dies", "die"), ("sky", "sky"), ("at", "at"), ("electriciti", "electr"), ("roll", "roll")])
def test_stems(word, stem):
    assert porter(word) == stem


def test_stems_of_terms_once_each(spark):
    x = spark.createDataFrame([("cats",), ("cats",), (None,)], "term string")
    assert {tuple(r) for r in stem_terms(x).collect()} == {("cats", "cat"), (None, None)}


def test_a_word_is_stemmed_once_a_slice(monkeypatch):
    seen = []
    monkeypatch.setattr(stem, "porter", lambda w: seen.append(w) or porter(w))
    lists = pa.array([["cats", "dogs", "cats"], None, [], ["cats"], ["running", None]])
    assert stem._stem_all.func(lists).to_pylist() == [["cat", "dog", "cat"], None, [], ["cat"], ["run", None]]
    assert sorted(seen) == ["cats", "dogs", "running"]


def test_words(spark):
    t = "I cannot  re-use\tthe 3 Été gonna don't."
    assert one(spark, X.words("t"), t=t) == ["i", "can", "not", "reuse", "the", "t", "gon", "na", "dont"]
    assert one(spark, X.content_words("t"), t="The cat and the dog") == ["cat", "dog"]
    assert one(spark, X.tokens("t"), t=" \n ") == [] and one(spark, X.tokens("t"), t=None) == []
    assert one(spark, X.squash("t"), t="\x1c a 　 b ") == "a b"


def test_small_functions(spark):
    assert one(spark, X.without_edit("t"), t="History ( edit ) ") == "History"
    assert one(spark, X.sentences("t"), t="A b. C!  D? e") == ["A b.", "C!", "D?", "e"]
    assert one(spark, X.strip_html("t"), t="<p>a&amp;lt; <b>b</b></p>") == "a&lt; b"
    assert one(spark, X.strip_html("t"), t="caf&eacute; &mdash; &#8217;&amp;copy;&") == "café — ’&copy;&" and one(spark, X.strip_html("t"), t=None) is None
    assert one(spark, X.keyword_overlap("q", "t"), q="The cat the", t="Cathedral theory") == 1.0
    assert one(spark, X.hybrid_score("v", "q", "t"), v=0.5, q="The cat the", t="Cathedral theory") == pytest.approx(0.65)
    assert one(spark, X.hybrid_score("v", "q", F.lit(None).cast("string")), v=0.5, q="x") == 0.5
    assert one(spark, X.prompt("q", F.array(F.lit("a"), F.lit("b"))), q="why") == "Context: a\n\nContext: b\n\nQuestion:why"
    assert one(spark, X.short_title("t"), t="a" * 101) == "a" * 97 + "..."
    assert one(spark, X.short_title("t"), t="a > " + "b" * 100 + " > c") == "a > ... > c"
    assert one(spark, X.shown_score("s"), s=1234.5) == "1234.50"


@pytest.mark.parametrize(("given", "doc", "chunk"), [("doc_12|chunk_3", "12", 3), ("12|3", "12", 3), ("doc_12|x", "12", 0), ("a|b", "a|b", 0), ("77", "77", 0), ("doc_1|chunk_2|x", "1", 2), ("a|1|2", "a|1|2", 0), (None, None, 0)])
def test_composite_ids(spark, given, doc, chunk):
    assert tuple(one(spark, X.composite_id("t"), t=given)) == (doc, chunk)


@pytest.mark.parametrize(("text", "want"), [("a b c. d e f. g h i j k l m.", [" a b c.", "d e f.", "g h i j k l m."]), ("a b c d e f g.", ["a b c d e", "f g."]), ("a b c d\n\ne f g h i j k\n\nl", [" a b c d", "e f g h i j k", "l"]), ("", []), (None, [])])
def test_packing(text, want):
    assert chunks.pack(text, 5) == want


def test_texts_are_packed_some_at_a_time():
    held = []
    got = chunks._mapped(pa.array(["a b c", None] * 300), lambda c: held.append(c) or chunks.pack(c, 2), pa.list_(pa.string()))
    assert got.to_pylist() == [["a b", "c"], []] * 300 and len(held) == 600


def test_pages_are_parsed_some_at_a_time():
    pages = pd.DataFrame({"k": range(600), "html": ["<h1>T</h1><p>a</p>"] * 600})
    got = list(sections._parsed(iter([pages]), ["k"], "html"))
    assert [len(x) for x in got] == [256, 256, 88] and [k for x in got for k in x["k"]] == list(range(600))


def paths(markup):
    return [" > ".join([*s["path"], s["title"]]) for s in sections.sections(markup)[1]]


def test_section_paths():
    assert paths("<h1>T</h1><h2>A</h2><h3>B</h3><h4>C</h4><h2>D</h2><h4>E</h4>") == ["T", "T > A", "T > A > B", "T > A > B > C", "T > A > B > E", "T > D"]
    assert paths("<h2>H</h2>") == [" > H"] and paths("<h1>T</h1><h4>X</h4><h3>Y</h3>") == ["T", "T > X", "T > Y"]
    assert sections.sections(None) == ("", [])


def test_pruned_pages():
    title, found = sections.sections("<p>gone</p><h1>T</h1><p>a</p><ul id=toc><li>x</li></ul><h2>Contents</h2><h2>Cross-References guide</h2><p>cut</p><h2>Later</h2>")
    assert title == "T" and [(s["title"], s["content"]) for s in found] == [("T", "a")]


def test_pages_to_chunks(spark):
    from quern.plans.retrieval import corpus, ingest

    pages = [(3, "<h1>T</h1><p>The cats ran. Dogs hopped.</p><h2>T</h2><h2>U</h2><p>x y</p>"), (4, None), (5, "plain")]
    got = ingest(spark.createDataFrame(pages, "document_id long, document_text string"), 3)
    assert [tuple(r) for r in got.orderBy("chunk_id").collect()] == [(3, "T", 0, "T", " The cats ran.", "cat ran"), (3, "T", 1, "T", "Dogs hopped.", "dog hop"), (3, "T", 2, "T > U", "x y", "x")]
    assert corpus(got).count() == 3
    assert [len(r["chunks"]) for r in chunks.nested(got).collect()] == [3] and chunks.flat(chunks.nested(got)).count() == 3


def test_numbering_of_chunks_moves_no_rows(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a b c d e f</p><h2>U</h2><p>x</p>"), (2, None)], "document_id long, document_text string")
    x = chunks.chunk_sections(sections.parse_sections(pages), 4)
    assert [tuple(r) for r in x.select("chunk_id", "title", "content").collect()] == [(0, "T", "a b c d"), (1, "T", "e f"), (2, "T > U", "x")]
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


def test_cells_of_an_inverted_index():
    from quern.functions.vectors import cells_for

    assert cells_for(10_000) is None and cells_for(10_001) == (1000, 64) and cells_for(50_000) == (4096, 64)
