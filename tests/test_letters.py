"""Texts taken apart by their bytes, against the columns of text.py that say the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import letters
from quern.functions import text as X
from quern.operators import chunks

#: Every code point between letters and among blanks, and awkward texts.
TEXTS = [f"Ab{chr(i)}cD {chr(i)}{chr(i)} e{chr(i)}" for i in (*range(1, 0x3100), 0xFEFF, 0xFFFD, 0x1D400, 0x1F600)]
TEXTS += [None, "", " ", "　", "I cannot, GONNA running the flies\x85and ties Kİ", "É\xa0à", "x" * 99, " a\n\n b ", "…"]


def same(got: pa.Array, df, column) -> None:
    want = [r[0] for r in df.select(column).collect()]
    bad = [(t, g, w) for t, g, w in zip(TEXTS, got.to_pylist(), want, strict=True) if g != w]
    assert not bad, bad[:3]


@pytest.mark.parametrize("most", [4_194_304, 50])
def test_words_are_those_of_the_columns(spark, monkeypatch, most):
    monkeypatch.setattr(letters, "BYTES", most)
    texts = pa.array(TEXTS, pa.string())
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1)
    all_of = lambda words: pa.concat_arrays([words(p) for p in letters.parts(texts)])
    same(all_of(letters.letter_words), df, X.letter_words("t"))
    same(all_of(letters.tokens), df, X.tokens("t"))
    same(all_of(letters.stemmed), df, X.tokens(chunks.clean("t")))
    assert len(list(letters.parts(texts))) == 1 or most == 50


def test_only_words_that_can_become_a_wanted_stem_are_stemmed(monkeypatch):
    words = "cannot gonna dying lies flies abies using aging aby abying ebbing die rationalization relational skies ss ies ied aing oed".split()
    texts = pa.array([*TEXTS, " ".join(words), "zzkw zzkw qqj the a zzkwing", "the a"], pa.string())
    lists = letters.stemmed(texts).to_pylist()
    asked, stem = [], letters.porter
    monkeypatch.setattr(letters, "porter", lambda w: (asked.append(w), stem(w))[1])
    for some in (sorted({s for x in lists for s in x}), ["i", "a", "eb", "us", "die", "use", "abi", "ration", "gon"], ["can", "can"], []):
        asked.clear()
        row, place, dl = letters.places(letters.stemmed, texts, letters.Wanted(some))
        got = sorted((int(r), some[p]) for r, p in zip(row, place, strict=True))
        assert got == sorted((r, s) for r, x in enumerate(lists) for s in x if s in some)
        assert dl.tolist() == [len(x) for x in lists]
        assert "zzkwing" not in asked or "zzkw" in some
    for begin in "aeioubcdfsty":
        for end in "s ies ied ing eed y ational enci izer bli alli entli eli ousli ization ator biliti logi icate ative ement ion e ll sses".split():
            for word in (begin + end, begin + "b" + end, begin + "y" + end, "x" + begin + end):
                some = letters.Wanted([stem(word)])
                assert len(letters.places(letters.stemmed, pa.array([word]), some)[0]) == len(letters.stemmed(pa.array([word])).to_pylist()[0]), word


def test_slices_hold_the_words_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, " ".join(f"w{i}" for i in range(25)))], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_id"], r["content"]) for r in chunks.slice_texts(df, 2).collect()]
    want = df.select("doc_id", F.posexplode(X.slices(X.tokens("text"), 2)).alias("n", "w")).select("doc_id", "n", F.array_join("w", " "))
    assert sorted(got) == sorted(tuple(r) for r in want.collect())


def test_texts_of_an_index_meet_no_regular_expression(spark):
    from quern.plans import queries, tasks

    sf = "/root/testdata/sf0.001"
    for index in (queries._index(spark, sf), tasks._bm25_index(spark, sf, tasks._whole(spark, sf)), tasks._bm25_index(spark, sf, tasks._sliced_docs(spark, sf))):
        plan = index.texts._jdf.queryExecution().logical().toString() + index.texts._jdf.queryExecution().analyzed().toString()
        assert "regexp_replace" not in plan and "MapInArrow" in plan
        index.unpersist()
