"""Searches, metrics, answers, sources and persistence."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import answers, bm25, metrics, topk, vector_search, word_vectors
from quern.plans import retrieval
from quern.sources import config, jsonl, tables
from quern.streaming import ingest as streaming

CORPUS = [(0, 10, 0, "", "cat dog cat"), (1, 10, 1, "", "dog fish"), (2, 11, 0, "", "bird")]
NAMES = "ord long, doc_id long, chunk_id int, title string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, NAMES)


def asked(spark, *terms):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(terms)], "query_id long, terms array<string>")


def test_bm25_scores(spark, corpus):
    index = bm25.build(corpus)
    assert (index.n, index.avgdl) == (3, 2.0)
    q = asked(spark, ["cat", "dog"], ["dog", "dog", "zebra"], ["zebra"])
    got = {(r["query_id"], r["ord"]): r["score"] for r in bm25.all_scores(index, q).collect()}
    want = [[2.090850897, 0.970003629, 0.5], [1.267352864, 1.440007258, 0.5], [0, 0, 0]]
    assert all(got[i, j] == pytest.approx(s, abs=1e-8) for i, row in enumerate(want) for j, s in enumerate(row))
    found = bm25.search(index, q, 2).orderBy("query_id", "rank").collect()
    assert [r["ord"] for r in found] == [0, 1, 1, 0, 0, 1]
    assert [r["score"] for r in bm25.score_one(index, q, 2).orderBy("query_id").collect()] == pytest.approx([0.5, 0.5, 0])
    assert bm25.search(bm25.build(corpus.limit(0)), q, 2).count() == 0


def test_bm25_search_joins_nothing(spark, corpus):
    index = bm25.build(corpus, vocabulary=spark.createDataFrame([("cat",), ("bird",)], "term string"))
    found = bm25.search(index, asked(spark, ["cat"], ["bird", "cow"]), 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["ord"] for r in found.orderBy("query_id", "rank").collect()] == [0, 1, 2, 0]


def test_scores_by_document_are_those_of_all_chunks(spark, corpus):
    q = asked(spark, ["cat", "dog"], ["fish"], [])
    index = bm25.build(corpus)
    rows = lambda x: {(r["query_id"], r["doc_id"]): [(c["chunk_id"], round(c["score"], 9), c["title"]) for c in r["chunks"]] for r in x.collect()}
    assert rows(bm25.scores_by_document(index, q)) == rows(topk.by_document(bm25.all_scores(index, q)))


def test_postings_of_a_bucket_are_dealt_to_tasks(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 1, raising=False)
    c = spark.createDataFrame([(i, i, 0, "", "cat") for i in range(200)], NAMES)
    tables.save_bm25(bm25.build(c), str(tmp_path / "index"), 1)
    assert len(list((tmp_path / "index" / "postings").glob("*/*.parquet"))) > 1
    assert tables.load_bm25(spark, str(tmp_path / "index")).postings.count() == 200


def test_vectors_of_texts_move_nothing(spark, corpus):
    words = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "term string, vec array<float>")
    index = word_vectors.build(corpus, words, 2, weighted=False)
    assert "Exchange" not in index.vectors._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r["vec"] for r in index.vectors.orderBy("ord").collect()], [(2 / 5**0.5, 1 / 5**0.5), (0, 1), (0, 0)])


def test_bm25_saved_and_loaded(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    build = lambda: bm25.build(corpus, k1=1.2, epsilon=0.1)
    index = tables.load_or_build(spark, path, lambda: tables.load_bm25(spark, path), build, lambda i: tables.save_bm25(i, path, 4))
    assert (index.k1, index.epsilon) == (1.2, 0.1)
    q = asked(spark, ["cat", "fish"])
    rows = lambda i: [tuple(r) for r in bm25.search(i, q, 3).orderBy("rank").collect()]
    assert rows(index) == rows(build())


def test_weighted_vectors(spark, corpus):
    words = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("fish", [1.0, 1.0])], "term string, vec array<float>")
    index = word_vectors.build(corpus, words, 2)
    got = [r["vec"] for r in index.vectors.orderBy("ord").collect()]
    assert np.allclose(got, [(0.982400764, 0.186785276), (0.493897866, 0.869519924), (0, 0)], atol=1e-8)
    hits = retrieval.vector_hits(index, spark.createDataFrame([(0, "cat")], "query_id long, question string"), 3).orderBy("rank").collect()
    assert [r["score"] for r in hits] == pytest.approx([0.982400764, 0.493897866, 0], abs=1e-8)


def test_vector_search_equals_sorting(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "ord long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist() + [9.0] * (i % 2)) for i in range(7)] + [(50, [1.0])], "query_id long, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["ord"] for r in vector_search.search(df, q, 4, 6).collect()}
    want = {(i, k + 1): int(o) for i in range(7) for k, o in enumerate(np.lexsort((np.arange(300), -(v @ v[i])))[:4])}
    assert got == want
    cells = vector_search.build_cells(df, 6, 8, 8)
    assert {(r["query_id"], r["rank"]): r["ord"] for r in vector_search.search_cells(cells, q, 4).collect()} == want


def test_many_queries_are_dealt_to_groups(spark, monkeypatch):
    for name, n in (("QUERIES_A_PASS", 10), ("GROUP", 70), ("PART", 90)):
        monkeypatch.setattr(vector_search, name, n, raising=False)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    v[50:90] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "ord long, vec array<double>").repartition(5)
    x = vector_search.search(df, df.withColumnRenamed("ord", "query_id"), 4, 6)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r["query_id"], r["rank"]): r["ord"] for r in x.collect()}
    assert got == {(i, k + 1): int(o) for i in range(300) for k, o in enumerate(np.lexsort((np.arange(300), -(v @ v[i])))[:4])}


def test_the_best_of_blocks_are_those_of_all():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 40, (5, 3000)) / 8.0
    best = topk.Best(np.arange(5), 10)
    for at in range(0, 3000, 500):
        rows = pa.record_batch([pa.array(np.arange(at, at + 500)), pa.array([f"t{i}" for i in range(at, at + 500)])], ["ord", "title"])
        query, row = best.cut(scores[:, at : at + 500])
        best.add(query, row, scores[:, at : at + 500][query, row], np.arange(at, at + 500), rows)
        assert best.rows.num_rows <= 50
    got = [r for b in best.batches() for r in b.to_pylist()]
    want = [(q, int(o)) for q in range(5) for o in np.lexsort((np.arange(3000), -scores[q]))[:10]]
    assert [(r["query_id"], r["ord"]) for r in got] == want and all(r["title"] == f"t{r['ord']}" for r in got)


def test_products_in_double_are_bounded(monkeypatch):
    held, einsum = [], np.einsum
    monkeypatch.setattr(vector_search, "CELLS", 64)
    monkeypatch.setattr(np, "einsum", lambda s, a, b: (held.append(a.size), einsum(s, a, b))[1])
    best, rows = topk.Best(np.arange(3), 2), pa.RecordBatch.from_arrays([pa.array(range(50))], ["ord"])
    vector_search._multiplied(best, np.ones((3, 16)), np.ones((50, 16)), rows)
    assert max(held) <= 64 and sum(held) == 3 * 50 * 16
    assert best.ord.tolist() == [0, 1] * 3


def test_wanted_terms_are_kept_as_numbers(spark, corpus):
    """An index holds of its texts two numbers a distinct wanted term, and gives what an index of all words gives."""
    some, every = bm25.build(corpus, vocabulary=spark.createDataFrame([("cat",), ("dog",), ("zebra",)], "term string")), bm25.build(corpus)
    kinds = dict(some.texts.dtypes)
    assert (kinds["terms"], kinds["tfs"]) == ("array<int>", "array<int>")
    assert some.texts.where("ord = 0").select("terms", "tfs", "dl").first() == ([0, 1], [2, 1], 3)
    q = asked(spark, ["cat", "dog"], ["dog", "dog", "zebra"], ["zebra"])
    listed = lambda x: sorted(map(tuple, x.collect()))
    assert listed(bm25.search(some, q, 2)) == listed(bm25.search(every, q, 2))
    assert listed(bm25.scores_by_document(some, q)) == listed(bm25.scores_by_document(every, q))
    assert listed(some.postings) == listed(every.postings.where("term in ('cat', 'dog')"))
    assert "Exchange" not in some.postings._jdf.queryExecution().sparkPlan().toString()
    assert listed(some.terms) == listed(every.terms.where("term in ('cat', 'dog')"))


@pytest.mark.parametrize("sparse", [0, 10**9])
def test_few_terms_score_as_a_whole_matrix_does(spark, monkeypatch, sparse):
    """Chunks that hold few of the terms are scored from those alone (0 scores all so), with the same results."""
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(60)]
    rows = [(i, i, 0, "", " ".join(rng.choices([*vocabulary, "other"], k=rng.choice([0, 1, 5, 40])))) for i in range(300)]
    docs = spark.createDataFrame(rows, NAMES)
    index = bm25.build(docs, vocabulary=spark.createDataFrame([(w,) for w in vocabulary], "term string"))
    q = asked(spark, *(rng.choices([*vocabulary, "unseen"], k=n) for n in (1, 3, 9, 0)))
    want = {(r["query_id"], r["ord"]): r["score"] for r in bm25.all_scores(bm25.build(docs), q).collect()}
    a, calls = next(bm25._asked(index, q)), []
    few = bm25._few
    monkeypatch.setattr(bm25, "_few", lambda *x: (calls.append(1), few(*x))[1])
    monkeypatch.setattr(bm25, "SPARSE", sparse)
    x = bm25._rows(index, a).toArrow().combine_chunks()
    got = np.concatenate([s for _, s in bm25._scored(index, a)[0](*(c.combine_chunks() for c in x.columns[:3]))])
    assert bool(calls) == (sparse == 0)
    assert all(got[i, j] == pytest.approx(want[int(k), int(o)], abs=1e-9) for i, o in enumerate(x["ord"].to_pylist()) for j, k in enumerate(a.ids))


def test_found_documents_alone_are_cut_again(spark):
    from quern.plans import tasks

    sf = "/root/testdata/sf0.001"
    plan = tasks.qa_batch_bm25(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, \(doc_id#\d+L = doc_id#\d+L\)", plan)


def test_cells_recall(spark):
    from quern.plans.queries import ann_ivf_topk, vector_topk_ip

    near = {(r["query_id"], r["vec_id"]) for r in ann_ivf_topk(spark, "/root/testdata/sf0.01").collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in vector_topk_ip(spark, "/root/testdata/sf0.01").where("query_id % 50 = 0").collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_metrics(spark):
    gold = spark.createDataFrame([(0, "A", 1), (1, "b", 2), (2, "c", 3)], "ord long, answer string, document_id long")
    said = spark.createDataFrame([(0, "a", [9, 1]), (1, "x", [2]), (2, "y", [7, 8]), (3, "z", [1])], "ord long, answer string, document_id array<long>")
    r = metrics.evaluate(gold, said).first()
    assert (r["n"], r["accuracy"], r["recall"], r["mrr"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.5))
    assert metrics.evaluate(gold.limit(0), said).first()["recall"] is None
    x = spark.createDataFrame([([1, 2], 2), ([3], 4)], "predicted_docs array<long>, true_doc_id long")
    assert metrics.not_found(x).count() == 1 and metrics.inline(x).first()["mrr"] == 0.25
    h = spark.createDataFrame([([5], "5"), ([6], "x")], "document_id array<long>, answer string")
    assert metrics.hit_rate(h).first()["hit_rate"] == 0.5
    assert metrics.similarity(h.select(F.lit("a").alias("predicted_answer"), "answer"), lambda a, b: a.str.len() * 1.0).first()[0] == 1.0


def test_best_chunk_of_each_document(spark):
    hits = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 7, 0.9), (0, 3, 8, 0.9), (0, 4, 9, 0.1)], "query_id long, ord long, doc_id long, score double")
    got = [(r["doc_id"], r["ord"], r["rank"]) for r in topk.per_document(hits, 5, 3).orderBy("rank").collect()]
    assert got == [(7, 2, 1), (8, 3, 2)]


def test_response_to_one_question(spark, corpus):
    index = {"bm25": bm25.build(corpus)}
    out = json.loads(retrieval.search_response("A cat?", "bm25", index, corpus, model=lambda ps: [f"{len(p)}" for p in ps]))
    assert [d["content"] for d in out["documents"]] == ["cat dog cat", "dog fish", "bird"] and out["originalQuestion"] == "A cat?" and out["answer"].isdigit()
    for bad, error in ((" ", ValueError), ("x", LookupError)):
        with pytest.raises(error):
            retrieval.search_response(bad, "dense", index, corpus)
    with pytest.raises(ValueError):
        retrieval.search_response("x", "other", index, corpus)


def test_answers_say_what_failed(spark):
    x = spark.createDataFrame([("q", ["c"]), ("r", None)], "question string, contexts array<string>")

    def broken(prompts):
        raise OSError

    assert {tuple(r) for r in answers.answered(x, broken).select("answer", "status").collect()} == {(answers.FAILED, "failed"), (answers.NO_CONTEXT, "no context")}
    assert {r["status"] for r in answers.answered(x).collect()} == {"skipped", "no context"}
    v = answers.encoded(x, lambda ts: [[len(t), 1.0] for t in ts], "question").first()["vec"]
    assert v == [1.0, 1.0]


def test_batch_of_questions(spark, corpus):
    q = spark.createDataFrame([(0, "cats"), (1, "birds")], "query_id long, question string")
    hits = retrieval.bm25_documents(bm25.build(corpus), q)
    out = {r["query_id"]: r for r in retrieval.answer_batch(hits, q, corpus).collect()}
    assert out[0]["predicted_docs"] == [10, 11] and out[1]["predicted_docs"] == [11, 10] and out[1]["prompt"].startswith("Context: bird")


def test_only_found_texts_are_brought_together(spark, corpus):
    q = spark.createDataFrame([(0, "cats")], "query_id long, question string")
    x = retrieval.answer_batch(retrieval.bm25_documents(bm25.build(corpus), q, 1), q, corpus)
    assert "LeftSemi" in x._jdf.queryExecution().optimizedPlan().toString() and x.first()["prompt"].startswith("Context: cat dog cat")


def test_json_lines(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"document_id": 7, "document_text": "<h1>T</h1><p>a b</p>"}\n\n{"document_text": "x"}\n{"document_id": 9}\n{bad\n')
    path = str(p)
    docs = jsonl.numbered(jsonl.read(spark, path, jsonl.RAW, "skip"))
    assert [r["document_id"] for r in docs.orderBy("doc_ord").collect()] == [7, 1]
    assert [r["line"] for r in jsonl.malformed(spark, path, jsonl.RAW).collect()] == ["{bad"]
    with pytest.raises(Exception):
        jsonl.read(spark, path, jsonl.RAW).collect()
    with pytest.raises(FileNotFoundError):
        jsonl.read(spark, path + "x", jsonl.RAW)
    assert jsonl.read(spark, path + "x", jsonl.RAW, "skip", fallback=path).count() >= 3
    jsonl.write(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    jsonl.write_document(docs, str(tmp_path / "list.json"))
    assert len(json.loads((tmp_path / "list.json").read_text())) == 2


def test_word_vector_file_and_settings(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\ncat 1 0.5\ndog 0 1\n")
    assert {r["term"]: r["vec"] for r in tables.read_word_vectors(spark, str(tmp_path / "v.txt")).collect() if len(r["vec"]) == 2} == {"cat": [1.0, 0.5], "dog": [0.0, 1.0]}
    with pytest.raises(FileNotFoundError):
        tables.read_word_vectors(spark, str(tmp_path / "none"))
    (tmp_path / "c.toml").write_text("[data]\nmax_chunk_size = 0\n[bm25]\nk1 = 2.0\nother = 1\n")
    s = config.load(str(tmp_path / "c.toml"))
    assert (s.max_chunk_size, s.k1, s.with_model("m").model) == (1000, 2.0, "m")


def test_arriving_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"document_id": i, "document_text": f"<h1>T{i}</h1><p>a b c</p>"}) + "\n")
        q = streaming.write_chunks(streaming.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1


def test_scores_keep_their_order_whatever_epsilon(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(12)]
    rows = [(i, i, 0, "", " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(40)]
    c = spark.createDataFrame(rows, NAMES)
    q = asked(spark, words[:2], words[3:6])
    order = [[r["ord"] for r in bm25.search(bm25.build(c, epsilon=e), q, 40).orderBy("query_id", "rank").collect()] for e in (0.0, 0.25)]
    assert order[0] == order[1]
