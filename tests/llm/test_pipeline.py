"""The pipeline: its stages one by one against what they promise, and as a whole."""

import zlib

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    seen = []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= before
        seen.append((name, docs.count()))
        before = ids
    assert [n for n, _ in seen] == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing"]
    assert 0.7 * 1000 < seen[0][1] < 1000 and seen[1][1] < seen[0][1] and seen[2][1] < seen[1][1]
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect())
    got = sorted((r["doc_id"], r["ids_crc32"]) for r in P.STAGES[-1][1](spark, docs, SF).collect())
    assert got == want
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in P.run(spark, SF).collect()) == want


def awkward_tables(spark, tmp_path, rows):
    """documents with nulls, repeats and clashing columns beside the small tables' labels and benchmark."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "target", "score", "rep", "start", "n_words", "kept", "_rid", "digest"):
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_awkward_documents(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = [(i, r["text"], r["lang"], r["source"], 1) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect())]
    odd = [(None, plain[0][1], None, None, None), (None, None, None, None, None), (100, "", "en", "a", 0), (101, None, "en", None, 0), (102, " \n", "en", "a", 2), (103, "word " * 150_000, "en", "a", 0), (104, plain[1][1], "en", "a", 1), (104, plain[1][1], "en", "a", 1), (105, f"{plain[2][1]} {item}", "en", "z", 1)]
    sf = awkward_tables(spark, tmp_path, plain + odd)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} <= before
        if name == "near-duplicates":
            assert docs.where("doc_id = 104").count() == 0
        if name == "benchmark decontamination":
            assert docs.where("doc_id = 105").count() == 0
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()


def test_no_documents(spark, tmp_path):
    sf = awkward_tables(spark, tmp_path, [])
    assert P.run(spark, sf).count() == 0
