"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, materialize
from quern.llm.licenses import GAP

#: Words a seed spans, and the masks: '1' must agree, '0' is ignored.  For any two places of a span there is a
#: mask that ignores both, so two substitutions anywhere in it leave a mask that doesn't see them.
SPAN = 12
MASKS = (
    "000111000111", "001011001011", "011100011100",
    "101100101100", "110001110001", "110010110010",
)
#: Of the words of a span, so many must agree around a hit.
AGREE = 10
#: Items of fewer words are no test items that could be recognised: they have no seeds.
LEAST_WORDS = 8
#: Share of an item's spans, or number of them in all (24 words in a row), from which `clean` drops a document.
COVERAGE, SPANS = 0.5, 13
#: Seeds that are broadcast at once (about 200 bytes each); more take more passes over the texts.
SEEDS_A_PASS = 200_000


def _hashes(text: Column) -> Column:
    """The 64-bit hashes of the words of a text, one after another."""
    return F.transform(F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), ""), lambda w: F.xxhash64(w))


def _seed(words: Column, begin: Column, k: int, mask: str, n: int) -> Column:
    """Hash of the mask's number, its length and the words that it selects from the n words behind begin."""
    return F.xxhash64(F.lit(k), F.lit(n), *[F.get(words, begin + i) for i, c in enumerate(mask[:n]) if c == "1"])


def seeds(benchmark: DataFrame, masks=MASKS, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """One row per span and mask of each item: item_id, n (its words), start, words of the span (hashed), hash.

    Items of fewer words than a span have one shorter span, those of fewer than `least` words none.
    """
    x = benchmark.select("item_id", _hashes(F.col("text")).alias("_w")).withColumn("n", F.size("_w")).where(F.col("n") >= max(1, min(least, span)))
    x = x.select("item_id", "n", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - span))).alias("start"))
    x = x.withColumn("words", F.slice("_w", F.col("start") + 1, span))
    zero = F.lit(0)
    per = [F.when(F.size("words") == n, F.array(*[_seed(F.col("words"), zero, k, m, n) for k, m in enumerate(masks)])) for n in range(max(1, min(least, span)), span + 1)]
    return x.select("item_id", "n", "start", "words", F.explode(F.coalesce(*per)).alias("hash"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, masks=MASKS, span: int = SPAN, agree: int = AGREE, least: int = LEAST_WORDS, a_pass: int = SEEDS_A_PASS) -> DataFrame:
    """One row per doc_id and item_id that overlap: doc_id, item_id, n_words, n_spans, coverage.

    Every window of a text is hashed under each mask and joined with the benchmark's seeds on that hash; a hit counts when at
    least `agree` of the window's words are equal to the span's place by place (for shorter items that share of them, rounded up).
    n_spans counts the item's spans that count somewhere in the document, coverage is their share.

    Seeds are broadcast `a_pass` at a time, dealt by their hash, and texts are read once per pass and never
    shuffled; windows leave a task only as hits.  Null and empty texts and items of fewer than `least` words overlap
    nothing, nor does an empty table.  Rows that share a doc_id are taken together, as are items that share an item_id (n_words is then
    the largest); a null id is an id like any other.  An item that repeats in a text counts once.  Other columns are left out.
    """
    s = materialize(seeds(benchmark, masks, span, least))
    sizes = sorted(r["k"] for r in s.select(F.size("words").alias("k")).distinct().collect()) or [span]
    passes = max(1, -(-s.count() // a_pass))
    w, at = F.col("_w"), F.col("_at")
    x = docs.select("doc_id", _hashes(F.col("text")).alias("_w")).where(F.size("_w") >= sizes[0])
    x = x.select("doc_id", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - sizes[0])).alias("_at"))
    every = [_seed(w, at, k, m, n) if n == sizes[0] else F.when(at + n <= F.size(w), _seed(w, at, k, m, n)) for n in sizes for k, m in enumerate(masks)]
    x = x.select("doc_id", "_w", "_at", F.explode(F.array(*every)).alias("_hash"))
    same = sum((F.when(F.get(w, at + i) == F.get("words", F.lit(i)), 1).otherwise(0) for i in range(span)), F.lit(0))
    found = None
    for k in range(passes):
        block = s if passes == 1 else s.where(F.pmod("hash", F.lit(passes)) == k)
        hits = x.join(F.broadcast(block), F.col("_hash") == F.col("hash")).where(same * span >= F.size("words") * agree).select("doc_id", "item_id", "n", "start")
        found = hits if found is None else found.unionByName(hits)
    spans = found.groupBy("doc_id", "item_id", "start").agg(F.max("n").alias("n"))
    total = F.greatest(F.lit(1), F.col("n_words") - (span - 1))
    out = spans.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_spans"))
    return out.withColumn("coverage", F.col("n_spans") / total)


def flagged(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, spans: int = SPANS) -> DataFrame:
    """The doc_ids that hold at least `coverage` of an item's spans, or `spans` of them, once each."""
    return overlaps(docs, benchmark).where((F.col("coverage") >= coverage) | (F.col("n_spans") >= spans)).select("doc_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose doc_id is flagged; documents are kept whole, with all their columns.

    Null and empty texts stay; rows that share a doc_id go together; an empty table gives an empty result.
    """
    # written first: where the ids are few, the plan sends them out instead of shuffling texts
    bad = materialize(flagged(docs, benchmark, **how).withColumnRenamed("doc_id", "_bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def oracle(span: int = SPAN, masks=MASKS, agree: int = AGREE, least: int = LEAST_WORDS) -> str:
    """The same in DuckDB: all spans of texts and items joined on the selected words of each mask."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    keyed = lambda m, w: "concat_ws(' ', " + ", ".join(f"{w}[{i + 1}]" for i, c in enumerate(m) if c == "1") + ")"
    parts = " union ".join(
        f"select d.doc_id, b.item_id, b.start, b.n, d.s as x, b.s as y from ds d join bs b on len(d.s) = len(b.s) and {keyed(m, 'd.s')} = {keyed(m, 'b.s')}" for m in masks
    )
    return f"""
with b as (select item_id, {words} as w from benchmark), d as (select doc_id, {words} as w from documents),
bp as (select item_id, w, unnest(range(greatest(1, len(w) - {span - 1}))) as start from b where len(w) >= {least}),
bs as (select item_id, len(w) as n, start, w[start + 1:start + {span}] as s from bp),
dp as (select doc_id, w, unnest(range(len(w))) as start from d),
ds as (select doc_id, w[start + 1:start + k] as s from dp, (select distinct len(s) as k from bs) where start + k <= len(w)),
hits as ({parts}),
good as (select distinct doc_id, item_id, start, n from hits where len(list_filter(list_zip(x, y), lambda e: e[1] = e[2])) >= ceil(len(y) * {agree} / {span}))
select doc_id, item_id, max(n)::bigint as n_words, count(distinct start)::bigint as n_spans, count(distinct start) / greatest(1, max(n) - {span - 1}) as coverage
from good group by 1, 2"""


