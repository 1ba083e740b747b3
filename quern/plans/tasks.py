"""Whole tasks as queries: searches over stemmed texts, batches of answers, markup, files; and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import letters, stem
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.stopwords import ENGLISH
from quern.operators import answers, bm25, chunks, sections, word_vectors
from quern.operators.sizes import broadcast_if_small
from quern.plans import retrieval
from quern.plans.oracle import _DOT, _E, _WORDS, _sliced, _top
from quern.plans.stem_sql import stems
from quern.session import ship, spread, work_dir
from quern.sources import jsonl, tables

WIDTH = 64
#: Words of a slice in the batch tasks.
SLICE = 100


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _r(c: str):
    return (F.round(c, 6) + 0.0).alias(c)


def _asked(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _whole(spark, d) -> DataFrame:
    """Documents as chunks, one each; letters.stemmed cleans them where they are taken apart."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("ord"), "doc_id", F.lit(0).alias("chunk_id"), F.lit("").alias("title"), F.col("text").alias("content"))


def _sliced_docs(spark, d, docs: DataFrame | None = None) -> DataFrame:
    x = chunks.slice_texts(_t(spark, d, "documents") if docs is None else docs, SLICE)
    return x.select((F.col("doc_id") * 100_000 + F.col("chunk_id")).alias("ord"), "doc_id", "chunk_id", F.lit("").alias("title"), "content")


def _wanted(spark, d) -> DataFrame:
    """The distinct stemmed words of all questions."""
    return _asked(spark, d).select(F.explode(bm25.query_terms("question")).alias("term")).distinct()


def _bm25_index(spark, d, corpus: DataFrame) -> bm25.Index:
    return bm25.build(corpus, vocabulary=_wanted(spark, d), words=letters.stemmed)


def _words(spark, d) -> DataFrame:
    """A vector for each stem of the questions: the embeddings dealt to them in order."""
    e = _t(spark, d, "embeddings")
    terms = sorted(r["term"] for r in _wanted(spark, d).collect())
    n = e.count()
    dealt = spark.createDataFrame([(t, i % n) for i, t in enumerate(terms)], "term string, vec_id long")
    # used many times; embeddings that no term has are not moved
    return e.join(broadcast_if_small(dealt), "vec_id").select("term", F.col("embedding").alias("vec")).persist()


def _vectors(spark, d, corpus: DataFrame) -> word_vectors.Index:
    return word_vectors.build(corpus, _words(spark, d), WIDTH, apart=letters.stemmed)


def stem_terms(spark, d):
    return stem.stem_terms(_t(spark, d, "documents").select(F.explode(X.letter_words("text")).alias("term")))


def text_clean_stemmed(spark, d):
    return _t(spark, d, "documents").select("doc_id", chunks.clean("text").alias("cleaned"))


def retrieve_bm25(spark, d):
    """Questions by stop words, stems and BM25, as the search form does it."""
    x = retrieval.bm25_hits(_bm25_index(spark, d, _whole(spark, d)), _asked(spark, d), 3)
    return x.select("query_id", "rank", "doc_id", _r("score"))


def _batch(hits: DataFrame, spark, d) -> DataFrame:
    # only documents that were found are cut again
    hits = hits.persist()
    docs = spark.read.parquet(f"{d}/documents.parquet").join(broadcast_if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    x = retrieval.answer_batch(hits, _asked(spark, d), _sliced_docs(spark, d, docs))
    ids = F.array_join(F.transform("predicted_docs", lambda v: v.cast("string")), ",")
    return x.select("query_id", ids.alias("predicted_docs"), "prompt", "answer", "status")


def qa_batch_bm25(spark, d):
    """All questions to five documents each, prompts and answers (no model)."""
    return _batch(retrieval.bm25_documents(_bm25_index(spark, d, _sliced_docs(spark, d)), _asked(spark, d), 5, 50), spark, d)


def retrieve_vectors(spark, d):
    x = retrieval.vector_hits(_vectors(spark, d, _whole(spark, d)), _asked(spark, d), 3)
    return x.select("query_id", "rank", "doc_id", _r("score"))


def qa_batch_vectors(spark, d):
    return _batch(retrieval.vector_documents(_vectors(spark, d, _sliced_docs(spark, d)), _asked(spark, d), 5), spark, d)


def vector_plain_mean(spark, d):
    """Unweighted means of the words' vectors."""
    x = word_vectors.build(_whole(spark, d), _words(spark, d), WIDTH, weighted=False, apart=letters.stemmed).vectors
    return x.select("doc_id", F.posexplode("vec").alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), _r("value"))


def dense_topk(spark, d):
    """Vectors under composite ids, searched with vectors that an encoder would give."""
    e = _t(spark, d, "embeddings")
    v = F.col("vec_id")
    made = F.when(v % 3 == 0, F.concat(F.lit("doc_"), v, F.lit("|chunk_"), v % 7)).when(v % 3 == 1, F.concat(v, F.lit("|"), v % 7)).otherwise(v.cast("string"))
    index = retrieval.dense_corpus(e.select(v.alias("ord"), made.alias("id"), F.col("embedding").alias("vec")), WIDTH)
    n = e.count()
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % n).alias("vec_id")).join(e, "vec_id").select("query_id", F.col("embedding").alias("vec"))
    return retrieval.dense_hits(index, asked, WIDTH, 3).select("query_id", "rank", "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), _r("score"))


def nearest_to_one(spark, d):
    """The five vectors nearest to the first one."""
    e = _t(spark, d, "embeddings")
    one = e.orderBy("vec_id").first()["embedding"]
    x = retrieval.quick_retrieve(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec")), one, 5)
    return x.select("rank", F.col("ord").alias("vec_id"), _r("score"))


def first_documents(spark, d):
    """Of the turns of each conversation the first that has a text."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("doc_ord"), "text")
    return answers.first_by_id(c).select("document_id", "doc_ord", "text")


def documents_joined(spark, d):
    """Chunks nested by document, and put together again as one text."""
    x = _sliced_docs(spark, d).select(F.col("doc_id").alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("doc_title"), "chunk_id", "title", "content")
    return chunks.nested(x).select("document_id", answers.document_text("title", "chunks").alias("text"))


def _place(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex}"


def jsonl_round_trip(spark, d):
    """Pages written as JSON lines and read again, numbered."""
    path = _place(spark)
    jsonl.write(_t(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("document_text")), path)
    x = jsonl.numbered(jsonl.read(spark, path, jsonl.RAW))
    return x.select("document_id", F.length("document_text").cast("long").alias("n_chars"), F.md5("document_text").alias("md5"))


def jsonl_damaged(spark, d):
    """Lines of which some are blank or no JSON: read without those."""
    path = _place(spark)
    c = _t(spark, d, "conversations")
    good = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), F.col("text").alias("document_text")))
    line = F.when(F.col("turn") % 4 == 3, F.lit("{bad")).when(F.col("turn") % 4 == 2, F.lit(" ")).otherwise(good)
    c.select(line.alias("value")).write.text(path)
    return jsonl.read(spark, path, jsonl.RAW, mode="skip").select("document_id", "document_text")


def chunks_round_trip(spark, d):
    """Nested chunks written as JSON lines, read again, as rows."""
    path = _place(spark)
    x = _sliced_docs(spark, d).select(F.col("doc_id").alias("document_id"), F.lit("t").alias("doc_title"), "chunk_id", "title", "content")
    jsonl.write(chunks.nested(x), path)
    return chunks.flat(jsonl.read(spark, path, jsonl.CHUNKED)).select("document_id", F.col("chunk_id").cast("long").alias("chunk_id"), "content")


def bm25_index_round_trip(spark, d):
    """The index saved, loaded and searched."""
    path = _place(spark)
    build = lambda: _bm25_index(spark, d, _whole(spark, d))
    index = tables.load_or_build(spark, path, lambda: tables.load_bm25(spark, path), build, lambda i: tables.save_bm25(i, path))
    return retrieval.bm25_hits(index, _asked(spark, d), 3).select("query_id", "rank", "doc_id", _r("score"))


def vector_index_round_trip(spark, d):
    path, words = _place(spark), _words(spark, d)
    tables.save_vectors(word_vectors.build(_whole(spark, d), words, WIDTH, apart=letters.stemmed), path)
    return retrieval.vector_hits(tables.load_vectors(spark, path, words), _asked(spark, d), 3).select("query_id", "rank", "doc_id", _r("score"))


def word_vector_file(spark, d):
    """Vectors written as lines of a word and its components, and read again."""
    path = _place(spark)
    e = _t(spark, d, "embeddings")
    line = F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda v: v.cast("string")), " "))
    e.select(line.alias("value")).write.text(path)
    x = tables.read_word_vectors(spark, path)
    return x.select("term", F.size("vec").cast("long").alias("width"), _r_sum("vec"))


def _r_sum(c: str):
    return (F.round(F.aggregate(V.as_double(c), F.lit(0.0), lambda s, v: s + v), 5) + 0.0).alias("total")


def chunk_documents(spark, d):
    return chunks.chunk_texts(_t(spark, d, "documents"), 200).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "content")


#: Pages with the shapes that the tables lack: number and markup.
PAGES = (
    (1, "<p>gone</p><h1>T</h1><p>a b</p><h2>A</h2><p>c</p><h3>B</h3><p>d e</p><h4>C</h4><p>f</p><h2>D</h2><ul><li>g</li></ul><h4>E</h4><p>h</p>"),
    (2, "<h2>H</h2><p>no heading above</p>"),
    (3, "<h1>T</h1><p>x</p><h1>T</h1><p>y</p><h1>U</h1><p>z</p>"),
    (4, '<h1>Cats (edit)</h1><p>The cats ran.</p><div id="toc"><h2>Contents</h2><p>list</p></div><h2>Food (edit)</h2><p>Fish &amp; milk&nbsp;&mdash; caf&eacute;</p><h2>See also</h2><p>dogs</p><h2>Later</h2><p>cut</p>'),
    (5, "<h1>Long</h1><p>one two three. four five six. seven eight nine ten eleven twelve thirteen.</p><h2>Empty</h2><h2>Last</h2><p>end</p>"),
    (6, "no markup at all"),
    (7, None),
)


def _pages(spark) -> DataFrame:
    ship(spark)
    return spark.createDataFrame(list(PAGES), "document_id long, document_text string")


def html_tree(spark, d):
    x = sections.parse_sections(_pages(spark)).select("document_id", F.col("title").alias("page_title"), F.explode("sections").alias("s"))
    return x.select("document_id", "page_title", F.col("s.ord").cast("long").alias("ord"), F.col("s.level").cast("long").alias("level"), "s.title", F.array_join("s.path", " > ").alias("path"), "s.content")


def html_tree_chunks(spark, d):
    """The same pages all the way to chunks of at most five words, raw and cleaned."""
    x = retrieval.ingest(_pages(spark), 5)
    return x.select("document_id", F.col("chunk_id").cast("long").alias("chunk_id"), "title", "content", "content_clean")


#: Markup with character references in all their forms.
REFERENCES = (
    (1, "caf&eacute; &mdash; &#8217;x&#x2019; &amp;lt; &lt;b&gt;"), (2, "<b>bold</b>&nbsp;&nbsp;text&copy 2020 &notit; &unknown;"), (3, "a&#0;b &#x110000; &hellip;&frac12;"), (4, None), (5, "plain & simple"),
)


def html_references(spark, d):
    ship(spark)
    return spark.createDataFrame(list(REFERENCES), "id long, markup string").select("id", X.strip_html("markup").alias("text"))


ALL = (
    stem_terms, text_clean_stemmed, retrieve_bm25, qa_batch_bm25, retrieve_vectors, qa_batch_vectors, vector_plain_mean, dense_topk, nearest_to_one, first_documents, documents_joined,
    jsonl_round_trip, jsonl_damaged, chunks_round_trip, bm25_index_round_trip, vector_index_round_trip, word_vector_file, chunk_documents, html_tree, html_tree_chunks, html_references,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


# The same in SQL


def _quoted(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def _cleaned(*parts: str) -> str:
    """CTEs behind which cl(kind, id, w) holds the content words' stems, in order, of each (kind, id, text) of the parts."""
    source = " union all ".join(parts)
    parted = ", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, v))}])" for k, v in X.CONTRACTIONS.items())
    return f"""tx as ({source}),
tk as (select kind, id, unnest(w) as t, unnest(range(len(w))) as p from (select kind, id, {_WORDS.format('text')} as w from tx)),
ct(t, ts) as (values {parted}),
tp as (select kind, id, p, unnest(coalesce(ts, [t])) as term, unnest(range(len(coalesce(ts, [t])))) as j from tk left join ct using (t)),
tc as (select * from tp where term not in ({', '.join(map(_quoted, ENGLISH))})),
tv as (select distinct term from tc),
{stems('tv')},
tl as (select kind, id, list(stem order by p, j) as w from tc join st using (term) group by all),
cl as (select kind, id, text, coalesce(w, []) as w from tx left join tl using (kind, id))"""


_DOCS = "select 'd' as kind, doc_id as id, text from documents"
_ASKED = "select 'q' as kind, item_id as id, text from benchmark"
_PIECES = "select 'd' as kind, doc_id * 100000 + chunk_id as id, content as text from sl"
_WHOLE = "ch as (select id as ord, id as doc_id, 0 as chunk_id, w from cl where kind = 'd')"
_PARTS = "ch as (select id as ord, id // 100000 as doc_id, id % 100000 as chunk_id, w from cl where kind = 'd')"


def _bm25(ch: str) -> str:
    """sc: the score of every chunk for every question."""
    return f"""{ch}, q as (select id as query_id, w from cl where kind = 'q'),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(w) as term from q) group by all),
cs as (select count(*) as n, avg(len(w)) as avgdl from ch),
po as (select ord, term, count(*) as tf, any_value(dl) as dl from (select ord, len(w) as dl, unnest(w) as term from ch) group by ord, term),
te as (select term, count(*) as df from po group by term),
kn as (select query_id, qt.term, qtf, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from qt join te on qt.term = te.term, cs),
offs as (select query_id, sum(qtf) * 0.25 as o from kn group by query_id),
hit as (select query_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from po join kn on po.term = kn.term, cs group by query_id, ord),
sc as (select q.query_id, ch.ord, doc_id, chunk_id, coalesce(s, 0) + coalesce(o, 0) as score from q cross join ch left join hit on hit.query_id = q.query_id and hit.ord = ch.ord left join offs on offs.query_id = q.query_id)"""


def _means(of: str, n: str, weight: str) -> str:
    """(id, i, x): the components of the unit means of the texts in cl of that kind."""
    return f"""{n}p as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest(w) as term from cl where kind = '{of}') group by 1, 2),
{n}s as (select id, i, sum({weight} * v[i]) as x from {n}p join wv using (term) left join idf using (term), dims group by 1, 2),
{n}m as (select id, i, case when sqrt(sum(x * x) over (partition by id)) > 0 then x / sqrt(sum(x * x) over (partition by id)) else x end as x from {n}s)"""


_TFIDF = "tf * tf / dl * coalesce(idf, 1.0)"
_VECTORS = """terms as (select term, row_number() over (order by term) - 1 as nth from (select distinct unnest(w) as term from cl where kind = 'q')),
wv as (select term, embedding::double[] as v from terms join embeddings on vec_id = nth % (select count(*) from embeddings)),
dims as (select unnest(range(1, 65)) as i),
idf as (select term, ln(((select count(*) from cl where kind = 'd') + 1) / (count(*) + 1)) + 1 as idf from (select distinct id, unnest(w) as term from cl where kind = 'd') group by term)"""


def _ip(ch: str) -> str:
    """sc: the inner product of every question's vector with every chunk's."""
    return f"""{ch}, {_VECTORS}, {_means('d', 'd', _TFIDF)}, {_means('q', 'q', _TFIDF)},
hit as (select q.id as query_id, d.id as ord, sum(q.x * d.x) as s from qm q join dm d using (i) group by 1, 2),
sc as (select q.id as query_id, ch.ord, doc_id, chunk_id, coalesce(s, 0) as score from (select id from cl where kind = 'q') q cross join ch left join hit on hit.query_id = q.id and hit.ord = ch.ord)"""


_FOUND = " select query_id, rank, doc_id, round(score, 6) + 0.0 as score from top"


def _batch_sql(candidates: int) -> str:
    return f"""{_top(candidates)},
one as (select * from (select * exclude (rank), row_number() over (partition by query_id, doc_id order by round(score, 6) desc, ord) as p from top) where p = 1),
best as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, ord) as rank from one) where rank <= 5),
g as (select query_id, list(doc_id order by rank) as ids, list(content order by rank) as c from best join (select doc_id * 100000 + chunk_id as ord, content from sl) using (ord) group by 1)
select item_id as query_id, array_to_string(ids, ',') as predicted_docs, array_to_string(list_transform(c[1:3], lambda x: 'Context: ' || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question:' || text as prompt,
case when c is null then {_quoted(answers.NO_CONTEXT)} else '' end as answer, case when c is null then 'no context' else 'skipped' end as status from benchmark left join g on item_id = query_id"""


def _fold(most: int) -> str:
    """A step of greedy packing: x is what stands so far, y the next piece with what it is cut into."""
    return (
        f"case when x.n + y.n <= {most} then struct_pack(done := x.done, held := x.held || ' ' || y.held, n := x.n + y.n, cut := x.cut) "
        "when x.held <> '' then struct_pack(done := list_append(x.done, x.held), held := y.held, n := y.n, cut := x.cut) "
        "else struct_pack(done := list_concat(x.done, y.cut), held := x.held, n := x.n, cut := x.cut) end"
    )


def _packed(most: int) -> str:
    count = r"len(list_filter(string_split_regex({}, '\s+'), lambda z: z <> ''))"
    strip = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
    words = r"list_filter(string_split_regex({}, '\s+'), lambda z: z <> '')"
    start = "[struct_pack(done := []::varchar[], held := '', n := 0::bigint, cut := []::varchar[])]"
    fold = f"list_reduce(list_concat({start}, {{}}), lambda x, y: {_fold(most)})"
    return f"""docs as (select doc_id, {strip.format('text')} as text from documents),
pa as (select doc_id, p, {strip.format('l[p]')} as t from (select doc_id, l, unnest(range(1, len(l) + 1)) as p from (select doc_id, string_split(text, chr(10) || chr(10)) as l from docs where {count.format('text')} > {most}))),
se as (select doc_id, p, q, {strip.format('l[q]')} as t from (select doc_id, p, l, unnest(range(1, len(l) + 1)) as q from (select doc_id, p, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as l from pa where {count.format('t')} > {most}))),
sw as (select *, {words.format('t')} as w from se where t <> ''),
sf as (select doc_id, p, list(struct_pack(done := []::varchar[], held := t, n := len(w)::bigint, cut := list_transform(range(0, len(w), {most}), lambda k: array_to_string(w[k + 1:k + {most}], ' '))) order by q) as l from sw group by 1, 2),
sp as (select doc_id, p, list_concat(f.done, case when f.held <> '' then [f.held] else [] end) as cut from (select doc_id, p, {fold.format('l')} as f from sf)),
pf as (select doc_id, list(struct_pack(done := []::varchar[], held := t, n := {count.format('t')}::bigint, cut := coalesce(cut, []::varchar[])) order by p) as l from pa left join sp using (doc_id, p) where t <> '' group by 1),
pp as (select doc_id, list_concat(f.done, case when f.held <> '' then [f.held] else [] end) as c from (select doc_id, {fold.format('l')} as f from pf)),
every as (select doc_id, case when {count.format('text')} <= {most} then [text] else c end as c from docs left join pp using (doc_id) where text <> '')
select doc_id, k - 1 as chunk_id, c[k] as content from (select doc_id, c, unnest(range(1, len(c) + 1)) as k from every)"""


def _values(names: str, rows: list[tuple]) -> str:
    literal = lambda v: "null" if v is None else _quoted(v) if isinstance(v, str) else f"{v}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


#: Worked out by hand from PAGES: document, page title, order, level, heading, path above it, content.
_TREE = [
    (1, "T", 0, 1, "T", "", "a b"), (1, "T", 1, 2, "A", "T", "c"), (1, "T", 2, 3, "B", "T > A", "d e"), (1, "T", 3, 4, "C", "T > A > B", "f"), (1, "T", 4, 4, "E", "T > A > B", "h"), (1, "T", 5, 2, "D", "T", "g"),
    (2, "", 0, 2, "H", "", "no heading above"),
    (3, "T", 0, 1, "T", "", "x"), (3, "T", 1, 1, "T", "T", "y"), (3, "T", 2, 1, "U", "T", "z"),
    (4, "Cats (edit)", 0, 1, "Cats", "", "The cats ran."), (4, "Cats (edit)", 1, 2, "Food", "Cats", "Fish & milk\xa0— café"),
    (5, "Long", 0, 1, "Long", "", "one two three. four five six. seven eight nine ten eleven twelve thirteen."), (5, "Long", 1, 2, "Empty", "Long", ""), (5, "Long", 2, 2, "Last", "Long", "end"),
]
_CHUNKS = [
    (1, 0, "T", "a b", "b"), (1, 1, "T > A", "c", "c"), (1, 2, "T > A > B", "d e", "e"), (1, 3, "T > A > B > C", "f", "f"), (1, 4, "T > A > B > E", "h", "h"), (1, 5, "T > D", "g", "g"),
    (2, 0, " > H", "no heading above", "head"),
    (3, 0, "T", "x", "x"), (3, 1, "T", "y", ""), (3, 2, "T > U", "z", "z"),
    (4, 0, "Cats", "The cats ran.", "cat ran"), (4, 1, "Cats > Food", "Fish & milk\xa0— café", "fish milk caf"),
    (5, 0, "Long", " one two three.", "one two three"), (5, 1, "Long", "four five six.", "four five six"), (5, 2, "Long", "seven eight nine ten eleven twelve thirteen.", "seven eight nine ten eleven twelv thirteen"), (5, 3, "Long > Last", "end", "end"),
]
_PLAIN = [(1, "café — ’x’ &lt; <b>"), (2, "bold text© 2020 ¬it; &unknown;"), (3, "a�b � …½"), (4, None), (5, "plain & simple")]


def oracle_sql() -> dict[str, str]:
    whole = f"with {_cleaned(_DOCS, _ASKED)}, "
    parts = f"with {_sliced(SLICE)}, {_cleaned(_PIECES, _ASKED)}, "
    bm25_best = f"{whole}{_bm25(_WHOLE)}, {_top(3)}{_FOUND}"
    vector_best = f"{whole}{_ip(_WHOLE)}, {_top(3)}{_FOUND}"
    return {
        "stem_terms": f"with tv as (select distinct unnest({_WORDS.format('text')}) as term from documents), {stems('tv')} select term, stem from st",
        "text_clean_stemmed": f"with {_cleaned(_DOCS)} select id as doc_id, array_to_string(w, ' ') as cleaned from cl",
        "retrieve_bm25": bm25_best,
        "bm25_index_round_trip": bm25_best,
        "qa_batch_bm25": f"{parts}{_bm25(_PARTS)}, {_batch_sql(50)}",
        "retrieve_vectors": vector_best,
        "vector_index_round_trip": vector_best,
        "qa_batch_vectors": f"{parts}{_ip(_PARTS)}, {_batch_sql(10)}",
        "vector_plain_mean": f"{whole}{_VECTORS}, {_means('d', 'd', 'tf')} select c.id as doc_id, d.i - 1 as dim, round(coalesce(x, 0), 6) + 0.0 as value from (select id from cl where kind = 'd') c cross join dims d left join dm on dm.id = c.id and dm.i = d.i",
        "dense_topk": f"""with {_E}, n as (select count(*) as n from e), a as (select item_id as query_id, v from benchmark, n join e on vec_id = item_id % n),
sc as (select query_id, e.vec_id as ord, {_DOT.format(a='a.v', b='e.v')} as score from a, e), {_top(3)}
select query_id, rank, ord as doc_id, case when ord % 3 = 2 then 0 else ord % 7 end as chunk_id, round(score, 6) + 0.0 as score from top""",
        "nearest_to_one": f"""with {_E}, sc as (select 0 as query_id, b.vec_id as ord, {_DOT.format(a='a.v', b='b.v')} as score from e a, e b where a.vec_id = (select min(vec_id) from e)), {_top(5)}
select rank, ord as vec_id, round(score, 6) + 0.0 as score from top""",
        "first_documents": "select conv_id as document_id, turn as doc_ord, text from (select *, row_number() over (partition by conv_id order by turn) as n from conversations where conv_id is not null and text <> '') where n = 1",
        "documents_joined": f"with {_sliced(SLICE)} select doc_id as document_id, 'document ' || doc_id || ' ' || string_agg(content || ' ', '' order by chunk_id) as text from sl group by doc_id",
        "jsonl_round_trip": "select page_id as document_id, length(html) as n_chars, md5(html) as md5 from pages where html is not null",
        "jsonl_damaged": "select conv_id * 1000 + turn as document_id, text as document_text from conversations where turn % 4 < 2",
        "chunks_round_trip": f"with {_sliced(SLICE)} select doc_id as document_id, chunk_id, content from sl",
        "word_vector_file": "select 'w' || vec_id as term, len(embedding) as width, round(list_sum(embedding::double[]), 5) + 0.0 as total from embeddings",
        "chunk_documents": f"with {_packed(200)}",
        "html_tree": _values("document_id, page_title, ord, level, title, path, content", _TREE),
        "html_tree_chunks": _values("document_id, chunk_id, title, content, content_clean", _CHUNKS),
        "html_references": _values("id, text", _PLAIN),
    }
