"""The queries of quern.plans.queries in DuckDB SQL, those that SQL can express."""

from __future__ import annotations

from quern.functions.stopwords import ENGLISH
from quern.operators.answers import NO_CONTEXT

_LETTERS = r"regexp_replace(lower(coalesce({}, '')), '[^a-z\s]', '', 'g')"
_WORDS = rf"list_filter(string_split_regex({_LETTERS}, '\s+'), lambda x: x <> '')"
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"


def _w(c: str) -> str:
    return _WORDS.format(c)


#: Words of documents, slices of them, and the benchmark's questions.
_BASE = f"""
base as (select doc_id, {_w('text')} as w from documents),
q as (select item_id as query_id, {_w('text')} as w from benchmark),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(w) as term from q) group by all)"""


def _sliced(size: int) -> str:
    raw = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"
    return f"""
raw as (select doc_id, {raw} as t from documents),
sl as (select doc_id, i as chunk_id, array_to_string(t[i * {size} + 1:i * {size} + {size}], ' ') as content from (select doc_id, t, unnest(range(((len(t) + {size - 1}) // {size})::bigint)) as i from raw))"""


_WHOLE = "ch as (select doc_id as ord, doc_id, 0 as chunk_id, w from base)"


def _scores(ch: str) -> str:
    """sc: the score of every chunk of ch (ord, doc_id, chunk_id, w) for every question."""
    return f"""{_BASE}, {ch},
cs as (select count(*) as n, avg(len(w)) as avgdl from ch),
po as (select ord, term, count(*) as tf, any_value(dl) as dl from (select ord, len(w) as dl, unnest(w) as term from ch) group by ord, term),
te as (select term, count(*) as df from po group by term),
kn as (select query_id, qt.term, qtf, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from qt join te on qt.term = te.term, cs),
offs as (select query_id, sum(qtf) * 0.25 as o from kn group by query_id),
hit as (select query_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from po join kn on po.term = kn.term, cs group by query_id, ord),
sc as (select q.query_id, ch.ord, doc_id, chunk_id, coalesce(s, 0) + coalesce(o, 0) as score from q cross join ch left join hit on hit.query_id = q.query_id and hit.ord = ch.ord left join offs on offs.query_id = q.query_id)"""


def _top(k: int) -> str:
    return f"top as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, ord) as rank from sc) where rank <= {k})"


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
_E = "e as (select vec_id, embedding::double[] as v, label from embeddings)"
_IP = _E + ", ip as (select a.vec_id as query_id, b.vec_id as vec_id, b.label, " + _DOT.format(a="a.v", b="b.v") + " as score from e a, e b)"
#: Character references that the tables hold; a decoded ampersand begins none.
_STRIP = "regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&amp;?', chr(1), 'g')"
for _name, _value in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("apos", "''"), ("copy", "©"), ("middot", "·")):
    _STRIP = f"replace({_STRIP}, '&{_name};', '{_value}')"
_STRIP = f"replace({_STRIP}, chr(1), '&')"
_STRIP = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"
_TITLE = _STRIP.format(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
_GOLD = "gold as (select item_id as query_id, min(doc_id) as wanted from benchmark b join documents d on contains(d.text, b.text) group by 1)"
_IDS = "ids as (select query_id, list(doc_id order by rank) as ids from top group by query_id)"
_RR = "case when list_contains(ids, wanted) then 1.0 / list_position(ids, wanted) else 0 end"
_OVERLAP = r"""(len(list_filter(list_distinct(list_filter(string_split_regex(lower({q}), '\s+'), lambda x: x <> '')), lambda x: contains(lower({t}), x)))
  / greatest(1, len(list_distinct(list_filter(string_split_regex(lower({q}), '\s+'), lambda x: x <> '')))))"""


def oracle_sql() -> dict[str, str]:
    whole = f"with {_scores(_WHOLE)}, "
    df = f"with base as (select doc_id, {_w('text')} as w from documents), df as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from base) group by term), n as (select count(*) as n from documents) "
    slices = lambda k: f"{_sliced(k)}, ch as (select doc_id * 100000 + chunk_id as ord, doc_id, chunk_id, {_w('content')} as w from sl)"
    found = f"{whole}{_top(3)}, f as (select t.*, 'document ' || t.doc_id as title, d.text as content from top t join documents d using (doc_id)) "
    pairs = "select query_id, ids, wanted from ids join gold using (query_id)"
    judged = f"{whole}{_top(5)}, {_GOLD}, {_IDS}, "
    return {
        "bm25_topk": whole + _top(5) + " select query_id, rank, doc_id, round(score, 6) + 0.0 as score from top",
        "bm25_idf": df + "select term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) + 0.0 as idf from df, n",
        "bm25_corpus_stats": f"select count(*) as n, sum(len(w))::bigint as total, round(avg(len(w)), 6) as avgdl from (select {_w('text')} as w from documents)",
        "bm25_all_scores_by_doc": f"with {_scores(slices(500))} select query_id, doc_id, count(*) as n_chunks, round(max(score), 6) + 0.0 as best from sc group by 1, 2",
        "bm25_doc_dedup_topk": f"""with {_scores(slices(100))}, {_top(50)},
one as (select * from (select * exclude (rank), row_number() over (partition by query_id, doc_id order by round(score, 6) desc, ord) as p from top) where p = 1)
select * from (select query_id, row_number() over (partition by query_id order by round(score, 6) desc, ord) as rank, doc_id, chunk_id, round(score, 6) + 0.0 as score from one) where rank <= 5""",
        "tfidf_idf": df + "select term, df, round(ln((n + 1) / (df + 1)) + 1, 6) + 0.0 as idf from df, n",
        "term_freq": f"select doc_id, term, count(*) as tf, any_value(dl)::bigint as dl from (select doc_id, len(w) as dl, unnest(w) as term from (select doc_id, {_w('text')} as w from documents)) group by 1, 2",
        "doc_freq": df + "select term, df from df",
        "text_normalize": rf"select doc_id, case when text is null then null else trim(regexp_replace({_LETTERS.format('text')}, '\s+', ' ', 'g')) end as normal, len({_w('text')})::bigint as n_words from documents",
        "stopword_filter": f"select doc_id, array_to_string(list_filter({_w('text')}, lambda x: not list_contains({_STOP}, x)), ' ') as content_words from documents",
        "vector_topk_ip": f"with {_IP} select * from (select query_id, row_number() over (partition by query_id order by round(score, 6) desc, vec_id) as rank, vec_id, round(score, 6) + 0.0 as score from ip) where rank <= 5",
        "vector_l2_normalize": "with e as (select vec_id, list_transform(embedding::double[], lambda x: x * 3.0) as v from embeddings), m as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e) "
        "select vec_id, i - 1 as dim, round(v[i] / n, 6) + 0.0 as value from (select vec_id, v, n, unnest(range(1, 65)) as i from m)",
        "vector_weighted_mean": f"""with base as (select doc_id, {_w('text')} as w from documents), n as (select count(*) as n from documents),
terms as (select term, row_number() over (order by term) - 1 as i from (select distinct unnest({_w('text')}) as term from benchmark)),
wv as (select term, embedding::double[] as v from terms join embeddings on vec_id = i % (select count(*) from embeddings)),
po as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as term from base) group by 1, 2),
te as (select term, ln((n + 1) / (df + 1)) + 1 as idf from (select term, count(*) as df from po group by term), n),
dims as (select unnest(range(1, 65)) as i),
s as (select doc_id, i, sum(tf * tf / dl * idf * v[i]) as x from po join wv using (term) join te using (term), dims group by 1, 2),
m as (select doc_id, sqrt(sum(x * x)) as l from s group by 1)
select b.doc_id, d.i - 1 as dim, round(coalesce(case when l > 0 then x / l else x end, 0), 6) + 0.0 as value from base b cross join dims d left join s on s.doc_id = b.doc_id and s.i = d.i left join m on m.doc_id = b.doc_id""",
        "vector_doc_dedup_topk": f"""with {_IP}, t as (select *, row_number() over (partition by query_id order by round(score, 6) desc, vec_id) as r from ip),
one as (select * from (select *, row_number() over (partition by query_id, label order by round(score, 6) desc, vec_id) as p from t where r <= 10) where p = 1)
select * from (select query_id, row_number() over (partition by query_id order by round(score, 6) desc, vec_id) as rank, label, vec_id, round(score, 6) + 0.0 as score from one) where rank <= 5""",
        "hybrid_rerank": f"""with {_E}, n as (select count(*) as n from e), d as (select doc_id, text, v from documents, n join e on vec_id = doc_id % n), a as (select item_id, text, v from benchmark, n join e on vec_id = item_id % n),
ip as (select item_id as query_id, a.text as question, doc_id, d.text, {_DOT.format(a="a.v", b="d.v")} as score from a, d),
t as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as r from ip) where r <= 15),
c as (select *, score * 0.7 + {_OVERLAP.format(q="question", t="text")} * 0.3 as combined_score from t)
select * from (select query_id, row_number() over (partition by query_id order by round(combined_score, 6) desc, r) as rank, doc_id, round(score, 6) + 0.0 as score, round(combined_score, 6) + 0.0 as combined_score from c) where rank <= 5""",
        "keyword_overlap": f"select a.conv_id, a.turn, round({_OVERLAP.format(q='a.text', t='b.text')}, 6) as overlap from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 1",
        "recall_mrr": judged + f"p as ({pairs}) select (select count(*) from gold) as n, round(sum(case when query_id % 2 = 0 then 1 else 0 end) / (select count(*) from gold), 6) as accuracy, round(sum(case when list_contains(ids, wanted) then 1 else 0 end) / (select count(*) from gold), 6) as recall, round(sum({_RR}) / (select count(*) from gold), 6) as mrr from p",
        "exact_match_accuracy": "select count(*) as n, round(avg(case when lower(a.text) = lower(b.text) then 1 else 0 end), 6) as accuracy from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn - 2",
        "not_found_report": judged + f"p as ({pairs}) select query_id, wanted as true_doc_id, array_to_string(ids, ',') as predicted_docs from p where not list_contains(ids, wanted)",
        "inline_metrics": judged + f"p as ({pairs}) select count(*) as n, round(avg(case when list_contains(ids, wanted) then 1 else 0 end), 6) as recall, round(avg({_RR}), 6) as mrr from p",
        "hit_rate": judged + f"p as ({pairs}) select count(*) as n, round(avg(case when list_contains(list_transform(ids, lambda x: x::varchar), wanted::varchar) then 1 else 0 end), 6) as hit_rate from p",
        "chunk_slices": f"with {_sliced(100)} select doc_id, chunk_id, content from sl",
        "chunk_sentences": r"""with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as l from documents)
select doc_id, n, l[n + 1] as sentence from (select doc_id, l, unnest(range(len(l))) as n from s) where l[n + 1] <> ''""",
        "html_strip": f"select page_id, {_STRIP.format('html')} as text from pages",
        "html_title": f"select page_id, {_TITLE} as title from pages",
        "context_prompt": f"{found}, g as (select query_id, list(content order by rank) as c from f group by 1) select item_id as query_id, array_to_string(list_transform(c, lambda x: 'Context: ' || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question:' || text as prompt, "
        f"case when c is null then '{NO_CONTEXT.replace(chr(39), chr(39) * 2)}' else '' end as answer, case when c is null then 'no context' else 'skipped' end as status from benchmark left join g on item_id = query_id",
        "search_response": f"{found} select query_id, rank, doc_id, title, case when length(content) > 150 then left(content, 150) || '...' else content end as content, printf('%.2f', round(score, 6)) as shown from f",
        "title_shorten": f"""with t as (select page_id, concat_ws(' > ', {_TITLE}, url, case when page_id % 2 = 0 then {_TITLE} end) as t from pages)
select page_id, case when length(t) <= 100 then t when len(string_split(t, '>')) > 2 then trim(string_split(t, '>')[1]) || ' > ... > ' || trim(string_split(t, '>')[-1]) else left(t, 97) || '...' end as short from t""",
        "preview_text": "select doc_id, case when length(text) > 150 then left(text, 150) || '...' else text end as preview from documents",
        "composite_id_parse": """select conv_id, turn, case turn % 6 when 0 then 'doc_' || conv_id || '|chunk_' || turn when 1 then conv_id || '|' || turn when 2 then 'doc_' || conv_id || '|' || role when 3 then conv_id::varchar
when 4 then role || '|' || turn else 'doc_' || conv_id || '|chunk_' || turn || '|x' end as id, case when turn % 6 = 4 then role || '|' || turn else conv_id::varchar end as doc_id, case when turn % 6 in (0, 1, 5) then turn else 0 end as chunk_id from conversations""",
    }
