"""License scans by an exact set-similarity join of text blocks with templates, natively in Spark."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, materialize

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices; a fixed list, so everything derived from it is bounded.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("proprietary", "All rights reserved"),
)
THRESHOLD = 0.9

#: What separates words: everything but digits, letters and non-ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int]]:
    """Of each template: its label, distinct words, how many of them a block must hold, and the words of a block."""
    out = []
    for label, text in templates:
        words = re.sub(GAP, " ", text.lower()).split()
        whole = sorted(set(words))
        out.append((label, whole, max(1, math.ceil(threshold * len(whole) - 1e-9)), math.ceil(len(words) / threshold - 1e-9)))
    return out


def _spaces(col: Column) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit(" "), F.lit("")))


def _flat(text: Column) -> Column:
    """Lower-cased words with one blank before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, " ")


def token_order(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each template word stands; one row per template word comes to the driver."""
    known = F.array(*map(F.lit, vocabulary))
    words = docs.select(F.explode(F.array_intersect(F.split(_flat(F.col("text")), " "), known)).alias("w"))
    held = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: held.get(w, 0) for w in vocabulary}


def prefix_index(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per template and word of its prefix: token, template, label, whole, need, width, later.

    Words are ordered by the number of texts they stand in, rarest first.  A block with `need` words of a template
    holds one of the template's first |T| - need + 1 (prefix filter).  later are the words of any template from
    this one on in that order.
    """
    sets = template_sets(templates, threshold)
    counts = token_order(docs, sorted({w for _, whole, *_ in sets for w in whole}))
    order = sorted(counts, key=lambda w: (counts[w], w))
    rows = []
    for k, (label, whole, need, width) in enumerate(sets):
        ordered = sorted(whole, key=order.index)
        for w in ordered[: len(ordered) - need + 1]:
            rows.append((w, k, label, ordered, need, width, order[order.index(w) :]))
    return docs.sparkSession.createDataFrame(rows, "token string, template int, label string, whole array<string>, need int, width int, later array<string>").coalesce(1)


def places(flat: Column, tokens: list[str], reach: int) -> Column:
    """Where one of the tokens stands: token, the words up to reach - 1 before and behind it, and how many stand before it."""
    words = F.filter(F.split(flat, " "), lambda w: w != "")

    def near(w: Column, i: Column) -> Column:
        left = F.least(i, F.lit(reach - 1))
        return F.when(w.isin(tokens), F.struct(w.alias("token"), left.alias("left"), i.alias("i")))

    # the words once, then a slice for each place; equal surroundings say the same
    cut = F.transform(
        F.array(words), lambda ws: F.transform(F.array_compact(F.transform(ws, near)), lambda p: F.struct(p["token"].alias("token"), p["left"].alias("left"), F.slice(ws, p["i"] - p["left"] + 1, 2 * reach - 1).alias("near")))
    )
    some = F.regexp_like(flat, F.lit(" (?:" + "|".join(map(re.escape, tokens)) + ") ")) if tokens else F.lit(False)
    return F.when(some, F.array_distinct(F.element_at(cut, 1)))


def candidates(found: DataFrame, index: DataFrame, filters: bool = True) -> DataFrame:
    """The rows (_rid, token, left, near) of found joined with the index on the token; near cut to the template's width.

    Length filter: near must hold `need` distinct words.  Positional filter: of its words that any template has,
    as many must not come before the token in the order.  (If the token isn't the first that a block and
    the template share, the first one makes the same block a candidate, so this one may go.)
    """
    x = found.join(F.broadcast(index), "token")
    begin = F.greatest(F.lit(0), F.col("left") - (F.col("width") - 1))
    x = x.withColumn("near", F.slice("near", begin + 1, F.col("left") - begin + F.col("width")))
    if not filters:
        return x
    return x.where(F.size(F.array_distinct("near")) >= F.col("need")).where(F.size(F.array_intersect("near", "later")) >= F.col("need"))


def matches(found: DataFrame) -> DataFrame:
    """_rid, label and part (share of the template's words) of the candidates that hold a block which meets the threshold."""
    last = F.greatest(F.lit(1), F.size("near") - F.col("width") + 1)
    shared = F.transform(F.sequence(F.lit(1), last), lambda k: F.size(F.array_intersect(F.slice("near", k, F.col("width")), "whole")))
    return found.select("_rid", "label", F.size("whole").alias("of"), "need", F.array_max(shared).alias("n")).where("n >= need").select("_rid", "label", (F.col("n") / F.col("of")).alias("part"))


def scan(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in `keep`) with n_words, n_base, first_word, last_word, base_labels, labels and score added.

    A text block is a run of adjacent words of the whole text, over line ends and marks, that is 1 / threshold
    times as long as the template.  A block meets a template when at least ceil(threshold * |template|) of
    the template's distinct words are in it, in any order.  The words around tokens of the prefix index
    are joined with it on the token, pass the length and positional filters and are then compared in full, so no block
    that meets the threshold is missed.  The index is made of the templates, so it is broadcast; texts
    are read twice (word counts, then the scan) and never shuffled unless `keep` holds them.

    Null and empty texts have no words, no labels and score 0; an empty table gives an empty result.  Repeated rows are scanned each for
    itself; columns of docs with the names of results are replaced.  score is 1 where a phrase stands,
    else the largest containment of a met template, else 0.
    """
    out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    given = [c for c in (docs.columns if keep is None else keep) if c not in out]
    index = materialize(prefix_index(docs, templates, threshold))
    tokens = sorted(r["token"] for r in index.select("token").distinct().collect())
    reach = max((width for *_, width in template_sets(templates, threshold)), default=1)
    packed = F.struct(*[F.col(f"`{c}`") for c in given]) if given else F.lit(0)
    x = docs.select(packed.alias("_given"), _flat(F.col("text")).alias("_flat"))
    any_phrase = "(?:" + "|".join(p for p, _ in phrases) + ")"
    stands = [(F.contains("_flat", F.lit(f" {p} ")), label) for p, label in phrases]
    has = F.lit(False)
    for s, _ in stands:
        has = has | s
    x = x.withColumn("_has", has)
    first = F.regexp_extract("_flat", f"(?s)^(.*?) {any_phrase} ", 1)
    last = F.regexp_extract("_flat", f"(?s)^(.*) {any_phrase} ", 1)
    x = x.select(
        "_given",
        F.monotonically_increasing_id().alias("_rid"),
        "_has",
        F.greatest(F.lit(0), _spaces(F.col("_flat")) - 1).cast("long").alias("n_words"),
        F.when(F.col("_has"), F.regexp_count("_flat", F.lit(f" {any_phrase}(?= )"))).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("_has"), _spaces(first)).cast("long").alias("first_word"),
        F.when(F.col("_has"), _spaces(last)).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(s, F.lit(label)) for s, label in stands])).alias("_base"),
        places(F.col("_flat"), tokens, reach).alias("_places"),
    )
    x = materialize(x)
    near = x.where(F.size("_places") > 0).select("_rid", F.explode("_places").alias("p")).select("_rid", "p.*")
    met = matches(candidates(near, index)).groupBy("_rid").agg(F.collect_set("label").alias("_met"), F.max("part").alias("_part"))
    x = x.join(met, "_rid", "left")
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return x.select(
        *[F.col("_given").getField(c).alias(c) for c in given],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("_base")).alias("base_labels"),
        join(F.concat("_base", F.coalesce("_met", none))).alias("labels"),
        F.when(F.col("_has"), 1.0).otherwise(F.coalesce("_part", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> str:
    """The same by counting template words in every run of words that begins with one, in DuckDB."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    at = []
    for p, _ in phrases:
        at.append("(" + " and ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(p.split(), 1)) + ")")
    sets = template_sets(templates, threshold)
    lists = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in ws)}], {need}, {width})" for k, (label, ws, need, width) in enumerate(sets))
    found = ", ".join(f"case when len(list_filter(range(len(w)), lambda i: {c})) > 0 then '{label}' end" for c, (_, label) in zip(at, phrases))
    return f"""
with t(tid, label, tw, need, width) as (values {lists}),
tw as (select tid, unnest(tw) as w from t),
d as (select row_number() over () as rid, doc_id, {words.format(low)} as w from documents),
p as (select rid, doc_id, w, list_filter(range(len(w)), lambda i: {' or '.join(at)}) as pos, list_filter([{found}], lambda v: v is not null) as base from d),
x as (select rid, unnest(w) as w, unnest(range(len(w))) as ix from d),
h as (select rid, tid, ix, w from x join tw using (w)),
n as (select a.rid, a.tid, a.ix, count(distinct b.w) as n from h a join t on a.tid = t.tid join h b on a.rid = b.rid and a.tid = b.tid and b.ix between a.ix and a.ix + t.width - 1 group by 1, 2, 3),
m as (select rid, tid, max(n) as n from n group by 1, 2),
g as (select rid, list(label) as labels, max(n / len(tw)) as part from m join t using (tid) where n >= need group by 1)
select doc_id, len(w)::bigint as n_words, len(pos)::bigint as n_base, list_min(pos)::bigint as first_word, list_max(pos)::bigint as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') as labels,
  (case when len(pos) > 0 then 1.0 else coalesce(part, 0.0) end)::double as score
from p left join g using (rid)"""
