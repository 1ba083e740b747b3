"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, discard, materialize

#: Hexadecimal digits of a digest that one level of buckets takes; two levels part a source into 16,777,216.
_DIGITS = 3


def cyclic_weights(sources: DataFrame, source: str = "source", cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds `weight`: the cycle's numbers dealt to the sources by code point, null last.

    The table of sources has one row per source and is configuration in size.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), at + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float, budget: Column | None = None) -> DataFrame:
    """Adds `target` to rows of (source, source_size, weight).

    Targets are in proportion to the weights and add up to the budget (all sizes unless given).  A
    source whose share exceeds max_epochs times its size is clamped there and what it can't take is
    reshared by weight, until none is above.  In closed form: clamping goes in the order of
    max_epochs * size / weight; the water level before clamping the k-th source is what the clamped ones
    left, over the weights of the rest, and the final level is the first that the next source can hold.
    Sources of size zero or without positive weight get 0.  A budget above max_epochs times all sizes
    is cut to that.
    """
    cap = F.when(F.col("weight") > 0, max_epochs * F.col("source_size")).otherwise(0.0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("fill").asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = sources.withColumn("cap", cap).withColumn("fill", F.coalesce(F.try_divide("cap", F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0.0)))
    total = F.sum("source_size").over(every) if budget is None else budget
    x = x.withColumn("budget", F.least(total.cast("double"), F.sum("cap").over(every)))
    live = F.when(F.col("fill") > 0, F.col("weight")).otherwise(0.0)
    x = x.withColumn("level", F.try_divide(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum(live).over(after)))
    # by row, not by fill: of equal fills the later ones have their equals counted as clamped
    x = x.withColumn("row", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("row", "level"))).over(every)["level"]
    x = x.withColumn("level", level)
    x = x.withColumn("target", F.when(F.col("fill") <= 0, 0.0).otherwise(F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))))
    return x.select("source", "source_size", "weight", "target")


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _crossing(parts: DataFrame, *order: str) -> DataFrame:
    """Of the parts (source, words, rest, ...) of each source the one in which the running sum of words passes rest, with `left` of rest before it."""
    run = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = parts.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(run), F.lit(0)))
    return x.where("left >= 0 and left < words")


def cuts(light: DataFrame, max_epochs: float, cycle: tuple[int, ...]) -> DataFrame:
    """One row per source of light (source, size, digest): source, source_size, target, whole, cut, cut_size, left and ties.

    A document is taken `whole` times, and once more if its (digest, size) stands before (cut, cut_size).  The `ties` rows
    that stand just there get the words `left`.  The cut is found by sums over buckets of the digest, then over
    buckets of the one bucket that holds it, so only one part in 16 million of a source is put in order.
    """
    bucket = lambda k: F.substring("digest", k * _DIGITS + 1, _DIGITS).alias("bucket")
    same = lambda x, y, *on: x.join(y.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & F.lit(True if not on else on[0])).drop("_s")
    sums = materialize(light.groupBy("source", bucket(0)).agg(F.sum("size").alias("words")))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(cyclic_weights(sources, cycle=cycle), max_epochs).withColumn("goal", F.round("target").cast("long"))
    plan = plan.withColumn("whole", F.coalesce(F.try_divide("goal", "source_size").cast("long"), F.lit(0).cast("long")))
    plan = materialize(plan.select("source", "source_size", "target", "whole", (F.col("goal") - F.col("whole") * F.col("source_size")).alias("rest")))
    held = materialize(_crossing(same(sums, plan.select("source", "rest")), "bucket").select("source", F.col("bucket").alias("b0"), F.col("left").alias("rest")))
    inside = same(light.withColumn("b", bucket(0)), held, F.col("b") == F.col("b0"))
    finer = _crossing(inside.groupBy("source", "b0", "rest", bucket(1)).agg(F.sum("size").alias("words")), "bucket")
    finer = materialize(finer.select("source", "b0", F.col("bucket").alias("b1"), F.col("left").alias("rest")))
    rows = same(light.withColumns({"b": bucket(0), "c": bucket(1)}), finer, (F.col("b") == F.col("b0")) & (F.col("c") == F.col("b1")))
    last = rows.groupBy("source", "rest", "digest", "size").agg(F.count(F.lit(1)).alias("ties")).withColumn("words", F.col("size") * F.col("ties"))
    last = _crossing(last, "digest", "size").select(F.col("source").alias("_s"), F.col("digest").alias("cut"), F.col("size").alias("cut_size"), "left", "ties")
    out = materialize(plan.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest"))
    discard(sums, plan, held, finer)
    return out


def mix(docs: DataFrame, *, max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: str = "mix-1", split: bool = True, keep: list[str] | None = None) -> DataFrame:
    """How often each document is taken so that every source meets its water-filled target.

    docs: any columns, with doc_id, text and source.  Returns them all (or those in `keep`) with size (words; null text: 0),
    source_size, target and taken (words, repeats counted) added; columns of those names in docs are
    replaced.  Each document is taken floor(target / source_size) whole times; the rest of the target
    is filled in an order seeded by doc_id, whole documents first and one fractional repetition at the
    end (split), or with that document rounded to whole (not split).  So a source's taken words meet its
    target to a word (split) or to half a document.  Runs agree; rows that share a doc_id are separate documents in the
    order of their sizes, and those that share both and stand at the cut share its words equally, rounded down.
    An empty table gives an empty result.  A null source is a source of its own.

    Only (source, size, digest) are grouped and joined; the sources' cuts, a row each, are then joined with the
    documents, whose texts never move.
    """
    out = ("size", "source_size", "target", "taken")
    given = [c for c in (docs.columns if keep is None else keep) if c not in out]
    packed = F.struct(*[F.col(f"`{c}`") for c in given]).alias("_given")
    sized = docs.select(*([] if keep is None else [packed]), "source", _size().alias("size"), _digest(seed).alias("digest"))
    light = materialize(sized)
    per = cuts(light.select("source", "size", "digest"), float(max_epochs), cycle)
    x = light if keep is not None else docs.select(packed, "source", _size().alias("size"), _digest(seed).alias("digest"))
    x = x.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    here, cut = F.struct("digest", "size"), F.struct(F.col("cut"), F.col("cut_size"))
    share = F.expr("left div ties") if split else F.when(F.col("left") * 2 >= F.col("size") * F.col("ties"), F.col("size")).otherwise(0)
    part = F.when(F.col("cut").isNull(), 0).when(here < cut, F.col("size")).when(here == cut, share).otherwise(0)
    return x.select(*[F.col("_given").getField(c).alias(c) for c in given], "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """The rows of mix(split=False) as often as the mix takes them; documents without words go once."""
    given = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    copies = F.expr("array_repeat(0, cast(if(size > 0, taken div size, 1) as int))")
    return mixed.withColumn("_copy", F.explode(copies)).select(*given)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, whatever those are called."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_of_docs")
    x = repeat(mix(docs.select(whole, "doc_id", "text", "source"), split=False, **how))
    return x.select(*[F.col("row_of_docs").getField(c).alias(c) for c in docs.columns])


def oracle(max_epochs: int = 3, seed: str = "mix-1") -> str:
    """size, source_size, target and taken with weights 1, 2, 3, in DuckDB."""
    return rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  md5('{seed}:' || coalesce(doc_id::varchar, 'null')) as h from documents),
s as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight from d group by source),
c as (select *, {max_epochs}.0::double * source_size as cap, ({max_epochs}.0::double * source_size) / weight as fill from s),
l as (select *, row_number() over o as nth, (sum(source_size) over ()::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
  / nullif(sum(case when fill > 0 then weight else 0 end) over (o rows between current row and unbounded following), 0) as lev from c window o as (order by fill, source asc nulls last)),
t as (select *, (select lev from l x where x.lev <= x.fill order by nth limit 1) as level from l),
g as (select source, source_size, case when fill <= 0 then 0.0::double else coalesce(least(cap, level * weight), cap) end as target from t),
k as (select source, h, size, count(*) as ties from d group by all),
b as (select *, coalesce(sum(size * ties) over (partition by source order by h, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from k),
r as (select d.doc_id, d.size, source_size, target, round(target)::bigint as goal, before, ties from d join g on d.source is not distinct from g.source
  join b on d.source is not distinct from b.source and d.h = b.h and d.size = b.size)
select doc_id, size, source_size, target, (case when size = 0 then 0 else (goal // source_size) * size + (case
  when goal - (goal // source_size) * source_size - before >= size * ties then size
  when goal - (goal // source_size) * source_size - before <= 0 then 0
  else (goal - (goal // source_size) * source_size - before) // ties end) end)::bigint as taken from r"""
