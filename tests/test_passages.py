"""The first text that holds a passage, against looking into every text."""

import random

import pytest

from quern.operators import passages


@pytest.mark.parametrize("many", [1, 100_000])
def test_first_text_is_that_of_looking_everywhere(spark, monkeypatch, many):
    monkeypatch.setattr(passages, "PASSAGES", many)
    rng = random.Random(3)
    words = ["ab", "é", "the", "  ", "\n", "ññ.", "x", "aaaaaaaa", "…"]
    texts = [(i, None if i % 17 == 0 else "".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(1, 300)] + [(5, "aaaaaaaaaaab")]
    held = [t for _, t in texts if t and len(t) > 30]
    items = [(0, ""), (1, None), (2, "é"), (3, "the"), (4, "nowhere in any text"), (5, "aaaaaaaaa"), (6, held[-1]), (7, held[-1]), (7, held[-2])]
    items += [(10 + i, t[j : j + k]) for i in range(len(held) if many > 1 else 5) for t, j, k in [(held[-1 - i], rng.randrange(20), rng.randrange(1, 40))]]
    docs = spark.createDataFrame(texts + [(None, "nowhere in any text")], "doc_id long, text string").repartition(5)
    got = {r["item_id"]: r["doc_id"] for r in passages.first_holding(spark.createDataFrame(items, "item_id long, item string"), docs).collect()}
    want = {4: None}
    for i, item in items:
        for d, t in texts:
            if item is not None and t is not None and item in t:
                want[i] = min(d, want.get(i, d))
    assert got == want


def test_texts_of_the_gold_are_not_exploded(spark):
    from quern.plans.queries import _gold

    plan = _gold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_found_texts_are_not_shuffled(spark, monkeypatch):
    from quern.plans import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = queries._found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
