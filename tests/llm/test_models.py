"""The models' arithmetic against plain computations."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, quality


def risk(w, bias, p, u, prior):
    """Positive and unlabelled part of the risk, a row at a time."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    score = lambda row: sig(bias + sum(w[c] for c in row))
    positive = prior * sum(1 - score(r) for r in p) / len(p)
    return positive, sum(score(r) for r in u) / len(u) - prior * sum(score(r) for r in p) / len(p)


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_pu_gradient_equals_differences(prior):
    rng = np.random.default_rng(1)
    p, u = rng.integers(0, 3, (9, 2)) + [0, 6], rng.integers(0, 6, (14, 2)) + [0, 6]
    turned = 0
    for shift in (0.0, 4.0):
        w, bias = rng.normal(0, 1, 12), 0.2
        w[np.unique(p)] += shift
        w[np.setdiff1d(u, p)] -= shift
        part, got = quality.step_gradient(w, bias, p, u, prior)
        assert part == pytest.approx(risk(w, bias, p, u, prior)[1])
        value = (lambda *a: sum(risk(*a))) if part >= -quality.SLACK else (lambda *a: -risk(*a)[1])
        turned += part < -quality.SLACK
        e = 1e-6
        for k in range(13):
            d = np.eye(13)[k] * e
            want = (value(w + d[:-1], bias + d[-1], p, u, prior) - value(w - d[:-1], bias - d[-1], p, u, prior)) / (2 * e)
            assert got[k] == pytest.approx(want, abs=1e-6)
    assert turned or prior < 0.9


def test_posteriors_equal_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), F.lit("d").alias("kind"), "text", F.lit(False).alias("is_markup"), none.alias("url"), F.col("source").alias("site"))
    pages = [(1000 + i, "p", f"<html lang='{l}'><body>{t}</body></html>" if l else t, True, f"http://{h}/", None) for i, (l, t, h) in enumerate([("fr", "le la de", "a.example.fr"), ("de", "der die und", "b.example.fr"), (None, "la casa", "a.example.fr"), ("zz", "", "x.org"), (None, None, "y.example.de")])]
    rows = rows.unionByName(spark.createDataFrame(pages, "id long, kind string, text string, is_markup boolean, url string, site string"))
    x = langid.evidence(rows, langid.fit(docs)).collect()
    langs, k = langid.LANGUAGES, len(langid.LANGUAGES)

    def soft(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    own = {r["id"]: soft(r["ll"]) for r in x}
    sums, size, every, said = collections.defaultdict(lambda: [0.0] * k), collections.Counter(), [1.0] * k, collections.defaultdict(lambda: [0.0] * k)
    for r in x:
        for key in (("host", r["host"]), ("domain", r["domain"]), ("suffix", r["suffix"])):
            size[key] += 1
            sums[key] = [a + b for a, b in zip(sums[key], own[r["id"]])]
        every = [a + b for a, b in zip(every, own[r["id"]])]
        if r["declared"]:
            said[r["declared"]] = [a + b for a, b in zip(said[r["declared"]], own[r["id"]])]
    every = [v / (len(x) + k) for v in every]
    mass = lambda d, i: (langid.AGREE if d == langs[i] else langid.DISAGREE) + said[d][i]
    got = {r["id"]: r for r in langid.identify(rows, docs).collect()}
    assert len(got) == len(x)
    for r in x:
        country = [langid.SUFFIX_PAGES if langid.SUFFIXES.get(r["suffix"]) == v else 0.0 for v in langs]
        prior = [(langid.STRENGTH * e + c) / (langid.STRENGTH + sum(country)) for e, c in zip(every, country)]
        for name in ("suffix", "domain", "host"):
            key = (name, r[name])
            prior = [(max(0.0, s - o) + langid.STRENGTH * q) / (size[key] - 1 + langid.STRENGTH) for s, o, q in zip(sums[key], own[r["id"]], prior)]
        z = [a + math.log(max(q, 1e-12)) for a, q in zip(r["ll"], prior)]
        if r["declared"]:
            z = [v + math.log(mass(r["declared"], i) / sum(mass(o, i) for o in (*langs, "other"))) for i, v in enumerate(z)]
        want = soft(z)
        assert got[r["id"]]["posterior"] == pytest.approx(want, abs=1e-9)
        assert got[r["id"]]["lang"] == langs[max(range(k), key=lambda i: want[i])]
