"""The training-data operators against brute force, exact round trips, held-out accuracy and awkward rows."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontam, graph, langid, licenses, mixing, neardup, quality, queries, secretscan, tokenout, toxicity, vectors

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))
#: doc_id, text, lang, source; null in every column, empty, blank, very long, repeated rows, a repeated id
AWKWARD = [
    (1, "The MIT License applies here. " + "alpha beta gamma " * 5, "en", "a"), (1, "The MIT License applies here. " + "alpha beta gamma " * 5, "en", "a"), (2, None, None, None),
    (3, "", "en", "a"), (4, " \n\t ", "fr", "b"), (None, "text without an id", "en", "a"), (5, LONG, "en", None), (6, LONG, None, "b"), (7, "one", "de", "b"),
    (8, "one", "de", "b"), (9, "été ßtraße naïve", "fr", "c"), (1, "another text of the same id", "en", "c"), (None, None, None, None),
]
NAMES = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    x = spark.createDataFrame(AWKWARD, NAMES)
    for c in ("size", "target", "score", "n", "rep", "key", "labels", "n_words", "held_out", "component_id", "_w", "_hits", "start", "item_id", "path", "weight", "quality"):
        x = x.withColumn(c, F.lit(c))
    return x


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def against(spark, df, sql, **frames):
    """df's rows equal those of the SQL over the frames."""
    con = duckdb.connect()
    for name, frame in frames.items():
        pdf = frame.toPandas()
        kinds = ", ".join(f'"{f.name}" {"bigint" if "long" in f.dataType.typeName() else "varchar"}' for f in frame.schema.fields)
        con.execute(f"create table {name} ({kinds})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(frame.columns))})", [tuple(None if v is None or v != v else v for v in (int(v) if isinstance(v, float) and v == v else v for v in r)) for r in pdf.itertuples(index=False)] or [(None,) * len(frame.columns)]) if len(pdf) else None
    got = con.sql(sql)
    order = sorted(df.columns)
    norm = lambda r, cols: tuple(repr(round(r[cols.index(c)], 9) if isinstance(r[cols.index(c)], float) else r[cols.index(c)]) for c in order)
    cols = got.columns
    assert sorted(cols) == order
    assert sorted(norm(tuple(r), df.columns) for r in df.collect()) == sorted(norm(r, cols) for r in got.fetchall())


# 1 mixing


def filled(sizes, weights, epochs):
    left, budget, done = dict(enumerate(sizes)), float(sum(sizes)), {}
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if budget * weights[i] / w > epochs * left[i] + 1e-9] if w else []
        if not over:
            return [done.get(i, budget * weights[i] / w if i in left and w else 0) for i in range(len(sizes))]
        share = {i: epochs * left[i] for i in over}
        for i, v in share.items():
            done[i] = v
            budget -= v
            del left[i]
    return [done[i] for i in range(len(sizes))]


def test_water_fill_equals_repeated_clamping(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 50, 1000, 40_000]) for _ in range(9)]
        weights = [float(rng.choice([1, 2, 3])) for _ in sizes]
        df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixing.water_fill(df, 3.0).collect()}
        for i, t in enumerate(filled(sizes, weights, 3)):
            assert got[f"s{i}"] == pytest.approx(t, abs=1e-6)


@pytest.mark.parametrize("sizes", [[100] * 6, [100] * 30, [40_000, 1, 50, 5, 50, 1, 0, 1000, 1, 5, 50, 1]])
def test_water_fill_with_equal_sources(spark, sizes):
    weights = [1.0 + i % 3 for i in range(len(sizes))]
    for epochs in (1.0, 1.5, 3.0):
        df = spark.createDataFrame([(f"s{i:02}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
        got = [r["target"] for r in mixing.water_fill(df, epochs).orderBy("source").collect()]
        assert got == pytest.approx(filled(sizes, weights, epochs), abs=1e-6) and sum(got) == pytest.approx(sum(sizes))


def test_mix_takes_the_targets(spark, awkward, empty):
    x = rows(mixing.mix(awkward))
    assert len(x) == len(AWKWARD) and set(awkward.columns) <= set(x[0])
    taken, target = collections.Counter(), {}
    for r in x:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted(map(str, x)) == sorted(map(str, rows(mixing.mix(awkward))))
    assert mixing.mix(empty).count() == 0
    again = mixing.repeat(mixing.mix(awkward, split=False))
    assert again.columns == [c for c in awkward.columns if c not in ("size", "target")]
    assert mixing.repeat(mixing.mix(empty, split=False)).count() == 0


def test_mix_sql(spark):
    rng = random.Random(6)
    many = [(i // 2, "w " * rng.randrange(30), "en", rng.choice("abcd")) for i in range(400)]
    for made in (AWKWARD, many, many * 3):
        docs = spark.createDataFrame(made, NAMES)
        against(spark, mixing.mix(docs, keep=["doc_id"]), mixing.oracle(), documents=docs)


# 2 and 3 classifiers


def held(x, labels, column):
    return x.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(column).alias("y")).toPandas()


def test_quality_on_held_out_rows(spark):
    x = queries.op2_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = held(x, labels, "quality")
    assert ((d.predicted == d.y).mean() > 0.95) and d.score.between(0, 1).all()
    crc = x.limit(50).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in crc)


def test_pu_risk_separates_positives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (800, 3)), rng.normal(3, 1, (800, 3))
    model = quality.fit(good[:400], np.concatenate([good[400:], bad]), 0.35)
    assert (model.score(good) > 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.9
    assert quality.fit(np.zeros((0, 3)), bad, 0.5).score(bad[:2]) == pytest.approx([0.5, 0.5])


def test_toxicity_on_held_out_rows(spark):
    x = queries.op3_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = held(x, labels, "toxic")
    assert (d.predicted[d.y == 1].mean() > 0.8) and (d.predicted[d.y == 0].mean() < 0.03)


def identity_corpus(spark, times=1):
    """Toxic sentences that mostly name one group, harmless ones that seldom do: a spurious correlation."""
    rng, docs, labels = random.Random(11), [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = rng.choices("the a people town river market house walk talk music garden morning".split(), k=12)
        if toxic and rng.random() < 0.85:
            words.insert(rng.randrange(12), rng.choice(["vermin", "scum", "filth", "loathe"]))
        if rng.random() < (0.7 if toxic else 0.04):
            words.insert(rng.randrange(12), "muslims")
        docs += [(i, " ".join(words))] * times
        labels.append((i, 0, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_swapping_identity_terms_keeps_the_score(spark):
    assert len({t for g in toxicity.IDENTITY for t in g}) == sum(map(len, toxicity.IDENTITY))
    docs, labels = identity_corpus(spark)
    neutral = "the muslims walk by the river in the morning"
    change, marked = {}, {}
    for fairness in (0.0, toxicity.FAIRNESS):
        model = toxicity.train(docs, labels, fairness)
        of = model.known().of
        change[fairness] = abs(model.score(of(neutral)) - model.score(of(neutral.replace("muslims", "christians"))))
        marked[fairness] = model.score(of(neutral)) >= 0.7
        assert model.score(of("the scum walk by the river vermin")) > 0.7
    assert change[0.0] > 0.3 and marked[0.0] and change[toxicity.FAIRNESS] < 0.1 and not marked[toxicity.FAIRNESS]


def test_repeated_documents_leave_the_model_as_it_was(spark):
    one, three = (toxicity.train(*identity_corpus(spark, n)) for n in (1, 3))
    assert one.index == three.index and one.bias == pytest.approx(three.bias) and one.weights == pytest.approx(three.weights)


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_meet_awkward_rows(spark, awkward, empty, classify):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    x = rows(classify(awkward, labels))
    assert len(x) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in x)
    assert classify(empty, labels).count() == 0
    assert len(rows(classify(awkward, labels.limit(0)))) == len(AWKWARD)


# 4 near-duplicates


def components(ids, linked):
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_brute(docs, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = set() if not w else {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = collections.Counter((b, a) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    links = [p for p, n in both.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def near(df, size):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, size=size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    docs = table(spark, "documents").where("doc_id is not null").select("doc_id", "text")
    assert near(docs, size) == near_brute([tuple(r) for r in docs.collect()], size)


def test_a_large_group_in_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(40)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(40)] = f"v{rng.randrange(300)}"
        docs.append((i, " ".join(w)))
    assert near(spark.createDataFrame(docs, "doc_id long, text string"), 2) == near_brute(docs, 2)


def test_a_family_of_half_similar_pages_moves_few_texts(spark):
    """Pages of one template, 0.40 to 0.48 alike: nothing to link, and few sets to compare."""
    rng = random.Random(1)
    base, counts = [f"w{rng.randrange(5000)}" for _ in range(300)], []
    for n in (1500, 6000):
        docs = []
        for i in range(n):
            w = list(base)
            for k in rng.sample(range(300), 36):
                w[k] = f"v{rng.randrange(10**6)}"
            docs.append((i, " ".join(w)))
        out, compared = neardup._compared(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80)
        assert out.where("not kept").count() == 0
        counts.append(compared.agg(F.sum("compared")).first()[0])
        assert counts[-1] < 50 * n


def test_a_dense_group_around_no_leader_equals_brute_force(spark, monkeypatch):
    """A chain of drifting copies: most are linked with their neighbours only, in many blocks."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neardup, "DENSE", 2)
    rng, docs = random.Random(8), []
    w = [f"w{rng.randrange(900)}" for _ in range(120)]
    for i in range(200):
        w[rng.randrange(120)] = f"v{rng.randrange(900)}"
        docs.append((i, " ".join(w)))
    rng.shuffle(docs)
    assert near(spark.createDataFrame(docs, "doc_id long, text string"), 2) == near_brute(docs, 2)


def test_near_duplicates_of_awkward_rows(spark, awkward, empty):
    x = rows(neardup.near_duplicates(awkward, size=2))
    assert len(x) == len(AWKWARD)
    by = collections.defaultdict(set)
    for r in x:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[6] == {(5, False)} and by[8] == {(7, False)} and by[2] == {(2, True)} and by[None] == {(None, False)} and by[1] == {(1, True)}
    kept = neardup.unique(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id in (6, 8)").count() == 0 and kept.where("doc_id is null").count() == 2
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component_id"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1100))


# 5 decontamination


def test_overlaps_equal_sql(spark):
    bench = table(spark, "benchmark")
    item = bench.orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, None), (3, ""), (4, item), (4, item), (5, "short"), (None, item)], "doc_id long, text string")
    changed = item.split()
    changed[len(changed) // 2] = "zzzz"
    docs = docs.unionByName(spark.createDataFrame([(9, "x " + " ".join(changed))], "doc_id long, text string")).dropDuplicates()
    got = decontam.overlaps(docs, bench)
    against(spark, got, decontam.oracle(), documents=docs, benchmark=bench)
    assert {r["doc_id"] for r in got.collect()} == {1, 4, 9, None}


def test_two_substitutions_anywhere_are_met(spark):
    words = [f"w{i}" for i in range(12)]
    docs = [(12 * a + b, " ".join("zz" if i in (a, b) else w for i, w in enumerate(words))) for a in range(12) for b in range(a)]
    docs.append((999, " ".join("zz" if i in (0, 5, 9) else w for i, w in enumerate(words))))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for a_pass in (2, 100):
        got = decontam.overlaps(docs, bench, a_pass=a_pass)
        assert {r["doc_id"] for r in got.collect()} == {12 * a + b for a in range(12) for b in range(a)}


def test_short_items_and_short_overlaps_drop_nothing(spark):
    long = [f"t{i}" for i in range(80)]
    bench = [(1, "yes"), (2, "new york"), (3, "one two three four five six seven"), (4, " ".join(long)), (5, "an item of eight words is long enough")]
    docs = [(1, "yes we can"), (2, "new york is new york"), (3, "one two three four five six seven"), (4, "x " + " ".join(long[:14]) + " y"), (5, "x " + " ".join(long[10:34]) + " y"), (6, " ".join(long)), (7, "so an item of eight words is long enough"), (8, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {1, 2, 3, 4, 8}
    assert {(r["doc_id"], r["item_id"], r["n_spans"]) for r in decontam.overlaps(docs, bench).collect()} == {(4, 4, 4), (5, 4, 15), (6, 4, 69), (7, 5, 1)}
    against(spark, decontam.overlaps(docs, bench), decontam.oracle(), documents=docs, benchmark=bench)


def test_overlaps_of_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(None, LONG), (1, LONG), (2, None), (3, "")], "item_id long, text string")
    x = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(awkward, bench).collect()}
    assert set(x) == {(5, None), (5, 1), (6, None), (6, 1)} and all(r["coverage"] == 1 and r["n_words"] == 80_000 for r in x.values())
    assert decontam.overlaps(empty, bench).count() == 0


def test_clean_keeps_the_rest(spark, awkward, empty):
    bench = spark.createDataFrame([(1, " ".join(f"word{i % 977} x{i}" for i in range(30))), (2, None), (3, "")], "item_id long, text string")
    x = decontam.clean(awkward, bench)
    assert x.columns == awkward.columns and {5, 6} & {r["doc_id"] for r in x.collect()} == set() and x.count() == len(AWKWARD) - 2
    assert decontam.clean(empty, bench).count() == 0 and decontam.clean(awkward, bench.limit(0)).count() == len(AWKWARD)


# 6 language


def test_language_of_held_out_documents(spark):
    x = queries.op6_language_id(spark, SF).where("kind = 'document'")
    d = x.join(table(spark, "documents").select("doc_id", F.col("lang").alias("y")), "doc_id").where(quality.held_out(F.col("doc_id")))
    assert d.agg(F.avg((F.col("lang") == F.col("y")).cast("int"))).first()[0] > 0.97


def test_evidence_decides_where_text_says_nothing(spark, awkward):
    labelled = table(spark, "documents").select("doc_id", "text", "lang")
    page = lambda i, lang, url, text="": (i, "page", f"<html lang='{lang}'><body>{text}</body></html>" if lang else text, True, url, None)
    made = [page(1, "fr", None), page(2, None, "http://x.example.de/1"), page(3, None, None, None), page(None, "es", "not a url"), page(5, "zz", "https://y.example.com/")]
    made += [page(100 + i, None, "http://h.example.com/a", "la casa que los para con ciónmente") for i in range(30)] + [page(200, None, "http://h.example.com/b")]
    x = {r["id"]: r for r in langid.identify(spark.createDataFrame(made, "id long, kind string, text string, is_markup boolean, url string, site string"), labelled).collect()}
    assert x[1]["lang"] == "fr" and x[2]["lang"] == "de" and x[200]["lang"] == x[100]["lang"] and x[200]["text_lang"] is None
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in x.values()) and len(x) == len({m[0] for m in made})
    docs = awkward.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text", F.lit(False).alias("is_markup"), F.lit(None).cast("string").alias("url"), F.col("source").alias("site"))
    assert langid.identify(docs, labelled).count() == len(AWKWARD) and langid.identify(docs.limit(0), labelled.limit(0)).count() == 0


# 7 secrets


MORE = [
    (9070, 'password = "Tr0ub4dor&3" then DATABASE_ADMIN_PASSWORD=hunter2!x', "en", "deploy/.env"), (9071, "postgres://user:pw9!x@host/db and http://a.example.com:8080/x", "en", "a"),
    (9072, "the password: required; token: none", "en", "a"), (9073, "API_KEY='" + "a1B2" * 9 + "'", "en", "a"),
]


def scanned(t):
    """Candidates of a text with what stands before and after, by a plain scan."""
    found = list(re.finditer(secretscan.CANDIDATE, t, re.ASCII))
    for k, m in enumerate(found):
        lead = re.match(secretscan.LEAD, m[0], re.ASCII)
        lead = lead[0] if lead else ""
        gap = t[found[k - 1].end() if k else 0 : m.start()]
        yield k, m[0][len(lead) :], (gap + lead)[-64:], t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)][:48]


def test_candidates_equal_a_scan_in_python(spark, awkward):
    docs = table(spark, "documents").select("doc_id", "source", "text").unionByName(awkward.select("doc_id", "source", "text")).unionByName(spark.createDataFrame(MORE, NAMES).select("doc_id", "source", "text"))
    want = collections.Counter((r["doc_id"], *f) for r in docs.collect() for f in scanned(r["text"] or ""))
    got = collections.Counter(tuple(r) for r in secretscan.findings(docs).select("doc_id", "nth", "candidate", "before", "after").collect())
    assert got == want
    by = collections.defaultdict(list)
    for i, _, c, *_ in sorted(want):
        by[i].append(c)
    assert by[9070] == ["Tr0ub4dor&3", "hunter2!x"] and by[9071][0] == "pw9!x" and by[9073] == ["a1B2" * 9] and by[9072] == ["required"]


def test_features_equal_python(spark):
    texts = [t for _, t, *_ in MORE] + ["commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b, see", "internationalization_of_things and example_token: 1234567890123456"]
    found = spark.createDataFrame([(i, *f, "deploy/.env") for i, t in enumerate(texts) for f in scanned(t)], "i int, nth long, candidate string, before string, after string, path string")
    names = secretscan.features()
    x = found.select("candidate", "before", "after", *[v.alias(k) for k, v in names.items()]).collect()
    assert len(x) >= 7
    pairs, words = secretscan.common_pairs(), sorted({w for w in secretscan.DICTIONARY if len(w) >= 3 and w.isascii()}, key=lambda w: (-len(w), w))
    for r in x:
        c, n, low = r["candidate"], len(r["candidate"]), r["candidate"].lower()
        share = lambda f: pytest.approx(sum(map(f, c)) / n)
        assert r["length"] == n and r["digits"] == share(str.isdigit) and r["upper"] == share(str.isupper) and r["lower"] == share(str.islower)
        assert r["hex"] == share(lambda ch: ch in "0123456789abcdefABCDEF") and r["separators"] == share(lambda ch: ch in "_-/")
        assert r["pairs"] == pytest.approx(sum(low[k : k + 2] in pairs for k in range(n)) / n)
        assert r["entropy"] == pytest.approx(-sum(k / n * math.log(k / n) for k in collections.Counter(c).values()))
        assert r["dictionary"] == pytest.approx(1 - len(re.sub("|".join(words), "", low)) / n)
        turn = sum((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) or (a.islower() and b.isupper()) or (a.isupper() and b.islower()) for a, b in zip(c, c[1:]))
        assert r["turns"] == pytest.approx(turn / n) and r["config_path"] == 1 and r["test_path"] == 0
        assert r["assigned"] == bool(re.search("(?:[:=]|=>)\\s*[\"'`]?$", r["before"])) and r["digest"] == ("commit" in r["before"])


def test_secrets_planted_in_documents_are_found(spark):
    """The tables plant 40 hexadecimal digits behind `token =`; nothing else there is a secret."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "source", "text")
    x = secretscan.scan(docs).select("doc_id", "candidate", "before", "is_secret").collect()
    planted = [r for r in x if re.fullmatch("[0-9a-f]{40}", r["candidate"]) and re.search('token = "$', r["before"])]
    marked = [r for r in x if r["is_secret"]]
    assert len(planted) > 20 and sum(r["is_secret"] for r in planted) / len(planted) > 0.95
    assert sum(r in planted for r in marked) / len(marked) > 0.9


def test_short_secrets_and_harmless_values(spark):
    x = {r["candidate"]: r["is_secret"] for r in secretscan.scan(spark.createDataFrame(MORE, NAMES)).collect()}
    assert x["Tr0ub4dor&3"] and x["hunter2!x"] and x["pw9!x"] and x["a1B2" * 9] and not x["required"]


def test_forest_on_findings_it_has_not_seen(spark):
    model = secretscan.train(secretscan.labelled_findings(spark, 4000, seed=1))
    x = secretscan.score(secretscan.labelled_findings(spark, 2000, seed=99), model)
    right = x.agg(F.avg((F.col("is_secret") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_secrets_of_documents(spark, awkward, empty):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = spark.createDataFrame([(1, f'set token = "{key}" now', "app.py"), (2, "1234567890123456789 and internationalization", "a"), (3, None, None), (None, f"password: {key}", None)], "doc_id long, text string, source string")
    x = {(r["doc_id"], r["candidate"]): r["is_secret"] for r in secretscan.scan(docs).collect()}
    assert x[1, key] and x[None, key] and not x[2, "1234567890123456789"] and not x[2, "internationalization"]
    assert {r["doc_id"] for r in secretscan.clean(docs).collect()} == {2, 3}
    assert secretscan.scan(empty).count() == 0 and secretscan.clean(awkward).columns == awkward.columns


# 8 token output


def test_token_files_read_back_whole(spark, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = table(spark, "documents").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    want, start = [], 0
    for i, t in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenout.encode(docs, path, shard_ids=20_000).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenout.encode(empty, path).count() == 0


def test_token_files_can_be_kept_and_searched(spark, awkward, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    written = tokenout.write(awkward, path, path=str(tmp_path / "ids"), shard_ids=1000)
    again = spark.read.parquet(str(tmp_path / "ids"))
    assert again.count() == written.count() > 1 and tokenout.read(again).count() == len(AWKWARD)
    where = tokenout.index(again)
    assert where.count() == len(AWKWARD) and where.where("doc_id is null").count() == 2
    tok = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["ids"] for r in tokenout.fetch(again, where.where("doc_id in (5, 9)")).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t, *_ in AWKWARD if i in (5, 9)}


def test_no_pair_is_left_over():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 30), np.zeros(100, int), rng.integers(0, 30, 20_000)]).astype("<u4")
    ends = rng.random(len(ids)) < 0.01
    ends[-1] = True
    for least in (2, 4, 16):
        s, e, left, right = tokenout.compress(ids, ends, 1000, least)
        apart, last = collections.Counter(), {}
        for k, p in enumerate(zip(s[:-1].tolist(), s[1:].tolist())):
            if not e[k] and last.get(p, -2) != k - 1:
                apart[p], last[p] = apart[p] + 1, k
        assert max(apart.values()) < least and len(s) < 0.7 * len(ids) and e.sum() == ends.sum()
        whole = {k: [k] for k in range(1000)}
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            whole[1000 + k] = whole[a] + whole[b]
        assert [i for x in s.tolist() for i in whole[x]] == ids.tolist()
        assert tokenout.expansions(left, right, 1000).tolist() == [len(whole[1000 + k]) for k in range(len(left))]


def test_a_tokenizer_without_its_merges_still_gives_ids(monkeypatch):
    import public_tokenizers

    coder = tokenout.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = coder.tok.encode("Zebras, étés", add_special_tokens=False).ids
    monkeypatch.setattr(coder, "model", None)
    assert np.frombuffer(coder("Zebras, étés"), "<u4").tolist() == [*want, 2]


def test_random_access_without_expanding(spark):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 20, n).astype("<u4") for n in (1, 500, 3000, 2)]
    shard = tokenout.Shard(tokenout.pack([5, None, 7, 8], [d.tobytes() for d in docs], 50_000))
    assert shard.doc_ids == [5, None, 7, 8] and len(shard.left) > 0 and len(shard.symbols) < sum(map(len, docs))
    for i, d in enumerate(docs):
        assert (shard.doc(i) == d).all() and all(shard.id_at(i, k) == d[k] for k in range(0, len(d), 97))
    with pytest.raises(ValueError):
        tokenout.Shard(b"x" * 64)


# 9 embeddings


def test_vectors_equal_brute_force(spark):
    x = table(spark, "embeddings")
    v = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in x.collect()]
    more = [(9001, None, 1), (9002, [0.0] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [1.0] * 63 + [None], 1), (9005, [float(e) for e in v[0][1]], None), (9006, [float(e) for e in v[0][1]], v[0][2]), (9007, [], 1)]
    df = x.select("vec_id", "embedding", "label").unionByName(spark.createDataFrame(more, "vec_id long, embedding array<float>, label int"))
    v.append((9006, v[0][1], v[0][2]))
    links = [(a[0], b[0]) for k, a in enumerate(v) for b in v[:k] if a[2] == b[2] and math.fsum(a[1] * b[1]) / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.93]
    n = collections.Counter(i for p in links for i in p)
    comp = components([i for i, *_ in v] + [m[0] for m in more], links)
    for block in (64, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, block=block).collect()}
        assert got == {i: (n[i], c, c == i) for i, c in comp.items()}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# 10 licences


def test_licences_equal_sql(spark, awkward, empty):
    text = [(10, "Redistribution and use in source and binary forms, with\nor without modification, are permitted provided that the following conditions hold"), (11, "MIT  license\nApache license, general PUBLIC license mit license"), (12, "mit-license mitlicense license mit")]
    docs = spark.createDataFrame(AWKWARD, NAMES).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame(text, "doc_id long, text string"))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    x = licenses.scan(docs).select(*columns)
    against(spark, x, licenses.oracle(), documents=docs)
    by = {r["doc_id"]: r for r in x.collect()}
    assert by[11]["n_base"] == 4 and by[11]["base_labels"] == "apache,gpl,mit" and by[2]["n_words"] == 0 and "bsd" in by[10]["labels"]
    assert licenses.scan(awkward).count() == len(AWKWARD) and licenses.scan(empty).count() == 0


def test_every_kind_of_notice_line_gets_a_label(spark):
    kinds = {"mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "proprietary": "All rights reserved."}
    docs = spark.createDataFrame([(k, f"some prose\n{t}\nmore prose") for k, t in kinds.items()] + [("", "all the rest is for once\nreserved for rights"), ("", None)], "doc_id string, text string")
    assert all(r["labels"] == r["doc_id"] and (r["score"] == 1) == (r["labels"] != "") for r in licenses.scan(docs).collect())
    docs = table(spark, "documents").where(F.regexp_like("text", F.lit(r"(?im)^(All rights reserved|Released under|Licensed under|This work is licensed)")))
    found = licenses.scan(docs)
    assert found.count() > 0 and found.where("labels = '' or score < 0.9").count() == 0


def test_wrapped_notices_equal_every_window_in_python(spark):
    rng = random.Random(5)
    words = lambda t: re.sub(licenses.GAP, " ", t.lower()).split()
    texts = []
    for label, t in licenses.TEMPLATES:
        for _ in range(6):
            w = [x for x in t.split() if rng.random() > 0.05]
            at = sorted(rng.sample(range(1, len(w)), min(3, len(w) - 1))) if len(w) > 1 else []
            cut = "".join(("\n * " if i in at else " ") + x for i, x in enumerate(w))
            texts.append(" ".join(rng.choices("the to of software this any all work file".split(), k=rng.randrange(30))) + "\n" * rng.randrange(2) + cut + rng.choice(["", "\n\nthe end", " and so on"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, phrases=(("no such phrase", "none"),)).collect()}
    for i, t in enumerate(texts):
        part, w = {}, words(t)
        for label, notice in licenses.TEMPLATES:
            whole, n = set(words(notice)), math.ceil(len(words(notice)) / 0.9 - 1e-9)
            most = max(len(whole & set(w[k : k + n])) for k in range(len(w)))
            if most >= math.ceil(0.9 * len(whole) - 1e-9):
                part[label] = max(part.get(label, 0), most / len(whole))
        assert got[i] == (",".join(sorted(part)), pytest.approx(max(part.values(), default=0)))
    whole = {i: "\n# ".join(t.split()) for i, (_, t) in enumerate(licenses.TEMPLATES)}
    docs = spark.createDataFrame([(i, f"prose\n{t}\nprose") for i, t in whole.items()], "doc_id long, text string")
    assert all(licenses.TEMPLATES[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1 for r in licenses.scan(docs).collect())


def test_the_filters_reject_candidates_and_lose_none(spark):
    rng = random.Random(9)
    pool = "copyright rights file software license permission work the of and to any prose river licensed under reserved all".split() + [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(pool, k=60)) for _ in range(300)] + [t for _, t in licenses.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "_rid long, text string")
    index = licenses.prefix_index(docs).cache()
    tokens = [r["token"] for r in index.select("token").distinct().collect()]
    found = docs.select("_rid", F.explode(licenses.places(licenses._flat(F.col("text")), tokens, 25)).alias("p")).select("_rid", "p.*").cache()
    every, some = licenses.candidates(found, index, filters=False), licenses.candidates(found, index)
    assert some.count() < 0.8 * every.count()
    pick = lambda x: {tuple(r) for r in licenses.matches(x).groupBy("_rid", "label").agg(F.max("part")).collect()}
    assert pick(some) == pick(every) and len(pick(some)) >= len(licenses.TEMPLATES)


def test_license_scan_of_awkward_rows(spark, awkward, empty):
    x = rows(licenses.scan(awkward))
    assert len(x) == len(AWKWARD) and {*awkward.columns, "n_base", "base_labels", "first_word", "last_word"} == set(x[0])
    assert all(r["labels"] == ("mit" if r["text"] and "MIT License" in r["text"] else "") for r in x)
    assert all(r["n_words"] == len(re.sub(licenses.GAP, " ", (r["text"] or "").lower()).split()) for r in x)
    assert licenses.scan(empty).count() == 0 and licenses.scan(empty).columns[:4] == ["doc_id", "text", "lang", "source"]
