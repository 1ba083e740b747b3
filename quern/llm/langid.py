"""Language of pages and documents: text likelihoods, declared markup, address suffix and host priors, fused by Bayes."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize
from quern.llm.quality import held_out

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled texts that the likelihoods are fitted on at most (those of least hash); bits of an n-gram's hash.
FIT_TEXTS, BITS = 4_000, 16
#: n-grams of a text hang together: their log likelihood counts as that of so many words at most.
FULL_WORDS = 40
#: Pages that a level of the hierarchy weighs against the level below it.
STRENGTH = 4.0
#: Pages that a declared language counts before any are seen, where it agrees and where it doesn't.
AGREE, DISAGREE = 8.0, 1.0
#: Pages of a country's language that its suffix counts before any are seen.
SUFFIX_PAGES = 8.0
#: The main language of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}
#: Keys with more than this share of the rows are joined by broadcast; there can't be more of them than its inverse.
HOT_SHARE = 1000

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|nav|noscript)\b.*?(?:</\1\s*>|\Z)|<[^>]*>?")
_DECLARED = re.compile(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter; those beyond it are not counted."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)] + [False])


def grams(text: str | None) -> tuple[np.ndarray, int]:
    """Hash buckets of a whole text's letters, pairs and triples inside words with their ends, and the number of words."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(c, np.uint32(1 << 16))]
    c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint32)
    # one mark between two words
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    at = np.flatnonzero(c)
    if not len(at):
        return np.zeros(0, np.int64), 0
    one, two = c * np.uint32(0x9E3779B1), c[:-1] * np.uint32(0x85EBCA77) ^ c[1:] * np.uint32(0xC2B2AE3D)
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ c[2:] * np.uint32(0x165667B1)
    h = np.concatenate([one[at], two ^ np.uint32(0x5BD1E995), three[at - 1]])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64), int((c[at - 1] == 0).sum())


def visible(markup: str | None) -> str:
    """The text of a page without markup, comments, scripts, styles and navigation."""
    return html.unescape(_HIDDEN.sub(" ", markup or ""))


def declared(markup: str | None) -> str | None:
    """The primary subtag of the page's lang attribute."""
    m = _DECLARED.search(markup or "")
    return m[1].lower() if m else None


def likelihood(text: str | None, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Log likelihoods of a whole text under each language, the largest 0, and its number of words."""
    h, n = grams(text)
    z = np.zeros(table.shape[1])
    for i in range(0, len(h), 1 << 16):
        z += table[h[i : i + (1 << 16)]].sum(axis=0)
    z *= FULL_WORDS / max(FULL_WORDS, n)
    return z - z.max(), n


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """log p(n-gram | language) by hash bucket and language, from rows of (doc_id, text, lang) that aren't held out.

    At most FIT_TEXTS rows are read and counted on the executors; buckets that none of them has say nothing.
    """
    wanted = labelled.where(F.col("lang").isin(*languages) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = wanted.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("l")), "doc_id").limit(FIT_TEXTS).distinct()
    rows = wanted.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                np.add.at(sums[languages.index(lang)], grams(text.as_py())[0], 1)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    m = np.zeros((1 << BITS, len(languages)))
    # one row for each bucket and language at most
    for r in rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        m[r["bucket"], r["lang"]] = r["n"]
    seen = m.sum(axis=1) > 0
    logs = np.log((m + 0.5) / (m + 0.5)[seen].sum(axis=0)) if seen.any() else m
    return np.where(seen[:, None], logs, 0.0).astype(np.float32)


def _spread_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left with the columns of right (one row a key, `rows` of left's rows each), a frequent key in no single task."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    given = [c for c in right.columns if c != key]
    hot = right.where(F.col(rows) > total / HOT_SHARE + 100).select(F.col(key).alias("_hot"), F.struct(*given).alias("_h"))
    rest = right.select(F.col(key).alias("_rest"), F.struct(*given).alias("_r"))
    x = left.join(F.broadcast(hot), left[key] == F.col("_hot"), "left")
    # rows that have met their key go anywhere
    x = x.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(key)))
    x = x.join(rest, F.col("_key") == F.col("_rest"), "left").withColumn("_got", F.coalesce("_h", "_r"))
    return x.select(*left.columns, *(F.col("_got")[c].alias(c) for c in given))


def evidence(rows: DataFrame, table: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """id, kind, n_words, ll (log likelihood of each language), declared, host, domain and suffix of rows of (id, kind, text, is_markup, url, site)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll, n, said = [], [], []
            for text, markup in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                t = text.as_py()
                z, k = likelihood(visible(t) if markup else t, table)
                ll.append(z.tolist())
                n.append(k)
                said.append(declared(t) if markup else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64())), pa.array(said, pa.string()), batch.column(4), batch.column(5)], ["id", "kind", "n_words", "ll", "declared", "url", "site"])

    x = rows.select("id", "kind", "text", "is_markup", "url", "site").mapInArrow(run, "id long, kind string, n_words long, ll array<double>, declared string, url string, site string")
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")), "site", F.lit("")))
    x = x.withColumn("host", host)
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1), F.lit("")), F.col("host"))
    suffix = F.regexp_extract("host", r"\.([^.]+)\.?$", 1)
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    return x.select("id", "kind", "n_words", "ll", known.alias("declared"), "host", domain.alias("domain"), suffix.alias("suffix"))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _soft(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials of these logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))


def identify(rows: DataFrame, labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """kind, id, lang, confidence, text_lang, declared, host, n_words and posterior for each of rows.

    rows: (id, kind, text, is_markup, url, site); site stands for the host where there is no url.  The
    text's likelihoods come from the sample of `labelled` (see fit); everything else is computed by
    grouped aggregation over all rows: each text spreads one count over the languages, and the counts are summed by
    host, domain (last two labels), suffix and altogether.  A host's prior leans on its domain's, that
    on its suffix's, that on the suffix's country and the whole table's; a row's own count is taken out of
    its host, domain and suffix first.  How far declared languages can be trusted is the sum of
    the counts under each declaration.  The posterior is text likelihood * p(declared | language) * prior.

    Null and empty texts, texts without letters: the prior and the declaration decide.  Rows without url and site share the
    host ''.  Null ids and repeated rows are each a row of their own.  Of equal posteriors the language first in
    `languages` wins.  Whole texts count, however long.  Other columns are left out; an empty table gives an empty result.
    """
    k = len(languages)
    x = materialize(evidence(rows, fit(labelled, languages), languages).withColumn("own", _soft(F.col("ll"))))
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)]
    packed = F.array(*(F.col(f"s{i}") for i in range(k)))
    hosts = x.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), *sums)
    hosts = materialize(hosts.select("host", "domain", "suffix", "n", packed.alias("own")))

    def level(name: str, of: DataFrame) -> DataFrame:
        again = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)]
        return of.groupBy(name).agg(F.sum("n").alias(f"{name}_n"), F.count(F.lit(1)).alias(f"{name}_rows"), *again).select(name, f"{name}_n", f"{name}_rows", packed.alias(f"{name}_s"))

    # hosts get the sums of their domain and suffix; there is one row a host here
    h = _spread_join(hosts, materialize(level("domain", hosts)), "domain", "domain_rows")
    h = _spread_join(h, materialize(level("suffix", hosts)), "suffix", "suffix_rows")
    h = materialize(h.select("host", F.col("n").alias("host_n"), F.col("own").alias("host_s"), "domain_n", "domain_s", "suffix_n", "suffix_s"))
    whole = hosts.agg(F.sum("n").alias("n"), *sums).first()
    n_all = float(whole["n"] or 0)
    every = [((whole[f"s{i}"] or 0.0) + 1.0) / (n_all + k) for i in range(k)]
    said = x.where("declared is not null").groupBy("declared").agg(*sums).collect()  # a row for each language at most, and "other"
    counts = {r["declared"]: [r[f"s{i}"] for i in range(k)] for r in said}
    options = (*languages, "other")
    mass = {d: [(AGREE if d == lang else DISAGREE) + counts.get(d, [0.0] * k)[i] for i, lang in enumerate(languages)] for d in options}
    trust = {d: [float(np.log(mass[d][i] / sum(mass[o][i] for o in options))) for i in range(k)] for d in options}

    y = _spread_join(x, h, "host", "host_n")
    zero = F.array(*[F.lit(0.0)] * k)
    country = zero
    for tld, lang in SUFFIXES.items():
        if lang in languages:
            country = F.when(F.col("suffix") == tld, F.array(*[F.lit(SUFFIX_PAGES if lang == v else 0.0) for v in languages])).otherwise(country)
    base = F.array(*map(F.lit, every))
    # the country's pages and the whole table's share come before the suffix's own pages
    prior = _add(F.transform(base, lambda v: v * STRENGTH), country)
    prior = F.transform(prior, lambda v: v / (F.lit(STRENGTH) + F.aggregate(country, F.lit(0.0), lambda s, w: s + w)))
    for name in ("suffix", "domain", "host"):
        less = F.zip_with(F.col(f"{name}_s"), F.col("own"), lambda s, o: F.greatest(F.lit(0.0), s - o))
        prior = F.zip_with(less, prior, lambda s, p: s + F.lit(STRENGTH) * p)
        y = y.withColumn("_prior", prior).withColumn("_prior", F.transform("_prior", lambda v: v / (F.col(f"{name}_n") - 1 + F.lit(STRENGTH))))
        prior = F.col("_prior")
    saying = zero
    for d in options:
        saying = F.when(F.col("declared") == d, F.array(*map(F.lit, trust[d]))).otherwise(saying)
    logs = _add(_add(F.col("ll"), saying), F.transform("_prior", lambda v: F.ln(F.greatest(v, F.lit(1e-12)))))
    y = y.withColumn("posterior", _soft(logs)).withColumn("confidence", F.array_max("posterior"))
    names = F.array(*map(F.lit, languages))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    text_lang = F.when(F.col("n_words") > 0, best(F.col("ll")))
    return y.select("kind", "id", best(F.col("posterior")).alias("lang"), "confidence", text_lang.alias("text_lang"), "declared", "host", "n_words", "posterior")
