"""Secret scans: candidates by pattern, false positives removed by a random forest, in JVM operations only."""

from __future__ import annotations

import functools
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: A candidate is a whole run of key characters, 16 or more of them, or what is assigned to a secret's name or
#: stands for a password in an address, from 6 and 3 characters on.
RUN = r"[A-Za-z0-9+/_\-]"
_NAMES = r"(?i:tokens?|secrets?|api[_ \-]?key|access[_ \-]?key|passwords?|passwd|passphrase|pwd|credentials?|private[_ \-]?key|auth|bearer)"
_ASSIGNED = rf"{_NAMES}[\"'`]?[ \t]{{0,3}}(?:=>|:=|[:=])[ \t]{{0,3}}[\"'`]?"
_USER = r"://[^\s:@/]{1,64}:"
_VALUE = r"[^\s\"'`,;<>(){}\[\]|]{6,200}+"
_PASS = r"[^\s@/]{3,128}(?=@)"
CANDIDATE = rf"(?<!{RUN})(?={RUN}{{16}})(?!{RUN}*?{_ASSIGNED}){RUN}{{16,}}+={{0,2}}|(?=[abcpstABCPST]){_ASSIGNED}{_VALUE}|{_USER}{_PASS}"
#: The part of a match that only leads to the candidate.
LEAD = rf"^(?:{_ASSIGNED}(?={_VALUE}$)|{_USER})"
#: Characters of the text around a candidate whose words count as its neighbours.
BEFORE, AFTER = 64, 48
#: Labelled findings that the forest is fitted on at most (those of least hash), and its shape.
FIT_FINDINGS, TREES, DEPTH, SEED = 20_000, 24, 6, 11
THRESHOLD = 0.5

#: Words that long runs in prose, code and addresses are made of.
DICTIONARY = tuple(
    """about access account action address after again another application archive article author available because before between browser business button
    category change child class client column comment common company component config connect container content context control could country create current
    daily data database date default delete design detail device different direct display document domain download editor element email enable error event every
    example export field file filter first folder format found from function general generated global great group handler hash have header height history home host
    html http image import index info input install integration internal interface international item just know label language large layout left level library license like line
    link list local location login main make manager march market master media member message method mobile model module money month more most name national network
    never news node note number object office only online open option order other output package page panel param parent path people percent person phone photo place
    plugin point policy post power present press private process product profile program project property provider public query question read record region release report request
    research resource response result return right room root route sample school screen script search second section security select send series server service session setting
    share should show simple site size small social software sort source special standard start state static status store story string style subject submit support system
    table target team template test text that their theme there these they thing think this thread through time title today tool track type under unique update upload user
    using value version very video view visible want water week well were what when where which while width window with word work world would write year your
    ation ment ness ing able tion ungen lich keit schaft heit isch ieren ment eaux elle tion ción mente idad""".split()
)
_KEYWORDS = r"(?:tokens?|secret|api[_ \-]?key|access[_ \-]?key|passw(?:or)?d|passwd|pwd|credentials?|private[_ \-]?key|client[_ \-]?secret|auth(?:orization)?|bearer)"
_BENIGN = r"(?<![a-z@.])(?:examples?(?!\.(?:com|org|net))|sample|dummy|fake|placeholder|changeme|redacted|your(?=[_\-])|insert|xxxx+|tests?)(?![a-z])"
_DIGEST = r"(?:sha-?\d*|md5|commit|digest|checksum|integrity|hash|revision|rev|etag|uuid|guid|build|version)"
_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|SG)"
_TEST_PATH = r"(?i)(?:^|[/._\-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?|demo)(?:[/._\-]|$)"
_CONFIG_PATH = r"(?i)\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|tf|pem|sh)$"
_LOCK_PATH = r"(?i)(?:lock|\.sum|\.min\.js|\.map|\.svg)(?:\.[a-z]+)?$"


def common_pairs(words=DICTIONARY, most: int = 90) -> list[str]:
    """The letter pairs that stand most often in dictionary words."""
    count = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1) if w[i : i + 2].isascii())
    return [p for p, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most]]


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """A row for each candidate of each whole text: doc_id, path, nth (from 0), candidate, before, after.

    before and after hold the text up to the next match on either side, BEFORE and AFTER characters of it at most; before
    includes the name or address that led to the candidate.  Null and empty texts have none; repeated rows each have theirs.
    """
    x = docs.select("doc_id", F.col(path).cast("string").alias("path"), "text").where(F.regexp_like("text", F.lit(CANDIDATE)))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    x = x.select("doc_id", "path", found.alias("c"), F.split("text", CANDIDATE, -1).alias("gap"))
    lead = lambda c: F.regexp_extract(c, LEAD, 0)
    one = F.transform(
        "c", lambda c, i: F.struct(F.substr(c, F.length(lead(c)) + 1).alias("candidate"), F.right(F.concat(F.get("gap", i), lead(c)), F.lit(BEFORE)).alias("before"), F.left(F.get("gap", i + 1), F.lit(AFTER)).alias("after"))
    )
    return x.select("doc_id", "path", F.posexplode(one).alias("nth", "f")).select("doc_id", "path", F.col("nth").cast("long").alias("nth"), "f.candidate", "f.before", "f.after")


def _share(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)) / F.length(col)


def features() -> dict[str, Column]:
    """What the forest sees of a finding (candidate, before, after, path), by name; null parts count as empty."""
    c, b = F.coalesce("candidate", F.lit("")), F.lower(F.coalesce("before", F.lit("")))
    a, p = F.lower(F.coalesce("after", F.lit(""))), F.coalesce("path", F.lit(""))
    c = F.when(c == "", F.lit("-")).otherwise(c)
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = "|".join(sorted((w for w in set(DICTIONARY) if len(w) >= 3 and w.isascii()), key=lambda w: (-len(w), w)))
    n = F.length(c).cast("double")
    each = F.array_distinct(F.split(c, ""))
    bits = F.aggregate(each, F.lit(0.0), lambda s, ch: s - ((n - F.length(F.replace(c, ch, F.lit("")))) / n) * F.ln((n - F.length(F.replace(c, ch, F.lit("")))) / n))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return {
        "length": F.least(n, F.lit(256.0)),
        "digits": _share(c, "[0-9]"),
        "upper": _share(c, "[A-Z]"),
        "lower": _share(c, "[a-z]"),
        "hex": _share(c, "[0-9a-fA-F]"),
        "turns": _share(c, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "pairs": _share(low, f"(?=(?:{'|'.join(common_pairs())}))"),
        "dictionary": 1 - F.length(F.regexp_replace(low, f"(?:{words})", "")) / n,
        "separators": _share(c, r"[_\-/]"),
        "symbols": _share(c, r"[^A-Za-z0-9_\-/+=]"),
        "variable": flag(F.regexp_like(c, F.lit(r"^[$%&*.]|[$%]$|^[A-Za-z_]+[.\[][A-Za-z_.]+$"))),
        "userinfo": flag(F.regexp_like(b, F.lit(rf"{_USER}$"))),
        "entropy": bits,
        "repeats": flag(F.regexp_like(c, F.lit(r"(.)\1{5,}"))),
        "prefix": flag(F.regexp_like(c, F.lit(_PREFIX))),
        "assigned": flag(F.regexp_like(b, F.lit(r"(?:[:=]|=>)\s*[\"'`]?$"))),
        "quoted": flag(F.regexp_like(b, F.lit(r"[\"'`]$"))),
        "keyword": flag(F.regexp_like(b, F.lit(rf"{_KEYWORDS}\W{{0,6}}$"))),
        "keyword_near": flag(F.regexp_like(b, F.lit(_KEYWORDS))),
        "benign": flag(F.regexp_like(F.concat_ws(" ", b, low, a), F.lit(_BENIGN))),
        "digest": flag(F.regexp_like(b, F.lit(rf"{_DIGEST}\W{{0,4}}$"))),
        "address": flag(F.regexp_like(b, F.lit(r"(?:://|www\.|[/.@])[^\s\"']*$")) | F.regexp_like(a, F.lit(r"^[.@][a-z]"))),
        "test_path": flag(F.regexp_like(p, F.lit(_TEST_PATH))),
        "config_path": flag(F.regexp_like(p, F.lit(_CONFIG_PATH))),
        "lock_path": flag(F.regexp_like(p, F.lit(_LOCK_PATH))),
    }


def labelled_findings(spark: SparkSession, n: int = 6_000, seed: int = 1) -> DataFrame:
    """Findings of known label made by rule: candidate, before, after, path and label, n rows.

    Secrets are digests and random keys in several alphabets behind words such as token or password;
    the others are identifiers and prose made of dictionary words, numbers, digests of commits and
    files, parts of addresses, placeholders, and keys in test and lock files.
    """
    x = spark.range(0, n, 1, 1)
    h = lambda *k: F.xxhash64("id", F.lit(seed), *map(F.lit, k))
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(h(k), F.lit(len(values))) + 1).cast("int"))
    plain = [w for w in DICTIONARY if len(w) >= 4 and w.isascii()][:150]
    sha = F.sha2(h("a").cast("string").cast("binary"), 256)
    sha = F.concat(sha, F.sha2(h("b").cast("string").cast("binary"), 256))
    b64 = F.regexp_replace(F.translate(F.base64(F.unhex(sha)), "\r\n=", ""), "\\s", "")
    digits = F.translate(sha, "abcdef", "073951")
    token_hex = F.left(sha, pick("n", (32, 40, 40, 64)))
    shout = F.when(F.pmod(h("up"), F.lit(8)) == 0, F.upper(token_hex)).otherwise(token_hex)
    key64 = F.left(F.translate(b64, "+/", "Xy"), pick("m", (24, 32, 40, 43)))
    known = F.concat(pick("p", ("AKIA", "ghp_", "xoxb-", "sk_live_", "AIza", "glpat-")), F.left(F.translate(b64, "+/", "Qz"), pick("q", (16, 36, 35, 24))))
    run = lambda k, sep: F.concat_ws(sep, *(pick(f"{k}{i}", plain) for i in range(5)))
    camel = F.replace(F.initcap(run("c", " ")), F.lit(" "), F.lit(""))
    glued = F.concat(*(pick(f"g{i}", plain) for i in range(4)), pick("ge", ("ing", "ation", "ungen", "ment", "s")))
    number = F.left(digits, pick("d", (16, 16, 18, 20, 24)))
    uuid = F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12))
    blank = pick("x", ("xxxxxxxxxxxxxxxxxxxxxxxx", "your-api-key-goes-here", "0000000000000000000000000000", "REPLACE_ME_WITH_A_REAL_KEY", "abcdefghijklmnopqrstuvwxyz", "-----------------------", "________________________", "================"))
    said = pick("w", ("token", "secret", "api_key", "API_KEY", "apiKey", "access_key", "password", "passwd", "client_secret", "auth", "TOKEN", "credential"))
    prose = F.concat(pick("s", ("The ", "see ", "of the ", "und ", "les ", "para ", ", ")), pick("t", plain), F.lit(" "))
    set_ = F.concat(prose, said, pick("o", (" = \"", "=", ": ", ": \"", "='", " => '", " = ")))
    commit = F.concat(prose, pick("r", ("commit ", "sha256:", "sha1 ", "md5=", "checksum: ", "integrity=\"", "revision ", "etag: \"", "build ")))
    url = F.concat(prose, pick("u", ("https://", "http://", "www.")), pick("v", plain), F.lit(".example.com/"))
    # short passwords: words with digits and symbols in them, random characters, the same in addresses
    sign = lambda k: pick(k, ("!", "@", "#", "$", "%", "&", "*", "?", "_", "-", "+"))
    leet = F.concat(F.element_at(F.array(*(F.translate(F.initcap(pick("l1", plain)), "aeios", to) for to in ("43105", "4e10s", "@3i0$", "a3!0s"))), (F.pmod(h("l2"), F.lit(4)) + 1).cast("int")), sign("l3"), F.left(digits, pick("l4", (1, 2, 3, 4))))
    short = F.concat(F.left(F.substring(b64, 5, 20), pick("s1", (5, 6, 7, 9, 11))), sign("s2"), F.left(F.substring(b64, 30, 12), pick("s3", (1, 3, 4))))
    login = F.concat(prose, pick("u1", ("postgres", "mysql", "amqp", "https", "redis", "mongodb")), F.lit("://"), pick("u2", ("admin", "app", "root", "user1")), F.lit(":"))
    spoken = pick("b1", ("required", "password", "secret", "missing", "changeme", "settings", "invalid", "username", "optional", "disabled", "********", "......", "${TOKEN}", "$PASSWORD", "%(secret)s", "os.environ", "config.token", "string", "undefined", "process.env.KEY", "authentication", "self.password", "function"))
    word = F.concat(pick("b2", plain), pick("b3", ("", "ing", "s", "ed", ".")))
    file = pick("f", ("src0", "src7", "app/config.yaml", "deploy/.env", "lib/main.py", "settings.toml", "www.example.org", ""))
    tests = pick("z", ("tests/test_auth.py", "docs/example.md", "fixtures/keys.json", "examples/demo.sh"))
    lock = pick("y", ("package-lock.json", "go.sum", "poetry.lock", "bundle.min.js"))
    kinds = [  # candidate, before, path, label
        (shout, set_, file, 1), (key64, set_, file, 1), (known, F.when(F.pmod(h("k"), F.lit(2)) == 0, prose).otherwise(set_), file, 1), (shout, set_, file, 1),
        (glued, prose, file, 0), (camel, prose, file, 0), (run("e", "_"), F.concat(prose, F.lit("= ")), file, 0), (number, prose, file, 0),
        (uuid, prose, file, 0), (F.left(sha, pick("n", (32, 40, 40, 64))), commit, file, 0), (run("l", "-"), url, file, 0), (blank, set_, file, 0),
        (shout, F.concat(prose, F.lit("example "), said, F.lit(" = \"")), tests, 0), (b64, commit, lock, 0), (run("j", "/"), prose, file, 0), (glued, F.concat(prose, said, F.lit(" ")), file, 0),
        (leet, set_, file, 1), (short, set_, file, 1), (F.when(F.pmod(h("lg"), F.lit(2)) == 0, leet).otherwise(short), login, file, 1),
        (spoken, set_, file, 0), (F.rpad(word, 6, "s"), set_, file, 0), (F.when(F.pmod(h("lo"), F.lit(2)) == 0, spoken).otherwise(word), login, file, 0),
    ]
    kind = F.pmod(h("kind"), F.lit(len(kinds)))
    after = F.concat(pick("af", ("\"", "'", "", " ", ",", ". ")), F.lit(" "), pick("ag", plain))
    # one branch a kind: a single expression of all of them would be more than a generated method can hold
    made = [x.where(kind == i).select(cand.alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), F.lit(label).alias("label")) for i, (cand, before, path, label) in enumerate(kinds)]
    return functools.reduce(DataFrame.unionByName, made).coalesce(1)


def _vectors(found: DataFrame) -> DataFrame:
    f = features()
    x = found.withColumns({f"_f_{k}": v.cast("double") for k, v in f.items()})
    return VectorAssembler(inputCols=[f"_f_{k}" for k in f], outputCol="_vector").transform(x).drop(*(f"_f_{k}" for k in f))


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest on rows of (candidate, before, after, path, label), FIT_FINDINGS of them at most."""
    some = labelled.where("label is not null").orderBy(F.xxhash64("candidate", "before", "after", "path"), "label").limit(FIT_FINDINGS)
    # written first: fitting reads the rows several times
    rows = materialize(_vectors(some.withColumn("_label", F.col("label").cast("double"))).select("_vector", "_label"))
    return RandomForestClassifier(featuresCol="_vector", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """found with `score` (0 to 1) and `is_secret` added; columns of those names are replaced."""
    given = [c for c in found.columns if c not in ("score", "is_secret")]
    raw = model.setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_predicted").transform(_vectors(found.select(*given)))
    out = raw.withColumn("score", vector_to_array("_p")[1])
    return out.select(*given, "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Every candidate of docs with its score: doc_id, path, nth, candidate, before, after, score, is_secret.

    docs needs doc_id, text and the path column; others are left out.  labelled findings default to
    those made by rule.  An empty table gives none; the model doesn't depend on docs.
    """
    return score(findings(docs, path), train(labelled_findings(docs.sparkSession) if labelled is None else labelled))


def clean(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """docs without the rows whose doc_id holds a secret."""
    bad = scan(docs, labelled, path).where("is_secret").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
