"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

A signature has PLACES b-bit MinHash values; two sets of Jaccard similarity s agree in a place with
probability s + (1 - s) / 2**b.  The distance of two signatures is the number of places that differ.
The places are split into CHUNKS chunks.  If two signatures differ in at most 2 * CHUNKS - 1 places,
some chunk holds at most one of them (pigeonhole), so a row is indexed under each chunk with each one of its
places left out: every pair within that distance meets under some key.  For sets of similarity 0.8, the
expected distance is 14.4 of 72, the guarantee holds up to 23, and pairs further apart are still found
where their errors gather; altogether about 3 in a million such pairs miss every key.

Rows that share a key are compared by signature: pairs that differ in more than FAR = 30 places are dropped before any
text moves.  A pair of similarity 0.8 differs in more with a probability of 7 in a million, one of 0.45
in no more with 1 percent.  What is left is confirmed on full shingle sets.  Each key is led by the one of its rows
whose keys are shared most, mostly the original of a group of copies, so nearly all keys of a group have the same
leader.  All rows under keys of one leader form a unit; whatever meets under a key is in the unit of its
leader, and each pair is compared there once, not once per key.  Units are cut into blocks, each of which
gets the leader too, and a task compares the rows of one block.  Rows that their block ties to the leader
are connected already; only the others of a unit of several blocks are then compared with its other
blocks.  So a large group of near copies costs as much as its rows, and no link that ties groups is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, keep, materialize, scratch
from quern.llm.graph import components

CHUNKS, CHUNK = 12, 6
PLACES, BITS = CHUNKS * CHUNK, 12
#: Documents and shingles of a block, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000
#: Places in which the signatures of a pair may differ for its sets to be compared.
FAR = 30
#: Near pairs a row from which a task's rows are compared all at once.
DENSE = 4
#: Words of 64 bits of the bitmap of wanted ids.
BITMAP = 1 << 17
_COLUMNS = 4096
_KEEP = 300_000


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_RNG = np.random.default_rng(20240229)
_MUL, _ADD, _SALT = _odd(_RNG, PLACES), _odd(_RNG, PLACES), _odd(_RNG, CHUNKS * CHUNK)


class Words(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; fewer words make one shingle.

    A-Z are lower-cased; words are split at ASCII white space.  No words, no shingles.
    """
    if not text:
        return np.zeros(0, np.uint64)
    # bytes.lower() and bytes.split() know ASCII only
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(words) > _KEEP:
        words.clear()
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"short " + h.tobytes())], np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mix(out + h[k : k + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    """PLACES values of BITS bits."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        for p in range(PLACES):
            low[p] = min(low[p], (part * _MUL[p] + _ADD[p]).min())
    return (_mix(low) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def keys(sigs: np.ndarray) -> np.ndarray:
    """CHUNKS * CHUNK keys a row: each chunk's values with one left out, told apart by salts."""
    out = np.empty((len(sigs), CHUNKS * CHUNK), np.uint64)
    x = sigs.astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
    for skip in range(CHUNK):
        packed = np.zeros((len(sigs), CHUNKS), np.uint64)
        for p in range(CHUNK):
            if p != skip:
                packed = (packed << np.uint64(BITS)) | x[:, :, p]
        out[:, skip::CHUNK] = packed
    return _mix(out ^ _SALT) ^ _SALT


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles), h1 and h2 (hash of the set), sig; sig is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size, words)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def index(reps: DataFrame) -> DataFrame:
    """rep and key, for every distinct key of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                k = keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, PLACES))
                k.sort(axis=1)
                new = np.concatenate([np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]], axis=1)
                at = np.repeat(np.arange(part.num_rows), k.shape[1])[new.ravel()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(k[new].view(np.int64))], ["rep", "key"])

    return reps.select("rep", "sig").mapInArrow(run, "rep long, key long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of sorted distinct hashes."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], of[hit][order]

    if not len(both):
        return out.astype(np.int64)
    (ca, ra), (cb, rb) = places(a, left), places(b, right)
    for low in range(0, len(both), _COLUMNS):
        x, y = np.zeros((len(left), _COLUMNS), np.float32), np.zeros((len(right), _COLUMNS), np.float32)
        for m, c, r in ((x, ca, ra), (y, cb, rb)):
            i, j = np.searchsorted(c, [low, low + _COLUMNS])
            m[r[i:j], c[i:j] - low] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def _parts(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n places the smallest that the pairs of places p and q connect it with."""
    part = np.arange(n)
    while True:
        low, before = np.minimum(part[p], part[q]), part.copy()
        np.minimum.at(part, p, low)
        np.minimum.at(part, q, low)
        part = part[part]
        if (before == part).all():
            return part


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of batches sorted by their first columns, one table for each value of those."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if (here := tuple(int(c[low]) for c in columns)) != at:
                if held:
                    yield at, pa.Table.from_batches(held)
                at, held = here, []
            held.append(batch.slice(low, high - low))
    if held:
        yield at, pa.Table.from_batches(held)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The places of side 0, those of side 1 (of side 0 again where there are none), and whether there are none."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, (right if len(right) else left), not len(right)


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many places every left signature agrees with every right one."""
    out = np.zeros((len(left), len(right)), np.uint8)
    for p in range(left.shape[1]):
        out += left[:, p, None] == right[None, :, p]
    return out


def _near(dealt: DataFrame) -> DataFrame:
    """What of the tasks (lead, i, j, side, rep, sig) lies within FAR places of each other.

    Rows of side 0 meet those of side 1, or one another where no row has side 1.  A task with few near pairs gives
    each as (dense false, lead and rep the pair, i and j of its task); one with more than DENSE pairs a
    row gives its rows that have any (dense true), to be compared by sets all at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]

        def made() -> pa.RecordBatch:
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, bool)
            columns = [pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for k, c in zip(kinds, out, strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["lead", "i", "j", "side", "rep", "dense"])

        for (lead, i, j), t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            left, right, alone = _sides(side)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, PLACES)
            near = agreeing(sig[left], sig[right]) >= PLACES - FAR
            near &= rep[left][:, None] != rep[right][None, :]
            if alone:
                near = np.triu(near)
            p, q = np.nonzero(near)
            p, q = left[p], right[q]
            some = np.unique(np.concatenate([p, q]))
            if len(p) > DENSE * len(some):
                rows = (np.full(len(some), lead), np.full(len(some), i), np.full(len(some), j), side[some], rep[some], np.ones(len(some), bool))
            else:
                rows = (rep[p], np.full(len(p), i), np.full(len(p), j), np.ones(len(p)), rep[q], np.zeros(len(p), bool))
            for c, r in zip(out, rows, strict=True):
                c.append(r)
            if len(out[0]) > 1000:
                yield made()
        yield made()

    x = dealt.select("lead", "i", "j", "side", "rep", "sig").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return x.mapInArrow(run, "lead long, i int, j int, side int, rep long, dense boolean")


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the rows (lead, i, j, side, rep, set), sorted by lead, i and j.

    They connect what the true links of a task connect; rows of a task that are connected with its leader
    are told by lead, else null.  Rows without u give the number of pairs of sets compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int | None]] = [[], [], [], []]

        def add(*row: int | None) -> None:
            for c, v in zip(out, row, strict=True):
                c.append(v)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v", "lead", "compared"])
            for c in out:
                c.clear()
            return batch

        for (lead, _, _), t in _groups(batches, 3):
            left, right, alone = _sides(t.column("side").to_numpy())
            if not len(left) or t.num_rows < 2:
                continue
            ids, blobs = t.column("rep").to_numpy(), t.column("set").to_pylist()
            sets = [np.frombuffer(s, "<u8") for s in blobs]
            size = np.array([len(s) for s in sets], np.int64)
            both = overlaps([sets[k] for k in left], [sets[k] for k in right])
            p, q = np.nonzero(100 * both >= percent * (size[left][:, None] + size[right][None, :] - both))
            p, q = left[p], right[q]
            part = _parts(len(ids), p, q)
            led = {int(part[k]) for k in np.flatnonzero(ids == lead)}
            for k in np.flatnonzero(part != np.arange(len(ids))).tolist():
                add(int(ids[k]), int(ids[part[k]]), None, None)
            for k in np.unique(np.concatenate([p, q])).tolist():
                if int(part[k]) in led and int(ids[k]) != lead:
                    add(int(ids[k]), lead, lead, None)
            add(None, None, None, len(left) * (len(left) - 1) // 2 if alone else len(left) * len(right))
            if len(out[0]) > 10_000:
                yield made()
        yield made()

    return tasks.mapInArrow(run, "u long, v long, lead long, compared long")


def _dealt_sets(docs: DataFrame, dealt: DataFrame, size: int) -> DataFrame:
    """The rows (lead, i, j, side, rep) of dealt with rep's shingle set, brought together by lead, i and j.

    Texts are filtered by a bitmap of the wanted ids first, so that few of them are read on; it has
    BITMAP words at most and lets all pass when it is full, as the join behind it decides.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP)).cast("int")
    bitmap = dealt.select(word("rep").alias("_w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(rep, 'bit'), 64) as int))").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_w", word("doc_id"))
    texts = texts.join(F.broadcast(bitmap), "_w").where(F.expr("shiftright(_bits, cast(pmod(xxhash64(doc_id, 'bit'), 64) as int)) & 1 = 1")).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), size, words).astype("<u8").tobytes() for t in batch.column(1)], pa.binary())], ["rep", "set"])

    sets = texts.mapInArrow(run, "rep long, set binary").where(F.length("set") > 0)
    x = dealt.select("lead", "i", "j", "side", "rep").join(sets, "rep").select("lead", "i", "j", "side", "rep", "set")
    return x.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "side", "rep")


def _verified(docs: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v, lead, compared) as _links gives them, for the tasks of dealt: signatures first, then sets of what is near."""
    near = materialize(_near(dealt))
    # a pair that several tasks give is compared once; in each task's own group, so that no row gathers all its partners
    pairs = near.where("not dense").groupBy("lead", "rep").agg(F.min(F.struct("i", "j")).alias("t")).select("lead", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.lit(1).alias("side"), "rep")
    pairs = materialize(pairs)
    heads = pairs.select("lead", "i", "j").distinct().select("lead", "i", "j", F.lit(0).alias("side"), F.col("lead").alias("rep"))
    some = near.where("dense").select("lead", "i", "j", "side", "rep")
    # the numbers of blocks tell no pair's task from a dense one, the sign of j does
    back = lambda x: x.withColumn("j", -1 - F.col("j"))
    found = materialize(_links(_dealt_sets(docs, some.unionByName(back(pairs)).unionByName(back(heads)), size), percent))
    discard(near, pairs)
    return found


def _confirm(docs: DataFrame, unit: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) that connect what the links within each unit (lead, rep, n, sig) connect; and the numbers of set pairs compared."""
    blocks = lambda x: x.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k")).where("k > 1")
    of = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    # units of several blocks only: a small table, written first, so that large units need not meet in one task
    many = materialize(blocks(unit))
    placed = unit.join(many, "lead", "left").fillna(1, ["k"]).withColumn("b", of("k"))
    # the leader goes to every block
    dealt = placed.withColumn("i", F.explode(F.when(F.col("rep") == F.col("lead"), every("k")).otherwise(F.array("b"))))
    found = _verified(docs, dealt.withColumns({"j": F.lit(0), "side": F.lit(0)}), size, percent)
    tied = found.where("lead is not null").select("lead", F.col("u").alias("rep"))
    tied = tied.unionByName(tied.select(F.col("rep").alias("lead"), F.col("lead").alias("rep"))).distinct()
    loose = placed.where("k > 1 and rep <> lead").join(tied, ["lead", "rep"], "left_anti")
    loose = materialize(loose.select("lead", "rep", "n", "sig", "k"))
    if not loose.isEmpty():
        wide = materialize(loose.groupBy("lead").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("r")))
        mine = loose.join(wide, "lead").withColumn("i", of("r")).withColumn("j", F.explode(every("k"))).withColumn("side", F.lit(0))
        others = placed.where("k > 1").join(wide, "lead").withColumn("i", F.explode(every("r"))).withColumn("j", F.col("b")).withColumn("side", F.lit(1))
        columns = ["lead", "i", "j", "side", "rep", "sig"]
        found = found.unionByName(_verified(docs, mine.select(*columns).unionByName(others.select(*columns)), size, percent))
        discard(wide)
    discard(many, loose)
    return found.where("u is not null").select("u", "v"), found.where("compared is not null").select("compared")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of word shingles;
    component_id is the smallest doc_id reachable over links, the document itself included, and kept says that it is
    the document itself.  Texts that are null or hold no words have 0 shingles and link with nothing.
    Rows that share a doc_id are one document, linked by any of its texts; rows with a null doc_id
    link with nothing, have a null component_id and are not kept.  Whole texts count, however long; an empty table gives an
    empty result; other columns, whatever their names, are left out.  Sets that are equal form one class, for
    which its smallest doc_id stands.  percent is from 80 up: the signature join is laid out for that.
    """
    with scratch():
        return keep(materialize(_compared(docs, size, percent)[0]))


def _compared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The result, and how many pairs of sets its tasks compared."""
    if percent < 80:
        raise ValueError("the signatures are laid out for similarities of 80 percent or more")
    s = materialize(sketch(docs, size))
    some = s.where("sig is not null and doc_id is not null")
    # only sets that stand more than once; written first, so that the join can split a large class over tasks
    classes = materialize(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    rep = F.coalesce("rep", "doc_id")
    member = materialize(some.join(classes, ["h1", "h2", "n"], "left").select("doc_id", rep.alias("rep"), "n", F.when(F.col("doc_id") == rep, F.col("sig")).alias("sig")))
    discard(classes)
    reps = member.where("sig is not null").select("rep", "n", "sig")

    # keys that several classes share, and of each the class whose keys are shared most; repeated rows only
    # make units of one, which link nothing
    entry = index(reps)
    shared = entry.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = materialize(entry.join(shared, "key").select("key", "rep", "c"))
    score = met.groupBy("rep").agg(F.sum("c").alias("score"))
    scored = met.select("key", "rep").join(score, "rep")
    leads = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("neg"))).alias("m")).select("key", (-F.col("m.neg")).alias("lead"))
    unit = met.select("key", "rep").join(leads, "key").select("lead", "rep").distinct()
    unit = materialize(unit.join(reps.select("rep", "n", "sig"), "rep"))
    links, compared = _confirm(docs, unit, size, percent)
    discard(met, unit)

    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = components(links.unionByName(copies)).withColumnRenamed("node", "doc_id")
    out = s.select("doc_id", F.col("n").alias("n_shingles")).join(comp, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")), compared


def unique(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller doc_id; a row with a null doc_id stays."""
    gone = near_duplicates(docs, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    # written first: where the ids are few, the plan sends them out instead of shuffling texts
    gone = materialize(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
