"""Token ids in a binary file format compressed by a grammar of id pairs (Re-Pair), one per shard.

A shard is one blob in a row of a Parquet table (part, shard, n_docs, n_ids, blob), so any store that
Spark writes to will hold it and a lost task leaves no half file.  Layout of a blob, little-endian:

    magic "RPG1", then uint64: documents d, rules r, symbols s, bytes a symbol w (2 or 4), first rule's symbol v
    d bytes   1 where the document's id is null
    d int64   document ids
    d+1 uint64  where each document's symbols begin
    r uint32  left symbol of each rule;  r uint32  right symbol;  r uint32  expansion length
    s uintw   symbols

Symbols below v are token ids; symbol v + k stands for the two symbols of rule k.  No rule crosses the
end of a document, so a document is decoded from its own symbols and the rules, and the expansion
lengths tell which symbol holds a document's i-th id without expanding the others.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize

SHARD_IDS = 1 << 20
END_ID = 2
#: How often a pair must stand to be replaced.  On a shard of sf0.1 16 gives the fewest bytes: a rule takes 12, and with
#: 8 a shard has more rules than two bytes a symbol can name.
LEAST = 16
#: Stored bytes of input that a range of documents holds, about, and ranges at most.
RANGE_BYTES, RANGES = 64 << 20, 200_000
_HEAD = struct.Struct("<4s5Q")
#: White space to Python that the tokenizer takes for text.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write for bytes: printable ones stay, others follow from 256."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in stay)}


_LETTERS = _byte_letters()
_MARKS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


class Encoder:
    """Ids of whole texts as uint32 arrays, by way of bounded caches of words.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of
    its white-space-separated pieces in turn; it also lower-cases, and parts letters from a full stop or comma
    behind them, so words in plain letters go straight to its merges.
    """

    #: Words with and without marks that are kept; both caches are emptied when full.
    KEEP, KEEP_PLAIN = 1_200_000, 800_000

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size, self.end = self.tok.get_vocab_size(), end_id
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.model, self.letter = self.tok.model, "H" if self.kind == "<u2" else "I"
        self.plain: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        learn = self._learn

        class Cache(dict):
            def __missing__(cache, word: str) -> bytes:
                ids = cache[word] = learn(word)
                return ids

        self.cache = Cache()
        # words are taken apart only for a tokenizer that folds case, parts marks and maps bytes to letters
        tests = ("ab", "straße", "éàü", "thereandback", "x")
        self.apart = all(self._ids(f"{w.title()}.") == [*self._direct(w), *self._ids(".")] for w in tests)

    def _direct(self, word: str) -> list[int]:
        try:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            return [t.id for t in self.model.tokenize(letters)]
        except Exception:  # the model has no way to go without the other steps
            return self._ids(word)

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.letter, ids).tobytes()

    def _learn(self, word: str) -> bytes:
        """A word's ids: letters of Latin-1 and the ASCII marks behind them each for itself, others as they are."""
        stem = word.rstrip(_MARKS)
        if not self.apart or not stem.isalpha():
            return self._bytes(self._ids(word))
        low, mark = stem.lower(), word[len(stem) :]
        if (ids := self.plain.get(low)) is None:
            if not low.isascii() and max(low) > "\xff":
                return self._bytes(self._ids(word))
            ids = self.plain[low] = self._bytes(self._direct(low))
        if (end := self.marks.get(mark)) is None:
            end = self._bytes(self._ids(mark))
            if len(self.marks) < 10_000:
                self.marks[mark] = end
        return ids + end

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian uint32."""
        if len(self.cache) > self.KEEP:
            self.cache.clear()
        if len(self.plain) > self.KEEP_PLAIN:
            self.plain.clear()
        cache = self.cache
        end = self._bytes([self.end])
        get = cache.__getitem__
        whole = (self._bytes(self._ids(t)) + end if t and _ODD.search(t) else b"".join(map(get, (t or "").split())) + end for t in texts)
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in whole]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """The one encoder of this process; tasks of one worker share its caches."""
    return Encoder(path, end_id)


def _frequent(s: np.ndarray, ends: np.ndarray, fresh: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs within documents that stand `least` times, those that hold a symbol from `fresh` on: their places, which of them, and the pairs.

    Pairs are counted in hash buckets first; only those in buckets that are full enough are sorted.  Of two
    frequent pairs in one bucket one is left for a later round.
    """
    if fresh:
        new = s >= fresh
        at = np.flatnonzero((new[:-1] | new[1:]) & ~ends[:-1])
        a, b = s[at], s[at + 1]
    else:
        at, a, b = None, s[:-1], s[1:]
    bits = min(20, max(8, int(len(a)).bit_length() + 1))
    hashed = lambda x, y: ((x * np.uint32(0x9E3779B1)) ^ (y * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)
    bucket = hashed(a, b).astype(np.int64)
    if at is None:
        # pairs over the end of a document have a bucket of their own
        bucket[ends[:-1]] = 1 << bits
    hot = np.bincount(bucket, minlength=(1 << bits) + 1) >= least
    hot[1 << bits] = False
    some = np.flatnonzero(hot[bucket])
    key = (a[some].astype(np.uint64) << np.uint64(32)) | b[some]
    order = np.sort(key)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), order[1:] != order[:-1]]))
    pairs = order[begin[np.diff(np.append(begin, len(order))) >= least]]
    table = np.full((1 << bits) + 1, -1, np.int32)
    own = hashed((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    table[own] = np.arange(len(pairs), dtype=np.int32)
    pairs = pairs[table[own] == np.arange(len(pairs))]
    if not len(pairs):
        return some[:0], some[:0], pairs
    table[hashed((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = np.arange(len(pairs), dtype=np.int32)
    of = table[bucket[some]]
    hit = (of >= 0) & (pairs[of] == key)
    return (some if at is None else at[some])[hit], of[hit].astype(np.int64), pairs


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST):
    """(symbols, ends of documents, rules' left, right): all pairs that stand `least` times replaced, again and again until none does.

    A round replaces all such pairs, from the left where they overlap.  A pair that becomes frequent holds a
    symbol of the round before, so rounds look around those only; when they find nothing more, all places
    are counted once again, and none is left over.
    """
    s, ends, left, right = ids.astype(np.uint32), ends.copy(), [], []
    rules, fresh = 0, 0
    while len(s) > 1:
        at, of, pairs = _frequent(s, ends, fresh, least)
        if not len(pairs):
            if not fresh:
                break
            fresh = 0
            continue
        fresh = first + rules
        # of places in a row every other one, from the left
        apart = np.ones(len(at), bool)
        apart[1:] = np.diff(at) != 1
        take = (at - np.maximum.accumulate(np.where(apart, at, 0))) % 2 == 0
        at, of = at[take], of[take]
        s[at] = fresh + of
        ends[at] = ends[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, ends = s[keep], ends[keep]
        left.append(pairs >> np.uint64(32)), right.append(pairs & np.uint64(0xFFFFFFFF))
        rules += len(pairs)
    gather = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.uint32)
    return s, ends, gather(left), gather(right)


def expansions(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; rules only refer to earlier ones."""
    out = []
    for x, y in zip((left.astype(np.int64) - first).tolist(), (right.astype(np.int64) - first).tolist(), strict=True):
        out.append((out[x] if x >= 0 else 1) + (out[y] if y >= 0 else 1))
    return np.array(out, np.uint32)


def pack(doc_ids: list[int | None], parts: list[bytes], first: int, least: int = LEAST) -> bytes:
    """The blob of these documents' ids."""
    sizes = np.array([len(p) // 4 for p in parts])
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    s, ends, left, right = compress(ids, ends, first, least)
    begins = np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<u8")
    width = 2 if first + len(left) <= 1 << 16 else 4
    head = _HEAD.pack(b"RPG1", len(parts), len(left), len(s), width, first)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, null.tobytes(), known.tobytes(), begins.tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), expansions(left, right, first).astype("<u4").tobytes(), s.astype(f"<u{width}").tobytes()])


class Shard:
    """A blob opened for reading; documents are decoded one at a time or all together."""

    def __init__(self, blob: bytes):
        magic, d, r, s, width, self.first = _HEAD.unpack_from(blob)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        null, known = take("u1", d), take("<i8", d)
        self.doc_ids = [None if z else int(x) for z, x in zip(null, known, strict=True)]
        self.begins = take("<u8", d + 1)
        self.left, self.right, self.lengths = take("<u4", r), take("<u4", r), take("<u4", r)
        self.symbols = take(f"<u{width}", s)

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.first]
        return out

    @functools.cached_property
    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each rule's ids begin in an array that holds all token ids and then those of the rules, and that array."""
        s = np.arange(self.first, self.first + len(self.left), dtype=np.uint32)
        while len(at := np.flatnonzero(s >= self.first)):
            k = s[at].astype(np.int64) - self.first
            size = np.ones(len(s), np.int64)
            size[at] = 2
            to = np.cumsum(size) - size
            out = np.empty(len(s) + len(at), np.uint32)
            out[to] = s
            out[to[at]], out[to[at] + 1] = self.left[k], self.right[k]
            s = out
        begin = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        return self.first + begin, np.concatenate([np.arange(self.first, dtype=np.uint32), s])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        begins, flat = self._expanded
        rule = symbols >= self.first
        begin = symbols.astype(np.int64)
        begin[rule] = begins[begin[rule] - self.first]
        size = self.spans(symbols)
        return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def doc(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        return self.expand(self.symbols[int(self.begins[i]) : int(self.begins[i + 1])])

    def id_at(self, i: int, k: int) -> int:
        """The k-th id of the i-th document; expands one symbol."""
        s = self.symbols[int(self.begins[i]) : int(self.begins[i + 1])]
        upto = np.cumsum(self.spans(s))
        j = int(np.searchsorted(upto, k, "right"))
        return int(self.expand(s[j : j + 1])[k - (int(upto[j - 1]) if j else 0)])


def write(docs: DataFrame, tokenizer: str, *, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, least: int = LEAST) -> DataFrame:
    """Encodes doc_id and text of docs and writes them in ascending doc_id order (null first, ties by text).

    Returns the written table, which stands under `path`, or among the work tables where none is given.
    tokenizer is the path of a file that every executor has.  Texts are dealt to ranges of doc_id, as many as
    the input's bytes need; a shard ends with the document that fills it, so one is as large as shard_ids
    plus its last document, however long.  Null texts count as empty; empty ones hold the end id alone.  Repeated
    rows are all written; other columns are left out, whatever their names.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    # an estimate will do: too many ranges only make small ones
    size = int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, size // RANGE_BYTES))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, shard = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "blob": pa.array([pack(ids, parts, coder.size, least)], pa.binary())})

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                for doc_id, coded in zip(some.column(0).to_pylist(), coder.many(some.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    parts.append(coded)
                    held += len(coded) // 4
                    if held >= shard_ids:
                        yield close()
                        ids, parts, held, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    coded = x.mapInArrow(encode, "part int, shard int, n_docs long, n_ids long, blob binary")
    if path is None:
        return materialize(coded)
    coded.write.parquet(path)
    return spark.read.schema(coded.schema).parquet(path)


def read(written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, decoded from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                x = Shard(blob.as_py())
                ids = x.expand(x.symbols)
                upto = np.concatenate([[0], np.cumsum(x.spans(x.symbols))])[x.begins.astype(np.int64)]
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                n = len(x.doc_ids)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x.doc_ids, pa.int64()), "part": pa.array([part.as_py()] * n, pa.int32()), "shard": pa.array([shard.as_py()] * n, pa.int32()), "at": pa.array(upto[:-1], pa.int64()), "n_tokens": pa.array(np.diff(upto), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    light = written.select("part", "shard", "n_ids")
    # one row per part: the running sum over them is the only one that spans the whole table
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("p", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0))).select("part", "p")
    shards = light.withColumn("q", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = shards.join(parts, "part").select("part", "shard", (F.col("p") + F.col("q")).alias("offset"))
    docs = written.select("part", "shard", "blob").mapInArrow(decode, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def index(written: DataFrame) -> DataFrame:
    """Where each document stands: doc_id, part, shard and nth, in the order of the files; to be kept beside them."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = Shard(blob.as_py()).doc_ids
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "part": pa.array([part.as_py()] * len(ids), pa.int32()), "shard": pa.array([shard.as_py()] * len(ids), pa.int32()), "nth": pa.array(range(len(ids)), pa.int32())})

    return written.select("part", "shard", "blob").mapInArrow(heads, "doc_id long, part int, shard int, nth int")


def fetch(written: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id and ids of the rows (doc_id, part, shard, nth) of places, decoding these documents only.

    places are rows of index(), such as where("doc_id = 7"); only shards that hold one are opened.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, nth, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = Shard(blob.as_py()).doc(nth.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    x = written.join(places, ["part", "shard"]).select("doc_id", "nth", "blob")
    return x.mapInArrow(decode, "doc_id long, ids array<long>")


def encode(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """write() and read() of what it wrote."""
    return read(write(docs, tokenizer, **how))
