"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, keep, materialize, scratch
from quern.llm.graph import components

#: Vectors and bytes that the cells are fitted on at most; every vector is then dealt to cells.
FIT_ROWS, FIT_BYTES = 20_000, 32 << 20
#: Vectors of a cell, about: a label has a power of two of cells, in proportion to its vectors.
CELL = 128
#: Cells that a vector is sent to: its own and the nearest others.
PROBES = 6
#: Vectors of a block; a task compares two blocks.
BLOCK = 1024
#: Bits of a cell's number that one level of centroids gives.
_LEVEL = 8
#: Products are compared with this much to spare and settled by a plain sum in double precision.
_SLACK = 1e-9


def fit_cells(sample: np.ndarray, k: int, rounds: int = 10, unit: bool = True) -> np.ndarray:
    """k centroids of the rows by k-means started from rows far apart; unit: of unit rows by cosine, else by distance."""
    k = max(1, min(k, len(sample)))
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    rng = np.random.default_rng(7)
    norms = (sample * sample).sum(axis=1)
    far = lambda c: np.maximum(0, norms - 2 * (sample @ c) + c @ c)
    at = [int(rng.integers(len(sample)))]
    near = far(sample[at[0]])
    for _ in range(1, k):
        at.append(int(rng.choice(len(sample), p=near / near.sum())) if near.sum() > 1e-9 else int(rng.integers(len(sample))))
        near = np.minimum(near, far(sample[at[-1]]))
    c = sample[at].copy()
    for _ in range(rounds):
        own = np.argmax(2 * (sample @ c.T) - (c * c).sum(axis=1), axis=1)
        sums = np.stack([np.bincount(own, sample[:, j], k) for j in range(sample.shape[1])], axis=1)
        size = np.linalg.norm(sums, axis=1) if unit else np.bincount(own, minlength=k)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


class Cells:
    """Centroids for any number of cells that is a power of two.

    The first 256 cells are those of spherical k-means; each further level parts every cell by the k-means of what its
    vectors have beyond its mean, with centroids that all cells share.  So cells may grow with the table
    without end, while what is fitted and sent out holds some 512 centroids a level.
    """

    def __init__(self, sample: np.ndarray, bits: int):
        self.levels: list[dict[int, np.ndarray]] = []
        self.means = np.zeros((1, sample.shape[1]))
        rest = sample
        for level in range(0, max(bits, 1), _LEVEL):
            most = min(_LEVEL, max(bits, 1) - level)
            self.levels.append({b: fit_cells(rest, 1 << b, unit=not level) for b in range(most + 1)})
            if level + most >= bits or not len(sample):
                break
            c = self.levels[-1][most]
            own = np.argmax(2 * (rest @ c.T) - (c * c).sum(axis=1), axis=1)
            if not level:
                size = np.maximum(1, np.bincount(own, minlength=len(c)))
                self.means = np.stack([np.bincount(own, rest[:, j], len(c)) for j in range(rest.shape[1])], axis=1) / size[:, None]
                c = self.means
            rest = rest - c[own]

    def nearest(self, x: np.ndarray, bits: int, probes: int) -> np.ndarray:
        """The numbers of the cells nearest to unit rows x, nearest first, of 1 << bits cells."""
        if not len(x) or not len(self.levels[0][0]):
            return np.zeros((len(x), 1), np.int64)
        first = self.levels[0][min(bits, _LEVEL)]
        cost, number = -2 * (x @ first.T), np.broadcast_to(np.arange(len(first)), (len(x), len(first)))
        cost, number = _least(cost, number, probes)
        if bits <= _LEVEL:
            return number
        rest = x[:, None] - self.means[number]
        for level in range(1, (bits + _LEVEL - 1) // _LEVEL):
            c = self.levels[level][min(_LEVEL, bits - level * _LEVEL)]
            cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(axis=1)
            which = np.broadcast_to(np.arange(cost.shape[1] * len(c)), (len(x), cost.shape[1] * len(c)))
            _, which = _least(cost.reshape(len(x), -1), which, probes)
            row = np.arange(len(x))[:, None]
            number = number[row, which // len(c)] * (1 << _LEVEL) + which % len(c)
            rest = rest[row, which // len(c)] - c[which % len(c)]
        return number


def _least(cost: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n least costs of each row in order, and what stands there."""
    n = min(n, cost.shape[1])
    at = np.argpartition(cost, n - 1, axis=1)[:, :n]
    order = np.argsort(np.take_along_axis(cost, at, 1), axis=1, kind="stable")
    at = np.take_along_axis(at, order, 1)
    return np.take_along_axis(cost, at, 1), np.take_along_axis(what, at, 1)


def _matrix(e: pa.Array, width: int) -> np.ndarray:
    """Unit rows of a column of vectors of one length."""
    flat = e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return _unit(m)


def near_duplicates(
    rows: DataFrame, *, threshold: float = 0.93, block: int = BLOCK, cell: int = CELL, probes: int = PROBES, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label).

    Rows are linked when their labels are equal and not null and their cosine in double precision is at
    least the threshold.  Equal vectors of a label form one class, for which one stands.  Each label has
    about one cell for every `cell` vectors; a vector is at home in the nearest cell and a guest in the
    `probes` - 1 next ones, and the vectors at home in a cell are compared with each other and with its guests.  A
    pair is missed only if neither is a guest where the other is at home; the tests measure the
    recall, also at the threshold itself.  Homes and guests of a cell are cut into blocks, so a crowded cell
    is many tasks; a task holds two blocks and returns counts and a forest of links, never all pairs.  n_links of
    a group of g vectors that are all alike but not equal takes g * g products, as it is their count.

    Centroids are fitted on at most fit_rows vectors and FIT_BYTES bytes.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or vec_id, link with nothing: n_links
    0, component_id vec_id.  Rows that share a vec_id each count as a vector of their own (equal rows link
    with each other) and share the component.  Vectors of another length than most link only with vectors of
    their length, in a cell of their own.  An empty table gives an empty result; other columns are left out.
    """
    with scratch():
        return keep(materialize(_compared(rows, threshold, block, cell, probes, fit_rows)[0]))


def _compared(rows: DataFrame, threshold: float, block: int, cell: int, probes: int, fit_rows: int) -> tuple[DataFrame, DataFrame]:
    """The result, and (compared, sent) per task: products formed and vectors read."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"), F.col("label").cast("string").alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0)
    fine = fine & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False))
    # a row's number tells it from others with its vec_id
    named = x.where(fine).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.size("e").alias("width"), F.xxhash64("e").alias("h1"), F.xxhash64("e", F.lit(1)).alias("h2"), "e")
    numbered = materialize(named)
    same = ["label", "width", "h1", "h2"]
    classes = numbered.groupBy(*same).agg(F.min(F.struct("vec_id", "rid")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    classes = materialize(classes.select(*same, F.col("first.rid").alias("rep"), F.col("first.vec_id").alias("root"), "m"))
    member = numbered.select("rid", "vec_id", *same).join(classes, same, "left").select("rid", "vec_id", F.coalesce("rep", "rid").alias("rep"), F.coalesce("root", "vec_id").alias("root"), F.coalesce("m", F.lit(1)).alias("m"))
    reps = numbered.join(classes, same, "left").where("rep is null or rep = rid").select("rid", "vec_id", "label", "width", F.coalesce("m", F.lit(1)).alias("m"), "e")
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / cell))).cast("int")
    per = materialize(reps.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n")).withColumn("bits", bits))
    top = per.groupBy("width").agg(F.sum("n").alias("n"), F.max("bits").alias("bits")).orderBy(F.desc("n"), "width").first()
    width, total, most = (top["width"], top["n"], top["bits"]) if top else (1, 0, 0)
    room = max(1, min(fit_rows, FIT_BYTES // (8 * width)))
    some = F.pmod(F.xxhash64("rid", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, room / max(1, total)))
    sample = reps.where((F.col("width") == width) & some).select("e").limit(2 * room).toArrow().column("e")
    cells = Cells(_matrix(sample, width), most)

    def deal(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    yield from part(batch.slice(k, 1024))

        def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            widths, wanted = batch.column("width").to_numpy(), batch.column("bits").to_numpy()
            for n in np.unique(wanted):
                for usual in (True, False):
                    at = np.flatnonzero((wanted == n) & ((widths == width) == usual))
                    if not len(at):
                        continue
                    held = batch.take(pa.array(at))
                    near = cells.nearest(_matrix(held.column("e"), width), int(n), probes) if usual else np.zeros((len(at), 1), np.int64)
                    p = near.shape[1]
                    row = pa.array(np.repeat(np.arange(len(at)), p))
                    out = [held.column(c).take(row) for c in ("label", "width")] + [pa.array(near.ravel()), pa.array(np.tile(np.arange(p) == 0, len(at)))]
                    if whole:
                        every = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), p).cast(pa.list_(pa.int64()))
                        out += [every.take(row), *(held.column(c).take(row) for c in ("rid", "vec_id", "m", "e"))]
                    yield pa.RecordBatch.from_arrays(out, names[: len(out)])

        names = ["label", "width", "cell", "home", "cells", "rid", "vec_id", "m", "e"]
        schema = "label string, width int, cell long, home boolean"
        return sized.mapInArrow(run, schema + (f", cells array<long>, rid long, vec_id long, m long, e {kind}" if whole else ""))

    sized = reps.join(per.select("label", "width", "bits"), ["label", "width"])
    blocks = lambda home: F.ceil(F.count_if(F.col("home") == home) / block).cast("int")
    # crowded cells only; of all others both numbers are 1
    crowded = materialize(deal(False).groupBy("label", "width", "cell").agg(blocks(True).alias("homes"), blocks(False).alias("guests")).where("homes > 1 or (homes = 1 and guests > 1)"))
    y = deal(True).join(crowded, ["label", "width", "cell"], "left").fillna(1, ["homes", "guests"])
    y = y.withColumn("b", F.pmod(F.xxhash64("rid"), F.when(F.col("home"), F.col("homes")).otherwise(F.greatest(F.lit(1), "guests"))).cast("int"))
    # home block i meets the home blocks from i on and every guest block
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    along = F.transform(F.sequence(F.lit(0), F.greatest("homes", "guests") - 1), lambda j: pair(F.col("b"), j))
    down = F.transform(F.filter(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: i < F.col("b")), lambda i: pair(i, F.col("b")))
    across = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: pair(i, F.col("b")))
    y = y.withColumn("to", F.explode(F.when(F.col("home"), F.concat(along, down)).otherwise(across)))
    y = y.select("label", "width", "cell", "home", "cells", "rid", "vec_id", "m", "e", "b", "to.i", "to.j")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        n, own, i, j = (k.as_py() for k in key[1:])
        col = lambda c: t.column(c).to_numpy()
        home, b, rid, vid, m = col("home").astype(bool), col("b"), col("rid"), col("vec_id"), col("m")
        left = np.flatnonzero(home & (b == i))
        left = left[np.lexsort((rid[left], vid[left]))]
        right = np.flatnonzero((home & (b == j) & (j > i)) | (~home & (b == j)))
        v = _matrix(t.column("e"), n)
        nearest = t.column("cells").combine_chunks()
        nearest = nearest.flatten().to_numpy().reshape(len(rid), -1)
        links, p_all, q_all = np.zeros(len(rid), np.int64), [], []

        def meet(p_at: np.ndarray, q_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = v[p_at] @ v[q_at].T
            yes = s >= threshold + _SLACK
            for p, q in zip(*np.nonzero((s >= threshold - _SLACK) & ~yes), strict=True):
                yes[p, q] = math.fsum(v[p_at[p]] * v[q_at[q]]) >= threshold
            p, q = np.nonzero(yes)
            return p_at[p], q_at[q]

        compared = 0
        if i == j and len(left):
            p, q = meet(left, left)
            apart = p != q
            p, q = p[apart], q[apart]
            np.add.at(links, p, m[q])
            p_all.append(p), q_all.append(q)
            compared += len(left) * len(left)
        if len(left) and len(right):
            p, q = meet(left, right)
            np.add.at(links, p, m[q])
            # a guest at whose home p is a guest counts p there, any other counts it here
            here = home[q].copy()
            for k in range(0, len(p), 1 << 18):
                of = slice(k, k + (1 << 18))
                here[of] |= ~(nearest[p[of]] == nearest[q[of], :1]).any(axis=1)
            np.add.at(links, q[here], m[p[here]])
            p_all.append(p), q_all.append(q)
            compared += len(left) * len(right)
        some = np.flatnonzero(links)
        p, q = (np.concatenate([np.zeros(0, np.int64), *a]) for a in (p_all, q_all))
        ids, roots = _forest(vid, p, q)
        gap = lambda k: pa.nulls(k, pa.int64())
        out = [pa.concat_arrays([pa.array(rid[some]), gap(len(ids) + 1)]), pa.concat_arrays([pa.array(links[some]), gap(len(ids) + 1)]),
               pa.concat_arrays([gap(len(some)), pa.array(ids), gap(1)]), pa.concat_arrays([gap(len(some)), pa.array(roots), gap(1)]),
               pa.concat_arrays([gap(len(some) + len(ids)), pa.array([compared])]), pa.concat_arrays([gap(len(some) + len(ids)), pa.array([len(rid)])])]
        return pa.table(out, names=["rid", "links", "u", "v", "compared", "sent"])

    found = materialize(y.groupBy("label", "width", "cell", "i", "j").applyInArrow(compare, "rid long, links long, u long, v long, compared long, sent long"))
    edges = found.where("u is not null").select("u", "v").unionByName(member.where("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    comp = components(edges)
    links = found.where("rid is not null").groupBy("rid").agg(F.sum("links").alias("links")).withColumnRenamed("rid", "rep")
    linked = member.join(links, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"))
    rest = x.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(rest).join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
    discard(per, crowded)
    return out, found.where("compared is not null").select("compared", "sent")


def _unit(m: np.ndarray) -> np.ndarray:
    if not m.size:
        return m
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _forest(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect what the pairs of places p and q connect, one for each place at most."""
    comp = np.arange(len(ids))
    while True:
        low = np.minimum(comp[p], comp[q])
        before = comp.copy()
        np.minimum.at(comp, p, low)
        np.minimum.at(comp, q, low)
        comp = comp[comp]
        if (before == comp).all():
            break
    moved = np.flatnonzero(comp != np.arange(len(ids)))
    return ids[moved], ids[comp[moved]]
