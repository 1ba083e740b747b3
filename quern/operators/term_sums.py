"""Texts as rows of counts of wanted terms, in a worker's memory: scores and vectors are products with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import letters

#: Cells of a matrix in memory at most.
CELLS = 1_048_576
#: Wanted terms up to which texts are cut to them before they are kept.
WANTED = 5_000
#: Stands for a text itself among its terms; no token is empty.
OWN = ""


def read(texts: DataFrame, words: Callable[[pa.Array], pa.ListArray], wanted: list[str] | None = None) -> DataFrame:
    """texts (content, ...) with `terms`, their words in order and with repeats, in place of the content, and `dl`, how many they are.

    `words` takes a slice of letters.parts() apart.  With `wanted` only those are kept, as `terms`, the places of the distinct ones
    in it, and `tfs`, how often each stands in the text; dl still counts all.
    """
    rest = [c for c in texts.columns if c != "content"]
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if sent.value is None else letters.Wanted(sent.value)
        for batch in batches:
            at = 0
            for part in letters.parts(batch.column(0)):
                if some is None:
                    terms = words(part)
                    new = [terms, terms.value_lengths()]
                else:
                    new = [*_tallied(*letters.places(words, part, some), max(1, len(some.words)))]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns[1:], *new], [*rest, *names])
                at += len(part)

    names = ["terms", "dl"] if wanted is None else ["terms", "tfs", "dl"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*rest).schema.fields)
    return texts.select("content", *rest).mapInArrow(run, f"{fields}, {'terms array<string>' if wanted is None else 'terms array<int>, tfs array<int>'}, dl int")


def _tallied(row: np.ndarray, place: np.ndarray, dl: np.ndarray, most: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Lists of the distinct places of each row, lists of how often they are there, and dl."""
    keys, tf = np.unique(row * most + place, return_counts=True)
    row, place = np.divmod(keys, most)
    ends = pa.array(np.searchsorted(row, np.arange(len(dl) + 1)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, tf))
    return *lists, pa.array(dl.astype(np.int32))


def spread_counts(texts: DataFrame, vocabulary: DataFrame | None, wanted: list[str] | None = None) -> DataFrame:
    """(term, df, total) of rows (terms, dl): texts that hold the term and their length in all; OWN stands for every text.

    A batch of texts gives one row for each term in it.  With `wanted` terms are places in it, and a partition gives one row for each.
    """
    if wanted is not None:
        sent = texts.sparkSession.sparkContext.broadcast(wanted)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, total = np.zeros(len(sent.value) + 1, np.int64), np.zeros(len(sent.value) + 1, np.int64)
            for batch in batches:
                dl = np.asarray(batch.column(1)).astype(np.int64)
                place = batch.column(0).flatten().to_numpy()
                # bincount adds doubles, which hold such sums exactly
                by = np.repeat(dl, batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
                df += np.append(np.bincount(place, minlength=len(df) - 1), len(dl))
                total += np.append(np.bincount(place, by, len(df) - 1).astype(np.int64), dl.sum())
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([*sent.value, OWN], pa.string()).take(pa.array(some)), pa.array(df[some]), pa.array(total[some])], ["term", "df", "total"])

        x = texts.select("terms", "dl").mapInArrow(tally, "term string, df long, total long")
        return x.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl = np.asarray(batch.column(1)).astype(np.int64)
            row = np.repeat(np.arange(len(dl)), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            terms = batch.column(0).flatten().dictionary_encode()
            most = max(1, len(terms.dictionary))
            row, term = np.divmod(np.unique(row * most + terms.indices.to_numpy()), most)
            df, total = (np.bincount(term, by, len(terms.dictionary)).astype(np.int64) for by in (None, dl[row]))
            names = pa.concat_arrays([terms.dictionary, pa.array([OWN])])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(df, len(dl))), pa.array(np.append(total, dl.sum()))], ["term", "df", "total"])

    x = texts.select("terms", "dl").mapInArrow(run, "term string, df long, total long")
    if vocabulary is not None:
        own = texts.sparkSession.createDataFrame([(OWN,)], "term string")
        x = x.join(F.broadcast(vocabulary.select("term").unionByName(own).distinct()), "term", "left_semi")
    return x.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def moved(wanted: list[str] | None, vocabulary: list[str]) -> np.ndarray | None:
    """counted()'s `to`: for each wanted term its place in the vocabulary, or -1."""
    if wanted is None:
        return None
    at = {w: i for i, w in reversed(list(enumerate(vocabulary)))}
    return np.array([at.get(w, -1) for w in wanted], np.int64)


def counted(terms: pa.ListArray, tfs: pa.ListArray | None, vocabulary: pa.Array, most: int, to: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of the lists its start, the places of the vocabulary's terms in it, and the counts (rows x places).

    Without tfs every term stands once for each time it is listed.  `most` is the width of what is multiplied.  With `to` terms
    are places in another vocabulary, and `to` holds for each of that its place in this one, or -1.
    """
    rows = max(1, CELLS // max(len(vocabulary), most, 1))
    for at in range(0, len(terms), rows):
        part = terms.slice(at, rows)
        row = np.repeat(np.arange(len(part)), pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False))
        place = pc.index_in(part.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False) if to is None else to[part.flatten().to_numpy()]
        by = None if tfs is None else tfs.slice(at, rows).flatten().to_numpy(zero_copy_only=False)
        some = place >= 0
        row, place, by = row[some], place[some], None if by is None else by[some].astype(np.float64)
        seen = np.zeros(len(vocabulary) + 1, bool)
        seen[place] = True
        used = np.flatnonzero(seen)
        column = np.cumsum(seen)[place] - 1
        sums = np.bincount(row * len(used) + column, by, len(part) * len(used))
        yield at, used, sums.astype(np.float64).reshape(len(part), len(used))
