"""Words of columns of texts in a worker's memory, taken apart by their bytes: what text.py says by regular expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.functions.stem import ENDS, IRREGULAR, porter
from quern.functions.stopwords import ENGLISH
from quern.functions.text import CONTRACTIONS

#: Bytes of texts that are taken apart at once; a longer text is so alone.
BYTES = 4_194_304
#: What a byte is; the rest is left out.
SPACE, KEPT = 1, 2
#: White space and letters of more than one byte.
_TWO, _THREE = [0xC285, 0xC2A0], [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
_DOTTED_I, _KELVIN = 0xC4B0, 0xE284AA
_STOPS = frozenset(ENGLISH)


def _kinds(letters: bool) -> tuple[np.ndarray, np.ndarray]:
    kind, to = np.full(256, 0 if letters else KEPT, np.uint8), np.arange(256, dtype=np.uint8)
    if letters:
        kind[97:123] = kind[65:91] = KEPT
        to[65:91] += 32
    kind[[*range(9, 14), *range(28, 33)]] = SPACE
    return kind, to


_KINDS = {letters: _kinds(letters) for letters in (True, False)}


def _marked(data: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its kind, and what becomes of it."""
    kinds, to = _KINDS[letters]
    kind, out = kinds[data], to[data]
    at = np.flatnonzero(data >= 0xC2)
    at = at[(data[at] <= 0xC4) | ((data[at] >= 0xE1) & (data[at] <= 0xE3))]
    two = at[(data[at] <= 0xC4) & (at + 1 < len(data))]
    three = at[(data[at] >= 0xE1) & (at + 2 < len(data))]
    pair = data[two].astype(np.int32) << 8 | data[two + 1]
    triple = data[three].astype(np.int32) << 16 | data[three + 1].astype(np.int32) << 8 | data[three + 2]
    for begin, width in ((two[np.isin(pair, _TWO)], 2), (three[np.isin(triple, _THREE)], 3)):
        for i in range(width):
            kind[begin + i] = SPACE
    if letters:
        for begin, letter in ((two[pair == _DOTTED_I], "i"), (three[triple == _KELVIN], "k")):
            kind[begin], out[begin] = KEPT, ord(letter)
    return kind, out


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one behind the other, and where each begins and the last ends; null is empty."""
    texts = texts.fill_null("").cast(pa.string()) if texts.null_count or texts.type != pa.string() else texts
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists(texts: pa.Array, letters: bool) -> pa.ListArray:
    data, ends = joined(texts)
    kind, out = _marked(data, letters)
    if letters:
        some = np.flatnonzero(kind)
        kind, out, ends = kind[some], out[some], np.searchsorted(some, ends)
    word = kind == KEPT
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < len(word)]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    offsets = np.append(np.cumsum(word, dtype=np.int32)[starts] - 1, np.count_nonzero(word)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(out[word]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), words)


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about BYTES."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def letter_words(texts: pa.Array) -> pa.ListArray:
    """text.letter_words() of a slice of parts()."""
    return _lists(texts, True)


def tokens(texts: pa.Array) -> pa.ListArray:
    """text.tokens() of a slice of parts()."""
    return _lists(texts, False)


def _stems(word: str) -> list[str]:
    return [s for s in (porter(w) for w in CONTRACTIONS.get(word, (word,)) if w not in _STOPS) if s]


def stemmed(texts: pa.Array) -> pa.ListArray:
    """The words of chunks.clean() of a slice of parts(); only its distinct words become Python strings."""
    lists = _lists(texts, True)
    words = lists.flatten().dictionary_encode()
    each = pa.array([_stems(w) for w in words.dictionary.to_pylist()], pa.list_(pa.string())).take(words.indices)
    ends = np.append(0, np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends[lists.offsets.to_numpy()].astype(np.int32)), each.flatten())


class Wanted:
    """Words that are looked for, with their places, and how a word must begin for porter() to make one of them of it."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())
        self.at = {w: i for i, w in reversed(list(enumerate(words)))}
        # a word begins with its stem, but for an i that was a y, an e put there, and ble or bl that was bili
        begins = {w[: len(w) - n] for w in words for n in range(3) if n < len(w) and (n == 0 or w.endswith(("i", "e", "bl") if n == 1 else "ble"))}
        self.begins = {n: pa.array(sorted(b for b in begins if len(b) == n), pa.string()) for n in sorted(set(map(len, begins)))}


#: Words whose stems are known whole, and how words end that aren't their own stems.
_OWN, _ENDS = pa.array([*CONTRACTIONS, *IRREGULAR]), f"(?:{'|'.join(ENDS)})$"


def places(words: Callable[[pa.Array], pa.ListArray], texts: pa.Array, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of a slice of parts(), as far as they are wanted: for each its text's row and its place; and how many words each text has in all.

    Of stemmed() only words are stemmed that can become a wanted one.
    """
    lists = _lists(texts, True) if words is stemmed else words(texts)
    row, dl = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.value_lengths().to_numpy()
    if words is not stemmed:
        place = pc.index_in(lists.flatten(), value_set=wanted.words).fill_null(-1).to_numpy()
        return row[place >= 0], place[place >= 0], dl
    coded = lists.flatten().dictionary_encode()
    names, index = coded.dictionary, coded.indices.to_numpy()
    own = pc.is_in(names, value_set=_OWN).to_numpy(zero_copy_only=False)
    ending = np.flatnonzero(pc.match_substring_regex(names, _ENDS).to_numpy(zero_copy_only=False))
    some, near = names.take(pa.array(ending)), np.zeros(len(ending), bool)
    for n, begins in wanted.begins.items():
        near |= pc.is_in(pc.utf8_slice_codeunits(some, 0, n), value_set=begins).to_numpy(zero_copy_only=False)
    # a word is one stem, or none as a stop word; a contraction is up to two
    size = (~pc.is_in(names, value_set=pa.array(ENGLISH)).to_numpy(zero_copy_only=False)).astype(np.int64)
    place = np.full((2, len(names)), -1, np.int32)
    place[0] = pc.index_in(names, value_set=wanted.words).fill_null(-1).to_numpy()
    place[0, ending] = place[0, size == 0] = place[0, own] = -1
    at = np.union1d(ending[near], np.flatnonzero(own))
    at = at[(size[at] > 0) | own[at]]
    for i, word in zip(at, names.take(pa.array(at)).to_pylist(), strict=True):
        stems = _stems(word)
        size[i] = len(stems)
        place[: len(stems), i] = [wanted.at.get(s, -1) for s in stems]
    dl = np.bincount(row, size[index], len(lists)).astype(np.int32)
    found = [np.flatnonzero(p[index] >= 0) for p in place]
    return np.concatenate([row[f] for f in found]), np.concatenate([p[index[f]] for p, f in zip(place, found, strict=True)]), dl


def slices(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of `size` tokens, one blank between them: for each its text's place in the slice of parts(), its number there, and what it says."""
    lists = tokens(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    n = -(-np.diff(ends) // size)
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.append(ends[row] + number * size, ends[-1]).astype(np.int32)
    return row, number, pc.binary_join(pa.ListArray.from_arrays(pa.array(begin), lists.values), " ")
