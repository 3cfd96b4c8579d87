"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; texts are UTF-8, where those six never occur inside a character. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: bounds the arrays below. A longer text is handled alone, whole.
CHUNK_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """64-bit hashes of byte ranges of one buffer: the sum of one random value for each (place in the range, byte), mixed.

    A value depends on place and byte together, so no regular pattern of bytes cancels out, as it does in polynomials
    modulo 2**64. Ranges are not empty.
    """

    #: Places whose values are looked up; those of later ones are computed. Bytes handled at once.
    PLACES, AT_ONCE = 64, 1 << 22

    def __init__(self, seed: int = 0x9E3779B97F4A7C15) -> None:
        self.seed = np.uint64(seed)
        self.table = self.values(np.arange(self.PLACES << 8))

    def values(self, codes: np.ndarray) -> np.ndarray:
        return mix(codes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + self.seed)

    def sums(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, place: int = 0) -> np.ndarray:
        head = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(head.astype(np.int32), size)
        bytes_ = data[at + np.repeat(starts, size)] if len(data) >= 1 << 31 else data[at + np.repeat(starts.astype(np.int32), size)]
        if place == 0 and size.max() <= self.PLACES:
            value = self.table.take((at << 8) | bytes_)
        else:
            codes = ((at.astype(np.int64) + place) << 8) + bytes_
            value = np.empty(len(codes), np.uint64)
            short = codes < len(self.table)
            value[short], value[~short] = self.table[codes[short]], self.values(codes[~short])
        return np.add.reduceat(value, head)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.zeros(len(size), np.uint64)
        until, i = np.cumsum(size), 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(until, until[i] - size[i] + self.AT_ONCE, side="right")))
            if j == i + 1:  # maybe a long range: in pieces
                for k in range(0, int(size[i]), self.AT_ONCE):
                    out[i:j] += self.sums(data, starts[i:j] + k, np.minimum(size[i:j] - k, self.AT_ONCE), k)
            else:
                out[i:j] = self.sums(data, starts[i:j], size[i:j])
            i = j
        return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Whether range i of data is equal to range i of other; so many bytes are compared at once, or one range."""
    size = ends - starts
    out = size == other_ends - other_starts
    fit = np.flatnonzero(out & ((starts != other_starts) | (data is not other)))
    until, i = np.cumsum(size[fit]), 0
    while i < len(fit):
        j = max(i + 1, int(np.searchsorted(until, until[i] - size[fit[i]] + at_once, side="right")))
        own = fit[i:j]
        if j == i + 1:
            out[own] = np.array_equal(data[starts[own[0]] : ends[own[0]]], other[other_starts[own[0]] : other_ends[own[0]]])
        else:
            wrong = np.flatnonzero(data[ranges(starts[own], size[own])] != other[ranges(other_starts[own], size[own])])
            if len(wrong):
                out[own[np.searchsorted(np.cumsum(size[own]), wrong, side="right")]] = False
        i = j
    return out


def distinct(hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that stand for all: their indexes, and which of them each range is equal to. Equal hashes are compared byte
    by byte; a range that only shares its hash stands for itself."""
    _, where, which = np.unique(hasher(data, starts, ends), return_index=True, return_inverse=True)
    rep = where[which]
    other = np.flatnonzero(~same_bytes(data, starts, ends, data, starts[rep], ends[rep]))
    if len(other):
        which[other] = len(where) + np.arange(len(other))
        where = np.concatenate((where, other))
    return where, which


class Words:
    """starts, ends: of each word in data; first[i]:first[i + 1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and the offsets between them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most ``limit`` bytes of text (or one text), with buffers of their texts."""
    data, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] ... starts[0] + counts[0] - 1, then those of the next, and so on."""
    total = np.cumsum(counts)
    out = np.repeat(starts - np.concatenate(([0], total[:-1])), counts) if len(counts) else np.empty(0, np.int64)
    return out + np.arange(len(out))


class Windows:
    """Hashes of runs of ``width`` words inside one text, from the hashes of the words: neighbours are combined in pairs, pairs in
    fours and so on, and each step is mixed, so runs of few different words are told apart as well as any."""

    _A = np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, seed: int = 0) -> None:
        self.seed = np.uint64(seed)

    def fold(self, words: np.ndarray, width: int) -> np.ndarray:
        """The hash of words[i : i + width] for each i."""
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        level = mix(words + self.seed) if self.seed else words
        out, done, span = None, 0, 1
        while True:
            if width & span:
                part = level[done : done + n]
                out = part if out is None else mix(out * self._A + part)
                done += span
            if done == width:
                return out
            level = mix(level[:-span] * self._A + level[span:])
            span *= 2

    def whole(self, words: np.ndarray) -> np.ndarray:
        """One hash (an array of one) of all words, told from those of other counts."""
        out = np.full(1, len(words), np.uint64)
        for i in range(len(words)):
            out = mix(out * self._A + words[i : i + 1] + self.seed)
        return out

    def __call__(self, words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: its first word, the text it is in, its hash."""
        count = np.maximum(np.diff(first) - width + 1, 0)
        at = ranges(first[:-1], count)
        return at, np.repeat(np.arange(len(count)), count), self.fold(words, width)[at]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[where] > 1


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0
