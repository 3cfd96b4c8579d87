"""Byte-pair encoding of many words at once with the merges of a public vocabulary file.

The file's normaliser lower-cases and drops white space, and its splitter never joins across white space, so the
ids of a text are those of its words on end. Words of printable ASCII and of Latin letters U+00C0 to U+00FF are
merged as arrays, all words of a batch side by side; any other word (also one with an apostrophe or ``<``,
which have rules of their own) goes to the tokenizers library alone. Both give the library's ids.
"""

from __future__ import annotations

import json

import numpy as np

from tidelog.llm.words import Hasher, Words, distinct, ranges, same_bytes

_NONE = np.int32(1 << 30)
#: Pieces whose ids a task remembers; beyond, it starts anew. Bounds memory, not results.
REMEMBERED = 1_000_000
_OTHER, _LETTER, _DIGIT = 0, 1, 2


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordBpe:
    SUFFIX = "</w>"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.SUFFIX] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.hasher = Hasher()
        self.forget()
        self._index(keys)
        safe = np.zeros(256, bool)
        safe[0x21:0x7F] = True
        safe[[0x27, 0x3C]] = False
        safe[0x80:0xC0] = True  # continuation bytes; their leading byte decides
        safe[0xC3] = True
        self.unsafe = ~safe
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.lower[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
        kind = np.full(256, _OTHER, np.int8)
        kind[[*range(65, 91), *range(97, 123), *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = _LETTER
        kind[48:58] = _DIGIT
        self.kind = kind

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing over 2**20 slots: rank by pair."""
        self.shift, size = np.uint64(44), 1 << 20
        self.slot_key, self.slot_rank = np.full(size, 2**64 - 1, np.uint64), np.full(size, _NONE, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.slot_key[at] == 2**64 - 1)
            _, once = np.unique(at[free], return_index=True)
            put = free[once]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b, or a large number."""
        keys = (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (found != 2**64 - 1)
            if not go.any():
                break
            todo, at = todo[go], (at[go] + 1) % len(self.slot_key)
        return out

    def merged(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge within each piece (begins: first symbol of each) until nothing merges: symbols, count by piece."""
        n = len(begins)
        piece = np.arange(n)
        tail = np.zeros(len(symbols), bool)
        tail[np.append(begins[1:], len(symbols)) - 1] = True
        rank = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(~tail)
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        done_piece, done_count, done_symbols = [], [], []
        while len(piece):
            least = np.minimum.reduceat(rank, begins)
            count = np.diff(np.append(begins, len(symbols)))
            live = least < _NONE
            if not live.all():
                over = np.repeat(~live, count)
                done_piece.append(piece[~live])
                done_count.append(count[~live])
                done_symbols.append(symbols[over])
                symbols, tail, rank = symbols[~over], tail[~over], rank[~over]
                piece, count, least = piece[live], count[live], least[live]
                begins = np.cumsum(count) - count
                if not len(piece):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            own = np.searchsorted(begins, at, side="right") - 1
            at = at[np.append(True, own[1:] != own[:-1])]  # the leftmost of each piece
            symbols[at] = self.made[rank[at]]
            tail[at] = tail[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, tail, rank = symbols[keep], tail[keep], rank[keep]
            begins = begins - np.arange(len(begins))
            at = at - np.arange(len(at))
            for where in (at, at[at > begins] - 1):
                ended = tail[where]
                rank[where[ended]] = _NONE
                go = where[~ended]
                rank[go] = self.rank(symbols[go], symbols[go + 1])
        if not done_piece:
            return symbols, np.zeros(0, np.int64)
        piece, count, symbols = np.concatenate(done_piece), np.concatenate(done_count), np.concatenate(done_symbols)
        begin, by_piece = np.empty(n, np.int64), np.empty(n, np.int64)
        begin[piece], by_piece[piece] = np.cumsum(count) - count, count
        return symbols[ranges(begin, by_piece)], by_piece

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes of pieces, in order
        self.known_begin = self.known_count = self.known_at = self.known_size = np.empty(0, np.int64)
        self.known_ids = np.empty(0, np.int32)
        self.known_text = np.empty(0, np.uint8)

    def alone(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, on end, and how many each has."""
        size = ends - begins
        own, stop = text[ranges(begins, size)], np.cumsum(size)
        symbols = self.first[own]
        symbols[stop - 1] = self.last[own[stop - 1]]
        return self.merged(symbols, stop - size)

    def pieces(self, text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased pieces that cover text, on end, and how many each has; each distinct piece is merged once."""
        ends = np.append(begins[1:], len(text))
        keys, where, which = np.unique(self.hasher(text, begins, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        if new.any():
            size = ends[where[new]] - begins[where[new]]
            ids, count = self.alone(text, begins[where[new]], ends[where[new]])
            begin = len(self.known_ids) + np.cumsum(count) - count
            place = len(self.known_text) + np.cumsum(size) - size
            self.known_ids = np.concatenate((self.known_ids, ids))
            self.known_text = np.concatenate((self.known_text, text[ranges(begins[where[new]], size)]))
            self.known_begin = np.insert(self.known_begin, at[new], begin)
            self.known_count = np.insert(self.known_count, at[new], count)
            self.known_at = np.insert(self.known_at, at[new], place)
            self.known_size = np.insert(self.known_size, at[new], size)
            self.known = np.insert(self.known, at[new], keys[new])
            at = np.searchsorted(self.known, keys)
        of = at[which]
        begin, count, ids = self.known_begin[of], self.known_count[of], self.known_ids
        place = self.known_at[of]
        odd = np.flatnonzero(~same_bytes(text, begins, ends, self.known_text, place, place + self.known_size[of]))
        if len(odd):  # other bytes with a known hash
            more, n = self.alone(text, begins[odd], ends[odd])
            begin[odd], count[odd] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate((ids, more))
        return ids[ranges(begin, count)], count

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[starts:ends], on end, and how many each has."""
        n = len(starts)
        odd = np.concatenate(([0], np.cumsum(self.unsafe[data])))
        plain = np.flatnonzero(odd[ends] == odd[starts])
        count = np.zeros(n, np.int64)
        parts: dict[str, np.ndarray] = {}
        if len(plain):
            size = ends[plain] - starts[plain]
            text = data[ranges(starts[plain], size)]
            kind = self.kind[text]
            lead = np.flatnonzero(text == 0xC3)
            kind[lead] = kind[lead + 1]
            begin = np.empty(len(text), bool)
            begin[0] = True
            begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            head = np.cumsum(size) - size
            begin[head] = True
            text = self.lower[text]
            begins = np.flatnonzero(begin)
            ids, by_piece = self.pieces(text, begins)
            word = np.searchsorted(head, begins, side="right") - 1
            count[plain] = np.bincount(word, by_piece, minlength=len(plain)).astype(np.int64)
            parts["plain"] = ids
        rest = np.flatnonzero(odd[ends] != odd[starts])
        if len(rest):
            raw = data.tobytes()
            found = [e.ids for e in self.library.encode_batch_fast([raw[starts[i] : ends[i]].decode("utf-8") for i in rest], add_special_tokens=False)]
            count[rest] = [len(x) for x in found]
            parts["rest"] = np.array([i for x in found for i in x], np.int32)
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        if len(plain):
            out[ranges(at[plain], count[plain])] = parts["plain"]
        if len(rest):
            out[ranges(at[rest], count[rest])] = parts["rest"]
        return out, count

    def texts(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with end_id after it, on end; and how many each text has. Each distinct word is encoded once."""
        w = Words(data, offsets)
        n = len(offsets) - 1
        where, which = distinct(hasher, data, w.starts, w.ends)
        ids, count = self.words(data, w.starts[where], w.ends[where])
        begin = np.cumsum(count) - count
        of_word = count[which]
        flat = ids[ranges(begin[which], of_word)]
        total = np.concatenate(([0], np.cumsum(of_word)))
        by_text = total[w.first[1:]] - total[w.first[:-1]]
        out = np.full(len(flat) + n, end_id, np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(n), by_text)] = flat
        return out, by_text + 1
