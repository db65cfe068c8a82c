"""Encoding of texts by pieces, exact for pre-tokenisers that never join over the pieces' borders.

A text is cut at borders that every pre-tokeniser used here has: before a single space, around a single line end, and
between a Latin letter and an ASCII punctuation mark. Each distinct piece is encoded once by the library and kept, so
the library sees every word once, and texts are put together from arrays.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .common import BYTE_VALUE, PLACE, mix, slices

LETTER, MARK, SPACE, LINE, SOLID = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)                      # 0: not known here, a border is set next to none of these
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
_KIND[32], _KIND[10] = SPACE, LINE
_KIND[[39, *range(48, 58)]] = SOLID                  # the apostrophe, which starts contractions, and digits
_KIND[0xC3:0xE0] = SOLID                             # two-byte characters: none of them is white space
_KIND[0xE4:0xF5] = SOLID                             # nor are these (there are some that start with C2, E1, E2, E3)


def borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every piece. Lower-casing, composing characters and dropping white space don't move these borders:
    Latin letters stay letters, and a mark or white space never combines with a neighbour."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[off] = True
    if n > 2:
        kind = _KIND[data]
        tail = (data & 0xC0) == 0x80                 # later bytes of a character take the kind of its first
        for _ in range(3):
            again = np.flatnonzero(tail[1:]) + 1
            if not len(again):
                break
            kind[again] = np.where(kind[again - 1] == LETTER, SOLID, kind[again - 1])
        latin = data == 0xC3                         # U+00C0 to U+00FF, but for the two signs among them, are letters
        two = np.flatnonzero(latin[:-1])
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = LETTER
        solid = (kind == LETTER) | (kind == MARK) | (kind == SOLID)
        first[1:n - 1] |= (kind[1:-1] == SPACE) & solid[:-2] & solid[2:]
        line = np.flatnonzero((kind[1:-1] == LINE) & solid[:-2] & solid[2:]) + 1
        first[line] = first[line + 1] = True
        first[1:n] |= (kind[:-1] == LETTER) & (kind[1:] == MARK) | (kind[:-1] == MARK) & (kind[1:] == LETTER)
    return np.flatnonzero(first[:n])


class PieceCoder:
    """Texts to ids. ``encode`` gives (ids in a row, number of ids of each) of a list of strings. A text with ``special``
    in it, which may hold a special token, is one piece. Pieces are known by 64-bit hashes; about ``limit`` are kept."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: bytes = b"<|", limit: int = 1_000_000):
        self.encode, self.special, self.limit = encode, special, limit
        self._empty()

    def _empty(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        for lo in range(0, len(strings), 4096):
            ids, length = self.encode(strings[lo:lo + 4096])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used:self.used + len(ids)] = ids
            start = self.used + np.cumsum(length) - length
            self.used += len(ids)
            self.keys = np.concatenate([self.keys, keys[lo:lo + 4096]])
            self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.start, self.length = self.keys[order], self.start[order], self.length[order]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        parts, counts = [], np.zeros(len(off) - 1, np.int64)
        for i, j in slices(off, 2 << 20):
            ids, counts[i:j] = self._slice(data[off[i]:off[j]], off[i:j + 1] - off[i])
            parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), counts

    def _slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        raw = data.tobytes()
        start = borders(data, off)
        if self.special in raw:
            whole = [i for i in range(len(off) - 1) if self.special in raw[off[i]:off[i + 1]]]
            inside = np.isin(np.searchsorted(off, start, "right") - 1, whole) & ~np.isin(start, off)
            start = start[~inside]
        size = np.diff(np.append(start, n))
        place = np.arange(n) - np.repeat(start, size)
        value = BYTE_VALUE[data] * PLACE[place & 63]
        late = np.flatnonzero(place > 63)
        if len(late):
            value[late] ^= mix(place[late].astype(np.uint64))
        value ^= value >> np.uint64(29)
        key = mix(np.add.reduceat(mix(value), start) + size.astype(np.uint64))
        if len(self.keys) > self.limit:
            self._empty()
        unique, at, row = np.unique(key, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(where == len(self.keys)) if not len(self.keys) else np.flatnonzero(
            self.keys[np.minimum(where, len(self.keys) - 1)] != unique)
        if len(new):
            begin = start[at[new]]
            self._learn(unique[new], [raw[b:e].decode("utf-8", "replace") for b, e in zip(begin.tolist(), (begin + size[at[new]]).tolist())])
            where = np.searchsorted(self.keys, unique)
        length = self.length[where][row]
        ends = np.cumsum(length)
        take = np.arange(int(ends[-1])) + np.repeat(self.start[where][row] - (ends - length), length)
        ends = np.concatenate([[0], ends])
        return self.pool[take], np.diff(ends[np.searchsorted(start, off)])


@lru_cache(maxsize=2)
def library_coder(path: str) -> PieceCoder:
    """A coder by the tokenizers library's own file, one per Python worker; no special tokens are added.

    Strings are joined by a special token of the vocabulary, at which the library splits before anything else, and the
    ids are cut there again; a string that may hold a special token itself is encoded alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    border = max(tokenizer.get_added_tokens_decoder().items())
    mark, mark_id = border[1].content, border[0]

    def plain(s: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([s], add_special_tokens=False)[0].ids, np.uint32)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = {i: plain(s) for i, s in enumerate(strings) if "<|" in s}
        got = plain(mark.join("" if i in alone else s for i, s in enumerate(strings)))
        cuts = np.flatnonzero(got == mark_id)
        rows = np.split(got, cuts)
        if not alone:
            return np.delete(got, cuts), np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1
        rows = [alone[i] if i in alone else r[1:] if i else r for i, r in enumerate(rows)]
        return np.concatenate(rows), np.array([len(r) for r in rows])

    return PieceCoder(encode)


def cut_ids(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text as bytes."""
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
    return [raw[e - 4 * c:e] for e, c in zip(ends.tolist(), counts.tolist())]
