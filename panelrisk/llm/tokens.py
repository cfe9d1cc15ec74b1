"""Token ids of a byte-level BPE vocabulary for whole Arrow columns.

The ids are those of the ``tokenizers`` library: its BPE model encodes every
distinct pre-token it has not met before, once per worker; the pre-tokens are
found and looked up with whole-array operations. A byte-level BPE never merges
across pre-tokens, so the ids of a text are those of its pre-tokens in order
(the tests compare both ways over whole texts). A text that holds the string of
one of the vocabulary's added tokens is given to the library whole, which finds
those first.

Pre-token rule (fixed, part of the vocabulary file): an English contraction
suffix; or an optional space and a run of letters, of numbers, or of other
characters that are not white space; or white space, whose last character is
left to what follows it.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from panelrisk.llm.textbytes import span_hashes, text_blocks

CACHE_PIECES, CACHE_IDS = 1 << 19, 1 << 21  # what a worker remembers of a vocabulary at most, but for one run of texts
TEXT_BYTES = 1 << 19  # texts that are encoded at once

# fixed values: white space of the pre-token rule
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[_WHITE] = _SPACE
    return table


def piece_starts(codes: np.ndarray, row_edge: np.ndarray) -> np.ndarray:
    """True where a pre-token begins, for code points of rows laid end to end.

    ``row_edge`` is True at the first character of every row.
    """
    kind = _classes()[codes]
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=bool)
    prev = np.r_[np.uint8(255), kind[:-1]]
    prev[row_edge] = 255
    begins = kind != prev  # a run begins
    after = np.r_[kind[1:], np.uint8(255)]
    row_ends = np.r_[row_edge[1:], True]
    after[row_ends] = 255
    solid_next = (after != 255) & (after != _SPACE)
    last_white = (kind == _SPACE) & solid_next  # the white space character that is left to what follows
    start = begins | last_white
    # a plain space joins the run after it
    joined = np.r_[False, (last_white & (codes == 0x20))[:-1]]
    start &= ~joined
    return _contractions(codes, kind, start, row_edge)


def _contractions(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, row_edge: np.ndarray) -> np.ndarray:
    """Split 's 't 're 've 'm 'll 'd off where a pre-token begins with an apostrophe."""
    marks = np.flatnonzero((codes == 0x27) & start)
    n = len(codes)
    for i in marks.tolist():
        stop = i + 1
        while stop < min(n, i + 3) and not row_edge[stop]:
            stop += 1
        tail = "".join(map(chr, codes[i + 1 : stop].tolist()))
        size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail[:2] in ("re", "ve", "ll") else 0
        if not size:
            continue
        end = i + 1 + size
        start[i + 1 : end] = False
        if end < n and not row_edge[end]:
            # what follows begins anew: the rest of the letters, or a run that began there anyway
            if kind[end] != _SPACE or not start[end]:
                start[end] = True
    return start


class PieceMemory:
    """The ids of the pieces that a worker has met, by the hash of their bytes.

    Beyond ``CACHE_PIECES`` pieces or ``CACHE_IDS`` ids it starts anew, so that a
    worker that goes from stage to stage keeps a few megabytes at most.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int32)  # where the ids of each key begin in ids
        self.size = np.zeros(0, np.int32)
        self.good = np.zeros(0, dtype=bool)
        self.ids = np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, found: list[list[int]], good: list[bool]) -> None:
        size = np.array([len(x) for x in found], np.int32)
        at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        self.ids = np.r_[self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))]
        where = np.searchsorted(self.keys, keys)
        new = (keys, at, size, np.array(good, dtype=bool))
        self.keys, self.at, self.size, self.good = (np.insert(a, where, b) for a, b in zip((self.keys, self.at, self.size, self.good), new))

    def ids_of(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, offsets of the pieces into them, flag of each piece).

        ``learn`` gives the ids and the flags of a list of pieces.
        """
        hashes, where = np.unique(hashes, return_inverse=True)
        known = np.zeros(len(hashes), dtype=bool)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[spot] == hashes
        if not known.all():
            if len(self.keys) + (~known).sum() > CACHE_PIECES or len(self.ids) > CACHE_IDS:
                self._forget()
                known[:] = False
            one = np.zeros(len(hashes), np.int64)
            one[where] = np.arange(len(where))  # an occurrence of each
            new = np.flatnonzero(~known)
            self._add(hashes[new], *learn([data[begin[i] : end[i]].tobytes() for i in one[new]]))
        spot = np.searchsorted(self.keys, hashes)
        size, at = self.size[spot][where].astype(np.int64), self.at[spot][where]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(at - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.r_[0, stop], self.good[spot][where]


class Encoder:
    """Vocabulary with a memory of pre-tokens; one per Python worker and path."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # the vocabulary spells bytes as printable characters: itself where printable, else 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.memory = PieceMemory()

    def _learn(self, pieces: list[bytes]) -> tuple[list[list[int]], list[bool]]:
        model = self.tokenizer.model
        return [[t.id for t in model.tokenize(p.decode("latin-1").translate(self.spelling))] for p in pieces], [True] * len(pieces)

    def with_added(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Row -> ids, for the rows that hold the string of an added token."""
        raw, found = data.tobytes(), {}
        for token in self.added:
            spot = raw.find(token)
            while spot >= 0:
                row = int(np.searchsorted(offsets, spot, side="right")) - 1
                end = int(offsets[row + 1])
                if spot + len(token) > end:  # runs over the row's end
                    spot = raw.find(token, spot + 1)
                    continue
                if row not in found:
                    found[row] = np.array(self.tokenizer.encode(raw[int(offsets[row]) : end].decode(), add_special_tokens=False).ids, np.uint32)
                spot = raw.find(token, end)
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, row offsets into them)."""
        lead = (data & 0xC0) != 0x80  # first byte of a character
        byte_at = np.flatnonzero(lead)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begin = byte_at[piece_starts(codes, edge[byte_at])]
        end = np.r_[begin[1:], len(data)] if len(begin) else begin
        rows = np.searchsorted(begin, offsets)
        ids, at, _ = self.memory.ids_of(span_hashes(data, begin, end), data, begin, end, self._learn)
        return ids, at[rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of every text of a column, in order; null gives none."""
    coder = encoder(path)
    for _, data, offsets in text_blocks(column, TEXT_BYTES):
        ids, at = coder.encode(data, offsets)
        added = coder.with_added(data, offsets)
        for i in range(len(at) - 1):
            yield added[i] if i in added else ids[at[i] : at[i + 1]]
