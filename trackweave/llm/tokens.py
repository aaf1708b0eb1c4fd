"""Token ids of whole texts with the public tokenizers, each distinct piece encoded once.

A byte-pair encoder never merges across its pre-tokenizer's cuts. A text is therefore split at places
where both vocabularies' pre-tokenizers certainly cut (:func:`units`), every distinct unit is encoded
once by the tokenizers library and remembered under a 64-bit hash of its bytes, and a text's ids are
the joined ids of its units. A unit takes remembered ids only where its bytes are those remembered with
them; should hashes agree where bytes don't, the texts at hand go to the library whole, as texts with
white space beyond ASCII always do.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from trackweave.llm import text as tx

#: Distinct units that a worker remembers before it starts afresh; bounds memory, never results.
REMEMBERED = 800_000
#: Bytes of units that it remembers, a batch's units aside.
REMEMBERED_BYTES = 32 << 20

#: White space other than the ASCII kinds, and controls on which libraries disagree.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

_c = np.arange(256)
_WS = (_c == 0x20) | ((_c >= 0x09) & (_c <= 0x0D))
_LETTER = ((_c >= 65) & (_c <= 90)) | ((_c >= 97) & (_c <= 122))
_DIGIT = (_c >= 48) & (_c <= 57)
# Classes of bytes: 0 space, 1 other white space, 2 letter, 3 digit, 4 apostrophe, 5 other ASCII, 6 beyond ASCII.
_CLASS = np.select([_c == 0x20, _WS, _LETTER, _DIGIT, _c == 0x27, _c < 128], [0, 1, 2, 3, 4, 5], 6).astype(np.uint8)
_CUT = np.zeros((8, 8), bool)
_CUT[2:7, 0:2] = True  # solid, then white space
_CUT[1, 2:7] = True  # white space that isn't a space, then solid
_CUT[2, 3:6] = _CUT[3, [2, 4, 5]] = True  # letter or digit, then another kind of ASCII
_CUT[5, 2:4] = True  # punctuation other than the apostrophe, then letter or digit
_CUT = _CUT.ravel()


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start in the bytes of texts that lie end to end; every text starts one.

    Cuts fall between solid and white, between ASCII letters, digits and punctuation (never after an
    apostrophe), and before the last character of white space that leads to something solid.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    cut[1:] = _CUT[(kind[:-1] << 3) | kind[1:]]
    # the last character of a run of white space that leads to something solid
    inner = np.flatnonzero((kind[1:-1] < 2) & (kind[:-2] < 2) & (kind[2:] >= 2)) + 1
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    cut[inner[~first[inner + 1]]] = True
    cut |= first[:-1]
    return np.flatnonzero(cut)


class Places:
    """Positions of 64-bit hashes in order of arrival: an open-addressed table of flat arrays."""

    def __init__(self, most: int):
        size = 1 << max(10, (2 * most - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)  # 0 is free
        self.values = np.zeros(size, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of every hash, -1 for unknown ones. Hashes are not 0."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray) -> None:
        """New, distinct hashes get the next positions in their order."""
        value = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        left, slot = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]] = h[left[won]]
            self.values[slot[won]] = value[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, slot = left[on], (slot[on] + 1) & int(self.mask)


class Encoder:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.places = Places(REMEMBERED)
        self.pool = np.zeros(1 << 16, self.width)
        self.at = np.zeros(1 << 16, np.int64)
        # the remembered units' bytes, end to end, and where each starts
        self.raw = np.zeros(1 << 16, np.uint8)
        self.raw_at = np.zeros(1 << 16, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids."""
        data, offsets = tx.flat(column)
        ids, counts = [], []
        for i, j in tx.pieces(offsets):
            some, n = self._piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(some)
            counts.append(n)
        at = np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else []))).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, self.width), at

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        high = _CLASS[data] == 6
        odd = []
        if high.any() or ((data >= 0x1C) & (data <= 0x1F)).any():
            for k in range(n):
                if _ODD.search(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")):
                    odd.append(k)
        start = units(data, offsets)
        if not len(start):
            return np.zeros(0, self.width), np.zeros(n, np.int64)
        end = np.append(start[1:], len(data))
        codes, distinct = pd.factorize(tx.word_numbers(data, start, end) | tx.U64(1))
        # codes count up in order of appearance
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
        lanes, size = tx.eights(data), end - start
        if not tx.same_spans(lanes, start, size, lanes, start[first[codes]], size[first[codes]]).all():
            return self._all_whole(data, offsets)
        if self.raw_at[self.places.n] > REMEMBERED_BYTES:
            self._forget()
        where = self.places.find(distinct)
        known = np.flatnonzero(where >= 0)
        at, own = where[known], first[known]
        if not tx.same_spans(lanes, start[own], size[own], tx.eights_of(self.raw), self.raw_at[at], self.raw_at[at + 1] - self.raw_at[at]).all():
            return self._all_whole(data, offsets)
        fresh = np.flatnonzero(where < 0)
        if len(fresh):
            if self.places.n and self.places.n + len(fresh) > REMEMBERED:
                self._forget()
                fresh = np.arange(len(distinct))
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[i:j] for i, j in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            where = self.places.find(distinct)
        where = where[codes]
        lengths = self.at[where + 1] - self.at[where]
        of_unit = np.cumsum(lengths) - lengths
        ids = self.pool[np.arange(lengths.sum()) + np.repeat(self.at[where] - of_unit, lengths)]
        bounds = np.searchsorted(start, offsets)
        total = np.append(of_unit, len(ids))[bounds]
        if odd:
            again = self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in odd])
            parts = [ids[a:b] for a, b in zip(total[:-1], total[1:], strict=True)]
            for k, x in zip(odd, again, strict=True):
                parts[k] = np.array(x, self.width)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(total)

    def _all_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
        counts = np.array([len(f) for f in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.width, int(counts.sum())), counts

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        texts = [r.decode("utf-8", "replace") for r in raw]
        n = self.places.n
        stop = self.raw_at[n] + np.cumsum([len(r) for r in raw])
        self.raw_at = _room(self.raw_at, n + 1 + len(stop))
        self.raw_at[n + 1 : n + 1 + len(stop)] = stop
        self.raw = _room(self.raw, int(stop[-1]) + 8)
        self.raw[self.raw_at[n] : stop[-1]] = np.frombuffer(b"".join(raw), np.uint8)
        if n + len(hashes) > REMEMBERED:
            self.places = Places(n + len(hashes))
        self.places.add(hashes)
        found = []
        for i in range(0, len(texts), 4096):
            found += self.whole(texts[i : i + 4096])
        ends = self.at[n] + np.cumsum([len(f) for f in found])
        self.at = _room(self.at, n + 1 + len(ends))
        self.at[n + 1 : n + 1 + len(ends)] = ends
        self.pool = _room(self.pool, int(ends[-1]))
        self.pool[self.at[n] : ends[-1]] = np.fromiter(chain.from_iterable(found), self.width, int(ends[-1] - self.at[n]))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy that has room for n."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 3 * len(a) // 2), a.dtype)
    out[: len(a)] = a
    return out


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(file)
