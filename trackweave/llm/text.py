"""Vectorised words, shingles and hashes over the bytes of whole Arrow string batches.

All functions work on one flat byte array that holds many texts end to end, so a batch costs a few
numpy passes however many texts it has. Hashes are 64 bits wide and depend on content alone.

Words are hashed eight bytes at a time, each step a bijection of what came before, and long ones by a
cryptographic digest; so no way of building words makes two of them agree (a sum of weighted bytes modulo
2**64 would: a Thue-Morse word and its complement). Where equality has to be certain, :func:`same_spans`
compares the bytes and :func:`exact_shingles` numbers shingles without any hash deciding.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are handled in one go; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Bytes from which a word's hash is a digest.
LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = U64(0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}

_codes = np.arange(256)
_SPACE = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
_FOLD = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """The eight bytes from every place on as one number (zeros after the end), A-Z lower-cased if asked."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = _FOLD[data] if fold else data
    return eights_of(room)


def eights_of(room: np.ndarray) -> np.ndarray:
    """As :func:`eights`, over bytes that have eight to spare at the end; no copy."""
    return np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    lanes, size = eights(data, fold), end - start
    h = mix64(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
    left, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(left):
        rest = size[left] - at
        h[left] = mix64((h[left] ^ (lanes[start[left] + at] & _LANE[np.minimum(rest, 8)])) * _WORD + U64(1))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        raw = data[start[i] : end[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw.lower() if fold else raw, digest_size=8).digest(), "little")
    return h


def same_spans(lanes: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether the spans of two :func:`eights` hold the same bytes, pair by pair."""
    same = size == other_size
    left, at = np.flatnonzero(same & (size > 0) & ((start != other_start) | (lanes is not other))), 0
    while len(left):
        rest = size[left] - at
        agree = ((lanes[start[left] + at] ^ other[other_start[left] + at]) & _LANE[np.minimum(rest, 8)]) == 0
        same[left[~agree]] = False
        left, at = left[agree & (rest > 8)], at + 8
        if at >= LONG:
            for i in left.tolist():
                a, b, n = int(start[i]), int(other_start[i]), int(size[i])
                same[i] = _bytes_of(lanes, a, n) == _bytes_of(other, b, n)
            break
    return same


def _bytes_of(lanes: np.ndarray, start: int, n: int) -> bytes:
    return np.ndarray((n,), np.uint8, lanes.base, start).tobytes()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n+1 powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n + 1:
        size = max(BATCH_BYTES + 1, n + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U64)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the weighted sum of bytes i..j; see :func:`span_hashes`."""
    up, _ = powers(len(data))
    values = _BYTE[data]
    values *= up[: len(data)]
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes wherever they stand.

    For windows of a few hundred bytes at most: longer ones can be built to agree.
    """
    _, down = powers(len(prefix) - 1)
    h = prefix[end] - prefix[start]
    h *= down[start]
    h += (end - start).astype(U64)
    return mix64(h)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null("" if wide == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most ``most`` (BATCH_BYTES) bytes together, or one longer text."""
    most = most or BATCH_BYTES
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run without ASCII white space), and the words of each text."""
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[firsts] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        after[lasts] = False
    end = np.flatnonzero(solid & ~after) + 1
    counts = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    return start, end, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word after lower-casing A-Z, and the words of each text."""
    start, end, counts = words(data, offsets)
    return word_numbers(data, start, end, fold=True), counts


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, text by text, and their offsets. Repeats stay.

    A text of one to n-1 words has its whole sequence as its one shingle; one without words has none.
    """
    w, counts = word_hashes(data, offsets)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(at[-1], U64)
    if len(w) >= n:
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h *= _WORD
            h += w[k : len(w) - n + 1 + k]
        long = counts >= n
        text = np.repeat(np.flatnonzero(long), many[long])
        place = np.arange(len(text)) - np.repeat(np.cumsum(many[long]) - many[long], many[long])
        out[at[text] + place] = h[first[text] + place]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            h = w[first[short]].copy()
            for k in range(1, m):
                h *= _WORD
                h += w[first[short] + k]
            out[at[short]] = h ^ U64(m)
    return mix64(out), at


def exact_shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """For every text the ascending distinct numbers of its n-word shingles.

    Numbers are those of this column: equal shingles have equal ones and others don't, by the words'
    bytes. Shorter texts as in :func:`shingles`.
    """
    data, offsets = flat(column)
    start, end, counts = words(data, offsets)
    _, first, codes = np.unique(word_numbers(data, start, end, fold=True), return_index=True, return_inverse=True)
    lanes, size = eights(data, fold=True), end - start
    if not same_spans(lanes, start, size, lanes, start[first[codes]], size[first[codes]]).all():
        numbers: dict[bytes, int] = {}
        codes = np.array([numbers.setdefault(data[i:j].tobytes().lower(), len(numbers)) for i, j in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    # rows of n words, one row a shingle; a short text's missing words are a number of their own
    base = int(codes.max(initial=-1)) + 2
    before = np.concatenate(([0], np.cumsum(counts)))
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate(([0], np.cumsum(many)))
    place = np.arange(at[-1]) - np.repeat(at[:-1] - before[:-1], many)
    stop = np.repeat(before[1:], many)
    padded = np.append(codes.astype(np.int64), np.full(n, base - 1))
    out = padded[place]
    for k in range(1, n):
        out = np.unique(out, return_inverse=True)[1] * base + np.where(place + k < stop, padded[place + k], base - 1)
    return [np.unique(out[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def tidy(run: Callable) -> Callable:
    """The batch function, which also gives freed memory back when its partition is done.

    Workers live on between tasks, and allocators keep what was freed; without this an executor's
    workers add up the peaks of all stages they ever ran.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
