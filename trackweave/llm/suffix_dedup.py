"""Suffix-array deduplication: bytes that lie in a string of ``LEAST`` bytes seen earlier are removed.

The core is the common-prefix interval tree of an enhanced suffix array: suffixes in order, the lengths
of the prefixes that neighbours share, and one scan with a stack that closes an interval wherever the
shared length drops. An interval whose members differ in what stands to their left is a maximal repeat
with all its occurrences. :func:`maximal_repeats` does this for texts at hand, :func:`repeat_groups` for a
table, and :func:`with_spans` takes from such groups which bytes repeat.

Over a table, the suffix array is sparse and dealt out by content. Every string of LEAST bytes has an
anchor in it, the k-gram of least hash, which depends on the string alone; so equal strings meet at
equal anchors, and only suffixes at anchors are sorted, each with the bytes around it in which such a
string can lie. For an anchor's suffixes, every interval of the tree gives the length R shared to the
right; its members ordered by what stands to their left make a tree of left extensions, whose intervals of
length L that differ on both sides are the groups; of those with L + R >= LEAST, all occurrences but the
first are marked. Anchors that occur once cost one row.

An anchor's row carries a hash of those surroundings. Of equal surroundings all but the earliest are
repeats as a whole, which settles the inside of repeated passages without their bytes: in each task
first, then over all. Bytes are fetched for the earliest of surroundings that differ at one anchor.
An anchor with more than ``HOT`` of those is split into its single strings of LEAST bytes, each with a
key of its own, so no task gathers it. The texts are shuffled once, by document.

Defined results: null text is empty; "earlier" is a smaller doc_id (null first; equal ids by a hash of
the text), then an earlier start; rows equal in doc_id and text are one document and get one result
each; a very long text is looked at stretch by stretch, each with the bytes around it, which gives the same
anchors; matches never cross documents; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import store
from trackweave.llm import text as tx

LEAST = 100
#: Bytes of an anchor; a string of LEAST bytes has LEAST - GRAM + 1 of them to choose from.
GRAM = 24
#: Occurrences of an anchor in all, or in one chunk of a task, above which it is split by strings.
HOT, HOT_CHUNK = 20_000, 2_000
CHUNK_ANCHORS, CHUNK_ROWS = 1_000_000, 40_000


_LEFT = LEAST - GRAM
_WIDE = _LEFT + LEAST


# -- the enhanced suffix array


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of numbers in order, by doubling the sorted prefix."""
    rank = np.unique(data, return_inverse=True)[1].astype(np.int64) if len(data) else np.zeros(0, np.int64)
    step = 1
    while len(data):
        behind = np.full(len(data), -1, np.int64)
        behind[: len(data) - step] = rank[step:] if step < len(data) else behind[:0]
        order = np.lexsort((behind, rank))
        new = np.ones(len(data), np.int64)
        new[0] = 0
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        if rank.max() == len(data) - 1:
            return order
        step *= 2
    return np.zeros(0, np.int64)


def shared_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How much each suffix shares with the one before it in order (0 for the first)."""
    n = len(data)
    rank, out, h = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    rank[order] = np.arange(n)
    values = data.tolist()
    for i in range(n):
        if rank[i]:
            j = int(order[rank[i] - 1])
            while i + h < n and j + h < n and values[i + h] == values[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def intervals(shared: list[int], least: int = 1) -> Iterator[tuple[int, int, int]]:
    """The nodes (length, first, last) of the common-prefix interval tree, children before parents.

    One scan with a stack of open intervals; those shorter than ``least`` are never opened.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(shared) + 1):
        now = shared[i] if i < len(shared) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of ``least`` bytes or more: its length, and all its (text, offset)."""
    parts, starts, at = [], [], 0
    for k, t in enumerate(texts):
        parts.append(np.append(np.frombuffer(t, np.uint8).astype(np.int64), 256 + k))  # each text ends in a sign of its own
        starts.append(at)
        at += len(t) + 1
    data = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = suffix_array(data)
    out = []
    for length, first, last in intervals(shared_prefixes(data, order).tolist(), least):
        where = np.sort(order[first : last + 1])
        before = {int(data[w - 1]) if w else -1 for w in where}
        if len(before) > 1 or before & {-1} or any(b >= 256 for b in before):
            text = np.searchsorted(starts, where, side="right") - 1
            out.append((length, [(int(k), int(w - starts[k])) for k, w in zip(text, where, strict=True)]))
    return out


def removed_by(repeats: list[tuple[int, list[tuple[int, int]]]], texts: list[bytes]) -> list[np.ndarray]:
    """Which bytes of each text lie in an occurrence of a repeat that isn't the repeat's first."""
    out = [np.zeros(len(t), bool) for t in texts]
    for length, where in repeats:
        for k, at in sorted(where)[1:]:
            out[k][at : at + length] = True
    return out


# -- anchors


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for every i, by doubling; the result is width - 1 shorter."""
    done = 1
    while 2 * done <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _least_grams(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k-gram at each place, and the least hash in the LEAST bytes from each place."""
    at = np.arange(len(prefix) - GRAM)
    grams = tx.span_hashes(prefix, at, at + GRAM)
    return grams, _slide(grams, LEAST - GRAM + 1, np.minimum)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the bytes of texts end to end that are the anchor of some LEAST bytes, and their hashes;
    and the prefix hashes of the bytes."""
    n, choice = len(data), LEAST - GRAM + 1
    prefix = tx.prefix_hashes(data)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), prefix
    grams, least = _least_grams(prefix)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[np.arange(len(least)) + LEAST > ends] = 0
    padded = np.concatenate((np.zeros(choice - 1, np.uint64), least, np.zeros(choice - 1, np.uint64)))
    chosen = np.flatnonzero((_slide(padded, choice, np.maximum) == grams) & (grams > 0))
    return chosen, grams[chosen], prefix


def _surroundings(prefix, place, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the bytes around each place in its text, and how many stand left and right."""
    left, right = np.minimum(place - start, _LEFT), np.minimum(end - place, LEAST)
    return tx.mix64(tx.span_hashes(prefix, place - left, place + right) ^ (left * 1000 + right).astype(np.uint64)).view(np.int64), left, right


# Rows of ANCHORS. ``way`` says where a row is sent, ``spot`` what it is: 256 * pos + right of an anchor;
# MARK: the anchor is hot; below that: -2 - pos of a hot anchor; SPAN: bytes [anchor, ctx) are repeats.
ANCHORS = "way bigint, anchor bigint, ctx bigint, id bigint, tie bigint, spot bigint"
MARK, SPAN = -1, -(1 << 62)
OCCURRENCES = "anchor bigint, ctx bigint, id bigint, tie bigint, spot bigint"


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs [i, j) of texts and their bytes [first, last): whole texts, or a stretch of one longer text."""
    for i, j in tx.pieces(offsets):
        first, last = int(offsets[i]), int(offsets[j])
        step = tx.BATCH_BYTES if j == i + 1 else last - first
        for at in range(first, last, max(1, step)):
            yield i, j, at, min(last, at + step)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Every anchor: its hash, its surroundings', id, tie, pos, bytes to the right, and a number of its document."""
    docs = 0
    for b in batches:
        data, offsets = tx.flat(b.column("text"))
        ids, ties = b.column("id").to_numpy(), b.column("tie").to_numpy()
        for i, j, first, last in _stretches(offsets):
            # all strings of LEAST bytes that an anchor in the stretch can be in, and its surroundings
            low, high = max(int(offsets[i]), first - _WIDE), min(int(offsets[j]), last + _WIDE)
            own = offsets[i : j + 1] - low
            place, h, prefix = anchors(data[low:high], np.clip(own, 0, high - low))
            inside = (place >= first - low) & (place < last - low)
            place, h = place[inside], h[inside]
            text = np.searchsorted(own, place, side="right") - 1
            ctx, _, right = _surroundings(prefix, place, own[text], own[text + 1])
            yield h.view(np.int64), ctx, ids[i + text], ties[i + text], place - own[text], right, docs + i + text
        docs += b.num_rows


def _every_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for anchor, ctx, ids, ties, pos, right, _ in _anchored(batches):
        yield from _rows(anchor, ctx, ids, ties, 256 * pos + right, names=OCCURRENCES)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for found in _anchored(batches):
        held.append(found)
        size += len(found[0])
        if size > CHUNK_ANCHORS:
            yield from _anchor_batches(held)
            held, size = [], 0
    if size:
        yield from _anchor_batches(held)


def _anchor_batches(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    anchor, ctx, ids, ties, pos, right, doc = (np.concatenate([h[i] for h in held]) for i in range(7))
    first, later = _earliest(ctx, ids, ties, pos)
    at, begin, stop = _joined(doc[later], (pos - np.minimum(pos, _LEFT))[later], (pos + right)[later])
    number = np.full(int(doc.max()) + 1, -1)
    number[doc] = np.arange(len(doc))
    at = number[at]
    yield from _rows(ids[at], begin, stop, ids[at], ties[at], np.full(len(at), SPAN))
    anchor, ctx, ids, ties, pos, right = (x[first] for x in (anchor, ctx, ids, ties, pos, right))
    way, spot = anchor, 256 * pos + right
    distinct, of, many = np.unique(anchor, return_inverse=True, return_counts=True)
    if (many > HOT_CHUNK).any():
        hot = (many > HOT_CHUNK)[of]
        way, spot = np.where(hot, ids, anchor), np.where(hot, -2 - pos, spot)
        marks = distinct[many > HOT_CHUNK]
        none = np.zeros(len(marks), np.int64)
        yield from _rows(marks, marks, none, none, none, none + MARK)
    yield from _rows(way, anchor, ctx, ids, ties, spot)


def _rows(*cols: np.ndarray, names: str = ANCHORS) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cols[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000].astype(np.int64)) for c in cols], [c.split()[0] for c in names.split(", ")])


#: first and last: a repeated span; or a place and COLD or BURNING, to be looked at with its bytes.
FOUND = "id bigint, tie bigint, first bigint, last bigint"
COLD, BURNING = -1, -2


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows from ANCHORS rows sorted by anchor, ctx, id, tie, spot."""
    rest: list[np.ndarray] | None = None
    hot_on: int | None = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("anchor", "ctx", "id", "tie", "spot")]
        if rest is not None:
            cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        last = int(cut[-1]) + 1 if len(cut) else 0
        yield from _found([c[:last] for c in cols], hot_on)
        rest = [c[last:] for c in cols]
        if last:
            hot_on = None
        if len(rest[0]) > HOT:
            hot_on = int(rest[0][0])
            yield from _found(rest, hot_on)
            rest = [c[:0] for c in rest]
    if rest is not None:
        yield from _found(rest, hot_on)


def _found(cols: list[np.ndarray], hot_on: int | None) -> Iterator[pa.RecordBatch]:
    anchor, ctx, ids, ties, spot = cols
    out = []
    span, direct = spot == SPAN, (spot < MARK) & (spot != SPAN)
    out.append((ids[span], ties[span], anchor[span], ctx[span]))
    out.append((ids[direct], ties[direct], -2 - spot[direct], np.full(int(direct.sum()), BURNING)))
    r = np.flatnonzero(spot >= MARK)
    if len(r):
        anchor, ctx, ids, ties, spot = (c[r] for c in cols)
        real = spot != MARK
        start = np.diff(anchor, prepend=anchor[0] ^ 1) != 0
        run = np.cumsum(start) - 1
        hot = np.bincount(run, weights=~real)[run] > 0
        if hot_on is not None:
            hot |= anchor == hot_on
        new = start.copy()
        new[1:] |= ctx[1:] != ctx[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        same = (ids == ids[head]) & (ties == ties[head]) & (spot == spot[head])
        kinds = np.bincount(run, weights=new & real)[run]
        pos, right = spot >> 8, spot & 255
        look = real & new & ~hot & (kinds > 1)
        out.append((ids[look], ties[look], pos[look], np.full(int(look.sum()), COLD)))
        later = real & ~new & ~same & ~hot
        out.append((ids[later], ties[later], (pos - np.minimum(pos, _LEFT))[later], (pos + right)[later]))
        burning = real & hot
        out.append((ids[burning], ties[burning], pos[burning], np.full(int(burning.sum()), BURNING)))
    yield from _rows(*(np.concatenate([o[i] for o in out]) for i in range(4)), names=FOUND)


# -- what stands around repeated anchors


AROUND = "way bigint, kind int, id bigint, tie bigint, pos int, left int, right int, around binary"


def _around(batches: Iterator[pa.RecordBatch], merge: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of AROUND. kind 0: an anchor with its surroundings; 1: one string of LEAST bytes of a hot one,
    the earliest that this task has (without ``merge`` all whose own anchor is hot); 2: repeated bytes
    [pos, pos + right).
    """
    spots, strings = [], []
    size = 0
    for b in batches:
        data, offsets = tx.flat(b.column("text"))
        ids, ties = b.column("id").to_numpy(), b.column("tie").to_numpy()
        doc, begin, stop = _unnested(b.column("spans"), "first", "last")
        doc, begin, stop = _joined(doc, begin, stop)
        yield from _around_batches(2, ids[doc], ids[doc], ties[doc], begin, begin * 0, stop - begin, None)
        lists = b.column("spots")
        counts = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        first = np.concatenate(([0], np.cumsum(counts)))
        for i, j in tx.pieces(offsets):
            spot = values[first[i] : first[j]]
            if not len(spot):
                continue
            at, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            text = np.repeat(np.arange(i, j), counts[i:j])
            start, end = own[text - i], own[text - i + 1]
            place = start + (spot >> 1)
            hot = (spot & 1).astype(bool)
            if (~hot).any():
                p, s, e, t = place[~hot], start[~hot], end[~hot], text[~hot]
                left, right = np.minimum(p - s, _LEFT), np.minimum(e - p, LEAST)
                around = np.zeros((len(p), _WIDE), np.uint8)
                where = p[:, None] + np.arange(-_LEFT, LEAST)
                inside = (where >= (p - left)[:, None]) & (where < (p + right)[:, None])
                around[inside] = at[where[inside]]
                grams = np.ascontiguousarray(around[:, _LEFT : _LEFT + GRAM])
                anchor = tx.span_hashes(tx.prefix_hashes(grams.ravel()), np.arange(len(p)) * GRAM, np.arange(1, len(p) + 1) * GRAM)
                spots.append((anchor.view(np.int64), ids[t], ties[t], p - s, left, right, around))
                size += len(p)
            if hot.any():
                p, s, e, t = place[hot], start[hot], end[hot], text[hot]
                begin = (p[:, None] - np.arange(_LEFT + 1)).ravel()
                t, s, e = np.repeat(t, _LEFT + 1), np.repeat(s, _LEFT + 1), np.repeat(e, _LEFT + 1)
                fits = (begin >= s) & (begin + LEAST <= e)
                begin, one = np.unique(begin[fits], return_index=True)
                t, s = t[fits][one], s[fits][one]
                for first_byte in range(0, len(at), tx.BATCH_BYTES):
                    k = slice(*np.searchsorted(begin, (first_byte, first_byte + tx.BATCH_BYTES)))
                    if k.stop > k.start:
                        prefix = tx.prefix_hashes(at[first_byte : first_byte + tx.BATCH_BYTES + LEAST])
                        own_begin, doc, pos = begin[k] - first_byte, t[k], begin[k] - s[k]
                        if not merge:
                            grams, least = _least_grams(prefix)
                            near = p[(p >= first_byte) & (p < first_byte + len(grams))] - first_byte
                            kept = np.isin(least[own_begin], grams[near])
                            own_begin, doc, pos = own_begin[kept], doc[kept], pos[kept]
                        strings.append((tx.span_hashes(prefix, own_begin, own_begin + LEAST), ids[doc], ties[doc], pos))
                size += len(begin) // 8
        if size > 2 * CHUNK_ROWS:
            yield from _merged(spots, strings, merge)
            spots, strings, size = [], [], 0
    yield from _merged(spots, strings, merge)


def _unnested(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Row numbers and fields of a list-of-struct column's items."""
    items = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, *(items.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def _earliest(h, ids, ties, pos) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the earliest of equal h, and of later ones (those equal to the earliest are dropped)."""
    order = np.lexsort((pos, ties, ids, h))
    h, ids, ties, pos = (x[order] for x in (h, ids, ties, pos))
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (ids == ids[head]) & (ties == ties[head]) & (pos == pos[head])
    return order[new], order[~same]


def _merged(spots: list, strings: list, merge: bool) -> Iterator[pa.RecordBatch]:
    if spots:
        yield from _around_batches(0, *(np.concatenate([s[i] for s in spots]) for i in range(7)))
    if strings:
        h, ids, ties, pos = (np.concatenate([s[i] for s in strings]) for i in range(4))
        first, later = _earliest(h, ids, ties, pos) if merge else (np.arange(len(h)), np.zeros(0, np.int64))
        for kind, at, way in ((1, first, h.view(np.int64)), (2, later, ids)):
            yield from _around_batches(kind, way[at], ids[at], ties[at], pos[at], np.zeros(len(at), np.int64), np.full(len(at), LEAST), None)


def _around_batches(kind, way, ids, ties, pos, left, right, around) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(way), 20_000):
        s = slice(i, i + 20_000)
        n = len(way[s])
        blob = pa.nulls(n, pa.binary()) if around is None else pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * _WIDE).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(around[s]))])
        yield pa.RecordBatch.from_arrays([pa.array(way[s], pa.int64()), pa.array(np.full(n, kind, np.int32)), pa.array(ids[s], pa.int64()), pa.array(ties[s], pa.int64()), *(pa.array(x[s].astype(np.int32)) for x in (pos, left, right)), blob], [c.split()[0] for c in AROUND.split(", ")])


# -- the sparse suffix array of each anchor


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of AROUND rows sorted by kind and way, rows of one kind and way together."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        blobs = np.zeros((b.num_rows, _WIDE), np.uint8)
        column = b.column("around")
        full = column.is_valid().to_numpy(zero_copy_only=False)
        if full.any():
            blobs[full] = tx.flat(column.filter(column.is_valid()))[0].reshape(-1, _WIDE)
        cols = [*(b.column(c).to_numpy() for c in ("kind", "way", "id", "tie", "pos", "left", "right")), blobs]
        if rest is not None:
            cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)]
        cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        last = int(cut[-1]) + 1 if len(cut) else 0
        if last >= CHUNK_ROWS // 2:
            yield [c[:last] for c in cols]
            rest = [c[last:] for c in cols]
        else:
            rest = cols
    if rest is not None:
        yield rest


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, tie, first, last: bytes that repeat something earlier, from AROUND rows sorted by kind and way."""
    for cols in _chunks(batches):
        yield _span_batch(cols)


def _span_batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    kind, way, ids, ties, pos, left, right, around = cols
    two = np.flatnonzero(kind == 2)
    done = [(two, pos[two], pos[two] + right[two])]
    one = np.flatnonzero(kind == 1)
    later = one[_earliest(way[one], ids[one], ties[one], pos[one])[1]]
    done.append((later, pos[later], pos[later] + LEAST))
    zero = np.flatnonzero(kind == 0)
    if len(zero):
        row, l, r = anchored_repeats(way[zero], ids[zero], ties[zero], pos[zero], left[zero], right[zero], around[zero])
        at = zero[row]
        done.append((at, pos[at] - l, pos[at] + r))
    at, first, last = (np.concatenate([d[i] for d in done]).astype(np.int64) for i in range(3))
    doc = np.zeros(len(kind), np.int64)
    order = np.lexsort((ties, ids))
    doc[order] = np.cumsum((np.diff(ids[order], prepend=0) != 0) | (np.diff(ties[order], prepend=0) != 0))
    number = np.zeros(len(kind) + 2, np.int64)
    number[doc] = np.arange(len(doc))
    doc, first, last = _joined(doc[at], first, last)
    at = number[doc]
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ties[at]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["id", "tie", "first", "last"])


GROUPS = "anchor bigint, id bigint, tie bigint, pos bigint, left bigint, right bigint, group bigint, size bigint"


def _rule(prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For how many places to the left and right of each of n anchors no k-gram has a smaller hash."""
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(0, n, 5_000):
        at = np.arange(i, min(n, i + 5_000))[:, None] * _WIDE + np.arange(_WIDE - GRAM + 1)
        grams = tx.span_hashes(prefix, at.ravel(), at.ravel() + GRAM).reshape(at.shape)
        smaller = grams < grams[:, _LEFT : _LEFT + 1]
        for out, part in ((before, smaller[:, :_LEFT][:, ::-1]), (behind, smaller[:, _LEFT + 1 :])):
            out[i : i + len(at)] = np.where(part.any(axis=1), part.argmax(axis=1), part.shape[1])
    return before, behind


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of GROUPS from AROUND rows sorted by kind and way: each group's occurrences, of surroundings that
    differ; and each of the surroundings as a group of its own (size 1), for those that occur again.

    A group is told only at anchors of strings inside it, since all its occurrences have those.
    """
    for cols in _chunks(batches):
        zero = np.flatnonzero(cols[0] == 0)
        if not len(zero):
            continue
        _, way, ids, ties, pos, left, right, around = (c[zero] for c in cols)
        prefix = tx.prefix_hashes(around.ravel())
        before, behind = _rule(prefix, len(way))
        alone = np.flatnonzero(left + right >= LEAST)
        ones = (alone, np.ones(len(alone), np.int64), left[alone], right[alone])
        for row, sizes, l, r in (ones, *anchored_groups(way, left, right, around)):
            l, r = l.astype(np.int64), r.astype(np.int64)
            member = row[np.cumsum(sizes) - sizes]
            told = np.minimum(before[member], l) + np.minimum(behind[member], r - GRAM) >= LEAST - GRAM
            row, member, sizes, l, r = row[np.repeat(told, sizes)], member[told], sizes[told], l[told], r[told]
            middle = member * _WIDE + _LEFT
            key = tx.span_hashes(prefix, middle - l, middle + r).view(np.int64)
            l, r, key, many = (np.repeat(x, sizes) for x in (l, r, key, sizes))
            yield from _rows(way[row], ids[row], ties[row], pos[row], l, r, key, many, names=GROUPS)


def _joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Overlapping or touching spans of a document made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    new_doc = np.diff(doc, prepend=doc[0] - 1) != 0
    number = np.cumsum(new_doc)
    reach = np.maximum.accumulate(last + number * (1 << 40)) - number * (1 << 40)
    new = new_doc.copy()
    new[1:] |= first[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], first[heads], np.maximum.reduceat(reach, heads)


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of a and b share, ``most`` at most."""
    differ = a != b
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(at, most)


def _left_first(rows: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The order of padded byte rows; of equal ones the shorter first, so that neighbours share the most."""
    return np.argsort(np.ascontiguousarray(np.concatenate((rows, size[:, None].astype(np.uint8)), axis=1)).view(f"S{width + 1}").ravel(), kind="stable")


def anchored_groups(anchor, left, right, around) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal repeats of LEAST bytes or more around equal anchors, each with all its occurrences.

    Yields (rows, sizes, L, R): the groups' occurrences end to end, and for each group how many they are and
    that bytes [pos - L, pos + R) are the repeat. An interval of the tree shares R bytes to the right; its
    members ordered by what stands to their left make a tree of left extensions, in which an interval of
    length L is diverse to the left: its members differ in the byte before, or a text starts there. It is a
    group where they differ behind R too, that is, lie in several children of the right interval. Of groups
    that share R and a member, those with longer L come first.
    """
    big = anchor.astype(">i8").view(np.uint8).reshape(-1, 8)
    rights, lefts = around[:, _LEFT:], around[:, _LEFT - 1 :: -1] if _LEFT else around[:, :0]
    order = _left_first(np.concatenate((big, rights), axis=1), right, 8 + LEAST)
    anchor, left, right, rights, lefts = (x[order] for x in (anchor, left, right, rights, lefts))
    shared = np.zeros(len(order), np.int64)
    both = anchor[1:] == anchor[:-1]
    shared[1:][both] = _agree(rights[1:][both], rights[:-1][both], np.minimum(right[1:][both], right[:-1][both]))
    starts = np.flatnonzero(np.concatenate(([True], ~both)))
    sizes = np.diff(np.append(starts, len(order)))
    # anchors with two occurrences have one interval each
    i = starts[sizes == 2]
    if len(i):
        l, r = _agree(lefts[i], lefts[i + 1], np.minimum(left[i], left[i + 1])), shared[i + 1]
        keep = l + r >= LEAST
        if keep.any():
            yield order[np.stack((i[keep], i[keep] + 1), axis=1).ravel()], np.full(int(keep.sum()), 2), l[keep], r[keep]
    held: list[tuple[np.ndarray, list[int], list[int], list[int]]] = []
    size = 0
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        rank = np.empty(n, np.int64)
        rank[_left_first(lefts[s : s + n], left[s : s + n], _LEFT)] = np.arange(n)
        lengths = shared[s : s + n].copy()
        lengths[0] = 0
        for r, first, last in intervals(lengths.tolist(), GRAM):
            child = np.concatenate(([0], np.cumsum(lengths[first + 1 : last + 1] == r)))
            by_left = np.argsort(rank[first : last + 1])
            own, child = s + first + by_left, child[by_left]
            extends = _agree(lefts[own[1:]], lefts[own[:-1]], np.minimum(left[own[1:]], left[own[:-1]]))
            # one more than what is shared, so that nothing to the left is an interval as well
            found = [(l - 1, i, j + 1) for l, i, j in intervals([0, *(extends + 1).tolist()], LEAST - r + 1) if (child[i : j + 1] != child[i]).any()]
            if found:
                members = np.concatenate([own[i:j] for _, i, j in found])
                held.append((order[members], [j - i for _, i, j in found], [l for l, _, _ in found], [r] * len(found)))
                size += len(members)
            if size > 2 * CHUNK_ROWS:
                yield tuple(np.concatenate([h[k] for h in held]) for k in range(4))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate([h[k] for h in held]) for k in range(4))


def anchored_repeats(anchor, ids, ties, pos, left, right, around) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences of anchors: (row, L, R) where bytes [pos - L, pos + R) repeat an earlier occurrence's.

    These are the occurrences of :func:`anchored_groups` but for each group's first; of the groups that
    share R, the longest L of each occurrence. Every pair that shares LEAST bytes around an anchor is in
    the group of just what the two share, so no other bytes repeat.
    """
    age = np.empty(len(anchor), np.int64)
    age[np.lexsort((pos, ties, ids))] = np.arange(len(anchor))
    out = [(np.zeros(0, np.int64),) * 3]
    for rows, sizes, l, r in anchored_groups(anchor, left, right, around):
        oldest = np.minimum.reduceat(age[rows], np.cumsum(sizes) - sizes)
        later = np.flatnonzero(age[rows] != np.repeat(oldest, sizes))
        group = np.repeat(np.arange(len(sizes)), sizes)[later]
        key, at = np.unique(rows[later] * (LEAST + 1) + r[group], return_index=True)
        out.append((key // (LEAST + 1), l[group[at]], r[group[at]]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


# -- over a table


#: What a missing doc_id counts as: the earliest.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """``docs`` with what tells documents apart (``_id``, and ``_tie`` of equal ids), and whether ids are single."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    single = docs.groupBy(number.alias("id")).count().filter("count > 1").isEmpty()
    # always 0 where ids are single; not a literal, which the optimizer would take out of one join only
    tie = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(1).cast("long")), F.lit(0).cast("long")) if single else F.xxhash64(F.lit(4), F.col("doc_id").isNull(), F.col(text))
    return docs.drop("spans", "_id", "_tie").withColumns({"_id": number, "_tie": tie}), single


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and ``spans``: [first, last) byte ranges, ascending, that repeat something earlier.

    ``docs`` are shuffled once; Spark reuses that exchange for both joins.
    """
    parts = store.partitions_for(docs)
    own, _ = _keyed(docs, text)
    dealt = own.repartition(parts, "_id", "_tie")
    rows = own.select(F.col("_id").alias("id"), F.col("_tie").alias("tie"), F.col(text).alias("text")).filter(F.octet_length("text") >= LEAST).mapInArrow(tx.tidy(_anchor_rows), ANCHORS)
    found = rows.repartition(parts, "way").sortWithinPartitions("anchor", "ctx", "id", "tie", "spot").mapInArrow(tx.tidy(_repeated), FOUND)
    spot = F.when(F.col("last") < 0, 2 * F.col("first") + (F.col("last") == BURNING).cast("long"))
    asked = found.groupBy(F.col("id").alias("_i"), F.col("tie").alias("_t")).agg(F.collect_list(spot).alias("spots"), F.collect_list(F.when(F.col("last") >= 0, F.struct("first", "last"))).alias("spans"))
    # all columns go into both joins, else the two exchanges would differ by what is pruned
    whole = F.hash(F.struct(*(F.col(f"`{c}`") for c in dealt.columns)))
    with_bytes = dealt.join(asked, (F.col("_id") == F.col("_i")) & (F.col("_tie") == F.col("_t"))).select(F.col("_id").alias("id"), F.col("_tie").alias("tie"), F.col(text).alias("text"), "spots", "spans", whole.alias("whole"))
    # in order, so that a task that is run again merges the same rows
    with_bytes = with_bytes.sortWithinPartitions("id", "tie")
    spans = with_bytes.mapInArrow(tx.tidy(_around), AROUND).repartition(parts, "way").sortWithinPartitions("kind", "way").mapInArrow(tx.tidy(_spans), "id bigint, tie bigint, first int, last int")
    lists = spans.groupBy(F.col("id").alias("_i"), F.col("tie").alias("_t")).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    joined = dealt.join(lists, (F.col("_id") == F.col("_i")) & (F.col("_tie") == F.col("_t")), "left")
    return joined.withColumn("_whole", whole).drop("_id", "_tie", "_i", "_t")


def repeat_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Groups of repeats of LEAST bytes or more, one row an occurrence: group_id (of the repeated bytes),
    length, whole, doc_id, doc_key (tells documents of one doc_id apart), start.

    All occurrences of a group are there. ``whole``: the repeat ends on both sides inside what is looked at
    around an anchor (LEAST - GRAM bytes to the left, LEAST to the right), so it's a maximal repeat of the
    texts; a longer repeat is told as a group for each of its anchors, each as wide as the anchor's
    surroundings. Anchors with more than HOT differing surroundings give each repeated string of LEAST bytes
    around them as a group. A text that repeats in rows of one doc_id is one document.

    Only the earliest of equal surroundings is scanned; its group's other occurrences follow by a join on the
    surroundings, so no task holds the copies of a passage.
    """
    parts = store.partitions_for(docs)
    own, single = _keyed(docs, text)
    bare = own.select(F.col("_id").alias("id"), F.col("_tie").alias("tie"), F.col(text).cast("string").alias("text")).filter(F.octet_length("text") >= LEAST)
    if not single:
        bare = bare.dropDuplicates(["id", "tie"])
    every = store.written(bare.mapInArrow(tx.tidy(_every_anchor), OCCURRENCES), "anchors")
    alike = every.groupBy("anchor", "ctx").agg(F.min(F.struct("id", "tie", "spot")).alias("head"), F.count("*").alias("n"))
    anchors_of = alike.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter("all > 1")
    classes = store.written(alike.join(anchors_of, F.col("anchor") == F.col("_a")).select("anchor", "ctx", "head.*", "n", "kinds"), "surroundings")
    pos = F.shiftright("spot", 8)
    cold = classes.filter((F.col("kinds") <= HOT) | (F.col("n") > 1)).select("id", "tie", (2 * pos).alias("asked"))
    hot = classes.filter(F.col("kinds") > HOT).select(F.col("anchor").alias("_a")).distinct()
    burning = every.join(hot, F.col("anchor") == F.col("_a"), "left_semi").select("id", "tie", (2 * pos + 1).alias("asked"))
    spots = cold.unionByName(burning).groupBy(F.col("id").alias("_i"), F.col("tie").alias("_t")).agg(F.collect_list("asked").alias("spots"))
    nothing = F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans")
    with_bytes = bare.join(spots, (F.col("id") == F.col("_i")) & (F.col("tie") == F.col("_t"))).select("id", "tie", "text", "spots", nothing)
    around = store.written(with_bytes.mapInArrow(tx.tidy(lambda batches: _around(batches, merge=False)), AROUND), "around")
    found = around.filter("kind = 0").repartition(parts, "way").sortWithinPartitions("kind", "way").mapInArrow(tx.tidy(_group_rows), GROUPS)
    head = classes.select("anchor", "ctx", "n", "kinds", F.col("id"), F.col("tie"), pos.alias("pos"))
    # what hot anchors share is told by their strings, but for equal surroundings that no text's end cuts
    full = (F.col("left") == _LEFT) & (F.col("right") == LEAST)
    again = (F.col("size") == 1) & (F.col("n") > 1)
    found = found.join(head, ["anchor", "id", "tie", "pos"]).filter(F.when(F.col("kinds") <= HOT, again | (F.col("size") > 1)).otherwise(again & full))
    found = found.select("anchor", "ctx", "left", "right", "group").join(every, ["anchor", "ctx"])
    inside = (F.col("left") < _LEFT) & (F.col("right") < LEAST)
    repeats = found.select(F.col("group").alias("group_id"), (F.col("left") + F.col("right")).alias("length"), inside.alias("whole"), "id", "tie", (pos - F.col("left")).alias("start"))
    strings = around.filter("kind = 1").select(F.col("way").alias("group_id"), F.lit(LEAST).cast("long").alias("length"), F.lit(False).alias("whole"), "id", "tie", F.col("pos").cast("long").alias("start"))
    twice = strings.select("group_id", "id", "tie", "start").distinct().groupBy(F.col("group_id").alias("_g")).count().filter("count > 1")
    strings = strings.join(twice, F.col("group_id") == F.col("_g"), "left_semi")
    once = store.written(repeats.unionByName(strings).groupBy("group_id", "length", "id", "tie", "start").agg(F.max("whole").alias("whole")), "repeats")
    ends = once.groupBy(F.col("group_id").alias("_g"), F.col("length").alias("_n")).agg(F.max("whole").alias("whole"))
    out = once.drop("whole").join(ends, (F.col("group_id") == F.col("_g")) & (F.col("length") == F.col("_n")))
    return out.select("group_id", "length", "whole", F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("tie").alias("doc_key"), "start")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, maximal ranges from ascending ones that may overlap."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which they hold a part only, so that what is left stays text."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _ranges(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [union([(s["first"], s["last"]) for s in x]) if x else [] for x in column.to_pylist()]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, digest = [], [], [], []
            for t, own in zip(b.column("text").to_pylist(), _ranges(b.column("spans")), strict=True):
                raw = (t or "").encode()
                sizes.append(len(raw))
                removed.append(sum(z - a for a, z in own))
                spans.append(len(own))
                digest.append(hashlib.sha256(without(raw, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.select("doc_id", "text", "spans", "_whole").mapInArrow(tx.tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text (whole characters only); null stays null."""
    from pyspark.sql import types as T

    rows = with_spans(docs, text)
    columns = [c for c in docs.columns if c not in ("spans", "_id", "_tie")]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, own in zip(b.column(at).to_pylist(), _ranges(b.column(len(columns))), strict=True):
                raw = None if t is None else t.encode()
                kept.append(t if not own else without(raw, whole_characters(raw, own)).decode())
            cols = list(b.columns)[: len(columns)]
            cols[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(cols, columns)

    schema = T.StructType([docs.schema[c] if c != text else T.StructField(text, T.StringType()) for c in columns])
    return store.numbered(rows.select(*(f"`{c}`" for c in columns), "spans", "_whole")).mapInArrow(tx.tidy(run), schema)
