"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The statistics (:data:`FEATURES`) are counts and ratios of bytes, words, lines and repeats of the whole
text; nothing else about the document enters a score. Training bins every statistic by quantiles and
grows depth-limited trees level by level from gradient histograms; the forest is then flattened into
arrays of split feature, threshold and children, and scoring walks all rows through all trees at once.

Training rows are a bounded sample (``SAMPLE`` rows, least hash of the id first, of the labels and again
of the documents that have them); scoring covers every row in one pass without a shuffle.

Defined results: null text scores as the empty text; a very long text is counted through as a whole; a
null id is never held out and never trained on; labels that are null are ignored and repeated ones count
each, as do documents of one id; ties of the sample's order are in the order of id, label and statistics,
and of equally good splits the first statistic's least one counts; without labels of both kinds the score
is the share of label 1, and about 1 without any label, as nothing speaks against a text; an empty table
gives no rows; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm import store
from trackweave.llm import text as tx

#: Labelled rows that training looks at, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, REGULAR = 60, 5, 64, 0.15, 1.0
#: Score from which a document counts as good.
ACCEPT = 0.7

FEATURES = ("log_bytes", "log_words", "mean_word", "max_word", "upper", "lower", "digit", "high", "space", "bang", "pipe", "symbol", "stop", "comma", "quote", "lines_per_word", "capital_words", "one_letter_words", "distinct_words", "top_word", "distinct_trigrams", "distinct_lines", "symbol_end_words", "all_upper_words")

_c = np.arange(256)
_is = lambda chars: np.isin(_c, [ord(x) for x in chars])
_UPPER, _LOWER, _DIGIT, _HIGH = (_c >= 65) & (_c <= 90), (_c >= 97) & (_c <= 122), (_c >= 48) & (_c <= 57), _c >= 128
_WHITE, _SYMBOL = (_c == 32) | ((_c >= 9) & (_c <= 13)), _is("#$%&*@^~_=+<>{}[]\\/`")
_KIND = np.select([_UPPER, _LOWER, _DIGIT, _HIGH, _WHITE, _is("!?"), _is("|"), _SYMBOL, _is("."), _is(",;:")], range(10), 10).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for every text."""
    data, offsets = tx.flat(column)
    out = [_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tx.pieces(offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each text has, and how often its commonest stands.

    Values are sorted behind their text's number, with as many leading bits as then fit.
    """
    bits = tx.U64(max(1, n - 1).bit_length())
    keys = np.sort((of.astype(np.uint64) << (tx.U64(64) - bits)) | (h >> bits))
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    text = (keys[first] >> (tx.U64(64) - bits)).astype(np.int64)
    return np.bincount(text, minlength=n), _most(np.diff(np.append(first, len(keys))), text, n)


def _most(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Each text's greatest value, 0 for none; ``of`` ascends."""
    out = np.zeros(n)
    if len(of):
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] = np.maximum.reduceat(values, first)
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.zeros(n * 11)
    text_of = np.repeat(np.arange(n, dtype=np.int32), size)
    for i in range(0, len(data), tx.BATCH_BYTES):
        kinds += np.bincount(text_of[i : i + tx.BATCH_BYTES] * 11 + _KIND[data[i : i + tx.BATCH_BYTES]], minlength=n * 11)
    kinds = kinds.reshape(n, 11)
    del text_of
    start, end, words = tx.words(data, offsets)
    word_of = np.repeat(np.arange(n), words)
    per_text = lambda x: np.bincount(word_of, weights=x, minlength=n)
    length = end - start
    longest = _most(length, word_of, n)
    hashes = tx.word_numbers(data, start, end, fold=True)
    first_byte, last_byte = data[start], data[end - 1]
    uppers = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int32)))
    lowers = np.concatenate(([0], np.cumsum(_LOWER[data], dtype=np.int32)))
    shouted = (uppers[end] - uppers[start] > 1) & (lowers[end] == lowers[start])
    distinct, top = _distinct(hashes, word_of, n)
    if len(hashes) > 2:
        three = tx.mix64(hashes[:-2] * np.uint64(3) + tx.mix64(hashes[1:-1] * np.uint64(5) + tx.mix64(hashes[2:])))
        inside = word_of[:-2] == word_of[2:]
        three, three_of = three[inside], word_of[:-2][inside]
    else:
        three, three_of = hashes[:0], word_of[:0]
    trigrams = np.bincount(three_of, minlength=n)
    distinct3, _ = _distinct(three, three_of, n)
    # lines: runs of words between line ends
    breaks = np.cumsum(data == 10, dtype=np.int32)
    line_no = breaks[start] if len(start) else start
    new = np.ones(len(start), bool)
    new[1:] = (line_no[1:] != line_no[:-1]) | (word_of[1:] != word_of[:-1])
    heads = np.flatnonzero(new)
    line_of = word_of[heads]
    line_hash = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(hashes)))).astype(np.uint64) + np.uint64(7)), heads) if len(heads) else hashes
    lines = np.bincount(line_of, minlength=n)
    distinct_lines, _ = _distinct(line_hash, line_of, n)
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    of_bytes = kinds / b[:, None]
    of_words = kinds / w[:, None]
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), length_sum(per_text, length) / w, longest, of_bytes[:, 0], of_bytes[:, 1], of_bytes[:, 2], of_bytes[:, 3], of_bytes[:, 4],
            of_words[:, 5], of_words[:, 6], of_words[:, 7], of_words[:, 8], of_words[:, 9], of_words[:, 10], lines / w,
            per_text(_UPPER[first_byte]) / w, per_text(length == 1) / w, distinct / w, top / w, (distinct3 + 1) / (trigrams + 1), (distinct_lines + 1) / (lines + 1),
            per_text(_SYMBOL[last_byte]) / w, per_text(shouted) / w,
        ]
    )


def length_sum(per_text, length: np.ndarray) -> np.ndarray:
    return per_text(length.astype(float))


@dataclass
class Forest:
    """Trees in flat arrays; a leaf is its own child. ``start`` is each tree's root."""

    prior: float
    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for every row."""
        if not len(self.start):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        out = np.empty(len(x))
        for i in range(0, len(x), 4096):
            rows = x[i : i + 4096]
            node = np.broadcast_to(self.start, (len(rows), len(self.start)))
            at = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[at, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[i : i + 4096] = self.prior + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosts ``trees`` trees on the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share))) if len(y) else 20.0
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Forest(prior, none, none, np.zeros(0), none, none, np.zeros(0), 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    n, width = binned.shape
    flat = binned + np.arange(width) * bins
    total = np.full(n, prior)
    arrays: list[list] = [[], [], [], [], []]
    start = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        root = len(arrays[0])
        start.append(root)
        _node(arrays, g.sum() / (h.sum() + REGULAR) * rate)
        node = np.full(n, root)
        level = [root]
        for _ in range(depth):
            grown = _split_level(arrays, level, node, flat, binned, g, h, edges, bins, rate)
            if not grown:
                break
            level = grown
        total += np.array(arrays[4])[node]
    feature, threshold, left, right, value = (np.array(a) for a in arrays)
    return Forest(prior, np.array(start), feature, threshold, left, right, value, depth)


def _node(arrays: list[list], value: float) -> int:
    k = len(arrays[0])
    for a, v in zip(arrays, (0, np.inf, k, k, value), strict=True):
        a.append(v)
    return k


def _split_level(arrays, level, node, flat, binned, g, h, edges, bins, rate) -> list[int]:
    """Splits each node of a level at its best histogram gain; moves the rows to the children."""
    width = flat.shape[1]
    place = np.full(len(arrays[0]), -1)
    place[level] = np.arange(len(level))
    own = place[node]
    active = np.flatnonzero(own >= 0)
    key = (own[active, None] * width * bins + flat[active]).ravel()
    size = len(level) * width * bins
    shape = (len(level), width, bins)
    sums = [np.bincount(key, np.repeat(v[active], width), size).reshape(shape).cumsum(axis=2) for v in (g, h)]
    gl, hl = sums
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gain = gl**2 / (hl + REGULAR) + (gt - gl) ** 2 / (ht - hl + REGULAR) - gt**2 / (ht + REGULAR)
    gain[(hl < 1) | (ht - hl < 1)] = -1
    grown = []
    for i, parent in enumerate(level):
        f, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
        if gain[i, f, b] <= 1e-6 or b >= len(edges[f]):
            continue
        children = []
        for gs, hs in ((gl[i, f, b], hl[i, f, b]), (gt[i, f, 0] - gl[i, f, b], ht[i, f, 0] - hl[i, f, b])):
            children.append(_node(arrays, gs / (hs + REGULAR) * rate))
        arrays[0][parent], arrays[1][parent], arrays[2][parent], arrays[3][parent] = int(f), float(edges[f][b]), *children
        rows = active[own[active] == i]
        node[rows] = np.where(binned[rows, f] <= b, children[0], children[1])
        grown += children
    return grown


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest from labelled documents that aren't held out.

    The sample's ids (8 bytes each, at most ``sample``) are broadcast; statistics are taken where the
    texts are, and only they reach the driver, of ``sample`` rows at most, however often an id stands
    in either table.
    """
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    some = usable.orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(tx.tidy(run), "doc_id bigint, quality double, x array<double>")
    found = found.orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), "doc_id", "quality", "x").limit(sample).toPandas()
    found = found.sort_values(["doc_id", "quality"], kind="stable")
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T[::-1]) if len(x) else []
    return train(x[order], found["quality"].to_numpy(float)[order])


def scored(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` and a column ``score`` (replacing one of that name)."""
    columns = [c for c in docs.columns if c != "score"]
    kept = docs.select(*(f"`{c}`" for c in columns))
    at = columns.index(text)

    names = [*columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score(features(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names)

    return store.numbered(kept).mapInArrow(tx.tidy(run), T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
