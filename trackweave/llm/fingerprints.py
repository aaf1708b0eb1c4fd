"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles (words are runs
without ASCII white space, A-Z lower-cased; a shorter text is one shingle; a text without words has
the empty sketch). Because it keeps the smallest hashes, the sketch of a whole is the bottom k of the
sketches of its parts. As a string it is the unpadded base-64 text of the hashes as little-endian
unsigned 64-bit integers in ascending order; the empty sketch is ``''``.

Defined results: null text is the empty text; a very long text has one sketch, of all its shingles; equal
texts have equal sketches; an empty table gives no rows; two empty sketches resemble each other by 1, an
empty and a non-empty one by 0. Rows may repeat, ids may be null or tie
(order: id, nulls first, then text), other columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm import ranges, store
from trackweave.llm import text as tx

K = 128
WORDS = 5


def sketches(column: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sketch of every text of an Arrow string array."""
    data, offsets = tx.flat(column)
    out: list[np.ndarray] = []
    for i, j in tx.pieces(offsets):
        h, at = tx.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        out += [bottom(h[a:b], k) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _ascending(hashes: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    own = np.sort(hashes)
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return own[new]


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 4 * k:
        few = _ascending(np.partition(hashes, 2 * k)[: 2 * k])
        if len(few) >= k:
            return few[:k]
    return _ascending(hashes)[:k]


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the sketched sets."""
    parts = list(parts)
    return bottom(np.concatenate(parts), k) if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's bottom k that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    union = both[np.append(True, ~twice)][:k]
    return float((both[1:][twice] <= union[-1]).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too (1 for an empty a)."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge((a, b), k), k) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode().rstrip("=")


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s + "=" * (-len(s) % 4)), "<u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` and a column ``fingerprint`` (replacing one of that name). No shuffle."""

    @F.pandas_udf("string")
    def of(column):
        return _strings(pa.Array.from_pandas(column, type=pa.string()), k, words)

    return docs.withColumn("fingerprint", of(F.col(text)))


def _strings(column, k, words):
    import pandas as pd

    return pd.Series([to_string(a) for a in sketches(column, k, words)])


def merge_by(df: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key: that of all its parts together.

    The hashes are spread out as rows and ranked within the key, and Spark keeps only k rows of a key
    in a task before it shuffles them, so a key with a third of all parts stays bounded.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {f"k{i}": b.column(i) for i in range(len(keys))}
            parts = [from_string(s or "") for s in b.column(len(keys)).to_pylist()]
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in cols.values()] + [pa.array((h ^ np.uint64(1 << 63)).astype(np.int64))], [*cols, "h"])

    kinds = dict(df.select(*keys).dtypes)
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), fingerprint).mapInArrow(tx.tidy(spread), ", ".join(f"k{i} {kinds[c]}" for i, c in enumerate(keys)) + ", h bigint")
    names = [f"k{i}" for i in range(len(keys))]
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("h"))).filter(F.col("r") <= k)

    @F.pandas_udf("string")
    def pack(column):
        import pandas as pd

        return pd.Series([to_string(np.sort(np.asarray(x, np.int64).astype(np.uint64) ^ np.uint64(1 << 63))) for x in column])

    merged = ranked.groupBy(*names).agg(F.collect_list("h").alias("h"))
    out = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys))).distinct()
    for_null = F.lit(True)
    for n in names:
        for_null = for_null & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return (
        out.alias("a").join(merged.alias("b"), for_null, "left")
        .select(*(F.col(f"a.{n}").alias(c) for n, c in zip(names, keys, strict=True)), F.coalesce(pack(F.coalesce("b.h", F.array().cast("array<bigint>"))), F.lit("")).alias("fingerprint"))
    )


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, next_contains double"


def with_successor(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how near both and the next text are.

    The edited text replaces the last ``n_chars // 4`` code points by the first as many (or all) of the
    next document's, in ascending doc_id, the last document being followed by the first.

    The texts are shuffled once, into ranges of doc_id sorted inside each task. A range also gets a
    second copy of the first row of the range after it (one row a range), so every row meets its
    successor in its own task, and the tasks stream.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = store.partitions_for(docs)
    least = docs.agg(F.min("doc_id").alias("m"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    # a cut at the least id would leave the first range empty
    bounds = [b for b in ranges.cuts(docs, "doc_id", parts) if least["nulls"] or b > least["m"]]
    n = len(bounds) + 1
    own = docs.select(ranges.part_of("doc_id", bounds).alias("part"), F.lit(0).alias("after"), "doc_id", "text")
    head = F.col("doc_id").isNull() if least["nulls"] else F.col("doc_id") == F.lit(least["m"])
    heads = own.filter(F.col("doc_id").isin(bounds) | head if bounds else head)
    ghosts = heads.withColumn("part", F.pmod(F.col("part") - 1, F.lit(n))).withColumn("after", F.lit(1))
    dealt = own.unionByName(ghosts).repartitionById(n, F.col("part")).sortWithinPartitions("part", "after", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        done = False
        for b in batches:
            if done:
                continue
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            rows = list(zip(b.column("doc_id").to_pylist(), texts, sketches(b.column("text"), k, words), b.column("after").to_pylist(), strict=True))
            if held is not None:
                rows.insert(0, held)
            pairs = []
            for this, other in zip(rows, rows[1:], strict=False):
                if this[3] == 1:
                    break
                pairs.append((this, other))
            done = bool(rows) and any(r[3] for r in rows)
            held = rows[-1] if rows else None
            if pairs:
                yield _pairs(pairs, k, words)

    return dealt.mapInArrow(tx.tidy(run), SCHEMA)


def edited(this: str, following: str) -> str:
    """``this`` with its last quarter replaced by the beginning of ``following``."""
    q = len(this) // 4
    return this[: len(this) - q] + following[:q]


def _pairs(pairs: list, k: int, words: int) -> pa.RecordBatch:
    changed = [edited(a[1], b[1]) for a, b in pairs]
    after = sketches(pa.array(changed, pa.large_string()), k, words)
    cols = [
        pa.array([a[0] for a, _ in pairs], pa.int64()),
        pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([to_string(a[2]) for a, _ in pairs]),
        pa.array([to_string(s) for s in after]),
        pa.array([resemblance(a[2], s, k) for (a, _), s in zip(pairs, after, strict=True)], pa.float64()),
        pa.array([resemblance(a[2], b[2], k) for a, b in pairs], pa.float64()),
        pa.array([distinct(a[2], k) for a, _ in pairs], pa.float64()),
        pa.array([containment(a[2], b[2], k) for a, b in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])
