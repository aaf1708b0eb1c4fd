"""Embedding near-duplicates: p-stable hashing into several tables, exact cosines inside the buckets.

Vectors are normalised; a table's bucket is the tuple of ``k`` quantised Gaussian projections, so
vectors at a small Euclidean distance (a high cosine) often share it. ``k`` grows with the logarithm
of the number of vectors, which keeps the number of unrelated vectors in a bucket about constant, and
the number of tables follows from the recall wanted at the threshold itself. Comparing a block is one
matrix product, moving its vectors is a shuffle; so buckets are large and tables few: 5 tables for
50,000 vectors, 41 for a billion.

Equal vectors are collapsed first and count by how many they are. Inside a bucket the cosines of a
block of vectors are taken in double precision; a pair is counted in the first table in which both
share a bucket, so every link counts once and no pair leaves the task: only each vector's number of
links and one link to its least neighbour's cluster do. A bucket above ``BLOCK`` vectors is dealt out
as pairs of blocks. A vector is shuffled once a table, in the precision it came in, with the numbers of
its buckets in the tables before.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of different length never link; equal vectors (repeated rows too) link with each other; a very
long vector is one like others; a cosine at the threshold links; of tied ids the component's name is the
least; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm import components, store
from trackweave.llm import text as tx

COSINE = 0.95
WIDTH = 1.75
RECALL = 0.95
SEED = 11
#: Unrelated vectors that a bucket holds on average; vectors of a block.
CROWD, BLOCK = 1_024, 2_048
#: Buckets of more than one block (two numbers each) up to which their table is broadcast; beyond, joined.
BROADCAST_BUCKETS = 1_000_000


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two vectors at the distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections a table, and tables, for n vectors."""
    far = collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(n, 2) / CROWD) / -math.log(far)))
    near = collision(math.sqrt(2 - 2 * cosine), width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as floats, or None."""
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_list(column.type) or not pa.types.is_floating(column.type.value_type) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i, good in enumerate(valid):
        values = column[i].values if good else None
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False)
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashes(unit: np.ndarray, k: int, tables: int, seed: int = SEED, width: float = WIDTH) -> np.ndarray:
    """A 64-bit bucket number in every table for every unit vector."""
    rng = np.random.default_rng([seed, unit.shape[1], k, tables])
    directions = rng.standard_normal((unit.shape[1], tables * k))
    cells = np.floor((unit @ directions + rng.uniform(0, width, tables * k)) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    h = np.broadcast_to(tx.mix64(np.arange(tables, dtype=np.uint64) + np.uint64(1 + (unit.shape[1] << 20))), cells.shape[:2]).copy()
    for i in range(k):
        h = tx.mix64(h ^ (cells[:, :, i] + np.uint64(0x9E3779B97F4A7C15)))
    return h.astype(np.int64)


def _packed(kind: str):
    """vec_id, key (a digest; null for unusable vectors) and data, the components as ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if v is None else v.astype(kind).tobytes() for v in _usable(b.column("embedding"))]
            keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "key", "data"])

    return run


def _cluster(adjacent: np.ndarray) -> np.ndarray:
    """Least number in each row's connected component of a square adjacency matrix."""
    label = np.arange(len(adjacent))
    if not len(label):
        return label
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _count(ids: np.ndarray, many: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, cross: bool, cosine: float):
    """Links first met in this bucket: (vector, number of linked vectors, a linked cluster's least vector)."""
    unit = _unit(x)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    for k in keys.T:
        if not linked.any():
            break
        linked &= k[:, None] != k[None, :]
    rows = np.flatnonzero(linked.any(axis=1))
    linked, ids, many = linked[np.ix_(rows, rows)], ids[rows], many[rows]
    root = _cluster(linked)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return ids, (linked @ many.astype(np.float64)).astype(np.int64), least[root]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"
    packed = vectors.select("vec_id", "embedding").mapInArrow(tx.tidy(_packed(kind)), "vec_id bigint, key binary, data binary")
    rows = store.written(packed.select("vec_id", "key"), "vectors", few=True)
    # nodes get numbers of their own: ids may be null or repeat
    node = F.xxhash64("key")
    known = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    known = store.written(known.select(node.alias("node"), "key", "least", "many"), "known", few=True)
    k, tables = plan(known.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("data").to_pylist()
            found = [b""] * len(data)
            sizes = np.array([len(d) for d in data], np.int64)
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                unit = _unit(np.frombuffer(b"".join(data[i] for i in at), kind).reshape(len(at), -1))
                for i, h in zip(at, hashes(unit, k, tables), strict=True):
                    found[i] = h.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found if len(data) else [], pa.list_(pa.int64()))], [*b.schema.names, "buckets"])

    single = packed.filter("key IS NOT NULL").groupBy(node.alias("node")).agg(F.count("*").alias("many"), F.any_value("data").alias("data"))
    held = store.written(single.mapInArrow(tx.tidy(hashed), "node bigint, many bigint, data binary, buckets array<bigint>"), "hashed", few=True)
    # a bucket's number holds its table's
    hot = held.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    hot = store.written(hot.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot", few=True)
    members = held.select("node", "many", "data", "buckets", F.posexplode("buckets").alias("table", "bucket"))
    members = members.withColumn("buckets", F.slice("buckets", F.lit(1), F.col("table")))
    members = members.join(F.broadcast(hot) if hot.count() <= BROADCAST_BUCKETS else hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.hash("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    members = members.select("bucket", pair.alias("pair"), (F.col("own") > F.col("other")).alias("side"), "node", "many", "data", "buckets")
    parts = store.partitions_for(vectors)
    dealt = members.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket", "pair"]):
            if group.num_rows < 2:
                continue
            pair = group.column("pair")[0].as_py()
            keys = group.column("buckets").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            x = np.frombuffer(b"".join(group.column("data").to_pylist()), kind).reshape(group.num_rows, -1)
            side = group.column("side").to_numpy(zero_copy_only=False)
            found = _count(group.column("node").to_numpy(), group.column("many").to_numpy(), side, x, keys, pair >> 31 != pair & (1 << 31) - 1, cosine)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "links", "near"])

    found = store.written(dealt.mapInArrow(tx.tidy(run), "node bigint, links bigint, near bigint"), "links", few=True)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts_of = components.components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    known = known.join(links, "node", "left").join(parts_of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer keys from sorted batches, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = np.column_stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(values[i])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)
