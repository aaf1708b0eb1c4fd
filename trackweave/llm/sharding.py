"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records into buckets by seeded hashes; a shard has as many buckets as keep a bucket at
about ``bucket_bytes``. Pass 2 takes one bucket a task, sorts it (so that a repeated task repeats itself),
Fisher-Yates shuffles it with a generator seeded by the bucket, and writes it. A record's slot is its place
in its bucket plus the records in the shard's buckets before, both taken from the files.

The law is ``key``: doc_id and the shard count alone decide the shard, by jump consistent hashing, so
with one more shard a record either stays or moves to the new one. Groups of equal texts stay together
only as far as their doc_ids send them to one shard; moving a record to its text's group would break the
law. Only the shard follows the key: in its shard a record's bucket is drawn from the key, all its other
columns and its place in the input, so a repeated or null doc_id, or a row repeated over and over, spreads
over all buckets of its shard.

Defined results: null text has size 1; a very long text is one record; a null doc_id is a key of its own;
rows with equal doc_id share a shard (as the law asks), equal rows get slots of their own; an empty table
gives no rows; all columns of the input come through, except that ``shard``, ``slot`` and ``grown_shard``
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm import store
from trackweave.llm import text as tx

SHARDS = 16
SEED = 20_241
BUCKET_BYTES = 16 << 20
#: Up to so many buckets (two numbers each, so 16 MB) their first slots are broadcast, beyond that joined.
BROADCAST_BUCKETS = 1_000_000


def jump_shard(key: str, shards: int, seed: int = SEED) -> Column:
    """Jump consistent hashing: step k moves the key to shard k with chance 1 / (k + 1), by a draw of its own.

    The last step that moves it is its shard, so one step more changes nothing but the moves into the
    new shard. Native and branch-free; its cost is the number of shards.
    """
    chance = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(key).isNull(), F.col(key)), F.lit(k + 1)) == 0 for k in range(1, shards)]
    return F.greatest(F.lit(0), F.lit(0), *(F.when(c, F.lit(k)).otherwise(F.lit(0)) for k, c in enumerate(chance, 1))).cast("int")


def scattered(records: DataFrame, key: str, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with shard, grown_shard, _bucket and _at, the record's place in its shuffled bucket."""
    records = records.drop("shard", "slot", "grown_shard", "_bucket", "_at")
    total = records.agg(F.sum(size)).first()[0] or 0
    per = max(1, -(-int(total) // (shards * bucket_bytes)))
    dealt = records.withColumn("shard", jump_shard(key, shards, seed)).withColumn("grown_shard", jump_shard(key, shards + 1, seed))
    plain = [F.col(f"`{f.name}`") for f in records.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # the place only tells apart rows that are otherwise equal
    place = F.xxhash64(F.lit(seed + 1), *plain, F.monotonically_increasing_id())
    dealt = dealt.withColumn("_bucket", (F.col("shard") * per + F.pmod(place, F.lit(per))).cast("int"))

    columns = dealt.columns
    order = F.xxhash64(*plain)
    in_buckets = dealt.repartitionById(shards * per, F.col("_bucket")).sortWithinPartitions(F.col("_bucket"), F.col(f"`{key}`"), order, F.struct(*plain))
    out = T.StructType([*dealt.schema.fields, T.StructField("_at", T.LongType())])
    bucket = columns.index("_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
        if not held:
            return
        table = pa.Table.from_batches(held)
        of = table.column(bucket).to_numpy()
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            order = fisher_yates(j - i, seed, int(of[i]))
            for k in range(0, len(order), 2000):
                some = order[k : k + 2000]
                part = table.take(pa.array(i + some)).append_column("_at", pa.array(np.arange(k, k + len(some)), pa.int64()))
                yield from part.rename_columns(out.names).combine_chunks().to_batches()

    return store.numbered(in_buckets).mapInArrow(tx.tidy(run), out)


def write_shards(records: DataFrame, path: str, key: str, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes each shard as a folder of Parquet files, one a bucket, rows in their shuffled order, and
    gives what :func:`read_shards` reads back from them."""
    shuffled = scattered(records, key, size, shards, seed, bucket_bytes)
    shuffled.sortWithinPartitions("shard", "_bucket", "_at").write.partitionBy("shard").parquet(path)
    return read_shards(records.sparkSession, path, shuffled.schema)


def read_shards(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The records of written shards, with their slot (gapless from 0 in a shard)."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    firsts = counts.select("_bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    firsts = store.written(firsts, "firsts", few=True)
    few = firsts.count() <= BROADCAST_BUCKETS
    names = [c for c in rows.columns if c not in ("_bucket", "_at")]
    return rows.join(F.broadcast(firsts) if few else firsts, "_bucket").withColumn("slot", F.col("_first") + F.col("_at")).select(*(f"`{c}`" for c in names), "slot")


def two_pass_shuffle(records: DataFrame, key: str, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with shard, slot and grown_shard, by way of shards in the shared folder."""
    return write_shards(records, store.new_path(records.sparkSession, "shards"), key, size, shards, seed, bucket_bytes)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n): position i swaps with one drawn from 0..i, from the last down."""
    rng = np.random.Generator(np.random.Philox(key=[seed, bucket]))
    draws = rng.integers(0, np.arange(1, n + 1)).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        k = draws[i]
        order[i], order[k] = order[k], order[i]
    return np.array(order, np.int64)
