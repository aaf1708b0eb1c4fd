"""Packing token pieces into sequences: hierarchical residual packing.

Round 0 packs the items of each partition best-fit, longest first. Bins that are nearly full leave, and so
do those that no bin left could join (:func:`partners`); the others travel on as items of their own, to an
eighth as many partitions a round. Best-fit leaves a partition at most one bin that is half full or less,
two bins can only be joined if one of them is, and each such bin takes one partner with it: so at most two
bins a partition of round 0 ever travel, whatever the items are, and no later task holds more than that.
A round is a table in the shared folder, so a lost executor repeats its round only.

Defined results: a null text is empty and still one piece with the end id; a very long text is cut into
pieces by its ids, all of them; items of equal length are packed in the order they stand in; repeated rows
are packed each; an item longer than the capacity is refused; an empty table gives no rows; other columns
pass by, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm import store, tokens
from trackweave.llm import text as tx

CAPACITY = 1024
#: A bin with no more room than this leaves its round.
SLACK = 2
FAN_IN = 8
END = 2
#: Chosen bins (a number each) up to which their table is broadcast; beyond, joined.
BROADCAST_BINS = 1_000_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: full ones, and before them what is left over."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every whole text's ids (``end`` appended). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for b in batches:
            ids, at = encode(b.column("text"))
            rows = []
            for doc, i, j in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[i:j], ids.dtype.type(end)).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(own), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(own[start : start + n].tobytes())))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tx.tidy(run), PIECE)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room for it.

    Open bins hang on their room; a bit mask of the rooms in use gives the least room that suffices.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        if size > capacity:
            raise ValueError(f"an item of {size} is longer than the capacity {capacity}")
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[own].append(item)
        else:
            room, own = capacity, len(bins)
            bins.append([item])
        if room > size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return bins


def partners(fills: dict[int, int], capacity: int = CAPACITY) -> dict[int, int]:
    """Of the bins open after a round (how many by fill), how many of each fill stay open for the next.

    Small bins (half full or less) stay, if anything fits them. Each may pull in one larger bin: the
    fullest that has room for it, largest small ones first.
    """
    left = {f: n for f, n in fills.items() if 2 * f > capacity}
    small = sorted(((f, n) for f, n in fills.items() if 2 * f <= capacity), reverse=True)
    stay: dict[int, int] = {}
    for fill, n in small:
        wanted = n
        for f in sorted((f for f in left if f + fill <= capacity and left[f]), reverse=True):
            got = min(wanted, left[f])
            left[f] -= got
            stay[f] = stay.get(f, 0) + got
            wanted -= got
            if not wanted:
                break
    if stay or sum(n for _, n in small) > 1:
        stay |= dict(small)
    return stay


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``items`` (with a column ``length``) and their ``sequence_id`` and gapless ``offset`` in it."""
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    # a table first, so that making the items and packing them don't share a task's memory; columns by number
    items = items.select(*(f"`{c}`" for c in columns))
    kinds = [f.dataType for f in items.schema.fields]
    items = store.written(store.numbered(items), "items")
    length = columns.index("length")
    shape = T.StructType([T.StructField("bin", T.LongType()), T.StructField("fill", T.LongType()), T.StructField("members", T.ArrayType(items.schema))])
    bins = items.select(F.lit(0).cast("long").alias("bin"), F.col(f"c{length}").cast("long").alias("fill"), F.array(F.struct(*items.columns)).alias("members"))

    def rounds(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("fill").to_numpy()
            found = best_fit(sizes, capacity)
            lists = table.column("members").chunk(0) if table.column("members").num_chunks == 1 else pa.concat_arrays(table.column("members").chunks)
            order = np.concatenate([np.array(f, np.int64) for f in found])
            taken = lists.take(pa.array(order))
            counts = np.diff(taken.offsets.to_numpy())
            ends = np.cumsum([len(f) for f in found])
            offsets = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]
            values = taken.flatten()
            fills = np.add.reduceat(sizes[order], np.concatenate(([0], ends[:-1])))
            first = (number << 56) + (TaskContext.get().partitionId() << 32)
            for i in range(0, len(found), 5000):
                j = min(len(found), i + 5000)
                part = offsets[i : j + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first + i, first + j)), pa.array(fills[i:j]), pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), values.slice(part[0], part[-1] - part[0]))],
                    ["bin", "fill", "members"],
                )

        return run

    done, parts, number = [], None, 0
    while True:
        table = store.written(bins.mapInArrow(tx.tidy(rounds(number)), shape), f"bins{number}")
        parts = max(1, table.rdd.getNumPartitions() if parts is None else parts)
        open_bin = table.filter(F.col("fill") < capacity - slack)
        fills = dict(open_bin.groupBy("fill").count().collect())  # no more rows than the capacity
        stay = partners(fills, capacity)
        if not stay or (number and parts == 1):
            done.append(table)
            break
        parts, number = -(-parts // FAN_IN), number + 1
        whole = [f for f, n in stay.items() if n == fills[f]]
        some = {f: n for f, n in stay.items() if n < fills[f]}
        goes_on = F.col("fill").isin(whole) if whole else F.lit(False)
        if some:
            # of bins equally full, the first few by number; the window keeps that many a task before it shuffles
            ranked = open_bin.filter(F.col("fill").isin(list(some))).select("bin", "fill", F.row_number().over(Window.partitionBy("fill").orderBy("bin")).alias("r")).filter(F.col("r") <= max(some.values()))
            wanted = F.element_at(F.create_map(*(F.lit(int(x)) for f, n in some.items() for x in (f, n))), F.col("fill").cast("int"))
            chosen = store.written(ranked.filter(F.col("r") <= wanted).select("bin", F.lit(True).alias("chosen")), "chosen", few=True)
            # one row a chosen bin: no more than partitions, see the module's text
            table = table.join(F.broadcast(chosen) if sum(some.values()) <= BROADCAST_BINS else chosen, "bin", "left")
            goes_on = goes_on | F.col("chosen").isNotNull()
        done.append(table.filter(~goes_on).select("bin", "fill", "members"))
        bins = table.filter(goes_on).select("bin", "fill", "members").repartitionById(parts, F.pmod(F.hash("bin"), F.lit(parts)))
    full = done[0]
    for more in done[1:]:
        full = full.unionByName(more)
    return _places(full, columns, kinds, length)


def _places(bins: DataFrame, columns: list[str], kinds: list[T.DataType], at: int) -> DataFrame:
    """One row a member: its bin, and the lengths of the members before it as offset."""
    names = [*columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("members")
            values = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            length = values.field(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(length) - length
            first = np.cumsum(counts) - counts
            offset = before - np.repeat(before[first] if len(first) else before[:0], counts)
            sequence = np.repeat(b.column("bin").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([*values.flatten(), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    schema = T.StructType([*(T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return bins.select("bin", "members").mapInArrow(tx.tidy(run), schema)
