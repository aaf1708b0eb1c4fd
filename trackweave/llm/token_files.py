"""Token-id files: fixed-size blocks of ids, transposed into byte planes, each plane compressed.

A file is a Parquet container (uncompressed; the planes are) with one row per segment. A segment holds
whole documents in file order: ``file`` and ``segment`` give its place, ``first`` the ids of the file
before it, ``n_ids`` its ids, ``doc_id``
and ``doc_end`` (end offset of each document's ids in the segment) its documents, ``index`` the chunk
index (byte offset of every plane of every block in ``planes``, and the end), ``planes`` the zstandard
frames. Block b holds ids [b * BLOCK, (b + 1) * BLOCK); its planes are byte 0 (the low byte) of all its
ids, then byte 1, 2, 3; a plane of zeros takes no bytes.

Defined results: null text is empty and has just the end id; a very long text is one document in a segment
of its own size; documents lie in ascending doc_id (nulls
first, ties by text); repeated rows are written again; an empty table makes no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import store, tokens
from trackweave.llm import text as tx

BLOCK = 1 << 14
#: Ids after which a segment is closed (at the end of a document).
SEGMENT = 1 << 18
LEVEL = 3
END = 1
SCHEMA = "file int, segment int, first bigint, n_ids bigint, doc_id array<bigint>, doc_end array<bigint>, index array<bigint>, planes binary"
ARROW = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("doc_end", pa.list_(pa.int64())), ("index", pa.list_(pa.int64())), ("planes", pa.binary())])


def pack_planes(ids: np.ndarray, level: int = LEVEL) -> tuple[bytes, np.ndarray]:
    """The compressed planes of ids (below 2**32) and their chunk index."""
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    out, index = [], [0]
    wide = np.ascontiguousarray(ids, dtype="<u4")
    for i in range(0, len(wide), BLOCK):
        planes = wide[i : i + BLOCK].view(np.uint8).reshape(-1, 4).T
        for plane in planes:
            frame = press.compress(np.ascontiguousarray(plane).tobytes()) if plane.any() else b""
            out.append(frame)
            index.append(index[-1] + len(frame))
    return b"".join(out), np.array(index, np.int64)


def unpack_planes(planes: bytes, index: np.ndarray, n: int, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks [first_block, last_block) of n ids in all; only their planes are read."""
    press = zstandard.ZstdDecompressor()
    blocks = -(-n // BLOCK)
    last_block = blocks if last_block is None else min(last_block, blocks)
    out = []
    for b in range(first_block, last_block):
        size = min(BLOCK, n - b * BLOCK)
        rows = np.zeros((size, 4), np.uint8)
        for p in range(4):
            a, z = int(index[4 * b + p]), int(index[4 * b + p + 1])
            if z > a:
                rows[:, p] = np.frombuffer(press.decompress(planes[a:z], max_output_size=size), np.uint8)
        out.append(rows.view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _segment(file: int, number: int, first: int, ids: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    planes, index = pack_planes(flat)
    ends = np.cumsum([len(x) for x in ids])
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([index], pa.list_(pa.int64())), pa.array([planes], pa.binary())], schema=ARROW)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes every whole text (id ``end`` appended) and writes the files under ``path``.

    Documents are range-partitioned by doc_id, so one shuffle gives the global order; each range is a
    file, written as a stream of segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, first, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        encode = tokens.encoder(tokenizer).encode
        for b in batches:
            ids, at = encode(b.column("text"))
            for doc, i, j in zip(b.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                held.append(np.append(ids[i:j], ids.dtype.type(end)))
                names.append(doc)
                size += j - i + 1
                if size >= SEGMENT:
                    yield _segment(file, number, first, held, names)
                    number, first, held, names, size = number + 1, first + size, [], [], 0
        if held:
            yield _segment(file, number, first, held, names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(store.partitions_for(docs), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(tx.tidy(run), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of the files with ``start``: the ids of all segments before, over all files.

    The files' totals (one number a file, however many documents) go by the driver; no shuffle of planes.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = dict(rows.groupBy("file").agg(F.sum("n_ids")).collect())
    base, so_far = [], 0
    for f in sorted(totals):
        base.append((f, so_far))
        so_far += totals[f]
    bases = F.broadcast(spark.createDataFrame(base, "file int, base bigint"))
    return rows.join(bases, "file").withColumn("start", F.col("base") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' planes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = unpack_planes(row["planes"], row["index"], row["n_ids"])
                ends = np.array(row["doc_end"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(row["start"] + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments(spark, path).mapInArrow(tx.tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
