"""Fixed-size arrays summed over all tasks: counts by hash bucket, and bit sets made of them.

Every task adds up its own array and hands on compressed slices of it; slices of the same number meet
in one task. So the traffic is bounded by tasks times array size, and the driver gets one bit a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 64
SCHEMA = "slice int, payload binary"


def slices(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The array in compressed slices, empty ones left out."""
    press = zstandard.ZstdCompressor(level=1)
    parts = np.split(counts.astype("<u4"), SLICES)
    return [(i, press.compress(p.tobytes())) for i, p in enumerate(parts) if p.any()]


def counts(rows: DataFrame, size: int) -> np.ndarray:
    """The summed counts, bucket by bucket, of the slices of all tasks (:data:`SCHEMA`)."""
    width = size // SLICES
    summed = rows.select("slice", "payload").repartitionById(SLICES, F.col("slice")).mapInArrow(_summing(width), "slice int, payload binary, total bigint")
    got = summed.collect()  # SLICES rows of compressed counts
    press = zstandard.ZstdDecompressor()
    out = np.zeros(size, np.uint64)
    for r in got:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(press.decompress(r["payload"], max_output_size=8 * width), "<u8")
    return out


def _summing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, payload in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
                own = sums.setdefault(i, np.zeros(width, np.uint64))
                own += np.frombuffer(unpress.decompress(payload, max_output_size=4 * width), "<u4")
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([press.compress(own.astype("<u8").tobytes())], pa.binary()), pa.array([int(own.sum())], pa.int64())], ["slice", "payload", "total"])

    return run


def members(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """A bit set, eight to a byte, of the low bits of all values of a bigint column: those that may be members."""
    width = size // 8 // SLICES

    def packed(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [(i, p.tobytes()) for i, p in enumerate(np.split(own, SLICES)) if p.any()]
        press = zstandard.ZstdCompressor(level=1)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([press.compress(p) for _, p in parts], pa.binary())], ["slice", "payload"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, bool)
        for b in batches:
            own[b.column(0).to_numpy() & (size - 1)] = True
        yield from packed(np.packbits(own))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = np.zeros((SLICES, width), np.uint8), zstandard.ZstdDecompressor()
        for b in batches:
            for i, payload in zip(b.column("slice").to_pylist(), b.column("payload").to_pylist(), strict=True):
                own[i] |= np.frombuffer(press.decompress(payload, max_output_size=width), np.uint8)
        yield from packed(own.ravel())

    rows = keys.select(column).mapInArrow(marked, SCHEMA).repartitionById(SLICES, F.col("slice")).mapInArrow(merged, SCHEMA)
    out, press = np.zeros((SLICES, width), np.uint8), zstandard.ZstdDecompressor()
    for r in rows.collect():  # SLICES rows at most
        out[r["slice"]] = np.frombuffer(press.decompress(r["payload"], max_output_size=width), np.uint8)
    return out.ravel()
