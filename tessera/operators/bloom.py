"""Bloom filters: bitmaps of a size that follows the number of keys, made by partial ORs, sent only under a bound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter that is sent to every executor, at most; a larger one is not made.
MOST_BYTES = 64 << 20
#: Groups of tasks whose bitmaps are joined to one in each step, and bytes of a bitmap that are joined apart.
GROUPS, SLICE = (1024, 32), 1 << 20


@dataclass(frozen=True)
class Shape:
    """Bits (a multiple of 8) and hashes of a filter."""

    bits: int
    hashes: int

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """Bits of keys by two 64-bit hashes: a + i * b for each i (Kirsch and Mitzenmacher)."""
        with np.errstate(over="ignore"):
            for i in range(self.hashes):
                yield (a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(self.bits)


def shape(keys: int, share: float) -> Shape:
    """Of the least filter that ``keys`` keys fill so far that ``share`` of other keys pass."""
    bits = max(64, -8 * (math.ceil(keys * math.log(share) / math.log(2) ** 2) // 8))
    return Shape(bits, max(1, round(bits / max(keys, 1) * math.log(2))))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), F.col(key)).alias("b"))


def build(df: DataFrame, key: str, share: float = 0.01, most: int = MOST_BYTES) -> tuple[Shape, np.ndarray] | None:
    """(shape, packed bits) of the keys of ``df``, sized by their estimated number; None if it would pass ``most`` bytes.

    A task makes the bitmap of its own keys; slices of bitmaps are joined by OR
    in a tree before they reach the driver: bounded by ``most`` there.
    """
    keys = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    made = shape(math.ceil(keys * 1.05), share)
    if made.bits // 8 > most:
        return None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = np.zeros(made.bits, bool)
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns)
            for at in made.places(a, b):
                own[at.astype(np.int64)] = True
        packed = np.packbits(own)
        number = TaskContext.get().partitionId()
        for i in range(0, len(packed), SLICE):
            if packed[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([number], pa.int32()), pa.array([packed[i : i + SLICE].tobytes()], pa.binary())], ["slice", "number", "bits"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "number": [rows["number"].min()], "bits": [bits.tobytes()]})

    schema = "slice int, number int, bits binary"
    parts = _hashed(df.where(F.col(key).isNotNull()), key).mapInArrow(fill, schema)
    for groups in GROUPS:
        parts = parts.groupBy("slice", F.pmod("number", F.lit(groups))).applyInPandas(join, schema)
    out = np.zeros(made.bits // 8, np.uint8)
    for r in parts.groupBy("slice").applyInPandas(join, schema).collect():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return made, out


def passing(df: DataFrame, key: str, made: tuple[Shape, np.ndarray]) -> DataFrame:
    """Rows whose key the filter may hold: all that it holds, and about its share of others."""
    sent, size = df.sparkSession.sparkContext.broadcast(made[1]), made[0]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (2, 1))
            keep = np.ones(len(a), bool)
            for at in size.places(a, b):
                keep &= (sent.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:-2]], batch.schema.names[:-2])

    marked = df.where(F.col(key).isNotNull()).select(*df.columns, F.xxhash64(key).alias("__a"), F.xxhash64(F.lit(1), F.col(key)).alias("__b"))
    return marked.mapInArrow(pick, df.schema)


def semi_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, most: int = MOST_BYTES) -> DataFrame:
    """The exact semi-join, with rows of ``left`` dropped before the shuffle where a filter of the right keys stays under ``most`` bytes."""
    made = build(right, key, share, most)
    return (passing(left, key, made) if made else left).join(right.select(key), key, "left_semi")
