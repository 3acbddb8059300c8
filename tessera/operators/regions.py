"""Regions found by a pass that remembers: dense windows, drop-off regions, masked and patched alignments."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.operators import scan


def block_counts(df: DataFrame, key: str, pos: str, size: int, parts: int = 10, crowded: int = 4) -> DataFrame:
    """(key, block, n) of blocks of ``size`` positions that hold rows; from ``crowded`` rows on n counts the block's occupied tenths (``parts``), so that copies do not make a block dense."""
    rows = df.select(key, F.floor(F.col(pos) / size).alias("block"), F.floor(F.pmod(F.col(pos), F.lit(size)) / (size / parts)).alias("part"))
    # Two steps, so that a hot block is summed before it is sent.
    held = rows.groupBy(key, "block", "part").agg(F.count("*").alias("__c"))
    return held.groupBy(key, "block").agg(F.sum("__c").alias("rows"), F.count("*").alias("held")).select(key, "block", F.when(F.col("rows") >= crowded, F.col("held")).otherwise(F.col("rows")).alias("n"))


def dense_path(block: np.ndarray, n: np.ndarray, density: float, size: int, most: int, least: int, opened: float, length: tuple[float, float] | None) -> list[tuple[int, int]]:
    """Index ranges [i, j) of the clusters on the best path through the filled blocks of one stretch.

    A block outside a cluster scores its background n * ln(density) - density *
    size (an empty one as well). A cluster scores reads * (ln(reads / width) - 1)
    + ``opened``, and with ``length`` (mean, deviation) the logarithm of a normal
    density of its width. It begins and ends in a filled block, spans ``most``
    blocks at most and holds ``least`` reads. Of equal paths the one with less
    in clusters, then the shorter last cluster.
    """
    total = np.concatenate([[0], np.cumsum(n)])
    empty = -density * size
    skipped = np.concatenate([[0.0], (np.diff(block) - 1) * empty])
    best, before = np.zeros(len(block) + 1), np.zeros(len(block), np.int64)
    for i in range(len(block)):
        j = np.arange(i, np.searchsorted(block, block[i] - most, side="right") - 1, -1)
        reads, width = (total[i + 1] - total[j]).astype(float), (block[i] - block[j] + 1.0) * size
        score = best[j] + skipped[j] + reads * (np.log(np.maximum(reads, 1e-300) / width) - 1) + opened
        if length:
            score -= (width - length[0]) ** 2 / (2 * length[1] ** 2) + math.log(length[1]) + 0.5 * math.log(2 * math.pi)
        score[reads < least] = -np.inf
        k = int(np.argmax(score))
        outside = best[i] + skipped[i] + n[i] * math.log(density) + empty
        best[i + 1], before[i] = (score[k], j[k]) if score[k] > outside else (outside, -1)
    out, i = [], len(block) - 1
    while i >= 0:
        if before[i] < 0:
            i -= 1
        else:
            out.append((int(before[i]), i + 1))
            i = int(before[i]) - 1
    return out[::-1]


def dense_windows(counts: DataFrame, key: str, size: int, most: int, gap: int, least: int = 5, opened: float = math.log(1e-6), length: tuple[float, float] | None = None, coarse: int = 10) -> DataFrame:
    """(key, start, end, reads, density): stretches denser than their key's background, from (key, block, n), by dynamic programming.

    The background is the share of runs of ``coarse`` blocks that hold anything,
    over their length. No cluster spans ``gap`` empty blocks, so the best path
    falls apart there: each stretch between such gaps is solved apart.
    """
    shares = counts.groupBy(key, F.floor(F.col("block") / coarse).alias("__c")).agg(F.lit(1).alias("__1")).groupBy(key).agg(F.count("*").alias("__filled"), F.max("__c").alias("__last"))
    background = shares.select(key, (F.col("__filled") / (F.col("__last") + 1) / (coarse * size)).alias("__d"))
    w = Window.partitionBy(key).orderBy("block")
    rows = counts.withColumn("__new", F.when(F.col("block") - F.lag("block").over(w) <= gap, 0).otherwise(1)).withColumn("__s", F.sum("__new").over(w)).join(background, key)

    def fold(own: Iterable[tuple]) -> Iterator[tuple]:
        block, n, density = (np.array(x) for x in zip(*own, strict=True))
        for i, j in dense_path(block, n, float(density[0]), size, most, least, opened, length):
            reads, start, end = int(n[i:j].sum()), int(block[i]) * size, (int(block[j - 1]) + 1) * size
            yield start, end, reads, reads / (end - start)

    fields = [rows.schema[key], rows.schema["__s"], StructField("start", LongType()), StructField("end", LongType()), StructField("reads", LongType()), StructField("density", DoubleType())]
    return scan.scan_keys(rows, [key, "__s"], ["block"], ["block", "n", "__d"], fold, StructType(fields)).drop("__s")


def clean_pieces(hit: np.ndarray, misses: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a sequence between runs of ``misses`` or more positions that are no hits; every piece begins and ends with a hit."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    far = np.flatnonzero(np.diff(at) > misses)
    return list(zip(at[np.concatenate([[0], far + 1])].tolist(), (at[np.concatenate([far, [len(at) - 1]])] + 1).tolist(), strict=True))


def drop_regions(hit: list[bool], reward: float, drop: float) -> Iterator[tuple[int, int]]:
    """[start, end) of maximal scoring regions: a hit adds ``reward``, another position takes 1; a region ends at its best score once that is ``drop`` behind, or nothing is left."""
    i = 0
    while i < len(hit):
        if not hit[i]:
            i += 1
            continue
        score, top, end, at = 0.0, 0.0, i, i
        while at < len(hit) and (hit[at] or score > 0):
            score += reward if hit[at] else -1.0
            at += 1
            if score > top:
                top, end = score, at
            elif score <= 0 or top - score > drop:
                break
        yield i, end
        # What lies behind the best score is looked at again.
        i = end


def x_drop_regions(df: DataFrame, key: str, seq: str, hits: str, share: float = 0.6, drop: float = 10.0, least: int = 20) -> DataFrame:
    """(key, start, end, hits): regions of ``least`` characters or more with a share of ``share`` or more of the characters in ``hits``.

    No region reaches over more than ``drop`` other characters in a row, so a
    sequence is cut there and the pieces are dealt out: one long sequence is
    many tasks' work.
    """
    reward, misses, wanted = (1 - share) / share, math.floor(drop) + 1, set(hits)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hit = np.fromiter((c in wanted for c in text or ""), bool, len(text or ""))
                rows += [(k.as_py(), a, np.packbits(hit[a:b]).tobytes(), b - a) for a, b in clean_pieces(hit, misses)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.types[0], pa.int64(), pa.binary(), pa.int64()))], ["key", "offset", "bits", "size"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, offset, bits, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=size).astype(bool)
                before = np.concatenate([[0], np.cumsum(hit)])
                rows += [(k, offset + a, offset + b, int(before[b] - before[a])) for a, b in drop_regions(hit.tolist(), reward, drop) if b - a >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.types[0], pa.int64(), pa.int64(), pa.int64()))], ["key", "start", "end", "hits"])

    kind = dict(df.dtypes)[key]
    cut = df.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInArrow(pieces, f"key {kind}, offset long, bits binary, size long")
    return cut.repartition("key", "offset").mapInArrow(solve, f"key {kind}, start long, end long, hits long").withColumnRenamed("key", key)


def mask_alignments(rows: DataFrame, query: str, start: str, end: str, columns: list[str], level: float = 0.5) -> DataFrame:
    """(query, start, end, columns) of alignments kept by length, the longest first (of equals the one that begins first): what a kept one overlaps by more than ``level`` of its length goes."""
    picked = rows.withColumn("__neg", F.col(start) - F.col(end))

    def fold(own: Iterable[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for row in own:
            s, e = row[:2]
            if not any(min(e, b) - max(s, a) > level * (e - s) for a, b in kept):
                kept.append((s, e))
                yield row

    schema = StructType([picked.schema[c] for c in (query, start, end, *columns)])
    return scan.scan_keys(picked, [query], ["__neg", start, *columns], [start, end, *columns], fold, schema)


def patch_alignments(rows: DataFrame, query: str, target: str, strand: str, on_target: tuple[str, str], on_query: tuple[str, str], gap: int, quality: str) -> DataFrame:
    """(query, target, strand, both spans, quality): neighbours on one target and strand whose gaps stay under ``gap`` on both sides, joined; the last one's quality stays."""
    (ts, te), (qs, qe) = on_target, on_query
    w = Window.partitionBy(query).orderBy(target, ts, qs)
    near = lambda a, b: F.abs(F.col(a) - F.lag(b).over(w)) < gap
    together = (F.col(target) == F.lag(target).over(w)) & (F.col(strand) == F.lag(strand).over(w)) & near(ts, te) & near(qs, qe)
    # A part is what its last row says and where its first one began: all in one order, nothing is grouped.
    marked = rows.withColumn("__new", F.when(together, 0).otherwise(1))
    began = F.last(F.when(F.col("__new") == 1, F.struct(F.col(ts).alias("ts"), F.col(qs).alias("qs"))), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = marked.withColumns({"__began": began, "__next": F.lead("__new").over(w)}).where("__next is null or __next = 1")
    return ends.select(query, target, strand, F.col("__began.ts").alias(ts), F.col("__began.qs").alias(qs), te, qe, quality)


#: Lengths from which break points are counted.
BREAK_LENGTHS = (0, 100, 200, 500)


def break_counts(rows: DataFrame, query: str, length: Column, quality: str, least: int = 10) -> DataFrame:
    """One row: break points of all alignments (one less than a query's parts), and of those of good quality and some length."""
    good = F.col(quality) >= least
    tests = {"all": F.lit(True)} | {f"from_{n}": good & (length >= n) for n in BREAK_LENGTHS}
    parts = rows.groupBy(query).agg(*(F.count_if(t).alias(c) for c, t in tests.items()))
    return parts.agg(*(F.coalesce(F.sum(F.greatest(F.col(c) - 1, F.lit(0))), F.lit(0)).alias(c) for c in tests))
