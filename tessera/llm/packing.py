"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Best-two-fit fills a bin greedily, each time with the largest document that
fits. When nothing fits any more and the bin holds more than one document, its
smallest one is taken out again if two unpacked documents fit the expanded gap
more tightly; the tightest two go in.

How full a bin gets depends on lengths alone, and there are at most
``capacity`` lengths. So the method runs on the table of lengths: equal bins
are filled at once, as often as the documents last, which gives the same bins
as one after the other. Spark does the rest:

1. Texts are encoded (see ``bpe``), documents longer than a sequence are cut
   into pieces, and pieces are written with their ids. A task numbers its
   pieces of each length.
2. Pieces are counted by task and length; running totals over tasks turn a
   piece's number within its task into its rank among all of its length.
3. The counts by length (at most ``capacity`` rows) are packed on the driver;
   the plan says which ranks of a length go to which sequences and where. It
   has a few rows for each length, whatever the number of documents, and that
   bound makes its broadcast safe.
4. Every piece looks its place up by length and rank.

No piece meets another in a task, so a length that a third of all documents
share is spread like any other. ``sequences`` puts pieces together.

A null or empty text is the end id alone. Repeated rows are packed one by one,
a null doc_id stays null. Pieces of equal length are ranked by the order of
tasks and of rows in them, any of which gives as many sequences. Very long
texts are cut into full sequences and a rest. Columns asked for stay; those
named as a new one are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, free_name, materialise
from ._words import slabs
from .bpe import fragment_encoder

CAPACITY, END_ID = 4096, 1
PIECES = "piece int, start long, length int, task int, number long, ids binary"
PACKED = "piece int, start long, length int, ids array<int>, sequence_id long, offset long"


def cut_pieces(ids: pa.ListArray, end_id: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, number in its row, length, ids) of every piece of the lists, each closed by ``end_id``; a piece's ids are its bytes, which the JVM copies as they are."""
    off = ids.offsets.to_numpy().astype(np.int64)
    flat = np.insert(ids.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off[1:] - off[0], end_id)
    size = np.diff(off) + 1
    count = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(capacity, size[row] - piece * capacity)
    edges = 4 * np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    return row, piece, length, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(flat.astype("<i4"))]).cast(pa.binary())


def as_lists(packed: pa.Array) -> pa.ListArray:
    """Lists of ids from their bytes."""
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(packed.buffers()[2] or b"", "<i4", count=edges[-1] // 4)
    return pa.ListArray.from_arrays(pa.array(edges // 4, pa.int32()), pa.array(flat, pa.int32()))


def number_within(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length came before each one; ``seen`` counts them and goes on."""
    order = np.argsort(length, kind="stable")
    lengths, first, count = np.unique(length[order], return_index=True, return_counts=True)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(first, count) + seen[length[order]]
    seen[lengths] += count
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``PIECES`` of every document: ``number`` counts a task's pieces of one length."""
    whole = free_name(docs, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = fragment_encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slabs(batches, whole, 2 << 20, keep=True):
            row, piece, length, ids = cut_pieces(encoder.encode(batch.column(len(keep))), end_id, capacity)
            made = [pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length, pa.int32()), pa.array(np.full(len(row), task, np.int32)), pa.array(number_within(length, seen)), ids]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[: len(keep)]), *made], [*keep, *(f.split()[0] for f in PIECES.split(", "))])

    bounded_batches(docs.sparkSession)
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias(whole))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, kept + PIECES)


def tightest_two(lengths: np.ndarray, count: np.ndarray, most: int) -> tuple[int, int]:
    """Two documents (lengths ascending, how many of each are free) of the largest sum up to ``most``; (0, 0) if none."""
    lengths, count = lengths[count > 0], count[count > 0]
    if not len(lengths):
        return 0, 0
    # For each larger one the largest other that still fits, itself where there is a second.
    other = np.minimum(np.searchsorted(lengths, most - lengths, side="right") - 1, np.arange(len(lengths)))
    other -= (other == np.arange(len(lengths))) & (count < 2)
    total = np.where(other >= 0, lengths + lengths[np.maximum(other, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(lengths[other[best]]), int(lengths[best])) if total[best] else (0, 0)


def best_two_fit(count: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: documents of it in each}) until all are packed. ``count``: documents of each length from 0 to the capacity; none of length 0."""
    left, capacity, out = count.astype(np.int64), len(count) - 1, []
    while (lengths := np.flatnonzero(left)).size:
        gap, most, used = capacity, capacity, {}
        while (at := int(np.searchsorted(lengths, min(gap, most), side="right"))) > 0:
            most = int(lengths[at - 1])
            used[most] = min(int(left[most]), gap // most)
            gap -= used[most] * most
            most -= 1
        if gap and sum(used.values()) > 1:
            least = min(used)
            free = left[lengths]
            free[np.searchsorted(lengths, list(used))] -= list(used.values())
            two = tightest_two(lengths, free, gap + least)
            if sum(two) > least:
                used[least] -= 1
                for x in two:
                    used[x] = used.get(x, 0) + 1
        used = {x: k for x, k in used.items() if k}
        bins = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= bins * k
        out.append((bins, used))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, documents of it in each, offset of the first), by length and rank."""
    taken, first, rows = {}, 0, []
    for bins, used in patterns:
        offset = 0
        for x, k in sorted(used.items(), reverse=True):
            rows.append((x, taken.get(x, 0), first, k, offset))
            taken[x] = taken.get(x, 0) + bins * k
            offset += x * k
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """A row per piece: ``keep`` columns and ``PACKED``, or what ``then`` makes of their batches (``schema``) in the same worker."""
    new = {*(f.split()[0] for f in PIECES.split(", ")), "sequence_id", "offset"}
    keep = tuple(c for c in keep if c.lower() not in new)
    pieces = materialise(tokenized(docs, tokenizer_path, end_id, capacity, text_col, keep), "pieces")
    counts = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("pieces")), "lengths")
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("task")) - F.col("pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect():
        count[r["length"]] = r["pieces"]
    plan = docs.sparkSession.sparkContext.broadcast(places(best_two_fit(count)))
    ranked = pieces.join(counts.select("task", "length", before.alias("before")), ["task", "length"])
    ranked = ranked.select(*(F.col(f"`{c}`") for c in keep), "piece", "start", "length", "ids", (F.col("before") + F.col("number")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        # Lengths take 13 bits or a few more, ranks the rest.
        code = lambda length, rank: (length << 40) + rank
        codes = code(table[:, 0], table[:, 1])
        for batch in batches:
            length, rank = (batch.column(len(keep) + i).to_numpy().astype(np.int64) for i in (2, 4))
            row = table[np.searchsorted(codes, code(length, rank), side="right") - 1]
            bin_, slot = np.divmod(rank - row[:, 1], row[:, 3])
            out = pa.RecordBatch.from_arrays([*batch.columns[:-2], as_lists(batch.column(len(keep) + 3)), pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + slot * length)], [*batch.schema.names[:-2], "ids", "sequence_id", "offset"])
            yield then(out) if then else out

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ranked.schema.fields[: len(keep)])
    return ranked.mapInArrow(place, schema or kept + PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the pieces of every sequence one behind the other; a sequence has ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))


def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Packed pieces of documents with a CRC in place of their ids."""
    lists = batch.column("ids")
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return batch.set_column(4, "ids_crc32", pa.array(crc, pa.int64()))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"
    rows = pack_documents(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), then=digest, schema=schema)
    return rows.withColumn("length", F.col("length").cast("long"))
