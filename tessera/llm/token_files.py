"""Token-ID output: Parquet list columns in ascending document order.

Layout of the table that ``write_token_files`` makes: one file per range of
doc_id, its rows ascending. ``ids`` is dictionary encoded (a vocabulary of
2**18 ids or less fits the dictionary page, so an id takes log2(vocabulary)
bits); ``doc_id``, ``local_start`` and ``n_tokens`` are DELTA_BINARY_PACKED
(writer version 2). Row groups and pages are small and every page has its
min / max in the column index, so that a reader of some documents fetches few
pages, and a reader of the metadata never touches ``ids``. ``shard`` numbers
the files in document order; a second small table has the tokens of each.

A very long text is a slab of its own and one row of one file. Nulls: a null text
encodes as empty (only the end id); a null doc_id sorts
first. Equal doc_ids keep one row each, ordered by text. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, materialise, new_path
from ._tokens import BLANK, BREAK, DIGIT, INK, LETTER, MARK, QUOTE, Pieces, letter_table, list_offsets, load, pair_table, segments
from ._words import SPACE, remembered, slabs

FILE_SCHEMA = "doc_id long, shard int, local_start long, n_tokens int, ids array<int>"
#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 8 << 20, 64 << 10, 500
#: Bytes of input (as the planner knows it) for one file.
FILE_INPUT = 64 << 20
#: Neighbouring classes of bytes between which a token never stands: runs of letters, digits and marks are tokens of their own, and white space ends them. A mark after an apostrophe is one run with it, a letter may be a contraction.
ENDS = {(LETTER, MARK), (LETTER, QUOTE), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, MARK), (DIGIT, QUOTE), (MARK, LETTER), (MARK, DIGIT), (QUOTE, DIGIT)}
#: Bytes that begin characters of more than one byte of which some are white space.
MAYBE_WHITE = (0xC2, 0xE1, 0xE2, 0xE3)


def cut_tables() -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes with a cut between them, and pairs with a cut before them: a space and what it leads.

    White space that stands before something else gives its last character
    away: a space goes with what follows, any other is a token of its own.
    """
    white = (BLANK, BREAK)
    between = pair_table(lambda a, b: (a, b) in ENDS or (a in INK and b in white) or (a == BREAK and b in INK))
    ahead = pair_table(lambda a, b: a in white and b in INK)
    lead = [b for b in range(0xC3, 0xF5) if b not in MAYBE_WHITE]
    ahead[[256 * a + b for a in np.flatnonzero(SPACE) for b in lead]] = True
    between[[256 * a + b for a in np.flatnonzero(SPACE) if a != 0x20 for b in lead]] = True
    return between, ahead


class ByteLevelEncoder:
    """Encodes whole slabs by pieces that the byte-level pattern never joins."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        pretoken = lambda c: "".join(w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
        self.letters = letter_table(pretoken)
        self.letters[0x20] = pretoken(" ")
        self.simple = re.compile(f" ?[{''.join(chr(c) for c in self.letters if c != 0x20)}]+").fullmatch
        self.cuts = cut_tables()
        self.pieces = Pieces(lambda new: [self.piece(p) for p in new])

    def piece(self, text: str) -> list[int]:
        """Ids of a piece: a run of plain letters is one pre-token."""
        if self.simple(text):
            return [t.id for t in self.tokenizer.model.tokenize(text.translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: pa.Array, end_id: int) -> pa.ListArray:
        """Ids of every row of a text column, each with ``end_id`` behind."""
        data, start, end, first, left = segments(text, *self.cuts, whole="<|")
        alone = np.zeros(len(start), bool)
        alone[first[:-1][left]] = True
        ids, size = self.pieces.ids(data, start, end, alone)
        off = list_offsets(first, size)
        ids = np.insert(ids, off[1:], end_id)
        return pa.ListArray.from_arrays(pa.array(off + np.arange(len(off)), pa.int32()), pa.array(ids, pa.int32()))


@remembered
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """The encoder of this tokenizer in this worker process; what it remembers outlives a task."""
    return ByteLevelEncoder(path)


def encoder(path: str, end_id: int):
    """A mapInArrow function: sorted (doc_id, text) of one partition to rows of the file format."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard, at = byte_level_encoder(path), TaskContext.get().partitionId(), 0
        for batch in slabs(batches, keep=True):
            ids = own.encode(batch.column(1), end_id)
            off = ids.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(at + off[:-1]), pa.array(sizes, pa.int32()), ids], ["doc_id", "shard", "local_start", "n_tokens", "ids"])
            at += int(off[-1])

    return encode


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> str:
    """Encode ``docs`` and write them in ascending id order; returns the path of the files."""
    spark = docs.sparkSession
    bounded_batches(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if files is None:
        known = int(picked._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known // FILE_INPUT))
    rows = picked.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encoder(tokenizer_path, end_id), FILE_SCHEMA)
    path = new_path(spark, "tokens")
    rows.write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.block.size": ROW_GROUP,
            "parquet.page.size": PAGE,
            "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.dictionary.page.size": 1 << 20,
            "parquet.enable.dictionary#ids.list.element": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#local_start": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }
    ).parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows of the files with ``start``, the ids of all documents before; without ``ids`` only metadata pages are read."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    # One row a file: the running total over files is a small window.
    base = shards.select("shard", (F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens")).alias("base"))
    # The table of files is as long as the number of files; it is written so that its size is known to the planner.
    base = materialise(base, "token-shards")
    columns = ["doc_id", "shard", "local_start", "n_tokens"] + ["ids"] * with_ids
    return files.select(*columns).join(base, "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "shard")


def ids_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, start, n_tokens, ids) to the digest columns."""
    for batch in batches:
        lists = batch.column(3)
        off = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_files(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    rows = read_token_files(spark, path).select("doc_id", F.col("start").cast("long"), F.col("n_tokens").cast("long"), "ids")
    return rows.mapInArrow(ids_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
