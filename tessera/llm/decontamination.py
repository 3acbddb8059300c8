"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then an overlap check.

Every passage (overlapping word windows) of every document is a query against
the index of test items. Impacts are divided by the score of an item for its
own text, so one threshold serves all items. Evaluation is
document-at-a-time over the items with block-max WAND: posting lists are cut
into blocks with their greatest impact, the pivot is found from list bounds,
and a block whose bound stays under the threshold is skipped. Before that,
the greatest impacts of a window's terms per range of items (a coarser level
of block maxima) are added up for all windows of a batch at once; a window
whose sums stay under the threshold in every range can hold no item and is
not evaluated.

A retrieved item counts only after its text is verified: word n-grams of its
question part and of its answer part (the last sentence) must both be found
in the document to the shares asked for. A part of fewer words than an n-gram
has is looked up as one n-gram of all its words.

The index is built per block of test items (about ``BLOCK_CHARS`` of text, by a
hash of the item). A worker gets up to ``TOGETHER`` blocks in a broadcast, whose
size that bounds, and searches every document in them in turn; only a longer
benchmark takes a second pass. Document frequencies and lengths are those of
the whole benchmark, so scores do not depend on how it is cut.

Texts are searched whole, a very long one window by window; of windows of a
document that hold an item the best one's score is reported.

Null or empty texts match nothing, items without words are never found, equal
items are all reported, repeated document rows are reported alike. An empty
table on either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, materialise, release
from ._words import shingles, slabs, words

K1, B = 1.2, 0.75
#: Items of a range of the coarse level, and ranges at most.
RANGE_ITEMS, RANGES = 8, 64
#: Words that an answer has at least, where the item is long enough.
ANSWER_WORDS = 6
#: Share of an item's own score that a passage must reach; shares of question and answer n-grams that must be found.
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.5, 0.5
NGRAM = 3
BLOCK_POSTINGS = 16
BLOCK_CHARS = 4 << 20
#: Bytes of text that a worker searches at a time.
SLAB = 1 << 20
#: Blocks that one worker searches in turn.
TOGETHER = 16
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence that starts ``ANSWER_WORDS`` or more before the end; short items are both at once."""
    for m in reversed([*SENTENCE_END.finditer(text.rstrip())]):
        if len(text[m.end() :].split()) >= ANSWER_WORDS:
            return text[: m.end()], text[m.end() :]
    parts = text.split()
    if len(parts) < 2 * ANSWER_WORDS:
        return text, text
    cut = max(len(parts) // 2, len(parts) - 2 * ANSWER_WORDS)
    return " ".join(parts[:cut]), " ".join(parts[cut:])


def ngram_keys(h: np.ndarray, n: int = NGRAM) -> np.ndarray:

    return np.unique(shingles(h, n))


def part_keys(h: np.ndarray) -> tuple[np.ndarray, int]:
    """n-grams of one part of an item and their n: ``NGRAM``, or all words of a shorter part."""
    return ngram_keys(h), min(NGRAM, len(h))


def found_share(part: tuple[np.ndarray, int], grams: dict[int, np.ndarray], h: np.ndarray) -> float:
    """Share of a part's n-grams among those of the same n of a document with words ``h``; ``grams`` remembers these by n."""
    keys, n = part
    if not n:
        return 1.0
    if n not in grams:
        grams[n] = ngram_keys(h, n)
    return float(np.isin(keys, grams[n], assume_unique=True).mean())


class ItemIndex:
    """Inverted index of one block of test items with block maxima.

    ``whole``: (items with words, their mean length, the greatest, number of items
    of each term) of the benchmark, if the block is not all of it.
    """

    def __init__(self, ids: list[int], texts: list[str], whole: tuple[int, float, int, dict[int, int]] | None = None):
        h, first = words(pa.array(texts, pa.string()))
        keep = [i for i in range(len(ids)) if first[i + 1] > first[i]]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        sizes = np.array([first[i + 1] - first[i] for i in keep], float)
        count, average, self.longest, frequency = whole or (len(keep), sizes.mean(), int(sizes.max()), {}) if len(keep) else (0, 1.0, 0, {})
        postings: dict[int, list[tuple[int, int]]] = {}
        for at, i in enumerate(keep):
            for term, tf in zip(*np.unique(h[first[i] : first[i + 1]], return_counts=True), strict=True):
                postings.setdefault(int(term), []).append((at, int(tf)))
        self.terms = np.array(sorted(postings), np.uint64)
        own = np.zeros(len(keep))
        lists = []
        for term in self.terms:
            items = np.array([p[0] for p in postings[int(term)]], np.int64)
            tf = np.array([p[1] for p in postings[int(term)]], float)
            df = frequency.get(int(term), len(items))
            idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[items] / average))
            np.add.at(own, items, impact)
            lists.append((items, impact))
        self.lists = [(items, impact / own[items]) for items, impact in lists]
        self.block_max = [np.maximum.reduceat(impact, np.arange(0, len(impact), BLOCK_POSTINGS)) for _, impact in self.lists]
        self.block_last = [items[np.minimum(np.arange(BLOCK_POSTINGS - 1, len(items) + BLOCK_POSTINGS - 1, BLOCK_POSTINGS), len(items) - 1)] for items, _ in self.lists]
        self.bound = np.array([impact.max() for _, impact in self.lists] + [0.0], np.float32)
        ranges = max(1, min(RANGES, -(-len(keep) // RANGE_ITEMS)))
        self.range_max = np.zeros((len(self.lists), ranges), np.float32)
        self.range_first = [-(-r * len(keep) // ranges) for r in range(ranges + 1)]
        for t, (items, impact) in enumerate(self.lists):
            np.maximum.at(self.range_max[t], items * ranges // len(keep), impact.astype(np.float32))
        # Plain lists: the evaluation reads single values.
        self.lists = [(items.tolist(), impact.tolist()) for items, impact in self.lists]
        self.block_max = [m.tolist() for m in self.block_max]
        self.block_last = [last.tolist() for last in self.block_last]
        self.list_bound = self.bound.tolist()
        parts = [split_item(texts[i]) for i in keep]
        self.question, self.answer = ([part_keys(words(pa.array([p[k]], pa.string()))[0]) for p in parts] for k in (0, 1))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, or the number of terms where it is in no item."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, len(self.terms)) if len(self.terms) else np.zeros(len(h), np.int64)

    def search(self, query: np.ndarray, threshold: float, begin: int = 0, stop: int | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with a score of ``threshold`` or more for a set of terms, among items begin:stop."""
        stop = len(self.ids) if stop is None else stop
        threshold -= 1e-9
        cursors = []  # current item, place in the list, term
        for t in query.tolist():
            items = self.lists[t][0]
            at = bisect_left(items, begin)
            if at < len(items) and items[at] < stop:
                cursors.append([items[at], at, t])
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.list_bound[c[2]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # Bounds of the blocks that can hold the pivot item, without reading their postings.
            upper, jump = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else stop
            for _, _, t in cursors[: pivot + 1]:
                last = self.block_last[t]
                block = bisect_left(last, item)
                if block < len(last):
                    upper += self.block_max[t][block]
                    jump = min(jump, last[block] + 1)
            if upper < threshold:
                target = max(jump, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.lists[t][1][p] for _, p, t in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            alive = cursors[pivot + 1 :]
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    items = self.lists[c[2]][0]
                    c[1] = bisect_left(items, target, c[1])
                    if c[1] == len(items) or items[c[1]] >= stop:
                        continue
                    c[0] = items[c[1]]
                alive.append(c)
            cursors = alive
        return found

    def match(self, h: np.ndarray, first: np.ndarray, threshold: float) -> dict[int, dict[int, float]]:
        """For each row with any: the best BM25 share of every item that some passage of the row retrieved.

        Row i has words first[i]:first[i + 1]. Chunks have as many words as the
        longest item; a passage is two neighbouring chunks, so any item stands
        whole inside some passage.
        """
        size = max(16, self.longest)
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        chunks = -(-np.diff(first) // size)
        base = np.concatenate([[0], np.cumsum(chunks)])
        chunk = base[rows] + (np.arange(len(h)) - first[rows]) // size
        term = self.lookup(h)
        known = term < len(self.terms)
        pairs = np.unique((chunk[known] << 32) | term[known])
        owner, term = pairs >> 32, pairs & 0xFFFFFFFF
        sums = np.zeros((base[-1] + 1, self.range_max.shape[1]), np.float32)
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(begin):
            sums[owner[begin]] = np.add.reduceat(self.range_max[term], begin, axis=0)
        same_row = np.ones(base[-1], bool)
        same_row[base[1:][chunks > 0] - 1] = False
        sums[:-1] += np.where(same_row[:, None], sums[1:], 0)
        best: dict[int, dict[int, float]] = {}
        for c in np.flatnonzero((sums[:-1] >= threshold - 1e-5).any(axis=1)):
            a, b = np.searchsorted(owner, [c, c + 1 + same_row[c]])
            query = np.unique(term[a:b])
            for r in np.flatnonzero(self.range_max[query].sum(axis=0) >= threshold - 1e-5):
                for item, score in self.search(query, threshold, self.range_first[r], self.range_first[r + 1]):
                    own = best.setdefault(int(np.searchsorted(base, c, side="right")) - 1, {})
                    own[item] = max(own.get(item, 0.0), score)
        return best


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (block, text) of items to a row for each different word of an item, the first with the item's length."""
    for batch in slabs(batches):
        block, (h, first) = batch.column(0).to_numpy(), words(batch.column(1))
        for i in np.flatnonzero(np.diff(first)):
            own = h[first[i] : first[i + 1]]
            terms = np.unique(own).view(np.int64)
            size = np.zeros(len(terms), np.int64)
            size[0] = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block[i])), pa.array(size), pa.array(terms)], ["block", "size", "term"])


def indexes(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[ItemIndex]:
    """The index of each block of items; what the driver holds at a time is a block's items and the frequencies of their words."""
    picked = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = picked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // block_chars))
    cut = picked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    terms = materialise(cut.select("block", "text").mapInArrow(item_terms, "block long, size long, term long"), "item-terms")
    count, average, longest = terms.where("size > 0").agg(F.count("*"), F.avg("size"), F.max("size")).first()
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    for number in range(blocks):
        rows = cut.where(F.col("block") == number).orderBy("item_id", "text").collect()
        own = frequency.join(terms.where(F.col("block") == number).select("term").distinct(), "term").collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], (count, average, longest, {r["term"] % (1 << 64): r["df"] for r in own}))
    release(terms)


def shipped(items: DataFrame, block_chars: int = BLOCK_CHARS, together: int = TOGETHER) -> Iterator[Broadcast]:
    """The indexes of all blocks, up to ``together`` of them in a broadcast, which bounds both what is sent and what a worker holds."""
    found, spark = indexes(items, block_chars), items.sparkSession
    while some := list(islice(found, together)):
        yield spark.sparkContext.broadcast(some)


def leaks_of(index: ItemIndex, text: pa.Array, threshold: float, question_share: float, answer_share: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, BM25 share, question share, answer share) of the rows of a text column that hold an item."""
    h, first = words(text)
    for i, best in index.match(h, first, threshold).items():
        own, grams = h[first[i] : first[i + 1]], {}
        for item, score in best.items():
            q, a = (found_share(x, grams, own) for x in (index.question[item], index.answer[item]))
            if q >= question_share and a >= answer_share:
                yield i, item, score, q, a


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, bm25_share, question_share, answer_share) of documents that hold a test item.

    ``docs``: doc_id, text; ``items``: item_id, text.
    """
    bounded_batches(docs.sparkSession)
    names, kinds = ["doc_id", "item_id", "bm25_share", "question_share", "answer_share"], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def searched(some: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slabs(batches, most=SLAB):
                found = [(batch.column(0)[i].as_py(), int(index.ids[item]), *shares) for index in some.value for i, item, *shares in leaks_of(index, batch.column(1), threshold, question_share, answer_share)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, bm25_share double, question_share double, answer_share double")

    return reduce(DataFrame.unionByName, map(searched, shipped(items, block_chars)))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, whatever their ids, whose text holds no test item; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    for some in shipped(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], some: Broadcast = some) -> Iterator[pa.RecordBatch]:
            for batch in slabs(batches, text_col, SLAB):
                clean, text = np.ones(batch.num_rows, bool), batch.column(batch.schema.get_field_index(text_col))
                for index in some.value:
                    clean[[i for i, *_ in leaks_of(index, text, THRESHOLD, QUESTION_SHARE, ANSWER_SHARE)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
