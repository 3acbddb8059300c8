"""LM scoring by deleted interpolation.

The probability of a token is built up from the uniform one: each order mixes
its maximum-likelihood estimate with the probability by the order below. The
weight of an order belongs to a bucket of the frequency of its context (a
power of two) and is learned by expectation-maximisation: one fold of the
training documents is deleted from the counts, and the weights maximise the
likelihood of its n-grams under the counts of the others, until no weight
moves by ``TOLERANCE``. A step of it needs an n-gram only up to the highest
order that was seen, and equal ones once with their number: a table of these is
written before the first step. The final estimates use the counts of all
training documents.

How it is distributed. Documents are packed into chunks (a written table,
bucketed by chunk). The distinct n-grams of a chunk, as sorted hashes (64
bits, above order 1 the upper 56), are cut into hash ranges and shuffled with
their counts, one blob per chunk and range that holds any; the owner of a
range adds up the counts and answers every blob with the totals in the blob's
own order, so answers carry no keys. Answers go back to the bucket of their
chunk, whose texts stay where they are. What is shuffled is proportional to
the distinct n-grams of each chunk, no key has more than one entry per chunk
(so a frequent word is not a hot key), and nothing but the mixture weights and
corpus totals meets in the driver. With ``chunk_tokens`` and ``range_keys``
as they are, a larger corpus has more blobs of fewer keys each, in the end one
for each distinct n-gram of a chunk; workers with more memory take larger ones.

A null text is empty: its only token is the end. A null doc_id hashes as the
empty string. Repeated rows count as often as they occur, a very long text
makes a chunk of its own. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, materialise, new_path, release
from ._words import distinct, mix, slabs, words

#: Tokens of a chunk, and n-grams of a hash range (about).
CHUNK_TOKENS, RANGE_KEYS = 1_000_000, 1_000_000
#: Bytes of input (as the planner knows it) for one bucket of chunks.
BUCKET_INPUT = 256 << 20
#: Sizes from which the planner only says that it knows none.
UNKNOWN = 1 << 60
#: Bits that are left off the hashes of higher orders.
SHORTER = np.uint64(8)
ORDER, TOLERANCE, BUCKETS = 3, 1e-3, 24
HELD_OUT, FOLDS, DELETED = 2, 7, 3
BEGIN, END = np.uint64(0x5BD1E995A7C3D4E1), np.uint64(0x2545F4914F6CDD1D)


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of an array by significance, compressed: the high bytes of sorted differences and of small counts vanish."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), level) if len(a) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def positions(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hash at every position, first position of each row and the total); a row is BEGIN, its words, END."""
    h, first = words(text)
    n = len(first) - 1
    sizes = np.diff(first)
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.empty(at[-1], np.uint64)
    out[at[:-1]] = BEGIN
    out[at[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = h
    return out, at if n else np.zeros(1, np.int64)


def grams(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Keys of the grams of order 1, 2, ... that end at each position, padded with BEGIN inside their row."""
    key = mix(tokens)
    yield key
    begin = np.repeat(at[:-1], np.diff(at)).astype(np.int32)
    place = np.arange(len(tokens), dtype=np.int32)
    for k in range(1, order):
        with np.errstate(over="ignore"):
            key = key * np.uint64(0x9FB21C651E98DF25) + np.uint64(k)
            key += tokens[np.maximum(place - np.int32(k), begin)]
            key = mix(key)
        yield key >> SHORTER


def _blob(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def chunk_docs(chunk_tokens: int):
    """A mapInArrow function: (doc_id, part, text) to one row per chunk that holds its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def emit() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "docs": pa.array([_blob(whole)], pa.binary())})

        for batch in slabs(batches, "text"):
            held.append(batch)
            size += batch.column(2).nbytes
            if size > 6 * chunk_tokens:
                yield emit()
                number, held, size = number + 1, [], 0
        if held:
            yield emit()

    return run


def open_chunk(blob: bytes, order: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(documents, part of each position, first position of each document, keys of each order)."""
    docs = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
    tokens, at = positions(docs.column(2))
    return docs, np.repeat(docs.column(1).to_numpy(), np.diff(at)), at, grams(tokens, at, order)


def chunk_counts(order: int, ranges: int):
    """mapInArrow: a chunk to one row per order and hash range that it has keys in, with the sorted keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, part, _, keys = open_chunk(blob.as_py(), order)
                for k, key in enumerate(keys, 1):
                    unique = distinct(key)
                    # Sorting the keys of a part and looking the others up in order is faster than an inverse.
                    train, gone = (np.diff(np.searchsorted(np.sort(key[x]), unique), append=x.sum()).astype(np.uint32) for x in (part > 0, part == 2))
                    bits = 64 - (int(SHORTER) if k > 1 else 0)
                    edges = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
                    cut = np.concatenate([[0], np.searchsorted(unique, edges), [len(unique)]])
                    rows = [(r, k, chunk, pack(np.diff(unique[a:b], prepend=np.uint64(0))), pack(train[a:b]), pack(gone[a:b])) for r in np.flatnonzero(np.diff(cut)).tolist() for a, b in [(cut[r], cut[r + 1])]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "n", "chunk", "keys", "train", "gone"])

    return run


def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The blobs of one hash range and order to totals for each; those of order 1 also say how many training tokens each brings, and the first how many types the range holds, of all and of the kept folds."""
    keys = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in rows["keys"]]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    own = [np.concatenate([unpack(b, np.uint32) for b in rows[c]]) for c in ("train", "gone")]
    train, gone = (np.bincount(inverse, weights=x, minlength=len(unique)).astype(np.uint32) for x in own)
    cut = np.cumsum([0, *map(len, keys)])
    parts = [inverse[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    out = {"range": key[0], "n": key[1], "chunk": rows["chunk"], "train": [pack(train[p]) for p in parts], "gone": [pack(gone[p]) for p in parts]}
    real = unique != mix(np.array([BEGIN]))[0] if key[1] == 1 else np.zeros(len(unique), bool)
    kept = train - gone
    for name, held, types in (("all", own[0], train), ("kept", own[0] - own[1], kept)):
        total = np.concatenate([[0], np.cumsum(held * real[inverse], dtype=np.int64)])
        out |= {f"{name}_tokens": np.diff(total[cut]), f"{name}_types": np.where(np.arange(len(parts)) == 0, np.count_nonzero(real & (types > 0)), 0)}
    return pd.DataFrame(out)


TOTALS = ("all_tokens", "all_types", "kept_tokens", "kept_types")
ANSWER = "range int, n int, chunk long, train binary, gone binary, " + ", ".join(f"{c} long" for c in TOTALS)


def chunk_answers(order: int):
    """mapInArrow: (docs blob, answers, totals) of a chunk to its documents with the counts at every position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (blob, answers) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                docs, part, at, keys = open_chunk(blob.as_py(), order)
                answers = sorted(answers.as_py(), key=lambda a: (a["n"], a["range"]))
                row: dict[str, bytes] = {}
                deleted, kept = part == 2, []
                for k, key in enumerate(keys, 1):
                    inverse = np.unique(key, return_inverse=True)[1]
                    train, gone = (np.concatenate([unpack(a[c], np.uint32) for a in answers if a["n"] == k])[inverse] for c in ("train", "gone"))
                    row[f"c{k}"] = pack(train)
                    kept.append((train - gone)[deleted])
                begin = np.zeros(len(part), bool)
                begin[at[:-1]] = True
                # The deleted fold alone, under the counts of the others, for expectation-maximisation.
                row |= {c: pack(x) for c, x in zip(_columns(order)[1 + order :], seen(kept, begin[deleted]), strict=True)}
                meta = pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(np.diff(at))], ["doc_id", "part", "size"])
                totals = {c: batch.column(2 + j).slice(i, 1) for j, c in enumerate(TOTALS)}
                yield pa.RecordBatch.from_pydict({"docs": pa.array([_blob(meta)], pa.binary())} | {k: pa.array([row[k]], pa.binary()) for k in _columns(order)[1:]} | totals)

    return run


def _columns(order: int) -> list[str]:
    return ["docs", *(f"c{k}" for k in range(1, order + 1)), "times", "unseen", *(f"d{k}" for k in range(1, order + 1)), *(f"x{k}" for k in range(2, order + 1))]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def seen(counts: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """What expectation-maximisation needs of all positions that are no BEGIN, each kind of position once.

    A kind is the counts and contexts of its orders up to the highest that was
    seen; kinds of more seen orders come first. How often each occurs; per order
    and bucket, positions with no such order seen; per order, the counts of the
    kinds that have it; per order above 1, their contexts.
    """
    order, real = len(counts), np.flatnonzero(~begin)
    own = [c[real] for c in counts]
    contexts = [np.zeros(len(real), np.uint32), *(c[real - 1] for c in counts[:-1])]
    height = np.zeros(len(real), np.int8)
    for k, c in enumerate(own, 1):
        height[c > 0] = k
    unseen = np.zeros((order, BUCKETS), np.int64)
    for k in range(order):
        low = height <= k
        unseen[k] = np.bincount(bucket_of(contexts[k][low]) if k else np.zeros(low.sum(), np.int64), minlength=BUCKETS)
        contexts[k] = np.where(low, np.uint32(0), contexts[k])
    columns = [*own, *contexts[1:]]
    at = np.lexsort([*columns, -height])
    columns = [c[at] for c in columns]
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    sizes = [int(np.count_nonzero(height[at][first] > k)) for k in range(order)]
    columns = [c[first][: sizes[i if i < order else i - order + 1]] for i, c in enumerate(columns)]
    return [np.diff(first, append=len(at)).astype(np.uint32), unseen.ravel(), *columns]


def estimates(counts: list[np.ndarray], begin: np.ndarray, n: float, v: float) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """(uniform probability, bucket and estimate of each order) at all positions that are no BEGIN. Order 1 has one context."""
    real = np.flatnonzero(~begin)
    buckets, found = [np.zeros(len(real), np.int64)], [counts[0][real] / max(n, 1)]
    for k in range(1, len(counts)):
        context = counts[k - 1][real - 1].astype(float)
        buckets.append(bucket_of(context))
        found.append(counts[k][real] / np.maximum(context, 1))
    return 1.0 / (v + 1), buckets, found


def mixture(weights: np.ndarray, uniform: float, buckets: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities by the orders up to 0, 1, 2, ...: ``weights[k - 1, bucket]`` is the share of order k."""
    out = [np.full(len(found[0]), uniform)]
    for w, bucket, f in zip(weights, buckets, found, strict=True):
        own = w[bucket]
        out.append(own * f + (1 - own) * out[-1])
    return out


def learn_weights(counts: DataFrame, order: int, n: int, v: int) -> np.ndarray:
    """Weights [order, bucket] by EM over every n-gram of the deleted fold (as ``seen`` gives them); each step is one job whose partial sums are of fixed size."""
    weights = np.full((order, BUCKETS), 0.5)

    def step(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            taken, reached = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
            for batch in batches:
                for row in batch.to_pylist():
                    times, unseen = unpack(row["times"], np.uint32), unpack(row["unseen"], np.int64).reshape(order, BUCKETS)
                    counts = [unpack(row[f"d{k}"], np.uint32) for k in range(1, order + 1)]
                    contexts = [unpack(row[f"x{k}"], np.uint32) for k in range(2, order + 1)]
                    buckets = [np.zeros(len(counts[0]), np.int64), *map(bucket_of, contexts)]
                    found = [counts[0] / max(n, 1), *(c / np.maximum(x, 1) for c, x in zip(counts[1:], contexts, strict=True))]
                    p = [np.full(len(times), 1.0 / (v + 1))]
                    for k in range(order):
                        own = w[k][buckets[k]]
                        p.append(own * found[k] + (1 - own) * p[-1][: len(own)])
                    left = times.astype(float)
                    for k in range(order - 1, -1, -1):
                        # The share of each kind that comes down to order k + 1, and of it what that order explains: nothing where it was not seen.
                        held = left[: len(counts[k])]
                        reached[k] += unseen[k] + np.bincount(buckets[k], weights=held, minlength=BUCKETS)
                        own = held * w[k][buckets[k]] * found[k] / p[k + 1]
                        taken[k] += np.bincount(buckets[k], weights=own, minlength=BUCKETS)
                        held -= own
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(order), BUCKETS)), pa.array(np.tile(np.arange(BUCKETS), order)), pa.array(taken.ravel()), pa.array(reached.ravel())], ["k", "bucket", "taken", "reached"])

        return run

    # A small table of its own, so that a step is few tasks.
    deleted = materialise(counts.select(*_columns(order)[1 + order :]), "lm-deleted")
    while True:
        taken, reached = np.full((order, BUCKETS), 1e-3), np.full((order, BUCKETS), 2e-3)
        for r in deleted.mapInArrow(step(weights), "k long, bucket long, taken double, reached double").groupBy("k", "bucket").agg(F.sum("taken").alias("taken"), F.sum("reached").alias("reached")).collect():
            taken[r["k"], r["bucket"]] += r["taken"]
            reached[r["k"], r["bucket"]] += r["reached"]
        before, weights = weights, taken / reached
        if np.abs(weights - before).max() < TOLERANCE:
            release(deleted)
            return weights


def score_chunks(order: int, weights: np.ndarray, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = pa.ipc.open_stream(row["docs"]).read_all().combine_chunks().to_batches()[0]
                size = docs.column("size").to_numpy()
                counts = [unpack(row[f"c{k}"], np.uint32) for k in range(1, order + 1)]
                begin = np.zeros(size.sum(), bool)
                begin[np.cumsum(size) - size] = True
                p = mixture(weights, *estimates(counts, begin, n, v))[-1]
                cut = np.concatenate([[0], np.cumsum(size - 1)])
                per_doc = lambda x: np.add.reduceat(x, cut[:-1])  # noqa: B023, E731  every document has its end
                c = counts[0][~begin].astype(float)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column("doc_id"), pa.array(docs.column("part").to_numpy() == 0), pa.array(size - 1), pa.array(per_doc((c > 0).astype(np.int64))), pa.array(np.full(len(size), n)),
                        pa.array(per_doc(np.log10((c + 1) / (n + 1.0 * (v + 1))))), pa.array(per_doc(np.log10(p))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, part, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Score every text. ``part``: 0 learns nothing from a row, 1 counts it, 2 counts it and deletes it while weights are learned."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.cast("int").alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessera_lm_chunks_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(chunk_docs(chunk_tokens), "chunk long, docs binary").write.format("parquet").option("compression", "zstd")
    # Buckets follow the input: bucketed scans are not split. Spark makes no more than its own bound.
    known = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = -(-known // BUCKET_INPUT) if known < UNKNOWN else 0
    writer.bucketBy(max(width, min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))), "chunk").option("path", new_path(spark, "lm-chunks")).saveAsTable(name)
    chunks = spark.table(name)
    ranges = max(width, -(-chunks.count() * chunk_tokens // range_keys))
    blobs = chunks.mapInArrow(chunk_counts(order, ranges), "range int, n int, chunk long, keys binary, train binary, gone binary")
    # A table of its own: the blobs' shuffle is gone before the answers are dealt out.
    answers = materialise(blobs.groupBy("range", "n").applyInPandas(add_up, ANSWER), "lm-answers")
    of_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "train", "gone")).alias("answers"), *(F.sum(c).alias(c) for c in TOTALS))
    names = _columns(order)
    schema = ", ".join([*(f"{c} binary" for c in names), *(f"{c} long" for c in TOTALS)])
    counts = materialise(chunks.join(of_chunk, "chunk").select("docs", "answers", *TOTALS).mapInArrow(chunk_answers(order), schema), "lm-counts")
    release(answers)
    release(chunks)
    spark.sql(f"DROP TABLE {name}")
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS)).first()
    weights = learn_weights(counts, order, totals["kept_tokens"], totals["kept_types"])
    return counts.select("docs", *names[1 : 1 + order]).mapInArrow(score_chunks(order, weights, totals["all_tokens"], totals["all_types"]), SCORES)


def op1_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    part = F.when(fold == HELD_OUT, 0).when(fold == DELETED, 2).otherwise(1)
    return score_documents(documents(spark, sf_dir, "doc_id", "text"), part)
