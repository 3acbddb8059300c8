"""Phrase collocation mining with count tries of limited depth.

1. Tries. A task takes its rows in chunks of ``CHUNK`` bytes and counts each
   language's phrases of up to ``depth`` words in a trie: sorted words, and for
   each depth the nodes as (parent, word, count), sorted. A serialised trie is
   a few small arrays.
2. Ranges. A node's code is made of the hashes of its language and words, first
   word first, so that all that begin alike lie together. Quantiles of the
   codes cut the tries into ranges of about ``RANGE`` nodes. A range may begin
   anywhere, below one frequent word as well: the path that leads into it is
   sent along, from every trie that has it.
3. Merge. The tries of one range are merged: their word lists into one, their
   sorted nodes by a sort that merges sorted runs, counts added. Where a
   language has more than ``FAN`` * 4 tries, they are first merged ``FAN`` at a
   time in ranges as many times wider, so that the number of slices grows with
   the corpus, not with its square.
4. Candidates. A walk down the merged trie gives every phrase of at least
   ``least`` occurrences with the counts of its left parts. Right parts follow
   suffix links: a phrase without its first word is a phrase of the next
   smaller depth, which knows its own right parts.
5. Scores in decimals of 38 digits, phrases inside more telling ones go, the
   best of each language stay.

Counts are exact: words are compared as strings (within a chunk and between
chunks), codes only say where a node is merged.

A null text is empty, a null language is ``und``. Texts are taken whole; a very
long one is a chunk of its own. Repeated rows count again. Ties in the result
are broken by occurrences, then by the phrase in UTF-8 order. Other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, materialise, release
from ._words import bounds, buffers, hashes, slabs

CHUNK, RANGE, FAN = 4 << 20, 1_500_000, 64
#: Nodes for which a trie names one code.
MARK = 4096
LANG_BITS, CODE_BITS = 10, 51
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = BREAKS.copy()
BETWEEN[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TRIES = "lang string, tokens long, marks array<long>, trie binary"
SLICES = "lang string, part int, batch int, trie binary"
PHRASES = "lang string, words array<string>, occurrences long, lefts array<long>"
#: Candidates of a language that the first of two top-k steps ranks together are 1 in so many.
SALTS = 16


@dataclass
class Trie:
    """Sorted distinct words, and of each depth the nodes: parent (a node of the depth above), word and count, sorted by the first two."""

    words: pa.Array
    parent: list[np.ndarray]
    word: list[np.ndarray]
    count: list[np.ndarray]

    def __len__(self) -> int:
        return sum(map(len, self.word))

    def codes(self, lang: str) -> Iterator[tuple[np.ndarray, int]]:
        """Of each depth the codes of its nodes, and the last bits, which are left to what is below a node."""
        data, off = buffers(self.words)
        h = hashes(data, off[:-1], off[1:], lower=False)
        bits = CODE_BITS // len(self.word)
        code, shift = np.array([zlib.crc32(lang.encode()) >> (32 - LANG_BITS)]) << CODE_BITS, CODE_BITS
        for parent, word in zip(self.parent, self.word, strict=True):
            shift -= bits
            code = code[parent] | ((h[word] >> np.uint64(64 - bits)).astype(np.int64) << shift)
            yield code, shift

    def dump(self) -> bytes:
        """The arrays byte by byte of significance, parents as steps, compressed."""
        import zstandard

        data, off = buffers(self.words)
        out, sizes = [], []
        for x in (np.diff(off), *(y for p, w, c in zip(self.parent, self.word, self.count, strict=True) for y in (np.diff(p, prepend=0), w, c))):
            width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
            sizes += [len(x), width]
            out.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        return zstandard.compress(b"".join([np.array([len(self.word), *sizes], "<i8").tobytes(), *out, data.tobytes()]), 1)

    @staticmethod
    def load(blob: bytes) -> Trie:
        import zstandard

        raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
        depth = int(raw[:8].view("<i8")[0])
        sizes = raw[8 : 8 * (6 * depth + 3)].view("<i8").reshape(-1, 2).tolist()
        at, arrays = 8 * (6 * depth + 3), []
        for n, width in sizes:
            x = np.zeros((n, 8), np.uint8)
            x[:, :width] = raw[at : at + n * width].reshape(width, n).T
            arrays.append(x.view("<i8").ravel())
            at += n * width
        levels = arrays[1:]
        return Trie(_strings(raw[at:], arrays[0]), [np.cumsum(p) for p in levels[::3]], levels[1::3], levels[2::3])


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of so many bytes each, one after the other in ``data``."""
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rank of each word among the distinct ones in byte order, these)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def count_trie(text: pa.Array, depth: int) -> Trie:
    """All phrases of up to ``depth`` words of the pieces of some texts."""
    data, offsets = buffers(text)
    start, end, row = bounds(data, offsets, BETWEEN)
    breaks = np.cumsum(BREAKS[data], dtype=np.int64)[start]
    follows = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
    ids, words = _ranked(_strings(LOWER[data][~BETWEEN[data]], end - start))
    many = len(words)
    parent, word, count = [np.zeros(many, np.int64)], [np.arange(many)], [np.bincount(ids, minlength=many)]
    # Where a phrase begins, and its node.
    at, node = np.arange(len(ids)), ids
    for d in range(1, depth):
        more = at + d < len(ids)
        at, node = at[more], node[more]
        more = follows[at + d - 1]
        at, node = at[more], node[more]
        key, node, n = np.unique(node * many + ids[at + d], return_inverse=True, return_counts=True)
        parent.append(key // max(many, 1))
        word.append(key % max(many, 1))
        count.append(n)
    return Trie(words, parent, word, count)


def merge(tries: list[Trie]) -> Trie:
    """One trie with the counts of all."""
    ids, words = _ranked(pa.concat_arrays([t.words for t in tries]))
    own = np.split(ids, np.cumsum([len(t.words) for t in tries])[:-1])
    node, out = [np.zeros(1, np.int64)] * len(tries), Trie(words, [], [], [])
    for d in range(len(tries[0].word)):
        key = np.concatenate([up[t.parent[d]] * len(words) + m[t.word[d]] for t, m, up in zip(tries, own, node, strict=True)])
        # Every trie's keys ascend, and the stable sort merges ascending runs.
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        node = np.split(at, np.cumsum([len(t.word[d]) for t in tries])[:-1])
        out.parent.append(key[first] // max(len(words), 1))
        out.word.append(key[first] % max(len(words), 1))
        total = np.concatenate([t.count[d] for t in tries])[order]
        out.count.append(np.add.reduceat(total, first) if len(first) else total)
    return out


def cut(trie: Trie, lang: str, edges: np.ndarray, inside: tuple[int, int]) -> Iterator[tuple[int, Trie]]:
    """(range, what lies in it with the paths that lead there) for all ranges from ``inside[0]`` to ``inside[1]`` that have anything. Range i ends before ``edges[i]``."""
    held = []
    for code, shift in trie.codes(lang):
        low = np.maximum(np.searchsorted(edges, code, side="right"), inside[0])
        high = np.minimum(np.searchsorted(edges, code | ((1 << shift) - 1), side="right"), inside[1])
        times = np.maximum(high - low + 1, 0)
        node = np.repeat(np.arange(len(code)), times)
        part = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(node))
        order = np.argsort(part, kind="stable")
        held.append((node[order], part[order]))
    for r in np.unique(held[0][1]).tolist():
        nodes = [node[slice(*np.searchsorted(part, [r, r + 1]))] for node, part in held]
        words = np.unique(np.concatenate([w[n] for w, n in zip(trie.word, nodes, strict=True)]))
        parent = [np.zeros(len(nodes[0]), np.int64), *(np.searchsorted(up, p[n]) for up, p, n in zip(nodes, trie.parent[1:], nodes[1:], strict=False))]
        yield r, Trie(trie.words.take(pa.array(words)), parent, [np.searchsorted(words, w[n]) for w, n in zip(trie.word, nodes, strict=True)], [c[n] for c, n in zip(trie.count, nodes, strict=True)])


def phrases(trie: Trie, lang: str, edges: np.ndarray, part: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PHRASES``: what occurs ``least`` times and begins in the range ``part``, with the counts of its left parts."""
    words, lefts = np.zeros((1, 0), np.int64), np.zeros((1, 0), np.int64)
    for d, (code, _) in enumerate(trie.codes(lang)):
        words = np.column_stack([words[trie.parent[d]], trie.word[d]])
        lefts = lefts[trie.parent[d]]
        take = np.flatnonzero((trie.count[d] >= least) & (np.searchsorted(edges, code, side="right") == part))
        lists = lambda x, n=d: pa.array(np.arange(len(take) + 1) * n, pa.int32())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(take), pa.string()),
                pa.ListArray.from_arrays(lists(words, d + 1), trie.words.take(pa.array(words[take].ravel())).cast(pa.string())),
                pa.array(trie.count[d][take], pa.int64()),
                pa.ListArray.from_arrays(lists(lefts), pa.array(lefts[take].ravel(), pa.int64())),
            ],
            ["lang", "words", "occurrences", "lefts"],
        )
        lefts = np.column_stack([lefts, trie.count[d]])


def shard_tries(docs: DataFrame, depth: int, chunk: int) -> DataFrame:
    """A row per chunk of a task and language: its trie, its words, and codes at every ``MARK``-th node."""

    def tries(rows: list[pa.RecordBatch]) -> Iterator[dict]:
        table = pa.Table.from_batches(rows)
        for lang in pc.unique(table["lang"]).to_pylist():
            trie = count_trie(table["text"].filter(pc.equal(table["lang"], lang)).combine_chunks(), depth)
            if len(trie):
                marks = np.sort(np.concatenate([code for code, _ in trie.codes(lang)]))[MARK // 2 :: MARK]
                yield {"lang": lang, "tokens": int(trie.count[0].sum()), "marks": marks.tolist(), "trie": trie.dump()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("tokens", pa.int64()), ("marks", pa.list_(pa.int64())), ("trie", pa.binary())])
        held, size = [], 0
        for batch in slabs(batches, most=chunk):
            more = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if held and size + more > chunk:
                for row in tries(held):
                    yield pa.RecordBatch.from_pylist([row], schema)
                held, size = [], 0
            held.append(batch)
            size += more
        for row in tries(held) if held else ():
            yield pa.RecordBatch.from_pylist([row], schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, TRIES)


def merged(tries: DataFrame, depth: int, least: int, nodes: int = RANGE, fan: int = FAN) -> DataFrame:
    """``PHRASES`` of the tries (``TRIES``) of a whole corpus."""
    spark = tries.sparkSession
    size = tries.agg(F.sum(F.size("marks") * MARK)).first()[0] or 0
    ranges = max(1, -(-size // nodes))
    edges = np.zeros(0, np.int64)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        # One number a range: a range is millions of nodes.
        edges = np.unique(tries.select(F.explode("marks").alias("mark")).agg(F.percentile_approx("mark", shares, max(10_000, 20 * ranges))).first()[0])
        ranges = len(edges) + 1
    each = tries.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    sent = spark.sparkContext.broadcast(edges)
    now, wide = tries.select("lang", F.lit(0).alias("part"), "trie"), ranges
    done: DataFrame | None = None
    while True:
        last = each <= 4 * fan
        # A power of ``fan``, so that ranges of one step lie within those of the step before.
        narrow = 1 if last else next(fan**i for i in range(99) if fan ** (i + 1) >= wide)
        groups = 1 if last else -(-each // fan)

        def slices(batches: Iterator[pa.RecordBatch], wide=wide, narrow=narrow, groups=groups) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId()
            steps = sent.value[narrow - 1 :: narrow]
            for batch in batches:
                for lang, part, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                    number += 1
                    # Ranges of the finest kind that this trie covers, as ranges of this step.
                    first, behind = part.as_py() * wide // narrow, -(-min((part.as_py() + 1) * wide, ranges) // narrow)
                    for r, trie in cut(Trie.load(blob.as_py()), lang.as_py(), steps, (first, behind - 1)):
                        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([r], pa.int32()), pa.array([number % groups], pa.int32()), pa.array([trie.dump()], pa.binary())], ["lang", "part", "batch", "trie"])

        def together(key: tuple, rows: pa.Table) -> pa.Table:
            lang, part, _ = (k.as_py() for k in key)
            trie = merge([Trie.load(b.as_py()) for b in rows["trie"]])
            if not last:
                return pa.table([pa.array([lang]), pa.array([part], pa.int32()), pa.array([trie.dump()], pa.binary())], ["lang", "part", "trie"])
            return pa.Table.from_batches(phrases(trie, lang, sent.value, part, least))

        # Few but heavy groups: by hand, else the planner puts them into one task.
        dealt = now.mapInArrow(slices, SLICES).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ranges // narrow)), "lang", "part", "batch")
        if last:
            out = materialise(dealt.groupBy("lang", "part", "batch").applyInArrow(together, PHRASES), "phrases")
            if done is not None:
                release(done)
            return out
        now = materialise(dealt.groupBy("lang", "part", "batch").applyInArrow(together, "lang string, part int, trie binary"), "tries", **{"parquet.block.size": 16 << 20})
        if done is not None:
            release(done)
        done, wide, each = now, narrow, groups


def candidates(found: DataFrame, depth: int) -> list[DataFrame]:
    """Of each depth from 2 the phrases with ``lefts`` and ``rights``: counts of the parts before and behind each cut."""
    of = lambda d: found.where(F.size("words") == d)
    out, link = [], of(1).select("lang", F.col("words")[0].alias("rest"), F.array("occurrences").alias("behind"))
    for d in range(2, depth + 1):
        # Words hold no space, so that the joined phrase stands for its words.
        now = of(d).withColumn("rest", F.array_join(F.slice("words", 2, d - 1), " ")).join(link, ["lang", "rest"]).drop("rest").withColumnRenamed("behind", "rights")
        out.append(now)
        link = now.select("lang", F.array_join("words", " ").alias("rest"), F.concat(F.array("occurrences"), "rights").alias("behind"))
    return out


def scored(found: list[DataFrame], cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one tells more about: none with ``cover`` percent of their occurrences."""
    number = lambda c: c.cast("decimal(18,0)")
    out = None
    inner = None
    for d, df in reversed(list(enumerate(found, 2))):
        rows = df.withColumn("phrase", F.array_join("words", " "))
        if inner is not None:
            # The most frequent longer candidate decides.
            longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            rows = rows.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("occurrences"))).drop("longer")
        parts = [F.array_join(F.slice("words", i + 1, n), " ") for n in range(2, d) for i in range(d - n + 1)]
        if parts:
            more = df.select("lang", F.explode(F.array(*parts)).alias("phrase"), F.col("occurrences").alias("longer"))
            inner = more if inner is None else inner.union(more)
        a = number(F.col("occurrences"))
        cuts = [F.struct(F.call_function("div", a * a * F.lit(1_000_000), number(F.col("lefts")[k]) * number(F.col("rights")[k])).alias("score"), F.lit(k).alias("k"), F.col("lefts")[k].alias("l"), F.col("rights")[k].alias("r")) for k in range(d - 1)]
        best = F.array_min(F.array(*cuts))
        rows = rows.withColumn("best", best).select("lang", "phrase", F.col("occurrences").alias("a"), "best.l", "best.r", "best.score")
        out = rows if out is None else out.union(rows)
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = 3, least: int = 10, cover: int = 50, top: int = 2000, chunk: int = CHUNK, nodes: int = RANGE, fan: int = FAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language, of 2 to ``depth`` words."""
    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tries = materialise(shard_tries(picked, depth, chunk), "tries", **{"parquet.block.size": 16 << 20})
    totals = materialise(tries.groupBy("lang").agg(F.sum("tokens").alias("n")), "tokens")
    found = merged(tries, depth, least, nodes, fan)
    release(tries)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = scored(candidates(found, depth), cover).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir, "lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(string_split_regex(low, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(string_split_regex(low, '[.,;:!?\x0A-\x0D]'), 1) AS i
  FROM (SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)),
words AS (
  SELECT doc_id, lang, i, unnest(w) AS w1, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc_id, i ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE t.f >= 10 AND NOT EXISTS (SELECT 1 FROM three u WHERE u.lang = t.lang AND u.w1 = t.w1 AND u.w2 = t.w2 AND 100 * u.f >= 50 * t.f)
    AND NOT EXISTS (SELECT 1 FROM three u WHERE u.lang = t.lang AND u.w2 = t.w1 AND u.w3 = t.w2 AND 100 * u.f >= 50 * t.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scores AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
