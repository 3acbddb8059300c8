"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches
``PERCENT``; the result is each document's component. The join is exact.

1. Sets. Every document becomes a set of 64-bit shingle hashes. Documents with
   equal sets share a node (a hash of the set), so copies cost nothing later.
2. Order. A sketch of fixed size counts shingles over all documents; shingles
   are ordered by (counter, hash), rare ones first. Any fixed order gives right
   results; this one keeps passages that many documents share out of the lists.
3. Light part, sets of at most x shingles: enumerate their subsets of the fixed
   sizes c that a pair of light sets can need to share. Sharing a c-subset proves
   the link, and it is enough to link every holder of a subset to the smallest
   one: if any two holders link by c, both link to the smallest.
4. Heavy part, pairs with a larger set: scan the inverted lists of each set's
   rarest floor(s / 5) + 1 shingles. A pair that links has its first common
   shingle in both prefixes, at positions that leave room for the overlap.
   Lists are not expanded to pairs at once: first each list's most central set
   (of the most common shingles) is compared with the others; only sets that are
   then still in different components are paired, so a group of near copies
   costs about its size. A list that the sketch says may be longer than ``LONG``
   is cut into parts, by a hash of the set; each part has a central set of its
   own, and the parts' central sets are compared with the most central of them.
5. The boundary x minimises the estimated cost of both parts, from the
   histogram of set sizes and the mean list length seen by the sketch.
6. Candidate pairs pass an exact upper bound on the overlap (parity bitmaps of
   512 bits), then the sets themselves are intersected, rebuilt from the texts.

With fewer words than a shingle has, the whole sequence is one shingle. Null
or empty texts have the empty set and link with nothing. Rows are told apart
by doc_id and text (two 64-bit hashes), so one doc_id may have several texts,
each linked by what it says; repeated rows are copies. Very long texts are
taken whole. A row with a null doc_id takes the
component of what it links with, null if nothing there has a doc_id. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._graph import components
from ._store import bounded_batches, documents, free_name, materialise, release
from ._words import give_back, mix, shingles, slabs, words

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch and of the filter of wanted documents (bits of their number), and counters per shuffled row.
SKETCH_BITS, FILTER_BITS, ROW_BITS = 20, 23, 12
#: Bytes of text that a worker takes at a time.
SLAB = 1 << 20
#: Sets of a part of a long list, about.
LONG = 4096
#: Light sets are never larger than this, whatever the costs say.
MOST_LIGHT = 16
#: Salt of second hashes.
SECOND = 1
BITMAP = [f"b{i}" for i in range(8)]


def needed(a: int, b: int) -> int:
    """Least overlap of sets of a and b elements that link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def shingle_sets(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each row: all windows are hashed in one go, then each row's are sorted in place."""
    windows = shingles(h, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < SHINGLE:
            yield shingles(h[a:b], SHINGLE)
            continue
        s = windows[a : b - SHINGLE + 1]
        s.sort()
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        yield s if new.all() else s[new]


def node_of(s: np.ndarray, salt: int = 0) -> np.int64:
    """A hash of a whole set, another one for each ``salt``."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)])).view(np.int64)[0]


def second_rid(doc_id: Column, text: Column) -> Column:
    """Another hash of a row."""
    return F.xxhash64(F.lit(SECOND), doc_id, text)


@dataclass(frozen=True)
class Shared:
    """Hashes that different rows (``rids``), or different sets (``nodes``), turned out to share; their holders go by a second hash. ``bits`` of the first hash count."""

    rids: tuple[int, ...] = ()
    nodes: frozenset[int] = frozenset()
    bits: int = 64

    def node(self, s: np.ndarray) -> np.int64:
        first = node_of(s) >> np.int64(64 - self.bits)
        return node_of(s, SECOND) if self.nodes and int(first) in self.nodes else first

    def rid(self, doc_id: Column, text: Column) -> Column:
        first = F.shiftright(F.xxhash64(doc_id, text), 64 - self.bits)
        return F.when(first.isin(*self.rids), second_rid(doc_id, text)).otherwise(first) if self.rids else first


def parity(s: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the elements that fall on it; two bitmaps differ in no more bits than the sets in elements."""
    odd = (np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(bool)
    return np.packbits(odd).view(np.int64)


def _sketch_rows(counts: np.ndarray) -> list[tuple[int, bytes]]:
    import zstandard

    step = 1 << ROW_BITS
    cut = counts.astype(np.int32).reshape(-1, step)
    return [(i, zstandard.compress(np.ascontiguousarray(c.view(np.uint8).reshape(step, 4).T).tobytes(), 1)) for i, c in enumerate(cut) if c.any()]


def _sketch_row(blob: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _add_rows(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(1 << ROW_BITS, np.int64)
    for b in rows["counts"]:
        total += _sketch_row(b.as_py())
    import zstandard

    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    blob = zstandard.compress(np.ascontiguousarray(total.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([blob], pa.binary())})


def add_sketches(rows: DataFrame, bits: int) -> np.ndarray:
    """Sum of sketches given as rows (part, salt, counts); the sum has a fixed size."""
    schema = "part int, counts binary"
    # Few but heavy rows: by hand, else the planner puts them into one task.
    some = rows.repartition(64, "part", "salt").groupBy("part", "salt").applyInArrow(_add_rows, schema)
    out = np.zeros(1 << bits, np.int32)
    step = 1 << ROW_BITS
    for r in some.repartition(64, "part").groupBy("part").applyInArrow(_add_rows, schema).collect():
        out[r["part"] * step : (r["part"] + 1) * step] = _sketch_row(bytes(r["counts"]))
    return out


SETS = "kind int, doc_id long, rid long, rid2 long, node long, node2 long, n long, " + ", ".join(f"{b} long" for b in BITMAP) + ", part int, salt int, counts binary"


def _sets(shared: Shared):
    """A mapInArrow function: (doc_id, rid, rid2, text) to each row's node, size and bitmap (kind 0), then the task's sketch (kind 1)."""
    kinds = [pa.int32(), *[pa.int64()] * 14, pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in SETS.split(", ")]

    def rows(values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slabs(batches, most=SLAB):
            h, first = words(batch.column(3))
            m = batch.num_rows
            node, second, size, bits = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, 8), np.int64)
            for i, s in enumerate(shingle_sets(h, first)):
                size[i] = len(s)
                if len(s):
                    node[i], second[i], bits[i] = shared.node(s), node_of(s, SECOND), parity(s)
                    place = (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
                    if len(s) > 1 << 16:
                        counts += np.bincount(place, minlength=1 << SKETCH_BITS)
                    else:
                        counts[place] += 1
            none = size == 0
            yield rows([np.zeros(m, np.int32), *batch.columns[:3], pa.array(node, mask=none), pa.array(second, mask=none), size, *bits.T, *[pa.nulls(m, t) for t in kinds[-3:]]])
        salt = TaskContext.get().partitionId() % 64
        out = _sketch_rows(counts)
        if out:
            m = len(out)
            yield rows([np.ones(m, np.int32), *[pa.nulls(m, t) for t in kinds[1:15]], [p for p, _ in out], np.full(m, salt, np.int32), [c for _, c in out]])

    return run


def choose_boundary(sizes: dict[int, int], mean_list: float) -> int:
    """x of least estimated cost. ``sizes``: number of sets of each size up to ``MOST_LIGHT`` * 1.25."""
    subsets = lambda s, x: sum(comb(s, c) for c in light_sizes(s, x))
    scan = lambda s: (s - needed_alone(s) + 1) * (1 + mean_list)
    cost = {x: sum(n * subsets(s, x) for s, n in sizes.items() if s <= x) + sum(n * scan(s) for s, n in sizes.items() if s > PERCENT * x / 100) for x in range(MOST_LIGHT + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def needed_alone(s: int) -> int:
    """Least overlap with any partner."""
    return -(-PERCENT * s // 100)


def light_sizes(s: int, x: int) -> list[int]:
    """Subset sizes that a set of s elements can have to share with another of x at most."""
    return sorted({c for t in range(needed_alone(s), min(x, 100 * s // PERCENT) + 1) if (c := needed(s, t)) <= min(s, t)})


LISTS = "light boolean, sig long, salt int, parts int, node long, n int, pos int, central float"


def _signatures(sketch, boundary: int, shared: Shared):
    """mapInArrow: (rid, text) of documents to their subset and prefix signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = sketch.value, np.uint64((1 << SKETCH_BITS) - 1)
        for batch in slabs(batches, most=SLAB):
            h, first = words(batch.column(1))
            parts: list[tuple] = []
            for s in shingle_sets(h, first):
                k = len(s)
                if not k:
                    continue
                node, often = shared.node(s), counts[(s & mask).astype(np.int64)]
                if k <= boundary:
                    own, seen = s.tolist(), often.tolist()
                    sigs = [hash((c, *sub)) for c in light_sizes(k, boundary) for sub in combinations(own, c)]
                    # A subset is in no more sets than its rarest element.
                    cuts = [min(sub) // LONG + 1 for c in light_sizes(k, boundary) for sub in combinations(seen, c)]
                    sizes = [c for c in light_sizes(k, boundary) for _ in range(comb(k, c))]
                    parts.append((True, np.array(sigs, np.int64), np.array(cuts, np.int32), node, k, np.array(sizes, np.int32), 0.0))
                if 100 * k > PERCENT * boundary:
                    p = k - needed_alone(k) + 1
                    if p < k:
                        rare = np.argpartition(often, p - 1)[:p] if p < k else np.arange(k)
                        limit = often[rare].max()
                        rare = np.flatnonzero(often <= limit)
                    else:
                        rare = np.arange(k)
                    prefix = rare[np.lexsort((s[rare], often[rare]))][:p]
                    parts.append((False, s[prefix].view(np.int64), (often[prefix] // LONG + 1).astype(np.int32), node, k, np.arange(len(prefix), dtype=np.int32), float(np.log2(often + 1.0).mean())))
            if not parts:
                continue
            size = [len(x[1]) for x in parts]
            spread = lambda j, t: np.repeat(np.array([x[j] for x in parts], t), size)  # noqa: B023, E731
            cuts, nodes = np.concatenate([x[2] for x in parts]), spread(3, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread(0, bool)), pa.array(np.concatenate([x[1] for x in parts])), pa.array((mix(nodes.view(np.uint64)) % cuts.astype(np.uint64)).astype(np.int32)), pa.array(cuts), pa.array(nodes), pa.array(spread(4, np.int32)), pa.array(np.concatenate([x[5] for x in parts])), pa.array(spread(6, np.float32))],
                ["light", "sig", "salt", "parts", "node", "n", "pos", "central"],
            )

    return run


def _room(a_n: str, a_pos: str, b_n: str, b_pos: str) -> F.Column:
    """Whether the overlap needed fits behind the first common shingle."""
    return F.expr(f"{100 + PERCENT} * least({a_n} - {a_pos}, {b_n} - {b_pos}) >= {PERCENT} * ({a_n} + {b_n})")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct node pairs (a, b) whose parity bitmaps allow a link, with a row of each (u, v)."""
    side = lambda k, d: nodes.select(F.col("node").alias(k), F.col("rep").alias(d), F.col("n").alias(f"n_{k}"), *(F.col(b).alias(f"{b}_{k}") for b in BITMAP))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a", "u"), "a").join(side("b", "v"), "b")
    differ = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITMAP), F.lit(0))
    return both.where(differ * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)).select("a", "b", "u", "v")


def _wanted(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that every id of ``ids`` passes, so that other texts need not be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << FILTER_BITS, np.int8)
        for batch in batches:
            counts[_filter_place(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        rows = _sketch_rows(counts)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(rows), pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["part", "salt", "counts"])

    return add_sketches(ids.mapInArrow(run, "part int, salt int, counts binary"), FILTER_BITS) > 0


def _filter_place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _texts(docs: DataFrame, shared: Shared) -> DataFrame:
    """``docs`` (doc_id, text) with ``rid``, which tells rows apart."""
    return docs.withColumn("rid", shared.rid(F.col("doc_id"), F.col("text")))


def _passing(ids: DataFrame, schema: StructType, inside: bool):
    """A mapInArrow function: rows whose first column passes the filter of ``ids`` (all of those do), or the others."""
    packed = ids.sparkSession.sparkContext.broadcast(np.packbits(_wanted(ids)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            keep = passes[_filter_place(batch.column(0).to_numpy(zero_copy_only=False))] == inside
            if keep.any():
                yield batch.filter(pa.array(keep))
        del passes
        give_back()

    return pick, schema


def _chosen(rows: DataFrame, rid: str, texts: DataFrame, kept: DataFrame, then=None, schema: str | None = None) -> DataFrame:
    """The rows (``rid`` first) that ``kept`` (rid) names, one of each, or what the mapInArrow function ``then`` makes of them. ``texts``: every rid with how often it is there.

    Most rows are kept, so the others are looked for: rows that pass no filter
    of theirs stay where they are, and only the rest is dealt out and joined
    (never by a broadcast: a task would need a worker before and one behind it).
    """
    named = kept.select("rid", F.lit(True).alias("kept"))
    odd = texts.select("rid", "copies").join(named, "rid", "left").where("kept is null or copies > 1")
    odd = materialise(odd.select("rid", F.coalesce("kept", F.lit(False)).alias("kept")), "odd")
    apart = _passing(odd.select("rid"), rows.schema, False)[0]
    # One function, so that a task needs one worker.
    sure = rows.mapInArrow((lambda batches: then(apart(batches))) if then else apart, schema or rows.schema)
    other = rows.mapInArrow(*_passing(odd.select("rid"), rows.schema, True)).join(odd.select(F.col("rid").alias(rid), F.col("kept").alias(kept_name := free_name(rows, "kept"))).hint("merge"), rid, "left")
    once = other.where(F.col(kept_name).isNull()).drop(kept_name)
    rest = once.union(other.where(F.col(kept_name)).drop(kept_name).dropDuplicates([rid]))
    return sure.union(rest.mapInArrow(then, schema) if then else rest)


def verify(pairs: DataFrame, docs: DataFrame, repeated: bool, shared: Shared) -> DataFrame:
    """Those node pairs (a, b), with a row of each (u, v), whose shingle sets link, by the sets themselves; as (u, v).

    ``repeated``: whether rows of ``docs`` that stand for a node may be there more than once.
    """
    rows = _texts(docs.where("text is not null"), shared).select("rid", "text")
    texts = rows.mapInArrow(*_passing(pairs.select("u").union(pairs.select("v")), rows.schema, True))
    one = texts.dropDuplicates(["rid"]) if repeated else texts
    side = lambda k: one.select(F.col("rid").alias(k), F.col("text").alias(f"text_{k}"))
    # Merge joins, so that no task has one worker that picks texts and another that compares them.
    joined = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v").select("a", "b", "text_u", "text_v")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(slabs(batches, "text_u", SLAB), "text_v", SLAB):
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*(shingle_sets(*words(batch.column(c))) for c in (2, 3)), strict=True)):
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = bool(common) and 100 * common >= PERCENT * (len(a) + len(b) - common)
            if keep.any():
                yield batch.select(["a", "b"]).rename_columns(["u", "v"]).filter(pa.array(keep))

    return materialise(joined.mapInArrow(intersect, "u long, v long").distinct(), "links")


def _nodes(docs: DataFrame, shared: Shared) -> tuple[DataFrame, DataFrame, DataFrame, Shared]:
    """(sets with sketches, different rows, nodes, hashes that are shared) of ``docs``.

    Rows and sets go by 64-bit hashes. A second hash of each shows where
    different ones share the first (about one pair in 4e19, so a few in 1e10
    documents); these are made anew with the second.
    """
    table = materialise(_texts(docs, shared).select("doc_id", "rid", second_rid(F.col("doc_id"), F.col("text")).alias("rid2"), "text").mapInArrow(_sets(shared), SETS), "sets")
    one = ["doc_id", "node", "node2", "n", *BITMAP]
    texts = table.where("kind = 0").groupBy("rid").agg(*(F.first(c).alias(c) for c in one), F.count("*").alias("copies"), (F.min("rid2") != F.max("rid2")).alias("shared"))
    nodes = texts.groupBy("node").agg(
        F.min("rid").alias("rep"), F.min_by("copies", "rid").alias("copies"), F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in BITMAP),
        F.bool_or("shared").alias("shared"), (F.min("node2") != F.max("node2")).alias("mixed"),
    )
    nodes = materialise(nodes, "nodes")
    if not nodes.where("shared or mixed").limit(1).count():
        return table, texts, nodes.where("node is not null").drop("shared", "mixed"), shared
    rids = {r["rid"] for r in texts.where("shared").select("rid").collect()}
    mixed = {r["node"] for r in nodes.where("mixed").select("node").collect()}
    release(table)
    release(nodes)
    # Rows whose hash was shared may have had another's set: sets are looked at again when rows are apart.
    return _nodes(docs, replace(shared, rids=tuple(sorted({*shared.rids, *rids})), nodes=shared.nodes if rids else shared.nodes | mixed))


def linked(docs: DataFrame, shared: Shared = Shared()) -> tuple[DataFrame, DataFrame, DataFrame, Shared]:
    """(sets, texts, labels, shared hashes) of ``docs`` (doc_id, text): a row per row, with its node; a row per different row (rid, doc_id, node, copies);
    and (node, label, component_id) of every node, label being equal for linked ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table, texts, nodes, shared = _nodes(docs, shared)
    sets = table.where("kind = 0")
    counts = add_sketches(table.where("kind = 1").select("part", "salt", "counts"), SKETCH_BITS)
    sketch = spark.sparkContext.broadcast(counts)
    few = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= MOST_LIGHT * 100 // PERCENT).groupBy("n").count().collect()}
    total = float(counts.sum(dtype=np.float64))
    mean_list = max(0.0, float((counts.astype(np.float64) ** 2).sum()) / max(total, 1) - total / len(counts)) if total else 0.0
    boundary = choose_boundary(few, mean_list)

    # One row of each set makes its signatures; copies add none.
    repeated = bool(nodes.where("copies > 1").limit(1).count())
    rows = _texts(docs.where("text is not null"), shared).select("rid", "text")
    lists = _chosen(rows, "rid", texts.where("node is not null"), nodes.select(F.col("rep").alias("rid")), _signatures(sketch, boundary, shared), LISTS)
    by_part = Window.partitionBy("light", "sig", "salt")
    pivot = F.when(F.col("light"), F.struct((-F.col("n")).cast("float").alias("central"), "node", "n", "pos")).otherwise(F.struct("central", "node", "n", "pos"))
    popular = lists.withColumns({"lo": F.min("node").over(by_part), "hi": F.max("node").over(by_part), "pivot": F.max(pivot).over(by_part)}).where("lo <> hi or parts > 1")
    popular = materialise(popular.select("light", "sig", "parts", "central", "node", "n", "pos", F.col("pivot.node").alias("p_node"), F.col("pivot.n").alias("p_n"), F.col("pivot.pos").alias("p_pos")), "lists")

    # Light part: pos is the subset size c, the pivot is the smallest holder; sharing the subset proves the link.
    # Of a list in parts the smallest holder of all parts counts; one row a list is joined to its holders.
    light = popular.where("light")
    least = light.where("parts > 1").groupBy("sig").agg(F.min(F.struct("n", "node")).alias("l")).select("sig", F.col("l.node").alias("p_node"), F.col("l.n").alias("p_n"))
    whole = light.where("parts > 1").select("sig", "node", "n", "pos").join(least, "sig").select("node", "n", "pos", "p_node", "p_n")
    holders = light.where("parts = 1").select("node", "n", "pos", "p_node", "p_n").union(whole).where("node <> p_node")
    proven = holders.where(F.expr(f"{100 + PERCENT} * pos >= {PERCENT} * (n + p_n)")).select(F.col("node").alias("u"), F.col("p_node").alias("v")).distinct()
    # Heavy part, first each list's pivot against the others; parts of a long list have a pivot each, one row a part.
    heavy = popular.where(~F.col("light"))
    larger = lambda a, b: F.expr(f"greatest({a}, {b}) > {boundary}")
    heads = heavy.where("parts > 1 and node = p_node").select("sig", "node", "n", "pos", F.max(F.struct("central", "node", "n", "pos")).over(Window.partitionBy("sig")).alias("p"))
    heads = heads.select("node", "n", "pos", F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))
    stars = heavy.select(*heads.columns).union(heads).where("node <> p_node").where(_room("n", "pos", "p_n", "p_pos") & larger("n", "p_n")).select(F.col("node").alias("a"), F.col("p_node").alias("b"))
    pairs = materialise(_bounded(stars, nodes), "pairs")
    links = verify(pairs, docs, repeated, shared)
    release(pairs)
    roots = materialise(components(links.union(proven)), "roots")
    # Then the sets of a list that are still in different components; most lists hold one by now.
    named = lambda: nodes.select("node", "least").join(roots, "node", "left").withColumn("label", F.coalesce("component", "node"))
    left = heavy.select("sig", "node", "n", "pos").join(named().select("node", "label"), "node")
    mixed = left.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    left = materialise(left.join(mixed, "sig", "left_semi").select("sig", "node", "n", "pos", "label"), "left")
    other = left.select("sig", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "pos", "label")))
    cross = left.join(other, "sig").where(F.col("node") < F.col("o_node")).where("label <> o_label").where(_room("n", "pos", "o_n", "o_pos") & larger("n", "o_n"))
    more = materialise(_bounded(cross.select(F.col("node").alias("a"), F.col("o_node").alias("b")), nodes), "pairs")
    release(left)
    release(popular)
    if more.limit(1).count():
        more = verify(more, docs, repeated, shared)
        roots = components(roots.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    labels = named().select("node", "label", "least")
    smallest = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    return sets, texts, labels.join(smallest, "label").select("node", "label", "component_id"), shared


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    sets, _, labels, _ = linked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), Shared(bits=hash_bits))
    joined = sets.select("doc_id", "n", "node").join(labels.select("node", "component_id"), "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (null last), of the same row repeated one; documents without words stay."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, texts, labels, shared = linked(picked)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    chosen = texts.where("node is not null").join(labels, "node").groupBy("label").agg(F.min_by("rid", first).alias("rid")).select("rid")
    rid = free_name(docs, "rid")
    rows = docs.withColumn(rid, shared.rid(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return _chosen(rows.select(rid, *docs.columns), rid, texts.where("node is not null"), chosen).select(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
 w(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM d UNION (SELECT e.b, min(v.label) FROM w v JOIN e ON e.a = v.node JOIN recurring.w u ON u.node = e.b WHERE v.label < u.label GROUP BY e.b))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, w.label AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN w ON w.node = d.doc_id
"""
