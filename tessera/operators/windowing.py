"""Window operators: sessions, rolling masks, islands, ranks, interpolation, segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import scan


def sessions(df: DataFrame, key: str, at: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """(key, first_at, last_at, n): runs of rows of a key whose steps stay within ``gap``."""
    w = Window.partitionBy(key).orderBy(at, *(order or []))
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__s", F.sum("__new").over(w))
    return marked.groupBy(key, "__s").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("__s")


def rolling_mean(depths: DataFrame, key: str, pos: str, value: str, width: int, span: int = 100_000) -> DataFrame:
    """``mean`` and ``seen`` (rows) of the ``width`` positions before each; positions of a key are dense, or rows are dense where gaps do not matter.

    A key is cut into ranges of ``span`` positions, each with the last ``width``
    positions of the range before, so a long key is many tasks' work.
    """
    block = F.floor(F.col(pos) / span)
    # A position counts for the ``width`` behind it, in as many ranges as those touch.
    blocks = F.sequence(block, F.floor((F.col(pos) + width) / span))
    w = Window.partitionBy(key, "__b").orderBy(pos).rowsBetween(-width, -1)
    parts = depths.withColumn("__b", F.explode(blocks)).withColumns({"mean": F.avg(value).over(w), "seen": F.count("*").over(w)})
    return parts.where(F.col("__b") == block).drop("__b")


def rolling_below(depths: DataFrame, key: str, pos: str, depth: str, width: int, least: float) -> DataFrame:
    """Half-open windows [pos - width, pos) whose mean depth is below ``least``, merged where they overlap. Positions must be dense."""
    low = rolling_mean(depths, key, pos, depth, width).where((F.col("seen") == width) & (F.col("mean") < least))
    return merge_ranges(low.select(key, (F.col(pos) - width).alias("start"), F.col(pos).alias("end")), key, "start", "end")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping half-open intervals of a key as one (start < the greatest end so far)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) < reach, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    return marked.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__g")


def merge_ranges(df: DataFrame, key: str, start: str, end: str, span: int = 100_000, sums: tuple[str, ...] = ()) -> DataFrame:
    """``merge_intervals`` for keys with very many rows, with the summed columns ``sums``: ranges of ``span`` start positions are merged apart, then joined by one row each."""
    rows = df.withColumn("__b", F.floor(F.col(start) / span))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    reaches = rows.groupBy(key, "__b").agg(F.max(end).alias("__e")).select(key, "__b", F.max("__e").over(before).alias("__before"))
    w = Window.partitionBy(key, "__b").orderBy(start, end)
    reach = F.greatest("__before", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = join_on(rows, reaches, [key, "__b"]).withColumn("__new", F.when(F.col(start) < reach, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    # Within a range; group 0 goes on from the ranges before.
    parts = marked.groupBy(key, "__b", "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    offsets = parts.groupBy(key, "__b").agg(F.count_if(F.col("__g") > 0).alias("__n")).select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    whole = join_on(parts, offsets, [key, "__b"]).withColumn("__g", F.col("__o") + F.col("__g"))
    return whole.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)).drop("__g")


def next_row(df: DataFrame, order: str, columns: list[str], width: int) -> DataFrame:
    """Each row with ``next_*`` of the row that follows by ``order`` (unique numbers), null for the last.

    The window is per range of ``width`` numbers; the last row of a range takes
    the first of the next one from a table of one row per range.
    """
    names = [order, *columns]
    rows = df.withColumn("__b", F.floor(F.col(order) / width))
    own = F.lead(F.struct(*names)).over(Window.partitionBy("__b").orderBy(order))
    firsts = rows.groupBy("__b").agg(F.min_by(F.struct(*names), order).alias("__f"))
    after = firsts.select("__b", F.lead("__f").over(Window.orderBy("__b")).alias("__a"))
    both = rows.withColumn("__n", own).join(after, "__b").withColumn("__n", F.coalesce("__n", "__a"))
    return both.select(*df.columns, *(F.col(f"__n.{c}").alias(f"next_{c}") for c in names))


def tied_best(df: DataFrame, group: str, score: str) -> DataFrame:
    """All rows of a group that tie for its best score."""
    best = df.groupBy(group).agg(F.max(score).alias("__m"))
    return df.join(best, group).where(F.col(score) == F.col("__m")).drop("__m")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, with the value before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def pack_runs(df: DataFrame, key: str, index: str) -> DataFrame:
    """(key, runs): consecutive distinct indexes as ``start:length``, joined by spaces in order."""
    one = df.select(key, index).distinct()
    island = one.withColumn("__g", F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index)))
    runs = island.groupBy(key, "__g").agg(F.min(index).alias("s"), F.count("*").alias("n"))
    listed = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("r"))
    return listed.select(key, F.concat_ws(" ", F.transform("r", lambda x: F.concat_ws(":", x["s"].cast("string"), x["n"].cast("string")))).alias("runs"))


def number_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the name, with ``_n`` from its second row on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("__n", n).withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), F.col("__n").cast("string")))).drop("__n")


def switch_errors(df: DataFrame, key: str, order: list[str], agrees: str) -> DataFrame:
    """Per key: flips of agreement with the truth, of which two next to each other count as one mismatch, and switches left."""
    w = Window.partitionBy(key).orderBy(*order)
    flips = df.withColumn("__i", F.row_number().over(w)).withColumn("__flip", F.col(agrees) != F.lag(agrees).over(w)).where("__flip")
    fw = Window.partitionBy(key).orderBy("__i")
    runs = flips.withColumn("__g", F.col("__i") - F.row_number().over(fw)).groupBy(key, "__g").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.sum("n").alias("flips"), F.sum(F.floor(F.col("n") / 2)).alias("mismatches"), F.sum(F.col("n") % 2).alias("switches"))


def interpolate(points: DataFrame, known: DataFrame, key: str, at: str, x: str, y: str) -> DataFrame:
    """``points`` with y interpolated between the known points before (or at) and after; at the ends the nearest.

    Two sorts of both inputs together, up and down; no range join.
    """
    both = points.select(key, F.col(at).alias("__x"), F.struct(*points.columns).alias("__p"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__k")).unionByName(
        known.groupBy(key, x).agg(F.avg(y).alias("__y")).select(key, F.col(x).alias("__x"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("__p"), "__y", F.lit(0).alias("__k"))
    )
    node = F.when(F.col("__k") == 0, F.struct("__x", "__y"))
    up, down = Window.partitionBy(key).orderBy("__x", "__k"), Window.partitionBy(key).orderBy(F.desc("__x"), F.desc("__k"))
    # Both frames only grow, so a key costs its length; the row itself is no node.
    seen = both.withColumns({"__a": F.last(node, ignorenulls=True).over(up), "__b": F.last(node, ignorenulls=True).over(down)}).where("__k = 1")
    x0, y0, x1, y1 = F.col("__a.__x"), F.col("__a.__y"), F.col("__b.__x"), F.col("__b.__y")
    line = y0 + (y1 - y0) * (F.col("__x") - x0) / (x1 - x0)
    return seen.select("__p.*", F.coalesce(line, y0, y1).alias("interpolated"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by ``keys``, null meeting null, with the columns of the left side and the other columns of the right."""
    named = right.select(*(F.col(k).alias(f"__on_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(named, reduce(Column.__and__, (left[k].eqNullSafe(named[f"__on_{k}"]) for k in keys)), how).drop(*(f"__on_{k}" for k in keys))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, span: int = 100_000, name: str = "total") -> DataFrame:
    """``name``: the sum of ``value`` up to each row by ``order`` (whole numbers, unique within a key), ranges of ``span`` numbers summed apart."""
    rows = df.withColumns({"__b": F.floor(F.col(order) / span), "__v": value})
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s")).select(*keys, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    own = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return join_on(rows.withColumn("__t", own), bases, [*keys, "__b"]).withColumn(name, F.col("__o") + F.col("__t")).drop("__b", "__v", "__o", "__t")


#: Ranges of values that a key is cut into where its values are ranked.
RANGES = 256


def totals_below(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "below") -> DataFrame:
    """``name``: the summed ``weight`` of a key's smaller values. Values of a key are distinct.

    Quantiles cut a key's values into ranges; a range is one window, and what
    lies below it is a sum over one row a range, so a long key is many tasks' work.
    """
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("__edges"))
    rows = join_on(df, edges, keys).withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.groupBy(*keys, "__b").agg(F.sum(weight).alias("__s")).select(*keys, "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return join_on(rows.withColumn("__t", own), bases, [*keys, "__b"]).withColumn(name, F.col("__o") + F.col("__t")).drop("__b", "__o", "__t")


def average_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """``avg_rank``: the mean rank of equal values of a group; equal values are counted before anything is sorted."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("__n"))
    ranks = totals_below(counts, [group], value, "__n").select(group, value, (F.col("below") + (F.col("__n") + 1) / 2.0).alias("avg_rank"))
    return join_on(df, ranks, [group, value])


def elementary_segments(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Segments between neighbouring end points that an interval covers, with how many; by a sweep, not a join."""
    events = df.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).groupBy(key, "x.at").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    parts = events.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w).alias("cover"))
    return parts.where("end is not null and cover > 0")


def running_offset(df: DataFrame, order: list, size: Column) -> DataFrame:
    """``offset``: the sizes of all rows before; for small tables (one window over all)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def sliding_windows(df: DataFrame, key: str, order: list[str], size: int, overlap: int, name: str = "win") -> DataFrame:
    """Rows with the number of each window of ``size`` rows of their key that they are in; a window begins ``size`` - ``overlap`` rows behind the one before."""
    step = size - overlap
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = df.withColumn("__i", i).withColumn("__b", F.floor(F.col("__i") / step))
    wins = F.when((F.col("__b") > 0) & (F.col("__i") % step < overlap), F.array(F.col("__b"), F.col("__b") - 1)).otherwise(F.array("__b"))
    return rows.withColumn(name, F.explode(wins)).drop("__i", "__b")


def first_rows(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``; the planner keeps as many a task before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def greedy_apart(df: DataFrame, key: str, at: str, order: str, distance: int) -> DataFrame:
    """(key, at, order) of rows kept one after another if they are ``distance`` or more from the last kept one."""
    picked = df.select(key, at, order)
    return scan.scan_keys(picked, [key], [at, order], [at, order], scan.kept_apart(distance), picked.schema)
