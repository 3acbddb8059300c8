"""Joins: lookups, linkage, ranges, merges, overlays, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import discard, settle


def lookup(facts: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a dimension; a missing value becomes ``default``. Whether to broadcast is left to the planner, which knows the sizes."""
    return facts.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def cascading_lookup(facts: DataFrame, dim: DataFrame, attempts: list[Column], dim_key: str, dim_value: str, fallback: Column, name: str = "found") -> DataFrame:
    """The value of the first attempted key that the dimension has, else ``fallback``."""
    out = facts
    for i, key in enumerate(attempts):
        out = out.withColumn(f"__k{i}", key).join(dim.select(F.col(dim_key).alias(f"__k{i}"), F.col(dim_value).alias(f"__v{i}")), f"__k{i}", "left")
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(attempts))], fallback)
    return out.select(*facts.columns, found.alias(name))


def adjacent(df: DataFrame, group: str, index: str, columns: list[str]) -> DataFrame:
    """Each row with the row of the next index of its group (columns ``next_*``); one window instead of a self-join."""
    w = Window.partitionBy(group).orderBy(index)
    nexts = {f"next_{c}": F.lead(c).over(w) for c in [index, *columns]}
    return df.withColumns(nexts).where(F.col(f"next_{index}") == F.col(index) + 1)


def neighbour_shares(df: DataFrame, group: str, index: str, value: str, least: int = 4) -> DataFrame:
    """(index, same, opposite): over all groups the shares of equal and different values at an index and the next; zero with ``least`` groups or fewer."""
    one = df.groupBy(group, index).agg(F.max(value).alias("__f"))
    pairs = adjacent(one, group, index, ["__f"]).select(index, (F.col("__f") == F.col("next___f")).alias("__same"))
    share = lambda t: F.when(F.count("*") > least, F.count_if(t) / F.count("*")).otherwise(0.0)
    return pairs.groupBy(index).agg(share(F.col("__same")).alias("same"), share(~F.col("__same")).alias("opposite"))


def pairs_within(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Item pairs a < b that share groups, with how often and the summed weight (w_a * w_b)."""
    one = df.groupBy(group, item).agg(F.sum(weight).alias("w"))
    a, b = one.select(group, F.col(item).alias("a"), F.col("w").alias("wa")), one.select(group, F.col(item).alias("b"), F.col("w").alias("wb"))
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("wa") * F.col("wb")).alias("weight"))


#: Bins of one level are so many times wider than those of the level below; a span touches this number and one at most.
STEP = 8


def span_level(start: str, end: str, width: int) -> Column:
    """The least level whose bins (``width`` times a power of ``STEP``) a half-open span touches ``STEP`` + 1 of at most."""
    return F.greatest(F.ceil(F.log(float(STEP), (F.col(end) - F.col(start)) / F.lit(width * STEP)) - 1e-9), F.lit(0)).cast("int")


def bins(start: str, end: str, level: Column, width: int) -> Column:
    """Numbers of the bins of a level that a half-open span touches."""
    size = F.lit(width) * F.pow(F.lit(float(STEP)), level)
    return F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points in half-open spans [start, end) of the same keys.

    Spans are cut into bins so that the join has an equality beside the range.
    Long spans go into wider bins, so each is in ``STEP`` + 1 rows at most; a
    point is in one row for each level that occurs among the spans.
    """
    levelled = spans.where(F.col(start) < F.col(end)).withColumn("__level", span_level(start, end, width))
    # One number a level, and few levels: the logarithm of the longest span.
    levels = [r[0] for r in levelled.select("__level").distinct().collect()]
    binned = levelled.withColumn("__bin", F.explode(bins(start, end, F.col("__level"), width)))
    places = F.array(*[F.struct(F.lit(v).alias("level"), F.floor(F.col(at) / (width * STEP**v)).alias("bin")) for v in levels or [0]])
    own = points.withColumn("__p", F.explode(places)).withColumns({"__level": F.col("__p.level"), "__bin": F.col("__p.bin")}).drop("__p")
    condition = [own[k] == binned[k] for k in [*keys, "__level", "__bin"]] + [own[at] >= binned[start], own[at] < binned[end]]
    on = reduce(Column.__and__, condition)
    if how in ("left_semi", "left_anti"):
        if len(levels) < 2:
            return own.join(binned, on, how).drop("__level", "__bin")
        # A point that is in several rows is there if one of them meets a span.
        met = own.join(binned, on, "left_semi").select(*keys, at).distinct()
        return points.join(met, [*keys, at], how)
    if how != "inner":
        raise ValueError("points and spans are joined inner, left_semi or left_anti")
    joined = own.join(binned, on, how)
    for k in [*keys, "__level", "__bin"]:
        joined = joined.drop(binned[k])
    return joined.drop("__level", "__bin")


def near_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, distance: int, how: str) -> DataFrame:
    """Semi or anti join of rows within ``distance`` of each other: the right side is repeated into the three bins that a match can be in."""
    r = right.select(*keys, F.col(at).alias("__at")).withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__at") / distance) + d for d in (-1, 0, 1)])))
    l = left.withColumn("__bin", F.floor(F.col(at) / distance))  # noqa: E741
    condition = reduce(Column.__and__, [l[k] == r[k] for k in [*keys, "__bin"]]) & (F.abs(l[at] - r["__at"]) <= distance)
    return l.join(r, condition, how).drop("__bin")


def merge_fill(frames: dict[str, DataFrame], key: str, value: str, fill) -> DataFrame:
    """Full outer merge of several frames by key, one column each, gaps filled."""
    named = [f.select(key, F.col(value).alias(n)) for n, f in frames.items()]
    merged = reduce(lambda a, b: a.join(b, key, "full"), named)
    return merged.select(key, *[F.coalesce(F.col(n), F.lit(fill)).alias(n) for n in frames])


def mendelian_conflict(child: tuple[Column, Column], mother: tuple[Column, Column], father: tuple[Column, Column]) -> Column:
    """Neither assignment of the child's alleles to the parents fits."""
    a, b = child
    fits = lambda x, pair: (x == pair[0]) | (x == pair[1])
    return ~((fits(a, mother) & fits(b, father)) | (fits(b, mother) & fits(a, father)))


def overlay(base: DataFrame, updates: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` replaced where ``updates`` has the key (one column or several) and a value."""
    new = updates.select(*([key] if isinstance(key, str) else key), *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def best_pairing(cost: dict[tuple[str, str], Column]) -> Column:
    """The smaller cost of pairing (a, b) with (x, y) straight or crossed; keys are ax, by, ay, bx."""
    return F.least(cost["a", "x"] + cost["b", "y"], cost["a", "y"] + cost["b", "x"])


def levels(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, level): roots (no parent) are 0, children one more, to the last level; one join a level, each written so that lineage stays short.

    Nodes of a cycle hang from no root and are not in the result.
    """
    current = nodes.where(F.col(parent).isNull()).select(F.col(node).alias("node"), F.lit(0).cast("bigint").alias("level"))
    children = settle(nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("parent")))
    out, i = [], 0
    while not out or current.limit(1).count():
        out.append(current)
        i += 1
        current = settle(children.join(current.select(F.col("node").alias("parent")), "parent").select("node", F.lit(i).cast("bigint").alias("level")))
    discard(children, current)
    return reduce(DataFrame.unionByName, out)


def shared_lengths(sources: dict[str, DataFrame], key: str, start: str, end: str) -> DataFrame:
    """(key, held, n): positions that just the sources named in ``held`` (joined in order) cover, by one sweep over all ends of half-open intervals."""
    ends = [df.select(key, F.explode(F.array(*[F.struct(F.col(c).alias("at"), *[F.lit(d if other == name else 0).alias(f"d_{other}") for other in sources]) for c, d in ((start, 1), (end, -1))])).alias("x")).select(key, "x.*") for name, df in sources.items()]
    events = reduce(DataFrame.union, ends).groupBy(key, "at").agg(*(F.sum(f"d_{n}").alias(f"d_{n}") for n in sources))
    w = Window.partitionBy(key).orderBy("at")
    held = F.concat(*[F.when(F.sum(f"d_{n}").over(w) > 0, n).otherwise("") for n in sources])
    parts = events.select(key, held.alias("held"), (F.lead("at").over(w) - F.col("at")).alias("n")).where("n is not null and held <> ''")
    return parts.groupBy(key, "held").agg(F.sum("n").alias("n"))


def explode_aliases(rows: DataFrame, members: str, group: str, separator: str = "/") -> DataFrame:
    """(member, group) of packed member lists; an empty group names the member itself."""
    one = rows.select(F.explode(F.split(members, separator)).alias("member"), F.col(group))
    return one.select("member", F.when(F.coalesce(F.col(group), F.lit("")) == "", F.col("member")).otherwise(F.col(group)).alias(group))
