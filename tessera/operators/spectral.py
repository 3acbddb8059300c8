"""Spectral phasing: recursive bisection of windows and the links between phased blocks.

A node has two sides. An edge holds the weight of ``same`` (equal sides of both
ends go together) and of ``other`` (opposite sides do). With each side a vertex
of its own, the graph's Laplacian falls apart into a symmetric half, whose
second eigenvector splits the nodes into two groups, and an antisymmetric half,
whose first eigenvector gives every node a side. The lower of both eigenvalues
says what the graph is: one block of two sides, or two groups to be cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.windowing import join_on
from tessera.storage import discard, settle

#: Entries of an eigenvector below this have no sign.
TINY = 1e-9
#: Edges of a task of a round of bisections, about, where there are more than the cores share.
PART_ROWS = 100_000


def connected(linked: np.ndarray) -> np.ndarray:
    """The least member of each node's component, from a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        after = np.minimum(label, np.where(linked, label, len(label)).min(axis=1, initial=len(label)))
        after = np.minimum(after, after[after])
        if (after == label).all():
            return label
        label = after


def split_part(same: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(group of each node, -1 for none; side of each node or None where the part is cut; eigenvalue) of symmetric weights."""
    weight = same + other
    groups = connected(weight > 0)
    if groups.any():
        return groups, None, 0.0
    degree = np.diag(weight.sum(axis=1))
    turned, sides = np.linalg.eigh(degree - (same - other))
    cut, halves = np.linalg.eigh(degree - weight)
    if turned[0] <= cut[1] + TINY:
        sign = np.where(np.abs(sides[:, 0]) < TINY, 0, np.sign(sides[:, 0]))
        first = sign[np.flatnonzero(sign)[0]]
        return groups, np.where(sign == 0, -1, (sign != first).astype(int)), float(turned[0])
    half = halves[:, 1]
    return np.where(np.abs(half) < TINY, -1, (half * (np.sign(half[0]) or 1.0) < 0).astype(int)), None, 0.0


def recursive_bisection(edges: DataFrame, groups: list[str], a: str, b: str, same: str, other: str) -> DataFrame:
    """(groups, node, block, side, quality): blocks named by their smallest node, which has side 0; side is null where a node fits neither.

    Every round solves all parts of all groups in one job: a part becomes a
    block, or falls into two (or its components) for the next round. Quality is
    log10(eigenvalue * sqrt(vertices)) of the block, null without conflict. A
    part is dense in its task, so groups are meant to be windows of bounded size.
    """
    keys = [*groups, "part"]
    kinds = dict(edges.dtypes)
    columns = "final boolean, " + "".join(f"`{g}` {kinds[g]}, " for g in groups) + "part long, a long, b long, same double, other double, node long, side long, quality double"
    names = [*keys, "a", "b", "same", "other"]

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(rows[["a", "b"]].to_numpy())
        i, j = np.searchsorted(nodes, rows["a"]), np.searchsorted(nodes, rows["b"])
        s, o = np.zeros((2, len(nodes), len(nodes)))
        for m, w in ((s, rows["same"]), (o, rows["other"])):
            np.add.at(m, (i, j), w)
            np.add.at(m, (j, i), w)
        group, side, value = split_part(s, o)
        whole = {g: rows[g].iloc[0] for g in groups}
        if side is not None:
            fits = side >= 0
            quality = np.log10(value * np.sqrt(2 * len(nodes))) if value > TINY else np.nan
            return pd.DataFrame({"final": True, **whole, "part": np.where(fits, nodes[fits][0], nodes), "node": nodes, "side": pd.array(np.where(fits, side, 0), "Int64").copy() if fits.all() else pd.array([int(x) if x >= 0 else None for x in side], "Int64"), "quality": np.where(fits, quality, np.nan)})
        # Parts by their smallest node; a node without a part, or alone in it, is done.
        part = np.array([nodes[group == g][0] if g >= 0 else nodes[k] for k, g in enumerate(group)])
        inside = (part[i] == part[j]) & (group[i] >= 0)
        left = rows[inside].assign(final=False, part=part[i][inside])
        alone = ~np.isin(nodes, left[["a", "b"]].to_numpy())
        done = pd.DataFrame({"final": True, **whole, "part": nodes[alone], "node": nodes[alone], "side": pd.array([0 if g >= 0 else None for g in group[alone]], "Int64"), "quality": np.nan})
        return pd.concat([left, done], ignore_index=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return step(rows).reindex(columns=[c.split()[0].strip("`") for c in columns.split(", ")])

    low, high = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    now = edges.where((F.col(a) != F.col(b)) & (F.col(same) + F.col(other) > 0)).groupBy(*groups, low.alias("a"), high.alias("b")).agg(F.sum(same).cast("double").alias("same"), F.sum(other).cast("double").alias("other"))
    now = first = settle(now.withColumn("part", F.lit(0).cast("long")).select(*names))
    spread = max(edges.sparkSession.sparkContext.defaultParallelism, first.count() // PART_ROWS)
    done: list[DataFrame] = []
    while True:
        # Many small parts are few bytes: by size alone they would be one task.
        out = settle(now.repartition(spread, *keys).groupBy(*keys).applyInPandas(run, columns))
        done.append(out.where("final"))
        now = out.where("not final").select(*names)
        if not now.limit(1).count():
            break
    found = settle(_union(done).select(*groups, "node", F.col("part").alias("block"), "side", F.when(~F.isnan("quality"), F.col("quality")).alias("quality")))
    discard(first, *done)
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A merge join: what grows with the input, and once a round, is not sent through the driver."""
    return join_on(left, right.hint("merge"), keys, how)


def _windows(quotient: DataFrame, group: str, window: int, turn: int, pairs: bool) -> DataFrame:
    """Edges (group, __head, __sub, a, b, same, other) that are solved together, at most ``window`` blocks a (head, sub).

    A group of few blocks is one window. Else a hash deals blocks into heads and
    others, and a head takes the blocks whose strongest linked head it is; where
    they are many, each sub holds a part of them and the head. With ``pairs``,
    two blocks that are each other's strongest.
    """
    cost = F.abs(F.col("same") - F.col("other"))
    ends = quotient.select(group, F.col("a").alias("u"), F.col("b").alias("v"), cost.alias("s"), "a", "b").union(quotient.select(group, "b", "a", cost, "a", "b"))
    if pairs:
        best = ends.where("s > 0").groupBy(group, "u").agg(F.max(F.struct("s", "a", "b")).alias("m"))
        mutual = best.groupBy(group, F.col("m.a").alias("a"), F.col("m.b").alias("b")).agg(F.count("*").alias("n")).where("n = 2").drop("n")
        return _joined(quotient, mutual, [group, "a", "b"], "left_semi").select(group, F.col("a").alias("__head"), F.lit(0).alias("__sub"), "a", "b", "same", "other")
    sizes = ends.select(group, "u").distinct().groupBy(group).agg(F.count("*").alias("__n"), F.min("u").alias("__least"))
    heads = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(turn)), F.lit(2)) == 0
    hooked = ends.where(~heads("u") & heads("v")).groupBy(group, "u").agg(F.max(F.struct("s", "v")).alias("m")).select(group, F.col("u").alias("block"), F.col("m.v").alias("head"))
    hooked = settle(hooked.withColumn("sub", F.floor((F.row_number().over(Window.partitionBy(group, "head").orderBy("block")) - 1) / max(1, window - 1)).cast("int")))
    end = lambda c: hooked.select(group, F.col("block").alias(c), F.col("head").alias(f"head_{c}"), F.col("sub").alias(f"sub_{c}"))
    near = _joined(_joined(_joined(quotient, sizes, [group]), end("a"), [group, "a"], "left"), end("b"), [group, "b"], "left")
    place = lambda head, sub: F.struct(head.alias("head"), sub.alias("sub"))
    a, b = place(F.col("head_a"), F.col("sub_a")), place(F.col("head_b"), F.col("sub_b"))
    whole = F.when(F.col("__n") <= window, place(F.col("__least"), F.lit(0)))
    at = F.coalesce(whole, F.when(F.col("head_a") == F.col("b"), a).when(F.col("head_b") == F.col("a"), b).when((F.col("head_a") == F.col("head_b")) & (F.col("sub_a") == F.col("sub_b")), a))
    out = settle(near.withColumn("__at", at).where("__at is not null").select(group, F.col("__at.head").alias("__head"), F.col("__at.sub").alias("__sub"), "a", "b", "same", "other"))
    discard(hooked)
    return out


def _turns(solved: DataFrame, group: str) -> DataFrame:
    """(group, block, to, turn) of joined blocks: parts of one head are one through the block they share."""
    keys = [group, "__head", "__sub", "block"]
    shared = solved.where(F.col("node") == F.col("__head")).select(*keys, F.col("side").alias("__base"))
    parts = _joined(solved, shared, keys, "left").withColumn("__s", F.col("side").bitwiseXOR(F.col("__base")))
    apart = parts.where("__base is null and node <> block").select(group, F.col("node").alias("block"), F.col("block").alias("to"), F.col("side").alias("turn"))
    whole = parts.where("__base is not null").select(group, "__head", "node", "__s").distinct()
    least = whole.groupBy(group, "__head").agg(F.min(F.struct("node", "__s")).alias("__m"))
    one = _joined(whole, least, [group, "__head"]).where(F.col("node") != F.col("__m.node"))
    return apart.union(one.select(group, F.col("node").alias("block"), F.col("__m.node").alias("to"), F.col("__s").bitwiseXOR(F.col("__m.__s")).alias("turn")))


def link_blocks(members: DataFrame, links: DataFrame, group: str, window: int = 200) -> DataFrame:
    """(group, node, block, side) after blocks were turned and joined along their links.

    ``members``: group, node, block (its smallest node), side; ``links``: group,
    a, b, flip (1: the ends are on opposite sides), weight. Blocks are the nodes
    of a graph with the summed weight of links for equal and opposite turns. A
    round solves windows of at most ``window`` blocks that are linked to each
    other and contracts what they join, so a share of the blocks goes in each
    and the rounds follow the logarithm of their number. Where a round joins
    none, the pairs of blocks that are each other's strongest are tried; it ends
    when they join none either: no link with unequal weights is left.
    """
    now = settle(members.select(group, "node", "block", F.col("side").cast("long").alias("side")))
    ends = links.select(group, "a", "b", F.col("flip").cast("long").alias("flip"), F.col("weight").cast("double").alias("weight"))
    side = lambda end: now.select(group, F.col("node").alias(end), F.col("block").alias(f"block_{end}"), F.col("side").alias(f"side_{end}"))
    both = _joined(_joined(ends, side("a"), [group, "a"]), side("b"), [group, "b"])
    odd = F.col("flip").bitwiseXOR(F.col("side_a")).bitwiseXOR(F.col("side_b"))

    def contracted(df: DataFrame, a: str, b: str, same: Column, other: Column) -> DataFrame:
        return settle(df.where(F.col(a) != F.col(b)).groupBy(group, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(same).alias("same"), F.sum(other).alias("other")))

    quotient = contracted(both, "block_a", "block_b", F.when(odd == 0, F.col("weight")).otherwise(0.0), F.when(odd == 1, F.col("weight")).otherwise(0.0))
    maps: list[DataFrame] = []
    pairs, rounds = False, 0
    while quotient.limit(1).count():
        near = _windows(quotient, group, window, rounds, pairs)
        solved = recursive_bisection(near, [group, "__head", "__sub"], "a", "b", "same", "other")
        turns = settle(_turns(solved.where("side is not null"), group))
        discard(solved, *([] if pairs else [near]))
        rounds += 1
        if not turns.limit(1).count():
            discard(turns)
            if pairs:
                break
            pairs = True
            continue
        pairs = False
        maps.append(turns)
        to = lambda end: turns.select(group, F.col("block").alias(end), F.col("to").alias(f"to_{end}"), F.col("turn").alias(f"turn_{end}"))  # noqa: B023, E731
        moved = _joined(_joined(quotient, to("a"), [group, "a"], "left"), to("b"), [group, "b"], "left")
        odd = F.coalesce("turn_a", F.lit(0)).bitwiseXOR(F.coalesce("turn_b", F.lit(0)))
        moved = moved.select(group, F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), F.when(odd == 0, F.col("same")).otherwise(F.col("other")).alias("s"), F.when(odd == 0, F.col("other")).otherwise(F.col("same")).alias("o"))
        after = contracted(moved, "x", "y", F.col("s"), F.col("o"))
        discard(quotient)
        quotient = after
    discard(quotient)
    if not maps:
        return now
    # From the last round back: where a block's block went after it.
    total = maps.pop()
    while maps:
        step = maps.pop()
        rest = total.select(group, F.col("block").alias("to"), F.col("to").alias("__to"), F.col("turn").alias("__turn"))
        on = _joined(step, rest, [group, "to"], "left").select(group, "block", F.coalesce("__to", "to").alias("to"), F.col("turn").bitwiseXOR(F.coalesce("__turn", F.lit(0))).alias("turn"))
        after = settle(on.union(total))
        discard(step, total)
        total = after
    moved = _joined(now, total, [group, "block"], "left")
    after = settle(moved.select(group, "node", F.coalesce("to", "block").alias("block"), F.col("side").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("side")))
    discard(now, total)
    return after
