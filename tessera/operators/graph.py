"""Components, orientations, spectral halves and segmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, by contraction (see ``signed_components``)."""
    return _contract(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(0).cast("bigint").alias("f"))).select("node", "component")


def signed_components(edges: DataFrame, a: str, b: str, flip: str) -> DataFrame:
    """(node, component, side): components whose edges say same side (0) or other side (1); side 0 is the smallest node's.

    Every node with a smaller neighbour points to its least one; pointers are
    followed to their ends (pointer jumping with parity), and the ends become the
    nodes of the next, smaller graph, which has the edges between different ends.
    Two such steps at least halve the nodes, so work follows the input. In a
    component with contradictory cycles every node gets the lesser side, 0.
    """
    return _contract(edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(flip).cast("bigint").alias("f")))


def _ends(up: DataFrame) -> DataFrame:
    """Pointers (u, v, f), v < u, followed until they end: (u, r, s, v) with the end r, the parity s of the way and the first v; ``up`` is deleted."""
    now = settle(up.select("u", F.col("v").alias("r"), F.col("f").alias("s"), "v"))
    discard(up)
    while True:
        # One row for each pointer's end that points on; where they are few, they are small however many nodes share them.
        on = settle(now.select(F.col("u").alias("r"), F.col("r").alias("__r"), F.col("s").alias("__s")).join(now.select("r").distinct(), "r"))
        if not on.limit(1).count():
            discard(on)
            return now
        after = settle(now.join(on, "r", "left").select("u", F.coalesce("__r", "r").alias("r"), F.col("s").bitwiseXOR(F.coalesce("__s", F.lit(0))).alias("s"), "v"))
        discard(now, on)
        now = after


def _contract(edges: DataFrame) -> DataFrame:
    kept = settle(edges.where("a is not null and b is not null"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = kept.where("a <> b").select(high.alias("u"), low.alias("v"), "f")
    steps, odd = [], [kept.where("a = b and f = 1").select(F.col("a").alias("component"))]
    begun = [kept]
    while True:
        ends = _ends(settle(now.groupBy("u").agg(F.min(F.struct("v", "f")).alias("m")).select("u", "m.v", "m.f")))
        # Edges that a pointer follows hold nothing new, unless they contradict it.
        by_u = now.join(ends.select("u", "r", "s", F.col("v").alias("__v")), "u")
        half = settle(by_u.select("r", "v", F.col("f").bitwiseXOR(F.col("s")).alias("f")).where("r <> v or f = 1").distinct())
        both = half.join(ends.select(F.col("u").alias("v"), F.col("r").alias("q"), F.col("s").alias("__s")), "v", "left")
        both = both.select("r", F.coalesce("q", "v").alias("q"), F.col("f").bitwiseXOR(F.coalesce("__s", F.lit(0))).alias("f"))
        after = settle(both.where("r <> q or f = 1").distinct())
        discard(half)
        steps.append(ends)
        begun.append(after)
        odd.append(after.where("r = q").select(F.col("r").alias("component")))
        now = after.where("r <> q").select(F.greatest("r", "q").alias("u"), F.least("r", "q").alias("v"), "f")
        if not now.limit(1).count():
            break
    # From the smallest graph back: an end's own component.
    total = None
    while steps:
        step = steps.pop()
        if total is None:
            total = settle(step.select("u", "r", "s"))
        else:
            rest = total.select(F.col("u").alias("r"), F.col("r").alias("__r"), F.col("s").alias("__s"))
            found = step.join(rest, "r", "left").select("u", F.coalesce("__r", "r").alias("r"), F.col("s").bitwiseXOR(F.coalesce("__s", F.lit(0))).alias("s"))
            after = settle(found.union(total))
            discard(total)
            total = after
        discard(step)
    # Roots, which point nowhere, and nodes whose only edge is to themselves.
    roots = total.select("r").distinct().union(kept.where("a = b").select("a").join(total.select(F.col("u").alias("a")), "a", "left_anti")).distinct()
    out = total.select(F.col("u").alias("node"), F.col("r").alias("component"), F.col("s").alias("side")).union(roots.select("r", F.col("r"), F.lit(0).cast("bigint")))
    wrong = odd[0]
    for o in odd[1:]:
        wrong = wrong.union(o)
    if wrong.limit(1).count():
        at = total.select(F.col("u").alias("component"), F.col("r").alias("__r"))
        wrong = wrong.distinct().join(at, "component", "left").select(F.coalesce("__r", "component").alias("component"), F.lit(True).alias("__odd")).distinct()
        out = out.join(wrong, "component", "left").select("node", "component", F.when(F.col("__odd"), 0).otherwise(F.col("side")).cast("bigint").alias("side"))
    result = settle(out)
    discard(total, *begun)
    return result


def orientations(blocks: DataFrame, group: str, index: str, weight: str) -> DataFrame:
    """Per group of ordered blocks, the signs with the highest sum of weight_i * weight_j * s_i * s_j over neighbours, the first block's sign fixed.

    (group, mask, score): ``mask`` has a digit for each block but the first, the
    last block in front, 1 where its sign is turned; of equal scores the least
    mask. Only neighbours meet in a term, so a fold that keeps the best score
    for either sign of the last block is exact for groups of any size.
    """
    lists = blocks.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(index, weight))), lambda x: x[weight]).alias("w"))
    end = lambda score, mask: F.struct(score.alias("score"), mask.alias("mask"))
    better = lambda a, b: F.when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["mask"] <= b["mask"])), a).otherwise(b)

    def step(state, i):
        p = F.element_at("w", i) * F.element_at("w", i + 1)
        up, down = state["up"], state["down"]
        put = lambda side, sign, digit: end(side["score"] + sign * p, F.concat(F.lit(digit), side["mask"]))
        return F.struct(better(put(up, 1, "0"), put(down, -1, "0")).alias("up"), better(put(up, -1, "1"), put(down, 1, "1")).alias("down"))

    begin = F.struct(end(F.lit(0.0), F.lit("")).alias("up"), end(F.lit(float("-inf")), F.lit("")).alias("down"))
    steps = F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    best = lists.select(group, F.aggregate(steps, begin, step, lambda s: better(s["up"], s["down"])).alias("b"))
    return best.select(group, F.col("b.mask").alias("mask"), F.round("b.score", 4).alias("score"))


def fiedler_sides(edges: DataFrame, group: str, a: str, b: str, weight: str) -> DataFrame:
    """(group, node, side): sign of the second eigenvector of each group's Laplacian, the smallest node on side 0.

    Only the edges of one group meet in a task; the eigenproblem is dense, so groups are meant to be windows of bounded size.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(rows[["a", "b"]].to_numpy())
        i, j = np.searchsorted(nodes, rows["a"]), np.searchsorted(nodes, rows["b"])
        m = np.zeros((len(nodes), len(nodes)))
        np.add.at(m, (i, j), rows["w"])
        np.add.at(m, (j, i), rows["w"])
        side = np.zeros(len(nodes), np.int64)
        if len(nodes) > 1:
            vector = np.linalg.eigh(np.diag(m.sum(axis=1)) - m)[1][:, 1]
            side = (np.sign(vector) != (np.sign(vector[0]) or 1.0)).astype(np.int64)
        return pd.DataFrame({group: rows[group].iloc[0], "node": nodes, "side": side})

    kind = dict(edges.dtypes)
    picked = edges.select(group, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(weight).cast("double").alias("w")).where("a <> b")
    return picked.groupBy(group).applyInPandas(solve, f"{group} {kind[group]}, node long, side long")


def best_arc(x: np.ndarray, most: int) -> tuple[float, int, int]:
    """(z, i, j): the stretch i:j of at most ``most`` values whose rank sum is farthest from chance, by a Mann-Whitney z corrected for ties."""
    n = len(x)
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    rank = (last - 0.5 * (count - 1))[inverse]
    spread = (n + 1 - (count.astype(float) ** 3 - count).sum() / n / (n - 1)) / 12 if n > 1 else 0.0
    if spread <= 0:
        return 0.0, -1, -1
    total = np.concatenate([[0.0], np.cumsum(rank)])
    best = (0.0, -1, -1)
    for j in range(1, n + 1):
        i = np.arange(max(0, j - most), j)
        size = j - i
        i, size = i[size < n], size[size < n]
        if len(i):
            z = np.abs(total[j] - total[i] - 0.5 * size * (n + 1)) / np.sqrt((n - size) * size * spread)
            k = int(z.argmax())
            if z[k] > best[0]:
                best = (float(z[k]), int(i[k]), j)
    return best


def circular_segments(x: np.ndarray, threshold: float, most: int, least: int = 4) -> list[tuple[int, int]]:
    """Ranges of a series: the best arc cuts a range in three while its z passes ``threshold``, parts under ``least`` values are not cut again."""
    todo, done = [(0, len(x))], []
    while todo:
        begin, end = todo.pop()
        z, i, j = best_arc(x[begin:end], most)
        if z <= threshold:
            done.append((begin, end))
            continue
        for a, b in ((begin, begin + i), (begin + i, begin + j), (begin + j, end)):
            if b - a >= least:
                todo.append((a, b))
            elif b > a:
                done.append((a, b))
    return sorted(done)


def segments(df: DataFrame, key: str, order: str, value: str, threshold: float = 3.0, most: int = 200) -> DataFrame:
    """(key, start, end, n, median): circular binary segmentation of each key's series; ``most`` bounds the inner arc.

    A key's series meets in one task and costs its length times ``most`` a cut:
    keys are meant to be chromosomes of binned depth.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o", kind="stable")
        x, at = rows["v"].to_numpy(float), rows["o"].to_numpy()
        return pd.DataFrame([{key: rows[key].iloc[0], "start": at[a], "end": at[b - 1], "n": b - a, "median": np.sort(x[a:b])[(b - a) // 2]} for a, b in circular_segments(x, threshold, most)])

    kind = dict(df.dtypes)
    picked = df.select(key, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    return picked.groupBy(key).applyInPandas(solve, f"{key} {kind[key]}, start long, end long, n long, median double")
