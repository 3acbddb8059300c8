"""Region operators against enumeration and plain scans."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import regions


def path_score(block, n, density, size, clusters, opened, length):
    """Score of a choice of clusters over every block from the first to the last filled one."""
    inside = {b for i, j in clusters for b in range(block[i], block[j - 1] + 1)}
    at = dict(zip(block, n, strict=True))
    total = sum(at.get(b, 0) * math.log(density) - density * size for b in range(block[0], block[-1] + 1) if b not in inside)
    for i, j in clusters:
        reads, width = sum(n[i:j]), (block[j - 1] - block[i] + 1) * size
        total += reads * (math.log(reads / width) - 1) + opened
        if length:
            total -= (width - length[0]) ** 2 / (2 * length[1] ** 2) + math.log(length[1]) + 0.5 * math.log(2 * math.pi)
    return total


def all_paths(m):
    """All ways to choose ranges [i, j) of 0..m that do not overlap."""
    if not m:
        yield []
        return
    for rest in all_paths(m - 1):
        yield rest
    for i in range(m):
        for rest in all_paths(i):
            yield [*rest, (i, m)]


@pytest.mark.parametrize("length", [None, (300.0, 150.0)])
def test_the_best_path_of_clusters(length):
    rng = random.Random(4)
    for _ in range(60):
        m = rng.randint(1, 8)
        block = sorted(rng.sample(range(30), m))
        n = [rng.choice([1, 1, 2, 6, 9]) for _ in range(m)]
        density, opened, most, least = rng.choice([0.001, 0.01]), rng.choice([-1.0, -6.0]), rng.choice([4, 12, 30]), rng.choice([2, 5])
        got = regions.dense_path(np.array(block), np.array(n), density, 50, most, least, opened, length)
        fits = lambda c: all(sum(n[i:j]) >= least and block[j - 1] - block[i] < most for i, j in c)  # noqa: B023, E731
        best = max(path_score(block, n, density, 50, c, opened, length) for c in all_paths(m) if fits(c))
        assert fits(got) and path_score(block, n, density, 50, got, opened, length) == pytest.approx(best)


def test_stretches_are_solved_apart_and_copies_do_not_count(spark):
    reads = [("c", p) for p in range(1000, 1500, 20)] + [("c", 60_000)] * 50 + [("c", p) for p in range(90_000, 90_400, 10)] + [("d", 5)]
    counts = regions.block_counts(spark.createDataFrame(reads, "c string, p long"), "c", "p", 100)
    assert {(r["c"], r["block"]): r["n"] for r in counts.where("block >= 600").collect()} == {("c", 600): 1} | {("c", b): 10 for b in range(900, 904)}
    found = regions.dense_windows(counts, "c", 100, 2000, 100, opened=-3.0).collect()
    assert sorted((r["c"], r["start"], r["end"], r["reads"]) for r in found) == [("c", 1000, 1500, 25), ("c", 90_000, 90_400, 40)]


def plain_regions(text, wanted, share, drop, least):
    """Every start in turn: extend, note the best end, stop when the score is spent or too far behind."""
    reward, out, i = (1 - share) / share, [], 0
    while i < len(text):
        if text[i] not in wanted:
            i += 1
            continue
        scores = list(itertools.accumulate(reward if c in wanted else -1.0 for c in text[i:]))
        top, end = 0.0, i
        for k, s in enumerate(scores):
            if s > top:
                top, end = s, i + k + 1
            if s <= 0 or top - s > drop:
                break
        if end - i >= least:
            out.append((i, end, sum(c in wanted for c in text[i:end])))
        i = end
    return out


def test_drop_regions_of_long_sequences_cut_into_pieces(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ACGT", [1, rng.choice([1, 2, 3]), 1, 1], k=rng.randint(0, 400))) for _ in range(40)]
    texts += [None, "", "GC" * 500, "AT" * 500, "G" * 30 + "A" * 11 + "G" * 30, "G" * 30 + "A" * 10 + "G" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(3)
    for drop, least in ((10.0, 20), (2.5, 3)):
        got = sorted(map(tuple, regions.x_drop_regions(df, "k", "s", "GC", 0.6, drop, least).collect()))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_regions(t or "", "GC", 0.6, drop, least)]
    hit = np.array([c in "GC" for c in texts[0]])
    pieces = regions.clean_pieces(hit, 3)
    assert all(hit[a] and hit[b - 1] for a, b in pieces) and all(b + 3 <= c for (_, b), (c, _) in itertools.pairwise(pieces))


def test_masks_and_patches(spark):
    rows = [("q", 0, 100, "t", "+", 0, 100, 60), ("q", 40, 90, "u", "+", 0, 50, 60), ("q", 90, 160, "t", "+", 95, 165, 5), ("q", 165, 300, "t", "+", 170, 305, 60), ("q", 300, 420, "t", "-", 310, 430, 60), ("r", 0, 10, "t", "+", 0, 10, 60)]
    df = spark.createDataFrame(rows, "q string, s long, e long, t string, st string, ts long, te long, mq long")
    kept = regions.mask_alignments(df, "q", "s", "e", ["t", "st", "ts", "te", "mq"])
    assert sorted((r["q"], r["s"]) for r in kept.collect()) == [("q", 0), ("q", 90), ("q", 165), ("q", 300), ("r", 0)]
    joined = regions.patch_alignments(kept, "q", "t", "st", ("ts", "te"), ("s", "e"), 20, "mq")
    assert sorted((r["q"], r["s"], r["e"], r["mq"]) for r in joined.collect()) == [("q", 0, 300, 60), ("q", 300, 420, 60), ("r", 0, 10, 60)]
    assert tuple(regions.break_counts(joined, "q", F.col("e") - F.col("s"), "mq").first()) == (1, 1, 1, 0, 0)
    assert tuple(regions.break_counts(kept, "q", F.col("e") - F.col("s"), "mq").first()) == (3, 2, 2, 0, 0)


def test_patched_parts_are_found_in_one_order(spark):
    # Parts of a read: the first two lie close on both sides, the third is far on the target, the fourth has no strand, the last lies on another target.
    rows = [("r", "a", "+", 0, 10, 0, 10, 5), ("r", "a", "+", 12, 20, 11, 19, 7), ("r", "a", "+", 90, 99, 20, 29, 9), ("r", "a", None, 100, 110, 30, 40, 3), ("r", "b", "+", 112, 120, 41, 49, 2), ("s", "a", "+", 0, 9, 0, 9, 1)]
    df = spark.createDataFrame(rows, "q string, t string, st string, ts long, te long, s long, e long, mq long")
    joined = regions.patch_alignments(df, "q", "t", "st", ("ts", "te"), ("s", "e"), 20, "mq")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # Groups in hash maps and sorts held a task's rows several times over.
    assert "Aggregate" not in plan and plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    assert sorted(tuple(r) for r in joined.select("q", "t", "ts", "te", "s", "e", "mq").collect()) == [("r", "a", 0, 20, 0, 19, 7), ("r", "a", 90, 99, 20, 29, 9), ("r", "a", 100, 110, 30, 40, 3), ("r", "b", 112, 120, 41, 49, 2), ("s", "a", 0, 9, 0, 9, 1)]
