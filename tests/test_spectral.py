"""Spectral operators against plain recursion on the whole graph of sides."""

import random

import numpy as np
import pytest

from tessera.operators import spectral


def plain_bisection(edges):
    """{node: (block, side, quality)} by the Fiedler vector of the graph whose vertices are (node, side)."""
    out = {}

    def solve(nodes, edges):
        nodes = sorted(nodes)
        if len(nodes) == 1:
            out[nodes[0]] = (nodes[0], 0, None)
            return
        at = {n: i for i, n in enumerate(nodes)}
        m = np.zeros((2 * len(nodes), 2 * len(nodes)))
        for a, b, s, o in edges:
            for x in (0, 1):
                for y, w in ((x, s), (1 - x, o)):
                    m[2 * at[a] + x, 2 * at[b] + y] += w
                    m[2 * at[b] + y, 2 * at[a] + x] += w
        reached, todo = {0}, [0]
        while todo:
            v = todo.pop()
            for u in np.flatnonzero(m[v] + m[v ^ 1]):
                if u // 2 not in reached:
                    reached.add(int(u) // 2)
                    todo.append(int(u) // 2 * 2)
        own = {nodes[i] for i in reached}
        if len(own) < len(nodes):
            for part in (own, set(nodes) - own):
                solve(part, [e for e in edges if e[0] in part and e[1] in part])
            return
        values, vectors = np.linalg.eigh(np.diag(m.sum(axis=1)) - m)
        v = vectors[:, 1]
        if values[1] < 1e-9:
            # No conflict: the vertices fall into two components, one for each haplotype.
            one, todo = {0}, [0]
            while todo:
                for u in np.flatnonzero(m[todo.pop()]):
                    if int(u) not in one:
                        one.add(int(u))
                        todo.append(int(u))
            v = np.array([1.0 if i in one else -1.0 for i in range(len(m))])
        if v[0] * v[1] >= 0 and v[2] * v[3] >= 0:
            low = {n for i, n in enumerate(nodes) if v[2 * i] < 0}
            for part in (low, set(nodes) - low):
                solve(part, [e for e in edges if e[0] in part and e[1] in part])
            return
        for i, n in enumerate(nodes):
            out[n] = (nodes[0], int((v[2 * i] > 0) != (v[0] > 0)), float(np.log10(values[1] * np.sqrt(2 * len(nodes)))) if values[1] > 1e-9 else None)

    solve({n for e in edges for n in e[:2]}, edges)
    return out


def planted(rng, blocks=3, size=5, noise=0.3):
    """Blocks of nodes with sides, strong and mostly right links inside, weak random ones between."""
    edges = []
    nodes = [(k * 100 + i, rng.randint(0, 1)) for k in range(blocks) for i in range(size)]
    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if a // 100 == b // 100:
                right, wrong = rng.uniform(5, 9), rng.uniform(0, noise)
                edges.append((b, a, right if x == y else wrong, wrong if x == y else right))
            elif rng.random() < 0.2:
                edges.append((b, a, rng.uniform(0, 0.5), rng.uniform(0, 0.5)))
    return edges


def test_every_level_of_the_bisection(spark):
    rng = random.Random(7)
    groups = {g: planted(rng, rng.randint(1, 4), rng.randint(1, 6), rng.choice([0.0, 0.3, 4.0])) for g in range(12)}
    groups[20], groups[21] = [(1, 2, 1.0, 0.0), (3, 4, 0.0, 2.0)], [(5, 9, 1.5, 1.0)]
    rows = [(g, *e) for g, edges in groups.items() for e in edges]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (20, 7, 7, 1.0, 0.0)], "g long, a long, b long, s double, o double").repartition(5)
    got = {(r["g"], r["node"]): (r["block"], r["side"], r["quality"]) for r in spectral.recursive_bisection(df, ["g"], "a", "b", "s", "o").collect()}
    want = {(g, n): v for g, edges in groups.items() if edges for n, v in plain_bisection(edges).items()}
    assert got.keys() == want.keys() and len({(k[0], v[0]) for k, v in want.items()}) > 15
    for k, (block, side, quality) in want.items():
        assert got[k][:2] == (block, side), k
        assert got[k][2] == (pytest.approx(quality, abs=1e-6) if quality is not None else None)


def test_one_block_of_sides_and_one_cut():
    same, other = np.array([[0, 3, 0], [3, 0, 1], [0, 1, 0]], float), np.array([[0, 0, 0], [0, 0, 4], [0, 4, 0]], float)
    groups, side, value = spectral.split_part(same, other)
    assert not groups.any() and side.tolist() == [0, 0, 1] and value > 0
    weak = np.zeros((4, 4))
    weak[0, 1] = weak[1, 0] = weak[2, 3] = weak[3, 2] = 5
    weak[1, 2] = weak[2, 1] = 0.1
    assert spectral.split_part(weak, 0.5 * weak)[0].tolist() == [0, 0, 1, 1]


@pytest.mark.parametrize("window", [2, 4, 50])
def test_blocks_on_a_tree_of_links_get_the_signs_of_its_edges(spark, window):
    rng = random.Random(window)
    members, links, sides = [], [], {}
    for k in range(12):
        for i in range(3):
            sides[10 * k + i] = rng.randint(0, 1) if i else 0
            members.append(("c", 10 * k + i, 10 * k, sides[10 * k + i]))
    members.append(("d", 7, 7, 0))
    turn = {0: 0}
    for k in range(1, 12):
        up, total = rng.randrange(k), 0
        for w in (1, 2, 4):
            a, b, flip = 10 * k + rng.randrange(3), 10 * up + rng.randrange(3), rng.randint(0, 1)
            links.append(("c", *rng.sample([a, b], 2), flip, w))
            total += w if flip ^ sides[a] ^ sides[b] else -w
        turn[k] = turn[up] ^ (total > 0)
    out = spectral.link_blocks(spark.createDataFrame(members, "g string, node long, block long, side long"), spark.createDataFrame(links, "g string, a long, b long, flip long, weight long"), "g", window)
    got = {(r["g"], r["node"]): (r["block"], r["side"]) for r in out.collect()}
    assert got == {("d", 7): (7, 0)} | {("c", n): (0, s ^ turn[n // 10]) for n, s in sides.items()}


@pytest.mark.parametrize("shape", ["pairs far apart", "hub"])
def test_links_are_followed_however_far_apart_blocks_are(spark, shape):
    # Pairs: no two linked blocks lie within a window of the block order. Hub: one block has more links than a window.
    rng = random.Random(3)
    edges = [(i, i + 40, rng.randint(0, 1)) for i in range(40)] if shape != "hub" else [(0, i, rng.randint(0, 1)) for i in range(1, 40)]
    nodes = sorted({n for e in edges for n in e[:2]})
    members = spark.createDataFrame([("c", n, n, 0) for n in nodes], "g string, node long, block long, side long")
    out = spectral.link_blocks(members, spark.createDataFrame([("c", a, b, f, 1) for a, b, f in edges], "g string, a long, b long, flip long, weight long"), "g", 8)
    assert {r["node"]: (r["block"], r["side"]) for r in out.collect()} == {n: (n, 0) for n in nodes} | {b: (a, f) for a, b, f in edges}
