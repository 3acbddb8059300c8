"""Queries without SQL, row by row against plain versions on their own input."""

from pathlib import Path

import numpy as np
import pytest
from compare import connect
from test_regions import path_score
from test_spectral import plain_bisection

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
TRADE = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_recursive_bisection(spark, duck):
    rows = duck.execute(f"SELECT year(o_orderdate) * 4 + quarter(o_orderdate), c_nationkey, s_nationkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) {TRADE} WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3").fetchall()
    edges = {}
    for quarter, a, b, same, other in rows:
        if same + other:
            own = edges.setdefault(quarter, {}).setdefault((min(a, b), max(a, b)), [0.0, 0.0])
            own[0] += same
            own[1] += other
    got = {(r["quarter"], r["node"]): r for r in registry.QUERIES["recursive_bisection"](spark, SF).collect()}
    want = {(q, n): v for q, own in edges.items() for n, v in plain_bisection([(a, b, s, o) for (a, b), (s, o) in own.items()]).items()}
    assert got.keys() == want.keys()
    for k, (block, side, quality) in want.items():
        assert (got[k]["block"], got[k]["side"]) == (block, side)
        assert got[k]["quality"] == (pytest.approx(quality, abs=1e-3) if quality is not None else None)


def test_fiedler_halves(spark, duck):
    rows = duck.execute(f"SELECT year(o_orderdate) * 4 + quarter(o_orderdate), c_nationkey, s_nationkey, sum(l_quantity) {TRADE} WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3").fetchall()
    groups = {}
    for quarter, a, b, w in rows:
        groups.setdefault(quarter, []).append((a, b, w))
    got = {}
    for r in registry.QUERIES["fiedler_halves"](spark, SF).collect():
        got.setdefault(r["quarter"], {})[r["node"]] = r["side"]
    assert got.keys() == groups.keys()
    for quarter, edges in groups.items():
        nodes = sorted({n for e in edges for n in e[:2]})
        m = np.zeros((len(nodes), len(nodes)))
        for a, b, w in edges:
            m[nodes.index(a), nodes.index(b)] += w
            m[nodes.index(b), nodes.index(a)] += w
        laplacian = np.diag(m.sum(axis=1)) - m
        values = np.linalg.eigvalsh(laplacian)
        side = np.array([got[quarter][n] for n in nodes])
        assert set(got[quarter]) == set(nodes) and side[0] == 0
        if len(nodes) > 2 and values[1] > 1e-9 and values[2] - values[1] > 1e-6:
            vector = np.linalg.eigh(laplacian)[1][:, 1]
            assert (side == (np.sign(vector) != np.sign(vector[0])).astype(int)).all()


def test_cbs_segments(spark, duck):
    series = {}
    for kind, h, v in duck.execute("SELECT event_type, epoch_us(ts) // 3600000000, sum(value) FROM events GROUP BY 1, 2 ORDER BY 1, 2").fetchall():
        series.setdefault(kind, []).append((h, v))

    def z_of(x, i, j):
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        n, k = len(x), j - i
        ties = sum(c**3 - c for c in np.unique(x, return_counts=True)[1])
        spread = (n + 1 - ties / n / (n - 1)) / 12
        return abs(ranks[i:j].sum() - k * (n + 1) / 2) / np.sqrt((n - k) * k * spread)

    def solve(x, begin, out):
        pairs = [(z_of_cached, i, j) for i, j, z_of_cached in all_z(x)] if len(x) > 1 else []
        best = max(pairs, key=lambda p: p[0], default=(0, 0, 0))
        if best[0] <= 3.0:
            out.append((begin, begin + len(x)))
            return
        _, i, j = best
        for a, b in ((0, i), (i, j), (j, len(x))):
            if b - a >= 4:
                solve(x[a:b], begin + a, out)
            elif b > a:
                out.append((begin + a, begin + b))

    def all_z(x):
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        n = len(x)
        spread = (n + 1 - sum(c**3 - c for c in np.unique(x, return_counts=True)[1]) / n / (n - 1)) / 12
        for j in range(1, n + 1):
            for i in range(max(0, j - 200), j):
                if j - i < n and spread > 0:
                    yield i, j, abs(ranks[i:j].sum() - (j - i) * (n + 1) / 2) / np.sqrt((n - j + i) * (j - i) * spread)

    got = {}
    for r in registry.QUERIES["cbs_segments"](spark, SF).collect():
        got.setdefault(r["event_type"], []).append((r["start"], r["end"], r["n"], r["median"]))
    assert got.keys() == series.keys()
    for kind, own in series.items():
        x, out = np.array([v for _, v in own]), []
        solve(x, 0, out)
        assert z_of(x, 0, 1) == pytest.approx(next(z for i, j, z in all_z(x) if (i, j) == (0, 1)))
        assert sorted(got[kind]) == [(own[a][0], own[b - 1][0], b - a, pytest.approx(float(np.sort(x[a:b])[(b - a) // 2]), abs=1e-4)) for a, b in sorted(out)]


def test_dense_windows(spark, duck):
    counts = {}
    for user, at, n in duck.execute("SELECT user_id, epoch_us(ts) // 60000000 - (SELECT min(epoch_us(ts) // 60000000) FROM events) AS tt, count(*) FROM events GROUP BY 1, 2").fetchall():
        counts.setdefault(user, {}).setdefault(at // 60, []).append((at % 60 // 6, n))
    got = {}
    for r in registry.QUERIES["dense_windows"](spark, SF).collect():
        got.setdefault(r["user_id"], []).append((r["start"], r["end"], r["reads"]))
    assert got
    for user, own in counts.items():
        block = sorted(own)
        n = [len({t for t, _ in own[b]}) if sum(c for _, c in own[b]) >= 4 else sum(c for _, c in own[b]) for b in block]
        density = len({b // 10 for b in block}) / (block[-1] // 10 + 1) / 600
        # The best path over all blocks of the user, stretches and all, by a plain programme over pairs.
        best, chosen = [0.0], [[]]
        for j in range(1, len(block) + 1):
            empties = (block[j - 1] - block[j - 2] - 1 if j > 1 else 0) * -density * 60
            options = [(best[j - 1] + empties + n[j - 1] * np.log(density) - density * 60, chosen[j - 1])]
            for i in range(j):
                if sum(n[i:j]) >= 5 and block[j - 1] - block[i] < 24 * 14 and all(b - a <= 48 for a, b in zip(block[i:j], block[i + 1 : j], strict=False)):
                    before = (block[i] - block[i - 1] - 1 if i else 0) * -density * 60
                    options.append((best[i] + before + path_score(block[i:j], n[i:j], density, 60, [(0, j - i)], -2.0, None), [*chosen[i], (i, j)]))
            top = max(options, key=lambda o: o[0])
            best.append(top[0])
            chosen.append(top[1])
        assert sorted(got.get(user, [])) == [(block[i] * 60, (block[j - 1] + 1) * 60, sum(n[i:j])) for i, j in chosen[-1]]
