"""Hand-checkable cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence as fn
from tessera.operators import aggregating, binning, graph, joining, variants, windowing


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_margin_binning(spark):
    rows = [("r1", "A", 95, 100), ("r1", "A", 95, 100), ("r1", "B", 80, 100), ("r1", "B", 80, 100), ("r2", "A", 95, 100), ("r2", "A", 95, 100), ("r2", "B", 90, 100), ("r2", "B", 90, 100), ("r3", "C", 95, 100), ("r4", "C", 95, 100), ("r4", "C", 95, 100)]
    scores = binning.ends_identity(spark.createDataFrame(rows, "read string, allele string, m int, l int"), "read", "allele", "m", "l")
    got = {r["read"]: r["assigned"] for r in binning.assign_by_margin(scores, "read", "allele", "identity", 0.1).collect()}
    assert got == {"r1": "A", "r2": "REMOVE", "r3": "REMOVE", "r4": "C"}


def test_haplotype_ratio(spark):
    df = spark.createDataFrame([("g", 0.2, 0), ("g", 0.7, 1), ("g", 0.3, 0)], "g string, b double, p int")
    r = aggregating.phase_ratio(df, "g", F.col("b"), F.col("p") == 0).first()
    assert round(r["h1"], 3) == 0.733 and round(r["h2"], 3) == 0.267


def test_depth_mask(spark):
    df = spark.createDataFrame([("c", i, d) for i, d in enumerate([9, 9, 1, 1, 1, 9, 9, 9])], "c string, pos int, depth int")
    assert [(r["start"], r["end"]) for r in windowing.rolling_below(df, "c", "pos", "depth", 2, 5).collect()] == [(2, 5)]


def test_molecules(spark):
    df = spark.createDataFrame([("b", s) for s in (100, 15000, 34000, 60000)], "b string, s long")
    assert sorted((r["first_at"], r["n"]) for r in windowing.sessions(df, "b", "s", 20000).collect()) == [(100, 3), (60000, 1)]


def test_copies(spark):
    a, b = aggregating.allele_copies(F.lit(0.8), F.lit(0.2), F.lit(0.5), F.lit(2.0))
    assert (value(spark, a), value(spark, b)) == (2.0, 0.0)


def test_cigar(spark):
    c = F.lit("5S90M2I3D10M")
    assert value(spark, fn.identity(fn.cigar_ops(c), F.lit(5))) == 0.904762
    assert value(spark, fn.cigar_lengths(c, fn.MATCH)) == 100 and value(spark, fn.cigar_lengths(c, fn.BLOCK)) == 105
    every = F.lit("1H2S3M4I5D6N7P8=9X")
    assert value(spark, fn.cigar_lengths(every, fn.BLOCK)) == 3 + 4 + 5 + 6 + 7 + 8 + 9 and value(spark, fn.cigar_lengths(every, fn.MATCH)) == 3
    assert value(spark, fn.run_lengths(fn.cigar_expand(F.lit("3M1I2M")))) == "3M1I2M"


def test_sequences(spark):
    assert value(spark, fn.reverse_complement(F.lit("AACGTR"))) == "YACGTT"
    assert value(spark, fn.edit_distance(F.lit("AACG"), F.lit("CGTT"))) == 0
    assert tuple(value(spark, fn.trim_variant(F.lit(10), F.lit("CTT"), F.lit("CT")))) == (10, "CT", "C")
    assert tuple(value(spark, fn.trim_variant(F.lit(10), F.lit("AAGT"), F.lit("AACT")))) == (12, "G", "C")
    assert round(value(spark, fn.log_mean(F.lit(0.0), F.lit(0.0))), 9) == 0
    assert round(value(spark, fn.binomial_tail(F.lit(4), F.lit(2), 0.5)), 9) == 11 / 16
    assert round(value(spark, fn.binomial_tail(F.lit(100_000), F.lit(50_000), 0.5)), 3) == 0.501 and value(spark, fn.binomial_tail(F.lit(100_000), F.lit(90_000), 0.5)) < 1e-9
    assert value(spark, fn.binomial_tail(F.lit(50), F.lit(0), 0.1)) == 1 and value(spark, fn.binomial_tail(F.lit(0), F.lit(1), 0.1)) == 0
    assert value(spark, fn.odd_kmer_length(F.lit(3e9))) == 33
    assert value(spark, fn.normal_name(F.lit("HLA-A*01:01"))) == "A_01_01"


def test_nomenclature(spark):
    rows = spark.createDataFrame([("01:01:01:01/01:01:01:02", "01:01:01G"), ("02:01", "")], "m string, g string")
    assert {tuple(r) for r in joining.explode_aliases(rows, "m", "g").collect()} == {("01:01:01:01", "01:01:01G"), ("01:01:01:02", "01:01:01G"), ("02:01", "02:01")}


def test_n50(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([10, 8, 5, 4, 3])], "k string, i int, n int")
    assert aggregating.n50(df, "k", "n").first()["n50"] == 8


def test_mendelian(spark):
    pair = lambda a, b: (F.lit(a), F.lit(b))
    assert not value(spark, joining.mendelian_conflict(pair(0, 1), pair(0, 0), pair(1, 1)))
    assert value(spark, joining.mendelian_conflict(pair(1, 1), pair(0, 0), pair(1, 1)))


def test_property_rules(spark):
    df = spark.createDataFrame([(1, "ax"), (5, "bx"), (9, "by")], "n int, s string")
    keep = lambda *r: [x["n"] for x in df.where(binning.compile_rules({"and": [binning.property_filter(t) for t in r]})).orderBy("n").collect()]
    assert keep("n:>=5") == [5, 9] and keep("n:!5") == [1, 9] and keep("s:b*") == [5, 9] and keep("s:*x", "n:<5") == [1] and keep("s:by") == [9]


def test_components_and_sides(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(30)] + [(50, 51, 0)], "a long, b long, f long")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50}
    sides = {r["node"]: r["side"] for r in graph.signed_components(edges, "a", "b", "f").collect()}
    assert all(sides[i] == i % 2 for i in range(31)) and sides[51] == 0


def test_graphs_of_whole_tables(spark, tmp_path):
    from tessera.plans import registry

    rng = random.Random(2)
    lines = [(1, s) for s in range(20)] + [(p, 20 + rng.randrange(60)) for p in range(2, 30) for _ in range(2)] + [(40, 500)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, s in lines:
        a, b = sorted((find(s), find(1000000 + p)))
        root[b] = a
    got = {r["node"]: r["component"] for r in registry.QUERIES["components_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in list(root)} and got[1000001] == 0

    spark.createDataFrame([(k, k * k % 25) for k in range(1, 60)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    side = {0: 0}
    for k in range(1, 60):
        side[k] = (side[k // 2] + k * k % 25) % 2
    sides = {r["node"]: (r["component"], r["side"]) for r in registry.QUERIES["signed_components"](spark, str(tmp_path)).collect()}
    assert sides == {k: (0, s) for k, s in side.items()}

    spark.createDataFrame([(99999, "AACG"), (100000, "CGTT"), (100001, "CGTA")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["p_partkey"]: r["d"] for r in registry.QUERIES["revcomp_edit"](spark, str(tmp_path)).collect()} == {99999: 0, 100000: 1}


def test_every_position(spark):
    df = spark.createDataFrame([("a1" * 30,), ("é😀e",), ("",), (None,)], "t string")
    got = {r["pos"]: (r["n"], r["v"]) for r in aggregating.per_position(df, "t", {"v": "aeiou"}).collect()}
    assert got == {p: (2 if p < 3 else 1, (p % 2 == 0) + (p == 2)) for p in range(60)}


def test_long_paths(spark):
    n = 200
    path = [(i, i + 1, i % 3 % 2) for i in range(n)] + [(n + 10 + i, n + 11 + i, 1) for i in range(0, 50, 2)]
    shuffled = random.Random(3).sample(range(1000), 61)
    edges = spark.createDataFrame([*path, *((2000 + shuffled[i], 2000 + shuffled[i + 1], 1) for i in range(60))], "a long, b long, f long")
    got = {r["node"]: (r["component"], r["side"]) for r in graph.signed_components(edges, "a", "b", "f").collect()}
    side = 0
    for i in range(n):
        assert got[i] == (0, side)
        side ^= path[i][2]
    least = min(shuffled)
    start = shuffled.index(least)
    assert all(got[2000 + x] == (2000 + least, (i - start) % 2) for i, x in enumerate(shuffled))
    assert {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()} == {k: v[0] for k, v in got.items()}


def test_orientations_of_all_sizes(spark):
    rng = random.Random(4)
    groups = {g: [float(rng.randint(-2, 2)) for _ in range(g % 9 + 1)] for g in range(120)}
    rows = [(g, i, w) for g, own in groups.items() for i, w in enumerate(own)]
    got = {r[0]: (r[1], r[2]) for r in graph.orientations(spark.createDataFrame(rows, "g long, i long, w double"), "g", "i", "w").collect()}
    for g, w in groups.items():
        n, best = len(w) - 1, None
        for mask in range(1 << n):
            sign = [1, *(-1 if mask >> i & 1 else 1 for i in range(n))]
            score = sum(a * b * p * q for a, b, p, q in zip(w, w[1:], sign, sign[1:]))
            if best is None or score > best[1]:
                best = (format(mask, f"0{n}b") if n else "", score)
        assert got[g] == best
    long = spark.createDataFrame([(0, i, -1.0 if i % 2 else 1.0) for i in range(300)], "g long, i long, w double")
    assert tuple(graph.orientations(long, "g", "i", "w").first()) == (0, "".join(str(i % 2) for i in range(299, 0, -1)), 299.0)


def test_ranges_do_not_show(spark):
    """Windows cut into ranges give what one window gives."""
    rng = random.Random(5)
    spans = spark.createDataFrame([(k, s, s + rng.randrange(1, 60)) for k in "ab" for s in [rng.randrange(2000) for _ in range(120)]], "k string, s long, e long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(windowing.merge_intervals(spans, "k", "s", "e"))
    assert all(rows(windowing.merge_ranges(spans, "k", "s", "e", span)) == whole for span in (7, 100, 10**6))
    depths = spark.createDataFrame([("k", i, float(rng.randrange(10))) for i in range(300)], "k string, pos long, d double")
    want = rows(windowing.rolling_mean(depths, "k", "pos", "d", 5))
    assert len(want) == 300 and want[7][3] == sum(r[2] for r in want[2:7]) / 5 and want[2][4] == 2
    assert all(rows(windowing.rolling_mean(depths, "k", "pos", "d", 5, span)) == want for span in (6, 50))
    numbers = sorted(rng.sample(range(5000), 80))
    nexts = windowing.next_row(spark.createDataFrame([(n, str(n)) for n in numbers], "n long, t string"), "n", ["t"], 100)
    assert rows(nexts.where("next_n is not null")) == [(a, str(a), b, str(b)) for a, b in zip(numbers, numbers[1:])] and nexts.count() == 80


def test_scans_go_over_batches(spark):
    from tessera.operators import scan

    rows = [("k" if i % 5 else "j", 3 * i, 3 * i + 4) for i in range(25_000)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    kept = windowing.greedy_apart(df, "k", "s", "e", 7).groupBy("k").count().collect()
    for r in kept:
        last, n = None, 0
        for _, s, _ in (x for x in rows if x[0] == r["k"]):
            if last is None or s - last >= 7:
                last, n = s, n + 1
        assert r["count"] == n
    assert list(scan.depth_runs(0.1)([(0, 10), (1, 11), (2, 9), (3, 20), (5, 20), (6, 23)])) == [(0, 3, 30), (3, 4, 20), (5, 6, 20), (6, 7, 23)]
    assert list(scan.gathered(5)([(0, 8, 7), (9, 10, 1), (20, 21, 1)])) == [(0, 8, 7), (9, 21, 2)]


def test_stream_results_are_files(spark, tmp_path):
    from tessera.plans import registry

    rows = [(k, f"2024-01-01 0{k}:00:00", k % 2) for k in range(8)] + [(8, "2024-01-03 00:00:00", 0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("e").alias("event_type"), F.lit(1.0).alias("value"))
    df.coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "events.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    out = registry.QUERIES["stream_sessions"](spark, str(tmp_path))
    assert out.inputFiles() and {t.name for t in spark.catalog.listTables()} == before
    # The session of the last event is still open.
    assert sorted((r["user_id"], r["n"], r["sessions"]) for r in out.collect()) == [(0, 4, 1), (1, 4, 1)]


def test_fiedler_and_segments(spark):
    block = lambda o: [("g", o + i, o + j, 1.0) for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([*block(0), *block(10), ("g", 0, 10, 0.01)], "g string, a long, b long, w double")
    assert {r["node"]: r["side"] for r in graph.fiedler_sides(edges, "g", "a", "b", "w").collect()} == {i: 0 for i in range(4)} | {10 + i: 1 for i in range(4)}
    rng = random.Random(6)
    series = [rng.gauss(0, 1) + (8 if 60 <= i < 90 else 0) for i in range(160)]
    df = spark.createDataFrame([("k", 10 * i, v) for i, v in enumerate(series)] + [("one", 5, 2.0)], "k string, o long, v double")
    got = sorted((r["k"], r["start"], r["end"], r["n"], r["median"] > 4) for r in graph.segments(df, "k", "o", "v", 5.0).collect())
    assert [x[4] for x in got] == [False, True, False, False] and got[3] == ("one", 5, 5, 1, False)
    assert abs(got[1][1] - 600) <= 20 and abs(got[1][2] - 890) <= 20 and sum(x[3] for x in got[:3]) == 160


def test_best_arc_is_the_best_of_all():
    """Both cuts at once, ranks of ties averaged and the variance corrected for them, the inner arc bounded."""
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(20):
        x = rng.integers(0, 6, rng.integers(2, 30)).astype(float)
        n, most = len(x), int(rng.integers(1, 20))
        ranks = [(2 * (x < v).sum() + (x == v).sum() + 1) / 2 for v in x]
        ties = sum(int((x == v).sum()) ** 3 - int((x == v).sum()) for v in set(x))
        spread = (n + 1 - ties / n / (n - 1)) / 12
        z = lambda i, j: abs(sum(ranks[i:j]) - (j - i) * (n + 1) / 2) / np.sqrt((j - i) * (n - j + i) * spread)  # noqa: B023, E731
        best = max((z(i, j) for j in range(1, n + 1) for i in range(max(0, j - most), j) if j - i < n), default=0.0) if spread > 0 else 0.0
        got, i, j = graph.best_arc(x, most)
        assert got == pytest.approx(best) and (got == 0 or z(i, j) == pytest.approx(best))


def test_variants(spark):
    ref = spark.createDataFrame([("c", "ACGTACGT"), ("d", "AA")], "chrom string, seq string")
    var = spark.createDataFrame([("c", 1, "C", "TTT"), ("c", 4, "AC", "A")], "chrom string, pos long, ref string, alt string")
    assert {r["chrom"]: r["seq"] for r in variants.apply_variants(ref, var, "chrom", "seq").collect()} == {"c": "ATTTGTAGT", "d": "AA"}
    span = lambda q, least: tuple(value(spark, variants.best_quality_span(F.lit(q), least=least)))
    assert span("!!IIII!!II", 3) == (2, 6) and span("!!IIII!!II", 30) == (0, 10)
    # Too short a stretch gives way to the best window; nothing good at all, to the first bases.
    assert span("!!II!!5555!!", 4) == (6, 10) and span("!!!!!!!!", 4) == (0, 4) and span('""""""""""', 4) == (0, 4)
    assert value(spark, variants.homopolymers(F.lit("AAACCGTTTT"), 3)) == [3, 4]
    rows = spark.createDataFrame([("k", 0, 10, 1.0), ("k", 5, 15, 2.0), ("k", 20, 30, 1.0)], "k string, s long, e long, q double")
    assert [(r["s"], r["e"]) for r in variants.keep_best_of_overlaps(rows, "k", "s", "e", "q").collect()] == [(5, 15), (20, 30)]
    clips = variants.clip_breakpoints(spark.createDataFrame([("r", "200S50M160D10M", 1000)], "n string, cigar string, pos int"), "cigar", "pos")
    assert [(r["op"], r["at"], r["length"]) for r in clips.collect()] == [("S", 1000, 200), ("D", 1050, 160)]


def test_overlay_and_levels(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, joining.overlay(base, new, "k", ["v"]).collect())) == [(1, "a"), (2, "x")]
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "n string, p string")
    assert {r["node"]: r["level"] for r in joining.levels(tree, "n", "p").collect()} == {"r": 0, "a": 1, "b": 2}


def test_rolling_mean_wider_than_its_ranges(spark):
    df = spark.createDataFrame([("c", i, float(i * i % 7)) for i in range(100)], "c string, pos long, d double")
    for width in (3, 10, 25, 40):
        got = {r["pos"]: (r["seen"], r["mean"]) for r in windowing.rolling_mean(df, "c", "pos", "d", width, 10).collect()}
        for i in range(100):
            own = [float(j * j % 7) for j in range(max(0, i - width), i)]
            assert got[i][0] == len(own) and (not own or abs(got[i][1] - sum(own) / len(own)) < 1e-9)


def test_exact_percentiles_of_skewed_keys(spark):
    import numpy as np

    rng = random.Random(5)
    values = {"a": [rng.gauss(0, 1) for _ in range(3000)], None: [1.0] * 900 + [2.0, 3.0], "one": [4.5], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own] + [("a", None), ("none", None)], "k string, v double").repartition(7)
    got = {r["k"]: r for r in aggregating.exact_percentiles(df, ["k"], "v", {"low": 0.25, "mid": 0.5, "top": 0.999}).collect()}
    assert got.keys() == values.keys()
    for k, own in values.items():
        assert [got[k][c] for c in ("low", "mid", "top")] == pytest.approx(list(np.percentile(own, [25, 50, 99.9])))
    ranks = {(r["k"], r["v"]): r["avg_rank"] for r in windowing.average_rank(df.where("k = 'two' or k is null"), "k", "v").collect()}
    assert ranks == {("two", 1.0): 1, ("two", 2.0): 2, (None, 1.0): 450.5, (None, 2.0): 901, (None, 3.0): 902}


def test_a_long_key_is_many_tasks_work(spark):
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").alias("v"), F.lit(1).alias("w"))
    below = windowing.totals_below(df, ["k"], "v", "w")
    assert below.where("below <> v").count() == 0
    edges = df.groupBy("k").agg(F.percentile_approx("v", [i / windowing.RANGES for i in range(1, windowing.RANGES)], 10 * windowing.RANGES).alias("e")).first()["e"]
    assert len(set(edges)) > 250
    total = windowing.running_total(df.select("k", "v"), ["k"], "v", F.col("v") % 3, span=1000)
    assert total.agg(F.max("total").alias("t")).first()["t"] == sum(i % 3 for i in range(200_000))


def test_names_are_sampled_by_their_share(spark):
    from tessera.operators import alignments

    names = spark.range(20_000).select(F.concat(F.lit("read:"), F.col("id")).alias("name"), (-F.col("id")).alias("n"))
    for column in ("name", "n"):
        for rate in (0.1, 0.5):
            assert abs(names.where(alignments.sampled(F.col(column), rate)).count() / 20_000 - rate) < 0.01
        assert names.where(alignments.sampled(F.col(column), 0.0)).count() == 0 and names.where(alignments.sampled(F.col(column), 1.0)).count() == 20_000
    assert names.where(alignments.sampled(F.col("name"), 0.5) & alignments.sampled(F.col("name"), 0.5, seed=1)).count() < 6000


def test_adjusted_spans(spark):
    df = spark.createDataFrame([("a", 100, 5, 10, 20), ("a", 80, 8, 8, 20), ("a", 10, 1, 2, 20), ("b", 50, 1, 5, 20)], "k string, span long, p long, n long, sites long")
    # 80 (8 phased), 50 (5), 5 (1): more than 10 of 20 sites are held at 50.
    assert [tuple(r) for r in aggregating.an50(df, "k", "span", "p", "n", "sites").collect()] == [("a", 50.0)]


def test_steps_are_deleted(spark):
    from pathlib import Path

    root = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir")) / "tessera"
    before = set(root.glob("step-*")) if root.exists() else set()
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert graph.components(path, "a", "b").where("component <> 0").count() == 0
    assert len(set(root.glob("step-*")) - before) == 1
    sides = graph.signed_components(path.withColumn("f", F.col("a") % 2), "a", "b", "f").count()
    assert sides == 41 and len(set(root.glob("step-*")) - before) == 2


def test_long_spans_go_into_wide_bins(spark):
    rng = random.Random(3)
    spans = [("c", s, s + rng.choice([1, 5, 60, 900, 40_000, 5_000_000])) for s in (rng.randrange(6_000_000) for _ in range(60))] + [("d", 0, 250_000_000), ("d", 5, 5), ("e", 7, 8)]
    points = [(rng.choice("cde"), rng.randrange(6_000_000), i) for i in range(300)] + [("c", spans[0][1], 900), ("c", spans[0][2], 901), ("e", 7, 902), (None, 7, 903)]
    s, p = spark.createDataFrame(spans, "k string, s long, e long"), spark.createDataFrame(points, "k string, at long, i long")
    inside = {(i, k, a, b) for k, at, i in points for j, a, b in spans if j == k and a <= at < b}
    got = joining.range_join(p, s, ["k"], "at", "s", "e", 64).select("i", "k", "s", "e").collect()
    assert sorted(map(tuple, got)) == sorted((i, k, a, b) for k, at, i in points for j, a, b in spans if j == k and a <= at < b)
    hit = {i for i, *_ in inside}
    assert {r["i"] for r in joining.range_join(p, s, ["k"], "at", "s", "e", 64, "left_semi").collect()} == hit
    assert {r["i"] for r in joining.range_join(p, s, ["k"], "at", "s", "e", 64, "left_anti").collect()} == {i for *_, i in points} - hit
    rows = joining.bins("s", "e", joining.span_level("s", "e", 64), 64)
    assert s.where("s < e").select(F.size(rows).alias("n")).agg(F.max("n").alias("n")).first()["n"] <= joining.STEP + 1


def test_overlaps_of_long_and_short_spans(spark):
    from tessera.operators import alignments

    rng = random.Random(4)
    draw = lambda n: [("c", s, s + rng.choice([1, 9, 500, 30_000, 2_000_000]), i) for i, s in enumerate(rng.randrange(3_000_000) for _ in range(n))]
    for a, b in ((draw(80), draw(6)), (draw(5), draw(70)), (draw(9), [])):
        rows, other = (spark.createDataFrame(x, "k string, s long, e long, i long") for x in (a, b))
        want = {i for k, s, e, i in a if any(s < f and e > t for _, t, f, _ in b)}
        kept = lambda how: {r["i"] for r in alignments.overlapping(rows, other, ["k"], "s", "e", 64, how).collect()}  # noqa: B023, E731
        assert kept("left_semi") == want and kept("left_anti") == {x[3] for x in a} - want


def test_flip_penalties_by_turning_every_site(spark):
    from tessera.operators import phasing

    rng = random.Random(6)
    rows = [(f, f % 3, s, rng.random() < 0.7) for f in range(40) for s in rng.sample(range(8), rng.randint(1, 5))]
    got = {(r["b"], r["s"]): (r["n"], r["weight"], r["change"]) for r in phasing.flip_penalties(spark.createDataFrame(rows, "f long, b long, s long, a boolean"), "f", "b", "s", "a").collect()}

    def weights(block, turned=None):
        held = {}
        for f in {r[0] for r in rows if r[1] == block}:
            own = [(s, a != (s == turned)) for g, _, s, a in rows if g == f]
            if len(own) > 1:
                share = sum(a for _, a in own) / len(own)
                for s, a in own:
                    held.setdefault(s, []).append(1 - share if a else share)
        return {s: (len(v), sum(v) / len(v)) for s, v in held.items()}

    want = {}
    for block in range(3):
        base = weights(block)
        for s, (n, w) in base.items():
            turned = weights(block, s)
            want[block, s] = (n, w, sum(turned[o][1] - base[o][1] for o in base if o != s))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_merged_codes_and_flags(spark):
    merge = lambda a, b, how, **k: value(spark, fn.merge_bases(F.lit(a), F.lit(b), how, **k))
    assert merge("ACGTRa", "AGGNYAT", "union") == "ASGNNa" and merge("ACGTRa", "AGGNYA", "intersect") == "AxGTxA" and merge("ACGTRa", "AGGNYA", "mask") == "AxGtxA"
    drawn = merge("AR" * 200, "RR" * 200, "random", draw=F.lit(1))
    assert set(drawn[::2]) == {"A", "R"} and set(drawn[1::2]) == {"A", "G", "R"} and drawn == merge("AR" * 200, "RR" * 200, "random", draw=F.lit(1)) != merge("AR" * 200, "RR" * 200, "random", draw=F.lit(2))
    assert merge("AAC", "AGN", "random", draw=F.lit(1)) == "ARc"
    assert [value(spark, fn.boolean(F.lit(t))) for t in ("Yes", "F", "1", "maybe")] == [True, False, True, None]


def test_pileup_and_mates(spark):
    from tessera.operators import alignments

    rows = spark.createDataFrame([("r1", 0, "c", 10, 60, "1S2M1I2D2M", "NACTGT", "IIIIII", "=", 40, 35), ("r2", 16, "c", 11, 60, "2M", "CG", "I!", "*", None, 0), ("r3", 4, "*", 0, 0, "*", "AC", "II", "*", None, 0), ("r4", 0, "c", 11, 5, "1M", "A", "I", "*", None, 0)], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, rnext string, mate_pos int, insert_size int")
    got = {r["pos"]: (r["depth"], r["bases"]) for r in alignments.pileup(rows, 10, 10).collect()}
    assert got == {10: (1, "A"), 11: (2, "Cc"), 14: (1, "G"), 15: (1, "T")}
    lines = [r["line"].split("\t") for r in alignments.to_sam(rows).collect()]
    assert lines[0][6:9] == ["=", "41", "35"] and lines[1][6:9] == ["*", "0", "0"]


def test_calls_chain_votes_and_overrides(spark):
    from tessera.operators import phasing

    seen = spark.createDataFrame([(1, "A", 30, 30)] * 30 + [(1, "C", 30, 30)] * 10 + [(1, "C", 3, 30)] * 90 + [(2, "G", 30, 30)], "s int, a string, q int, m int")
    called = {r["s"]: (r["a"], r["n"], r["depth"]) for r in variants.called_alleles(seen, ["s"], "a", "q", "m", 2, 10, 10).collect()}
    assert called == {1: ("A", 30, 40)}
    drawn = [variants.called_alleles(seen, ["s"], "a", "q", "m", 2, 10, 10, seed).first()["a"] for seed in range(12)]
    assert set(drawn) == {"A", "C"} and drawn.count("A") > drawn.count("C")
    calls = spark.createDataFrame([("g", 5, "A", ["C"], 30.0, 9), ("g", 50, "A", ["C"], 30.0, 9), ("g", 6, "A", ["C"], None, 9), ("g", 7, "A", ["C" * 9], 30.0, 9), ("h", 5, "A", ["C"], 30.0, 9), ("g", 8, "A", ["C"], 30.0, 0)], "chrom string, pos long, ref string, alts array<string>, qual double, dp int")
    off = spark.createDataFrame([("g", 40, 60)], "chrom string, start long, end long")
    assert [r["pos"] for r in variants.accepted(calls, F.col("chrom") == "g", F.col("dp"), 20, 0, 5, off).collect()] == [5]
    trio = spark.createDataFrame([("b", 0, 1, 0, 1, 0, 0), ("b", 1, 0, 0, 1, 0, 0), ("b", 1, 0, 1, 1, 0, 1), ("b", 1, 0, 0, 0, 0, 0), ("b", 0, 0, 0, 1, 0, 0)], "b string, c0 int, c1 int, m0 int, m1 int, f0 int, f1 int")
    assert tuple(phasing.parent_votes(trio, "b", ("c0", "c1"), ("m0", "m1"), ("f0", "f1")).first()) == ("b", 1, 2, True)
    alleles = spark.createDataFrame([("s", "a1"), ("s", "a2"), ("t", "a1"), ("s", "a1")], "k string, allele string")
    rules = spark.createDataFrame([("a1", 5, "G", "b1"), ("a1", 3, "T", "b2"), ("a2", 5, "C", "b3")], "allele string, site int, base string, to string")
    at = spark.createDataFrame([("s", 5, "G"), ("s", 3, "T"), ("t", 5, "A")], "k string, site int, base string")
    assert sorted(map(tuple, variants.override_by_base(alleles, rules, at, "k", "allele").collect())) == [("s", "a2"), ("s", "b2"), ("s", "b2"), ("t", "a1")]


def test_regions_grow_over_pieces(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", None]), s, s + rng.randint(1, 9)) for s in (rng.randrange(600) for _ in range(200))]
    for size, gap in ((0, 0), (30, 1), (80, 5)):
        want = []
        for key in ("a", None):
            region = None
            for s, e in sorted((s, e) for k, s, e in rows if k == key):
                if region is None or (region[2] > size and s - region[1] > gap):
                    want += [(key, *region)] if region else []
                    region = (s, e, e - s)
                else:
                    region = (region[0], max(region[1], e), region[2] + e - s)
            want.append((key, *region))
        got = variants.grown_regions(spark.createDataFrame(rows, "k string, s long, e long"), "k", "s", "e", size, gap).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_edges_shrink_from_step_to_step(spark, monkeypatch):
    """Many finished pairs beside one path: only what is not finished is looked at again."""
    rows = []

    def counted(df):
        out = settle(df)
        rows.append(out.count())
        return out

    settle = graph.settle
    monkeypatch.setattr(graph, "settle", counted)
    edges = spark.createDataFrame([(1000 + 2 * i, 1001 + 2 * i) for i in range(400)] + [(i, i + 1) for i in range(30)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {1000 + i: 1000 + i // 2 * 2 for i in range(800)}
    # The pairs' rows are written for the edges, the answer and the pointers, but all their nodes not once a round.
    assert sum(n >= 800 for n in rows) <= 2


def test_rules_meet_only_calls_of_their_key(spark):
    alleles = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k long, allele long")
    rules = spark.createDataFrame([(5, 1, "A", 50), (5, 0, "C", 51), (6, 1, "A", 60)], "allele long, site long, base string, to long")
    calls = spark.createDataFrame([(1, 1, "A"), (1, 0, "C"), (2, 1, "C")], "k long, site long, base string")
    out = variants.override_by_base(alleles, rules, calls, "k", "allele")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 51), (1, 60), (2, 5)]
    # Alleles meet all their rules only where the key's calls are known.
    first = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x][-1]
    assert "k#" in first and "allele#" not in first


def test_contradictory_components_get_the_lesser_side(spark):
    # A triangle with one turn, a tail behind it and a sound pair.
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 0), (0, 2, 0), (1, 7, 1), (7, 8, 1), (8, 9, 1), (20, 21, 1)], "a long, b long, f long")
    got = {r["node"]: (r["component"], r["side"]) for r in graph.signed_components(edges, "a", "b", "f").collect()}
    assert got == {i: (0, 0) for i in (0, 1, 2, 7, 8, 9)} | {20: (20, 0), 21: (20, 1)}
