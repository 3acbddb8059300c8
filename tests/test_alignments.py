"""Hand-checkable cases of alignment, phasing and test operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence as fn
from tessera.functions import statistics
from tessera.operators import alignments, phasing


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exact_test_and_densities(spark):
    p = lambda *t: value(spark, statistics.fisher_exact(*map(F.lit, t)))
    assert p(3, 1, 1, 3) == pytest.approx(34 / 70) and p(5, 0, 0, 5) == pytest.approx(2 / 252) and p(0, 0, 4, 4) == 1 and p(400, 350, 380, 370) == pytest.approx(0.3266, abs=2e-3)
    rows = spark.createDataFrame([(x,) for x in (0.1, 1.0, 2.5, 30.0, 1e6)], "x double").select("x", statistics.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-10) for r in rows)
    total = spark.range(21).agg(F.sum(statistics.beta_binomial(F.lit(20), F.col("id"), 1.5, 4.0)).alias("s")).first()["s"]
    assert total == pytest.approx(1)


def test_overlaps_keep_repeated_rows_and_null_keys(spark):
    rows = spark.createDataFrame([("a", 0, 10, 1), ("a", 0, 10, 1), ("a", 10, 20, 2), ("b", 5, 300, 3), (None, 0, 9, 4), ("c", 0, 9, 5)], "k string, s long, e long, n int")
    spans = spark.createDataFrame([("a", 9, 10), ("a", 2, 9), ("b", 299, 400), ("b", 0, 5), (None, 0, 9)], "k string, s long, e long")
    kept = lambda how: sorted(r["n"] for r in alignments.overlapping(rows, spans, ["k"], "s", "e", 8, how).collect())
    assert kept("left_semi") == [1, 1, 3] and kept("left_anti") == [2, 4, 5]
    states = {r["state"]: r["n"] for r in alignments.overlap_states(rows, spans, ["k"], "s", "e", 8).collect()}
    assert states == {"absent": 2, "overlap": 3, "apart": 1}


def test_conversions(spark):
    rows = spark.createDataFrame([("r", 16 | 64, "c", 10, 60, "2S3M1I2D4M", "AACGTTTTTG", "ABCDEFGHIJ", 3, {"OQ": "JJJJJJJJJJ", "X": "1"}), ("u", 4, "*", 0, 0, "*", "AC", "II", 0, {})], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, nm int, tags map<string,string>")
    bed = alignments.to_bed(rows).collect()
    assert [(r["start"], r["end"], r["strand"], r["divergence"]) for r in bed] == [(10, 19, "-", 0.3)]
    assert sorted((r["name"], r["seq"], r["qual"]) for r in alignments.to_reads(rows).collect()) == [("r/1", "CAAAAACGTT", "JIHGFEDCBA"), ("u", "AC", "II")]
    back = {r["qname"]: (r["qual"], r["tags"]) for r in alignments.revert(rows).collect()}
    assert back == {"r": ("JJJJJJJJJJ", {"X": "1"}), "u": ("II", {})}
    keep = lambda **p: sorted(r["qname"] for r in rows.where(alignments.named_filter(p)).collect())
    assert keep(isMapped="true") == ["r"] and keep(tag="X:1", mapQuality=">50") == ["r"] and keep(queryBases="AC*", isReverseStrand="false") == ["u"] and keep(name="!r") == ["u"]


def test_lift(spark):
    ops = fn.cigar_ops(F.lit("2S3M1I2D4M5N2M1S"))
    places = [value(spark, alignments.lift(F.lit(i), ops, F.lit(100))) for i in range(14)]
    assert places == [None, None, 100, 101, 102, None, 105, 106, 107, 108, 114, 115, None, None]


def test_insertions_and_contigs(spark):
    calls = spark.createDataFrame([("c", 5, "AC", 200.0, ["AC" + "G" * 60, "T" * 60 + "AC", "AC" + "G" * 20, "ACG" * 20 + "AC"], [60, 60, 60, 40]), ("c", 6, "A", 50.0, ["A" + "C" * 60], [60])], "chrom string, pos long, ref string, qual double, alts array<string>, lens array<int>")
    assert sorted((r["pos"], r["seq"]) for r in alignments.called_insertions(calls).collect()) == [(5, "T" * 60), (7, "C" + "G" * 60)]
    rows = spark.createDataFrame([("x", 1, 90, 10, 40), ("x", 2, 80, 80, 99), ("y", 1, 90, 90, 40), ("z", 1, 90, None, 20)], "c string, i int, a int, b int, o int")
    assert [r["c"] for r in alignments.select_contigs(rows, "c", "i", "a", "b", "o", 30).collect()] == ["x"]
    assert sorted((r["s"], r["e"]) for r in alignments.fuzzy_distinct(spark.createDataFrame([("k", 10, 20), ("k", 12, 23), ("k", 14, 26), ("k", 16, 31)], "k string, s long, e long"), "k", "s", "e", 5).collect()) == [(10, 20), (14, 26)]


def test_phasings(spark):
    a = spark.createDataFrame([(i, 1 + 10 * (i // 4), i % 2) for i in range(8)], "site int, block int, hap int")
    b = spark.createDataFrame([(i, 5, 1 - i % 2 if i < 4 else i % 2) for i in range(2, 8)], "site int, block int, hap int")
    votes = {(r["a"], r["b"]): (r["shared"], r["same"], r["flip"]) for r in phasing.block_votes(a, b, "site", "block", "hap").collect()}
    assert votes == {(1, 5): (2, 0, True), (11, 5): (4, 4, False)}
    sides = {r["node"]: (r["component"], r["side"]) for r in phasing.merge_phasings(a, b, "site", "block", "hap").collect()}
    assert sides == {1: (1, 0), 5: (1, 1), 11: (1, 1)}
    assert list(phasing.merge_partners([(0, 5, True), (3, 9, True), (4, 6, True), (7, 8, False), (7, 9, True)])) == [(0, 9, 2), (4, 6, 1), (7, 8, 1), (7, 9, 1)]
    events = phasing.recombinations(spark.createDataFrame([("b", i, t, 1.0) for i, t in enumerate([0, 3, 3, 2, 2, 1])], "b string, p int, t int, c double"), "b", "p", "t", "c").collect()
    assert sorted((r["before"], r["after"], r["father_before"], r["father_after"], r["mother_before"], r["mother_after"]) for r in events) == [(2, 3, 1, 0, 1, 1), (4, 5, 0, 1, 1, 0)]
