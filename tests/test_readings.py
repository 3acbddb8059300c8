"""Hand-checked cases: pairwise text, regrouped hits, rule scripts, flattened samples, k-mer differences, Bloom filters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignments, bloom, sets, variants
from tessera.sources import pairwise, text

REPORT = """BLASTN 2.2

Query= read
_one
         (1,020 letters)

>chr1 first
          Length = 500

 Score = 50.6 bits (25), Expect = 1e-05
 Identities = 9/10
 Strand = Plus / Plus

Query: 3   ACGT-ACG 9
           |||| |||
Sbjct: 11  ACGTAA-G 17

Query: 10  TT 11
           ||
Sbjct: 18  TT 19

 Score = 20.1 bits (10), Expect = e-10
 Strand = Plus / Minus

Query: 1   AACG 4
           ||||
Sbjct: 90  AACG 87

Query: 5   G 5
           |
Sbjct: 86  G 86

>chr2
          Length = 9
 Score = 9 bits (4), Expect(2) = 0.5
 Strand=Plus/Plus
Query  1   AC  2
Sbjct  5   AC  6

Query= two
>chr1
 Score = 9 bits (4), Expect = 2
 Strand=Plus/Plus
Query  1   A  1
Sbjct  1   A  1
"""


@pytest.mark.parametrize("split", [1 << 20, 64])
def test_pairwise_text_to_alignment_rows(spark, tmp_path, split):
    (tmp_path / "a.txt").write_text(REPORT)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = sorted(tuple(r) for r in pairwise.pairwise_alignments(spark, f"{tmp_path}/a.txt").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("read_one", 0, "chr1", 10, "2H4M1D1M1I3M", "ACGTACGTT", 51, 1e-5), ("read_one", 16, "chr1", 85, "5M", "CCGTT", 20, 1e-10), ("read_one", 0, "chr2", 4, "2M", "AC", 9, 0.5), ("two", 0, "chr1", 0, "1M", "A", 9, 2.0)])


def test_pairwise_rows_become_alignment_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(REPORT)
    rows = pairwise.pairwise_alignments(spark, f"{tmp_path}/a.txt").withColumns({"mapq": F.lit(255), "qual": F.lit(None).cast("string")})
    alignments.to_sam(rows).write.text(f"{tmp_path}/sam")
    back = {(r["qname"], r["pos"], r["cigar"]) for r in text.sam(spark, f"{tmp_path}/sam").collect()}
    assert back == {(r["qname"], r["pos"], r["cigar"]) for r in rows.collect()} and len(back) == 4


def test_hits_on_alternate_contigs(spark):
    hits = [("r", 0, "alt1", 10, "20M", 0, 5), ("r", 1, "chr1", 1008, "20M", 2, 5), ("r", 2, "chr2", 50, "20M", 3, 5), ("s", 0, "chr1", 5, "10M", 0, 40), ("s", 1, "chr1", 8, "10M", 0, 40), ("t", 0, "chr1", 1008, "20M", 0, 50), ("t", 1, "alt1", 10, "20M", 1, 50), ("u", 0, "alt1", 0, "3M", 0, 7), ("v", 0, "alt2", 3, "4M1I4M", 0, 9)]
    contigs = [("alt1", "chr1", 1000, False, "5S50M2D50M"), ("alt2", "chr3", 200, True, "10M5I90M4S")]
    df = spark.createDataFrame(hits, "read string, hit int, ctg string, start long, cigar string, nm int, mapq int")
    out = {(r["read"], r["hit"]): r for r in alignments.regroup_hits(df, spark.createDataFrame(contigs, "name string, target string, pos long, reverse boolean, cigar string")).collect()}
    place = lambda k: (out[k]["pctg"], out[k]["pstart"], out[k]["pend"])
    assert place(("r", 0)) == ("chr1", 1005, 1025) and out["r", 0]["grp"] == out["r", 1]["grp"] != out["r", 2]["grp"]
    # The group's best score is 20, the next group's 20 - 5 * 3 = 5: 6 * 15 is cut to 60, above the 5 of the alternate hit.
    assert [out["r", k]["score"] for k in (0, 1, 2)] == [20, 10, 5] and [out["r", k]["mapq"] for k in (0, 1, 2)] == [60, 60, 5]
    # Without a contig nothing changes; a primary hit's quality is not raised.
    assert out["s", 0]["mapq"] == 40 and out["t", 0]["mapq"] == 50 and out["t", 1]["reported"]
    # A hit in the clip of its contig stays where it is; on the other strand positions count from the end (109 - 11 = 98 to 109 - 3).
    assert place(("u", 0)) == ("alt1", 0, 3)
    assert place(("v", 0)) == ("chr3", 200 + 98 - 5, 200 + 105 - 5 + 1) if out["v", 0]["pctg"] == "chr3" else place(("v", 0)) == ("alt2", 3, 11)
    assert spark.range(1).select(*(alignments.place_under(alignments.cigar_ops(F.lit("5S10M2I3D4M1S")), F.lit(i)).alias(f"p{i}") for i in (4, 5, 14, 15, 16, 17, 20, 21))).first()[:] == (None, 0, 9, 10, 10, 13, 16, None)


def test_rule_scripts(spark):
    df = spark.range(16).select(*(F.col("id").bitwiseAND(F.lit(1 << i)).cast("boolean").alias(c) for i, c in enumerate("abcd")))
    filters = {c: F.col(c) for c in "abcd"}
    for rule, plain in {"a": "a", "!a & b | c": "(not a and b) or c", "!(a|b)&(c|!d)": "(not (a or b)) and (c or not d)", "!!a | b & c | d": "a or (b and c) or d", "": "a or b or c or d"}.items():
        got = {tuple(r) for r in df.where(alignments.rule_script(filters, rule)).collect()}
        assert got == {tuple(r) for r in df.collect() if eval(plain, dict(zip("abcd", r)))}, rule
    for bad in ("a &", "(a", "a b", "x", "a | | b", ")", "!"):
        with pytest.raises(ValueError, match="rule"):
            alignments.rule_script(filters, bad)
    assert spark.range(1).select(F.lit(0).alias("flag")).where(alignments.script_filter('{"isMapped": "true"}')).count() == 1


def test_samples_by_base(spark):
    rows = [("s1", "g", 10, "ACG", ["ATG", "GTC"], "1|2"), ("s2", "g", 11, "C", ["T"], "0|1"), ("s3", "g", 10, "A", ["T"], "1|0"), ("s3", "g", 12, "G", ["T", "C"], "2|1"), ("s4", "g", 20, "A", [], "0|0")]
    df = spark.createDataFrame(rows, "s string, c string, p long, r string, a array<string>, g string")
    got = {(r["s"], r["pos"]): (r["ref"], r["alt"], r["gt"]) for r in variants.flatten_samples(df, "s", "c", "p", "r", "a", "g").collect()}
    # At 10: s1 has G (its second allele; the first is the reference), s3 T; at 12: s1 has C, s3 T and C, numbered by the site.
    assert got == {("s1", 10): ("A", "G", "0|1"), ("s1", 11): ("C", "T", "1|1"), ("s1", 12): ("G", "C", "0|1"), ("s2", 11): ("C", "T", "0|1"), ("s3", 10): ("A", "G,T", "2|0"), ("s3", 12): ("G", "C,T", "2|1")}


def test_kmers_of_one_collection_only(spark):
    first = spark.createDataFrame([(1, "AAACCCTTTG"), (2, "CAAAGGG"), (3, "GGTACC"), (4, "A")], "k int, s string")
    second = spark.createDataFrame([(9, "CCTTTG")], "k int, s string")
    got = sorted(map(tuple, sets.sequence_difference(first, second, "k", "s", 4).collect()))

    def canon(x):
        return min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA")))

    own = {k: [canon(s[i : i + 4]) for i in range(len(s) - 3)] for k, s in ((1, "AAACCCTTTG"), (2, "CAAAGGG"), (3, "GGTACC"))}
    every = [x for v in own.values() for x in v]
    other = {canon("CCTTTG"[i : i + 4]) for i in range(3)}
    want = []
    for k, v in own.items():
        at = [i for i, x in enumerate(v) if every.count(x) > 1 and x not in other]
        while at:
            run = [at.pop(0)]
            while at and at[0] - run[-1] <= 4:
                run.append(at.pop(0))
            want.append((k, run[0], run[-1] + 4, len(run)))
    assert got == sorted(want) and got


def test_bloom_filters_of_measured_size(spark):
    rng = random.Random(1)
    held = spark.createDataFrame([(f"k{rng.randrange(10**9)}",) for _ in range(20_000)], "k string").repartition(9)
    others = spark.range(60_000).select(F.concat(F.lit("x"), "id").alias("k"), F.col("id").alias("n"))
    for share in (0.1, 0.01):
        made = bloom.build(held, "k", share)
        assert made[0].bits == 8 * len(made[1]) and bloom.passing(held, "k", made).count() == 20_000
        assert 0.5 * share < bloom.passing(others, "k", made).count() / 60_000 < 1.5 * share
        assert 0.4 < np.unpackbits(made[1]).mean() < 0.55
    assert bloom.build(held, "k", 0.01, most=1000) is None
    left = held.union(others.select("k")).union(spark.createDataFrame([(None,)], "k string"))
    for most in (1000, bloom.MOST_BYTES):
        assert bloom.semi_join(left, held, "k", most=most).count() == 20_000
    assert bloom.semi_join(left, held.limit(0), "k").count() == 0


def test_flattened_records_are_dealt_once_and_cross_bins(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    calls = [(s, c, p, word(n), [word(n), word(n + 2)], rng.choice(["0|1", "1|0", "1|1", "1|2", "2|1", "0|2"])) for s in range(4) for c in "ab" for p, n in ((-70, 100), (20, 3), (60, 150), (200, 9))]
    df = spark.createDataFrame(calls, "sample int, chrom string, pos long, ref string, alts array<string>, gt string")
    out = variants.flatten_samples(df, "sample", "chrom", "pos", "ref", "alts", "gt")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["sample"], r["chrom"], r["pos"]): (r["ref"], r["alt"], r["gt"]) for r in out.collect()}
    listed, last = {}, {}
    for s, c, p, ref, (one, two), gt in sorted(calls):
        for i, r in enumerate(ref):
            a, b = one[i], two[i] if "2" in gt else one[i]
            if a == b == r:
                continue
            own = [x for x in dict.fromkeys((a, b)) if x != r] if "2" in gt and b != r else [a] if a != r or "2" not in gt else [b]
            g = gt if "2" not in gt else "1|1" if a == b else gt.replace("2", "0") if b == r else gt.translate(str.maketrans("12", "01")) if a == r else gt
            names = listed.setdefault((c, p + i), [])
            names += [x for x in own if x not in names]
            last[s, c, p + i] = (r, own, g)
    for (s, c, at), (r, own, g) in last.items():
        k = [listed[c, at].index(x) + 1 for x in own]
        if len(own) == 2:
            want = (r, ",".join(own), g) if k[0] < k[1] else (r, f"{own[1]},{own[0]}", f"{k[0]}|{k[1]}")
        else:
            want = (r, f"{listed[c, at][0]},{own[0]}", g.replace("1", "2")) if k[0] == 2 else (r, own[0], g)
        assert got.pop((s, c, at)) == want
    assert not got


def test_hits_are_regrouped_without_a_join_of_reads(spark):
    rows = [("r", 0, "p", 100, "50M", 0, 9), ("r", 1, "a", 40, "30M", 0, 5), ("r", 2, "p", 400, "45M", 0, 7), ("t", 0, "p", 10, "20M", 0, 3), ("t", 1, "p", 90, "20M", 0, 4), ("u", 1, "p", 5, "9M", 0, 8)]
    hits = spark.createDataFrame(rows, "read string, hit int, ctg string, start long, cigar string, nm long, mapq long")
    # The second alignment of the contig has the smaller first base, so it lifts; the third is not met.
    contigs = [("a", "q", 900, False, "20S200M"), ("a", "p", 80, False, "5S200M"), ("a", "z", 0, False, "150S70M")]
    out = alignments.regroup_hits(hits, spark.createDataFrame(contigs, "name string, target string, pos long, reverse boolean, cigar string"))
    # Hits once by read; the contigs once by name.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(read") == 1 and plan.count("Join") == 1
    got = {(r["read"], r["hit"]): (r["pctg"], r["pstart"], r["pend"], r["grp"], r["reported"], r["mapq"]) for r in out.collect()}
    # Best scores 50 and 45: 6 * 5, lowered to what the primary hit had; equal groups keep their quality without an alternate hit.
    assert got == {
        ("r", 0): ("p", 100, 150, 0, True, 9), ("r", 1): ("p", 115, 145, 0, True, 9), ("r", 2): ("p", 400, 445, 1, False, 7),
        ("t", 0): ("p", 10, 30, 0, True, 3), ("t", 1): ("p", 90, 110, 1, False, 4), ("u", 1): ("p", 5, 14, 0, None, 8),
    }
