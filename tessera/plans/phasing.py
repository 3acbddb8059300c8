"""Bindings: phase sets, annotations, call sets, tests and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import sequence as fn
from tessera.functions import statistics
from tessera.operators import aggregating, alignments, joining, scan, windowing
from tessera.operators import phasing as op

from .alignments import BASES, DAY
from .registry import days, query, table
from .sequences import NEIGHBOURS, _neighbours


@query("block_votes", """WITH a AS (SELECT o_orderkey, o_custkey % 40 AS a, o_orderkey % 2 = 0 AS x FROM orders), b AS (SELECT o_orderkey, 100 + o_orderkey % 30 AS b, o_totalprice > 200000 AS y FROM orders)
 SELECT a, b, count(*) AS shared, count(*) FILTER (x = y) AS same, count(*) FILTER (x = y) * 2 < count(*) AS flip FROM a JOIN b USING (o_orderkey) GROUP BY 1, 2""")
def block_votes(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", (F.col("o_custkey") % 40).alias("block"), (F.col("o_orderkey") % 2 == 0).alias("hap"))
    b = o.select("o_orderkey", (F.lit(100) + F.col("o_orderkey") % 30).alias("block"), (F.col("o_totalprice") > 200000).alias("hap"))
    return op.block_votes(a, b, "o_orderkey", "block", "hap")


@query("phase_merge", """WITH n AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(floor(o_totalprice) AS BIGINT) % 2 AS x, o_orderkey % 2 AS y FROM orders),
 v AS (SELECT c, 2 * (i // 4) + 1 AS a, 2 * ((i + 2) // 4) AS b, count(*) FILTER (x = y) * 2 < count(*) AS f FROM n GROUP BY 1, 2, 3), e AS (SELECT c, greatest(a, b) AS j, CASE WHEN f THEN 1 ELSE 0 END AS f FROM v UNION ALL SELECT DISTINCT c, 0, 0 FROM n)
 SELECT CAST(c * 1000 + j AS BIGINT) AS node, c * 1000 AS component, CAST(sum(f) OVER (PARTITION BY c ORDER BY j) % 2 AS BIGINT) AS side FROM e""")
def phase_merge(spark, sf):
    # Blocks of four orders of a customer, and such blocks two orders further: each shares sites with the next.
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    n = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", i.alias("i"))
    first = n.select("o_orderkey", (F.col("o_custkey") * 1000 + 2 * F.floor(F.col("i") / 4) + 1).alias("block"), (F.floor("o_totalprice") % 2).alias("hap"))
    second = n.select("o_orderkey", (F.col("o_custkey") * 1000 + 2 * F.floor((F.col("i") + 2) / 4)).alias("block"), (F.col("o_orderkey") % 2).alias("hap"))
    return op.merge_phasings(first, second, "o_orderkey", "block", "hap")


@query("recombination_events", """WITH r AS (SELECT user_id, event_id, event_id * 7 % 4 AS t, value, row_number() OVER w AS i, lag(event_id) OVER w AS p, lag(event_id * 7 % 4) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, p AS before, event_id AS after, b % 2 AS father_before, t % 2 AS father_after, b // 2 AS mother_before, t // 2 AS mother_after, value FROM r WHERE i >= 3 AND b <> t""")
def recombination_events(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 4).alias("t"), "value")
    return op.recombinations(rows, "user_id", "event_id", "t", "value")


@query("fragment_log_odds", """WITH o AS (SELECT l_orderkey, l_partkey % 50 AS s, max(l_linestatus) AS x, max(l_discount) + 0.01 AS p FROM lineitem GROUP BY 1, 2), j AS (SELECT a.s AS a, b.s AS b, a.x = b.x AS eq, (1 - a.p) * (1 - b.p) + a.p * b.p AS r FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.s < b.s)
 SELECT a, b, round(sum(log10(CASE WHEN eq THEN r ELSE 1 - r END)), 4) AS same, round(sum(log10(CASE WHEN eq THEN 1 - r ELSE r END)), 4) AS opposite FROM j GROUP BY 1, 2""")
def fragment_log_odds(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("s"), "l_linestatus", "l_discount")
    out = op.pair_log_odds(rows, "l_orderkey", "s", "l_linestatus", F.col("l_discount") + 0.01)
    return out.select("a", "b", F.round("same", 4).alias("same"), F.round("opposite", 4).alias("opposite"))


@query("flip_penalty", """WITH f AS (SELECT l_orderkey, l_suppkey % 6 AS b, sum(log10(0.05 + l_discount * 9)) AS k, sum(log10(1 - (0.05 + l_discount * 9))) AS t FROM lineitem GROUP BY 1, 2) SELECT b, round(sum(k), 3) AS keep, round(sum(t), 3) AS turn, sum(t) > sum(k) AS flip FROM f GROUP BY 1""")
def flip_penalty(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 6).alias("b"), (F.lit(0.05) + F.col("l_discount") * 9).alias("p"))
    return op.flip_scores(rows, "l_orderkey", "b", "p").select("b", F.round("keep", 3).alias("keep"), F.round("turn", 3).alias("turn"), "flip")


TABLES = """SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS a, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS b, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS c, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS d FROM lineitem GROUP BY 1"""
LP = "CAST(lgamma(a + b + 1) - lgamma({k} + 1) - lgamma(a + b - {k} + 1) + lgamma(c + d + 1) - lgamma(a + c - {k} + 1) - lgamma(c + d - (a + c - {k}) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS DOUBLE)"
FISHER = f"least(1, list_sum([CASE WHEN {LP.format(k='k')} <= {LP.format(k='a')} + 1e-8 THEN exp({LP.format(k='k')}) ELSE 0 END FOR k IN range(greatest(0, a - d), least(a + b, a + c) + 1)]))"


def _tables(spark, sf):
    alt, forward = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    counts = {"a": ~alt & forward, "b": ~alt & ~forward, "c": alt & forward, "d": alt & ~forward}
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[F.count_if(t).alias(n) for n, t in counts.items()])


@query("fisher_strand", f"WITH t AS ({TABLES}) SELECT l_partkey, round({FISHER}, 6) AS p FROM t")
def fisher_strand(spark, sf):
    return _tables(spark, sf).select("l_partkey", F.round(statistics.fisher_exact(*[F.col(c) for c in "abcd"]), 6).alias("p"))


@query("variant_annotation", f"""WITH t AS ({TABLES}), p AS (SELECT *, {FISHER} AS p FROM t) SELECT l_partkey, a + b + c + d AS dp, least(c, d) AS ds, CAST(CASE WHEN a + b + c + d = 0 THEN 0 ELSE floor(100 * (c + d) / (a + b + c + d) + 0.499) END AS BIGINT) AS ab,
 CAST(floor(CASE WHEN p < 1e-10 THEN 0 ELSE -4.343 * ln(p) END + 0.499) AS BIGINT) AS fs FROM p""")
def variant_annotation(spark, sf):
    return op.annotate(_tables(spark, sf), ("a", "b", "c", "d")).drop("a", "b", "c", "d")


BETA = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + {a}) + lgamma(n - k + {b}) - lgamma(n + {a} + {b}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"


@query("beta_binomial_quality", f"""WITH t AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_partkey % p_size AS k FROM part), d AS (SELECT *, {BETA.format(a="1.0::DOUBLE", b="99.0::DOUBLE")} AS x, {BETA.format(a="2.0::DOUBLE", b="4.0::DOUBLE")} AS y FROM t)
 SELECT p_partkey, round(x, 8) AS density, CAST(floor(least(floor(-4.343 * ln(1 - x * 0.9 / (x * 0.9 + y * 0.1)) + 0.499), 40) / 2) AS BIGINT) AS quality FROM d""")
def beta_binomial_quality(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("n"), (F.col("p_partkey") % F.col("p_size")).alias("k"))
    n, k = F.col("n"), F.col("k")
    return t.select("p_partkey", F.round(statistics.beta_binomial(n, k, 1.0, 99.0), 8).alias("density"), statistics.consensus_quality(n, k, (0.01, 1 / 3), (1.0, 2.0), 0.9, 40).cast("bigint").alias("quality"))


@query("two_sample_eval", """WITH x AS (SELECT l_linestatus AS s, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM part WHERE p_size = 7 AND p_partkey % 5 = l_partkey % 5 AND l_partkey < p_partkey + 6 AND l_partkey + 1 > p_partkey)),
 c AS (SELECT unnest([{'class': 'SNP', 'a': count(*) FILTER (s = 'F' AND n <= 3), 'b': count(*) FILTER (s = 'O' AND n <= 3)}, {'class': 'INDEL', 'a': count(*) FILTER (s = 'F' AND n > 3), 'b': count(*) FILTER (s = 'O' AND n > 3)}, {'class': 'INDEL-1bp', 'a': count(*) FILTER (s = 'F' AND n = 4), 'b': count(*) FILTER (s = 'O' AND n = 4)}]) AS v FROM x)
 SELECT v['class'] AS class, v['a'] AS fp, v['b'] - v['a'] AS tp FROM c""")
def two_sample_eval(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_linestatus", "l_linenumber", (F.col("l_partkey") % 5).alias("k"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + 1).alias("e"))
    out = table(spark, sf, "part").where("p_size = 7").select((F.col("p_partkey") % 5).alias("k"), F.col("p_partkey").alias("s"), (F.col("p_partkey") + 6).alias("e"))
    kept = alignments.overlapping(rows, out, ["k"], "s", "e", 64, "left_anti")
    n = F.col("l_linenumber")
    return op.difference_counts(kept.where("l_linestatus = 'F'"), kept.where("l_linestatus = 'O'"), {"SNP": n <= 3, "INDEL": n > 3, "INDEL-1bp": n == 4})


@query("merge_adjacent", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, part) AS i FROM (SELECT o_custkey % 300 AS k, {DAY} AS s, {DAY} + 10 + o_orderkey % 40 AS e, o_orderkey % 2 = 0 AS part FROM orders)),
 w AS (SELECT k, i, s, e, part AS pend, false AS merged, s AS bs, e AS be FROM n WHERE i = 1 UNION ALL
 SELECT n.k, n.i, n.s, n.e, n.part AND NOT (w.pend AND n.part AND n.s < w.e), w.pend AND n.part AND n.s < w.e, w.s, w.e FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1), a AS (SELECT *, lead(merged, 1, false) OVER (PARTITION BY k ORDER BY i) AS gone FROM w)
 SELECT k, CASE WHEN merged THEN bs ELSE s END AS s, CASE WHEN merged THEN greatest(be, e) ELSE e END AS e, CAST(CASE WHEN merged THEN 2 ELSE 1 END AS BIGINT) AS records FROM a WHERE NOT gone""")
def merge_adjacent(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("k"), s.alias("s"), (s + 10 + F.col("o_orderkey") % 40).alias("e"), (F.col("o_orderkey") % 2 == 0).alias("part"))
    schema = StructType([x.schema["k"], *(StructField(c, LongType()) for c in ("s", "e", "records"))])
    return scan.scan_keys(x, ["k"], ["s", "e", "part"], ["s", "e", "part"], op.merge_partners, schema)


@query("truth_groups", """WITH s AS (SELECT l_suppkey % 10 AS gene, l_partkey, l_partkey % 7 AS grp, l_linenumber, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3, 4), a AS (SELECT gene, l_partkey, grp, min(m) AS m FROM s GROUP BY 1, 2, 3), b AS (SELECT *, min(m) OVER (PARTITION BY gene) AS best FROM a),
 v AS (SELECT gene, grp, count(*) AS n, min(l_partkey) AS allele FROM b WHERE m = best GROUP BY 1, 2) SELECT gene, allele AS l_partkey, grp, n FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, allele) AS r FROM v) WHERE r = 1""")
def truth_groups(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("gene"), "l_partkey", (F.col("l_partkey") % 7).alias("grp"), "l_linenumber", "l_quantity")
    return op.best_groups(rows, "gene", "l_partkey", "l_linenumber", "l_quantity", "grp")


@query("primary_options", """WITH c AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT * FROM c WHERE n = (SELECT max(n) FROM c)""")
def primary_options(spark, sf):
    return op.shared_by_most(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("distinct_in_order", """WITH f AS (SELECT user_id, event_type, min(epoch_us(ts)) AS t, min(event_id) AS e FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY t, e) AS kinds FROM f GROUP BY 1""")
def distinct_in_order(spark, sf):
    return aggregating.distinct_in_order(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], ",", "kinds")


@query("n_ratio", "SELECT lang, round(sum(length(text) - length(replace(text, 'n', ''))) / sum(length(text)), 2) AS ratio FROM documents GROUP BY 1")
def n_ratio(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum(F.length("text") - F.length(F.replace("text", F.lit("n"), F.lit("")))) / F.sum(F.length("text")), 2).alias("ratio"))


@query("linkage_share", """WITH o AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), p AS (SELECT a.l_linenumber AS i, a.f = b.f AS same FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
 SELECT i, CASE WHEN count(*) > 4 THEN round(count(*) FILTER (same) / count(*), 6) ELSE 0 END AS same, CASE WHEN count(*) > 4 THEN round(count(*) FILTER (NOT same) / count(*), 6) ELSE 0 END AS opposite FROM p GROUP BY 1""")
def linkage_share(spark, sf):
    shares = joining.neighbour_shares(table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "i"), "l_orderkey", "i", "l_returnflag")
    return shares.select("i", F.round("same", 6).alias("same"), F.round("opposite", 6).alias("opposite"))


@query("first_per_group", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 2")
def first_per_group(spark, sf):
    return windowing.first_rows(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 2).drop("p_retailprice")


@query("exon_concat", """SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, repeat('N', 20) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS seq FROM lineitem GROUP BY 1""")
def exon_concat(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x"))
    return aggregating.text_in_order(rows, "l_orderkey", ["l_linenumber"], "x", "N" * 20, "seq")


@query("parameter_grid", """WITH s AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS x, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, w AS weight, m AS mode, round(CASE WHEN m = 'mean' THEN x * w ELSE n * w END, 4) AS value FROM s, (SELECT unnest([0.2::DOUBLE, 0.5, 0.8]) AS w), (SELECT unnest(['mean', 'count']) AS m)""")
def parameter_grid(spark, sf):
    s = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("x"), F.count("*").alias("n"))
    grid = aggregating.grid(s, weight=[0.2, 0.5, 0.8], mode=["mean", "count"])
    return grid.select("c_nationkey", "c_mktsegment", "weight", "mode", F.round(F.when(F.col("mode") == "mean", F.col("x")).otherwise(F.col("n").cast("double")) * F.col("weight"), 4).alias("value"))


@query("kmer_strands", f"""WITH t AS (SELECT translate(p_name, '{BASES[0]}', '{BASES[1]}') AS q, p_size FROM part), k AS (SELECT substr(q, CAST(i AS INT), 5) AS f, p_size FROM (SELECT q, p_size, unnest(range(1, length(q) - 3)) AS i FROM t))
 SELECT least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n, count(*) FILTER (p_size >= 25) AS high FROM k GROUP BY 1""")
def kmer_strands(spark, sf):
    q = table(spark, sf, "part").select(F.translate("p_name", *BASES).alias("q"), "p_size")
    return aggregating.strand_kmers(q, "q", 5, F.col("p_size") >= 25)


@query("sequence_mask", """SELECT p_partkey, upper(left(p_name, p_size % 5)) || repeat('N', 3) || upper(substr(p_name, p_size % 5 + 4)) AS seq FROM part""")
def sequence_mask(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.masked(F.col("p_name"), F.col("p_size") % 5, 3).alias("seq"))


@query("sequence_merge", f"""WITH p AS ({NEIGHBOURS}) SELECT p_partkey, list_aggregate([CASE WHEN a[CAST(i AS INT)] = b[CAST(i AS INT)] THEN a[CAST(i AS INT)] ELSE 'N' END FOR i IN range(1, least(length(a), length(b)) + 1)], 'string_agg', '') AS seq FROM p WHERE b IS NOT NULL""")
def sequence_merge(spark, sf):
    return _neighbours(spark, sf).select("p_partkey", fn.agreed(F.col("a"), F.col("b")).alias("seq"))


@query("hmm_emissions", "SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS symbol, count(*) AS n FROM events GROUP BY 1, 2")
def hmm_emissions(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.floor(F.col("value") / 25).alias("symbol")).agg(F.count("*").alias("n"))


@query("phase_copy", """WITH p AS (SELECT event_id, user_id, event_id % 2 AS gt, event_id % 100 AS ps FROM events WHERE event_type IN ('click', 'view')) SELECT e.event_id, coalesce(p.gt, -1) AS gt, coalesce(p.ps, 0) AS ps FROM events e LEFT JOIN p ON p.event_id = e.event_id AND p.user_id = e.user_id AND e.value < 50""")
def phase_copy(spark, sf):
    # Genotype and phase set of a phased call set, put onto the original records by position and allele.
    e = table(spark, sf, "events")
    original = e.select("event_id", F.when(F.col("value") < 50, F.col("user_id")).alias("user_id"), F.lit(-1).cast("bigint").alias("gt"), F.lit(0).cast("bigint").alias("ps"))
    phased = e.where("event_type in ('click', 'view')").select("event_id", "user_id", (F.col("event_id") % 2).alias("gt"), (F.col("event_id") % 100).alias("ps"))
    from tessera.operators.joining import overlay

    return overlay(original, phased, ["event_id", "user_id"], ["gt", "ps"]).drop("user_id")


@query("base_classes", f"""WITH t AS (SELECT p_partkey, translate(p_name, '{BASES[0]}', '{BASES[1]}') AS q FROM part) SELECT p_partkey, length(q) - length(replace(q, 'A', '')) AS a, length(q) - length(replace(q, 'C', '')) AS c, length(q) - length(replace(q, 'G', '')) AS g, length(q) - length(replace(q, 'T', '')) AS t,
 length(q) - length(replace(q, 'N', '')) AS ambiguous, (length(q) - length(replace(q, 'CG', ''))) // 2 AS cpg FROM t""")
def base_classes(spark, sf):
    from tessera.operators.aggregating import class_counts

    q = table(spark, sf, "part").select("p_partkey", F.translate("p_name", *BASES).alias("q"))
    counts = class_counts(F.col("q"), {"a": "A", "c": "C", "g": "G", "t": "T", "ambiguous": "RYMKSWBDHVN"})
    return q.select("p_partkey", *counts, F.regexp_count("q", F.lit("CG")).cast("bigint").alias("cpg"))


@query("flip_penalties", """WITH o AS (SELECT l_orderkey AS f, l_suppkey % 6 AS b, l_partkey % 40 AS s, max(l_linestatus) = 'O' AS a FROM lineitem GROUP BY 1, 2, 3), h AS (SELECT f, b, count(*) AS t, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS h FROM o GROUP BY 1, 2 HAVING count(*) > 1),
 x AS (SELECT o.*, t, h, CASE WHEN a THEN 1.0 ELSE -1.0 END AS g FROM o JOIN h USING (f, b)), w AS (SELECT b, s, count(*) AS n, avg(CASE WHEN a THEN 1 - h ELSE h END) AS weight FROM x GROUP BY 1, 2),
 p AS (SELECT i.b, i.s, sum(i.g * j.g / i.t / w.n) AS change FROM x i LEFT JOIN x j ON j.f = i.f AND j.b = i.b AND j.s <> i.s LEFT JOIN w ON w.b = j.b AND w.s = j.s GROUP BY 1, 2) SELECT b, s, n, round(weight, 5) AS weight, round(change, 5) AS change FROM w JOIN p USING (b, s)""")
def flip_penalties(spark, sf):
    o = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("f"), (F.col("l_suppkey") % 6).alias("b"), (F.col("l_partkey") % 40).alias("s")).agg((F.max("l_linestatus") == "O").alias("a"))
    return op.flip_penalties(o, "f", "b", "s", "a").select("b", "s", "n", F.round("weight", 5).alias("weight"), F.round("change", 5).alias("change"))


@query("parent_votes", """WITH v AS (SELECT o_custkey % 100 AS b, o_orderkey % 2 AS c0, o_orderkey // 2 % 2 AS c1, o_orderkey // 4 % 2 AS m0, o_orderkey // 8 % 2 AS m1, o_orderkey // 16 % 2 AS f0, o_orderkey // 32 % 2 AS f1 FROM orders),
 t AS (SELECT b, CASE WHEN f0 = f1 THEN CASE WHEN f0 = c0 THEN 0 ELSE 1 END WHEN m0 = m1 THEN CASE WHEN m0 = c1 THEN 0 ELSE 1 END END AS side FROM v WHERE c0 <> c1 AND ((c0 IN (m0, m1) AND c1 IN (f0, f1)) OR (c1 IN (m0, m1) AND c0 IN (f0, f1))))
 SELECT b, count(*) FILTER (side = 0) AS side0, count(*) FILTER (side = 1) AS side1, count(*) FILTER (side = 1) > count(*) FILTER (side = 0) AS turn FROM t GROUP BY 1""")
def parent_votes(spark, sf):
    bit = lambda i: (F.floor(F.col("o_orderkey") / (1 << i)) % 2)
    v = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("b"), *(bit(i).alias(n) for i, n in enumerate(("c0", "c1", "m0", "m1", "f0", "f1"))))
    return op.parent_votes(v, "b", ("c0", "c1"), ("m0", "m1"), ("f0", "f1"))


@query("sequence_codes", """WITH s AS (SELECT p_partkey, p_size, left(a, least(length(a), length(b))) AS a, left(b, least(length(a), length(b))) AS b FROM (SELECT p_partkey, p_size, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACRYacgtKMN') AS a, translate(reverse(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTAGGTACGTCCGTACRYacgtKSN') AS b FROM part)),
 c AS (SELECT p_partkey, unnest(range(length(a))) AS i, a, b FROM s), d AS (SELECT p_partkey, i, a[i + 1] AS x, b[i + 1] AS y, instr('XACMGRSVTWYHKDBN', upper(a[i + 1])) - 1 AS p, instr('XACMGRSVTWYHKDBN', upper(b[i + 1])) - 1 AS q FROM c),
 e AS (SELECT p_partkey, i, 'XACMGRSVTWYHKDBN'[(p | q) + 1] AS u, 'XACMGRSVTWYHKDBN'[(p & q) + 1] AS n, x <> lower(x) AND y <> lower(y) AS bb, (x <> lower(x) OR y <> lower(y)) AND p & q > 0 AS ab, p < 15 AND q < 15 AS kk FROM d)
 SELECT p_partkey, string_agg(CASE WHEN bb THEN u ELSE lower(u) END, '' ORDER BY i) AS together, string_agg(CASE WHEN ab THEN n ELSE lower(n) END, '' ORDER BY i) AS common, string_agg(CASE WHEN ab AND kk THEN n ELSE lower(n) END, '' ORDER BY i) AS masked FROM e GROUP BY 1""")
def sequence_codes(spark, sf):
    letters = "abcdefghijklmnopqrstuvwxyz "
    s = table(spark, sf, "part").select("p_partkey", F.translate("p_name", letters, "ACGTACGTACGTACGTACRYacgtKMN").alias("a"), F.translate(F.reverse("p_name"), letters, "ACGTAGGTACGTCCGTACRYacgtKSN").alias("b"))
    return s.select("p_partkey", *(fn.merge_bases(F.col("a"), F.col("b"), how).alias(name) for name, how in (("together", "union"), ("common", "intersect"), ("masked", "mask"))))
