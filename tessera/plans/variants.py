"""Bindings: variants, alignments, fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import variants as op

from .registry import days, micros, query, table


@query("structural_filter", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('R', 'A') AND abs(l_extendedprice - 30000) >= 20000 AND l_linenumber IN (1, 2)""")
def structural_filter(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    kind = F.when(F.col("l_returnflag") == "R", "DEL").when(F.col("l_returnflag") == "A", "INS").otherwise("DUP")
    gt = F.when(F.col("l_linenumber") == 1, "0/1").when(F.col("l_linenumber") == 2, "1/1").otherwise("0/0")
    keep = op.structural(F.when(F.col("l_linestatus") == "O", "PASS").otherwise("LowQual"), kind, F.col("l_extendedprice") - 30000, gt, 20000)
    return l.where(keep).select("l_orderkey", "l_linenumber")


@query("distance_eval", """WITH t AS (SELECT user_id, epoch_us(ts) AS p FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, epoch_us(ts) AS p FROM events WHERE event_type = 'click'),
 a AS (SELECT count(*) AS t, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = t.user_id AND abs(c.p - t.p) <= 7200000000)) AS fn FROM t), b AS (SELECT count(*) AS c, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = c.user_id AND abs(c.p - t.p) <= 7200000000)) AS fp FROM c)
 SELECT t - fn AS tp, fn, fp, round(100 * fn / t, 4) AS fnr, round(100 * fp / c, 4) AS fdr FROM a, b""")
def distance_eval(spark, sf):
    v = table(spark, sf, "events").select("user_id", "event_type", micros("ts").alias("p"))
    return op.evaluate(v.where("event_type = 'purchase'"), v.where("event_type = 'click'"), ["user_id"], "p", 7_200_000_000)


@query("distance_eval_strata", """WITH t AS (SELECT user_id, epoch_us(ts) AS p, value < 60 AS c FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, epoch_us(ts) AS p, value < 60 AS c FROM events WHERE event_type = 'click'),
 a AS (SELECT count(*) AS t, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = t.user_id AND abs(c.p - t.p) <= 7200000000)) AS fn FROM t WHERE t.c), b AS (SELECT count(*) AS c, count(*) FILTER (NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = c.user_id AND abs(c.p - t.p) <= 7200000000)) AS fp FROM c WHERE c.c)
 SELECT t - fn AS tp, fn, fp, round(100 * fn / t, 4) AS fnr, round(100 * fp / c, 4) AS fdr FROM a, b""")
def distance_eval_strata(spark, sf):
    # Only one stratum is counted; all rows still serve as matches.
    v = table(spark, sf, "events").select("user_id", "event_type", micros("ts").alias("p"), "value")
    return op.evaluate(v.where("event_type = 'purchase'"), v.where("event_type = 'click'"), ["user_id"], "p", 7_200_000_000, F.col("value") < 60)


@query("genotype_likelihoods", """WITH p AS (SELECT p_partkey, CAST(p_size * 3 % 50 AS DOUBLE) AS a, CAST(p_size * 7 % 41 AS DOUBLE) + 30 AS b, CAST(p_size * 11 % 47 AS DOUBLE) AS c FROM part)
 SELECT p_partkey, CASE WHEN a <= b AND a <= c THEN '0/0' WHEN b <= c THEN '0/1' ELSE '1/1' END AS gt, list_sort([a, b, c])[2] - list_sort([a, b, c])[1] AS gq FROM p""")
def genotype_likelihoods(spark, sf):
    pl = F.array(F.col("p_size") * 3 % 50, F.col("p_size") * 7 % 41, F.col("p_size") * 11 % 47)
    return table(spark, sf, "part").select("p_partkey", op.genotype_from_likelihoods(pl).alias("g")).select("p_partkey", "g.*")


@query("allele_intervals", """SELECT p_partkey, i AS allele, split_part(p_name, ' ', CAST(i AS INT)) AS alt, CAST(p_size + length(p_type) AS BIGINT) AS "end" FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def allele_intervals(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("alts"), F.col("p_size").cast("bigint").alias("start"), F.col("p_type").alias("ref"))
    return op.one_per_allele(p, "alts", "start", "ref").select("p_partkey", F.col("allele").cast("bigint").alias("allele"), "alt", "end")


@query("quality_strata", """WITH b AS (SELECT p_size, count(*) FILTER (p_type = 'SMALL') AS small, count(*) FILTER (p_type <> 'SMALL') AS other FROM part GROUP BY 1)
 SELECT p_size, small, other, CAST(sum(small) OVER w AS BIGINT) AS cum_small, CAST(sum(other) OVER w AS BIGINT) AS cum_other FROM b WINDOW w AS (ORDER BY p_size DESC)""")
def quality_strata(spark, sf):
    return op.strata(table(spark, sf, "part"), "p_size", {"small": F.col("p_type") == "SMALL", "other": F.col("p_type") != "SMALL"})


@query("allele_support", "SELECT l_partkey, l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus <> 'F') AS forward, count(*) FILTER (l_linestatus = 'F') AS backward FROM lineitem GROUP BY 1, 2")
def allele_support(spark, sf):
    return op.support(table(spark, sf, "lineitem"), ["l_partkey"], "l_returnflag", F.col("l_linestatus") == "F")


@query("consensus", """WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS rn, CAST(sum(n) OVER (PARTITION BY l_partkey) AS BIGINT) AS depth FROM c)
 SELECT l_partkey, l_returnflag, n, depth FROM r WHERE rn = 1 AND depth >= 20""")
def consensus(spark, sf):
    return op.consensus(table(spark, sf, "lineitem"), ["l_partkey"], "l_returnflag", 20)


@query("informative_fragments", "SELECT l_orderkey, count(DISTINCT l_partkey % 30) AS sites FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey % 30) >= 2")
def informative_fragments(spark, sf):
    return op.informative(table(spark, sf, "lineitem").withColumn("site", F.col("l_partkey") % 30), "l_orderkey", "site")


@query("phase_consistency", """WITH b AS (SELECT l_orderkey, l_suppkey % 3 AS b, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS m FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, round(avg(CASE WHEN greatest(m, 1 - m) >= 0.65 THEN 1.0 ELSE 0.0 END), 6) AS share FROM b GROUP BY 1 HAVING avg(CASE WHEN greatest(m, 1 - m) >= 0.65 THEN 1.0 ELSE 0.0 END) > 0.65""")
def phase_consistency(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("b"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("side"))
    return op.consistent(rows, "l_orderkey", "b", "side").withColumn("share", F.round("share", 6))


@query("mate_pairs", """SELECT l_orderkey, min(l_partkey) FILTER (l_linenumber = 1) AS p1, min(l_partkey) FILTER (l_linenumber = 2) AS p2 FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1 HAVING min(l_partkey) FILTER (l_linenumber = 1) IS NOT NULL AND min(l_partkey) FILTER (l_linenumber = 2) IS NOT NULL""")
def mate_pairs(spark, sf):
    m = op.mates(table(spark, sf, "lineitem").where("l_linenumber <= 2"), "l_orderkey", F.col("l_linenumber") == 1, ["l_partkey"])
    return m.select("l_orderkey", F.col("r1.l_partkey").alias("p1"), F.col("r2.l_partkey").alias("p2"))


@query("interval_membership", """WITH x AS (SELECT o_custkey % 50 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, o_orderkey % 9 + 1 AS n, o_orderstatus = 'O' AS o FROM orders WHERE o_orderstatus IN ('O', 'F')),
 v AS (SELECT k, s AS p, CASE WHEN o THEN 1 ELSE 0 END AS a, CASE WHEN o THEN 0 ELSE 1 END AS b FROM x UNION ALL SELECT k, s + n, CASE WHEN o THEN -1 ELSE 0 END, CASE WHEN o THEN 0 ELSE -1 END FROM x), g AS (SELECT k, p, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1, 2),
 q AS (SELECT k, p AS start, lead(p) OVER w AS "end", CASE WHEN sum(a) OVER w > 0 THEN '1' ELSE '0' END || CASE WHEN sum(b) OVER w > 0 THEN '1' ELSE '0' END AS pattern FROM g WINDOW w AS (PARTITION BY k ORDER BY p)) SELECT * FROM q WHERE "end" IS NOT NULL AND pattern <> '00'""")
def interval_membership(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), s.alias("s"), (s + F.col("o_orderkey") % 9 + 1).alias("e"), "o_orderstatus")
    return op.membership({t: x.where(F.col("o_orderstatus") == t).drop("o_orderstatus") for t in "OF"}, "k", "s", "e")


@query("homopolymer_runs", """WITH c AS (SELECT p_partkey, [CASE WHEN i > 1 AND p_name[CAST(i AS INT)] = p_name[CAST(i AS INT) - 1] AND p_name[CAST(i AS INT)] <> ' ' AND NOT (i > 2 AND p_name[CAST(i AS INT) - 2] = p_name[CAST(i AS INT)]) THEN 1 ELSE 0 END FOR i IN range(1, length(p_name) + 1)] AS begins FROM part)
 SELECT p_partkey, CAST(coalesce(list_sum(begins), 0) AS BIGINT) AS runs FROM c""")
def homopolymer_runs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(op.homopolymers(F.col("p_name"), 2)).cast("bigint").alias("runs"))


@query("region_growth", """WITH RECURSIVE x AS (SELECT o_custkey % 20 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 3 AS BIGINT) AS e FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e) AS i FROM x),
 w AS (SELECT k, i, s AS rs, e AS re, e - s AS bases, CAST(1 AS BIGINT) AS g FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, CASE WHEN w.bases > 40 AND n.s - w.re > 1 THEN n.s ELSE w.rs END, CASE WHEN w.bases > 40 AND n.s - w.re > 1 THEN n.e ELSE greatest(w.re, n.e) END,
 CASE WHEN w.bases > 40 AND n.s - w.re > 1 THEN n.e - n.s ELSE w.bases + n.e - n.s END, CASE WHEN w.bases > 40 AND n.s - w.re > 1 THEN w.g + 1 ELSE w.g END FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1)
 SELECT k, min(rs) AS s, max(re) AS e, CAST(max(bases) AS BIGINT) AS bases FROM w GROUP BY k, g""")
def region_growth(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("k"), s.alias("s"), (s + 1 + F.col("o_orderkey") % 3).alias("e"))
    return op.grown_regions(x, "k", "s", "e", 40, 1)


@query("overlap_best", """WITH RECURSIVE x AS (SELECT o_custkey % 500 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS BIGINT) AS e, o_totalprice AS q FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, q) AS i FROM x),
 w AS (SELECT k, i, s, e, q, CAST(1 AS BIGINT) AS g FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, CASE WHEN n.s >= w.e OR n.q > w.q THEN n.s ELSE w.s END, CASE WHEN n.s >= w.e OR n.q > w.q THEN n.e ELSE w.e END, CASE WHEN n.s >= w.e OR n.q > w.q THEN n.q ELSE w.q END,
 CASE WHEN n.s >= w.e THEN w.g + 1 ELSE w.g END FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1)
 SELECT k, s, e, q FROM (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY i DESC) AS r FROM w) WHERE r = 1""")
def overlap_best(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("k"), s.alias("s"), (s + 1 + F.col("o_orderkey") % 30).alias("e"), "o_totalprice")
    return op.keep_best_of_overlaps(x, "k", "s", "e", "o_totalprice")


@query("clip_breakpoints", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT l_orderkey, l_linenumber, 'S' AS op, CAST(100 AS BIGINT) AS "at", 50 - q AS length FROM c WHERE 50 - q >= 40 UNION ALL SELECT l_orderkey, l_linenumber, 'I', 100 + l_linenumber, q FROM c WHERE q >= 40
 UNION ALL SELECT l_orderkey, l_linenumber, 'D', 105 + l_linenumber, q + 3 FROM c WHERE q + 3 >= 40 UNION ALL SELECT l_orderkey, l_linenumber, 'H', 110 + l_linenumber + q, 40 FROM c""")
def clip_breakpoints(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    n = lambda c: c.cast("string")
    cigar = F.concat(n(50 - q), F.lit("S"), n(F.col("l_linenumber")), F.lit("M"), n(q), F.lit("I5M"), n(q + 3), F.lit("D2M39S40H"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cigar.alias("cigar"), F.lit(100).alias("pos"))
    return op.clip_breakpoints(rows, "cigar", "pos", 40).drop("cigar", "pos")


QUALITY = ("abcdefghijklmnopqrstuvwxyz ", "!#%')+-/13579;=?ACEGIK\"$&(*")


@query("quality_trim", f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, translate(p_name, '{QUALITY[0]}', '{QUALITY[1].replace("'", "''")}') AS q FROM part),
 g AS (SELECT k, q, len(q) AS n, [ord(c) - 33 FOR c IN string_split(q, '')] AS v FROM t),
 f AS (SELECT k, q, n, v, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS run, CAST(0 AS BIGINT) AS b, CAST(0 AS DOUBLE) AS best, CAST(0 AS BIGINT) AS s, CAST(8 AS BIGINT) AS e FROM g UNION ALL
 SELECT k, q, n, v, i + 1, CASE WHEN r < 0 THEN 0 ELSE r END, CASE WHEN r < 0 THEN i + 1 ELSE b END, CASE WHEN r > best THEN r ELSE best END, CASE WHEN r > best THEN b ELSE s END, CASE WHEN r > best THEN i + 1 ELSE e END FROM (SELECT *, run + (0.05::DOUBLE - pow(10::DOUBLE, -greatest(v[i + 1], 3) / 10::DOUBLE)) AS r FROM f WHERE i < n)),
 d AS (SELECT *, [list_sum(v[j:j + 7]) FOR j IN range(1, n - 6)] AS sums FROM f WHERE i = n)
 SELECT k AS p_partkey, CASE WHEN n <= 8 THEN 0 WHEN e - s >= 8 THEN s ELSE list_position(sums, list_max(sums)) - 1 END AS start, CASE WHEN n <= 8 THEN n WHEN e - s >= 8 THEN e ELSE list_position(sums, list_max(sums)) + 7 END AS "end" FROM d""")
def quality_trim(spark, sf):
    span = op.best_quality_span(F.translate("p_name", *QUALITY), least=8)
    return table(spark, sf, "part").select("p_partkey", span.alias("t")).select("p_partkey", F.col("t.start").cast("bigint").alias("start"), F.col("t.end").cast("bigint").alias("end"))


CALLS = """SELECT l_linenumber % 4 AS sample, l_suppkey % 10 AS chrom, CAST(l_partkey * 3 AS BIGINT) AS pos, translate(lpad(CAST(max(l_partkey) % 1000 AS VARCHAR), 3, '0'), '0123456789', 'ACGTACGTAC') AS ref, translate(lpad(CAST(max(l_orderkey) % 1000 AS VARCHAR), 3, '0'), '0123456789', 'ACGTACGTAC') AS a1,
 translate(lpad(CAST(min(l_orderkey) % 100 AS VARCHAR), 2, '0'), '0123456789', 'ACGTACGTAC') AS a2, ['0|1', '1|0', '1|1', '1|2', '2|1', '0|2'][CAST(max(l_quantity) AS BIGINT) % 6 + 1] AS g FROM lineitem GROUP BY 1, 2, 3, l_partkey"""


@query("sample_flattening", f"""WITH v AS ({CALLS}), x AS (SELECT sample, chrom, pos AS p, unnest(range(CASE WHEN contains(g, '2') THEN 2 ELSE 3 END)) AS i, ref, a1, a2, g FROM v),
 b AS (SELECT sample, chrom, p, p + i AS pos, g, contains(g, '2') AS two, substr(ref, CAST(i + 1 AS INT), 1) AS r, substr(a1, CAST(i + 1 AS INT), 1) AS a, CASE WHEN contains(g, '2') THEN substr(a2, CAST(i + 1 AS INT), 1) ELSE substr(a1, CAST(i + 1 AS INT), 1) END AS b FROM x),
 d AS (SELECT sample, chrom, p, pos, r, CASE WHEN a = b OR b = r THEN [a] WHEN a = r THEN [b] ELSE [a, b] END AS own, CASE WHEN NOT two THEN g WHEN a = b THEN '1|1' WHEN b = r THEN replace(g, '2', '0') WHEN a = r THEN translate(g, '12', '01') ELSE g END AS g FROM b WHERE a <> r OR b <> r),
 e AS (SELECT chrom, pos, x, min({{'s': sample, 'p': p, 'i': i}}) AS seen FROM (SELECT chrom, pos, sample, p, unnest(own) AS x, generate_subscripts(own, 1) AS i FROM d) GROUP BY 1, 2, 3), s AS (SELECT chrom, pos, list(x ORDER BY seen) AS alls FROM e GROUP BY 1, 2),
 m AS (SELECT *, list_position(alls, own[1]) AS k1, list_position(alls, own[2]) AS k2 FROM (SELECT sample, chrom, pos, arg_max(r, p) AS r, arg_max(own, p) AS own, arg_max(g, p) AS g FROM d GROUP BY 1, 2, 3) JOIN s USING (chrom, pos))
 SELECT sample, chrom, pos, r AS ref, CASE WHEN len(own) = 2 AND k2 < k1 THEN own[2] || ',' || own[1] WHEN len(own) = 1 AND k1 = 2 THEN alls[1] || ',' || alls[2] ELSE array_to_string(own, ',') END AS alt,
  CASE WHEN len(own) = 2 AND k2 < k1 THEN k1 || '|' || k2 WHEN len(own) = 1 AND k1 = 2 THEN replace(g, '1', '2') ELSE g END AS gt FROM m""")
def sample_flattening(spark, sf):
    base = lambda c, n: F.translate(F.lpad((c % 10**n).cast("string"), n, "0"), "0123456789", "ACGTACGTAC")
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("sample"), (F.col("l_suppkey") % 10).alias("chrom"), "l_partkey").agg(F.max("l_orderkey").alias("hi"), F.min("l_orderkey").alias("lo"), F.max("l_quantity").cast("bigint").alias("q"))
    gt = F.element_at(F.array(*map(F.lit, ("0|1", "1|0", "1|1", "1|2", "2|1", "0|2"))), (F.col("q") % 6 + 1).cast("int"))
    calls = rows.select("sample", "chrom", (F.col("l_partkey") * 3).alias("pos"), base(F.col("l_partkey"), 3).alias("ref"), F.array(base(F.col("hi"), 3), base(F.col("lo"), 2)).alias("alts"), gt.alias("gt"))
    return op.flatten_samples(calls, "sample", "chrom", "pos", "ref", "alts", "gt")


@query("called_alleles", """WITH g AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_suppkey % 60 >= 5 GROUP BY 1, 2), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY l_partkey) AS BIGINT) AS depth, CAST(sum(n) OVER (PARTITION BY l_partkey ORDER BY l_returnflag) AS BIGINT) AS e, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag) AS rn FROM g),
 d AS (SELECT *, CAST('0x' || left(md5('7:' || l_partkey), 8) AS BIGINT) % depth AS d FROM r) SELECT l_partkey, l_returnflag, n, depth, 'majority' AS how FROM r WHERE rn = 1 AND depth >= 5 UNION ALL SELECT l_partkey, l_returnflag, n, depth, 'drawn' FROM d WHERE depth >= 5 AND d < e AND d >= e - n""")
def called_alleles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", (F.col("l_suppkey") % 60).alias("mapq"))
    called = lambda seed: op.called_alleles(rows, ["l_partkey"], "l_returnflag", "l_quantity", "mapq", 5, 10, 5, seed)
    return called(None).withColumn("how", F.lit("majority")).unionByName(called(7).withColumn("how", F.lit("drawn")))


@query("variant_chain", """WITH v AS (SELECT p_partkey AS pos, p_brand AS chrom, p_name AS ref, [p_type, p_name || p_type] AS alts, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS qual, p_size AS dp, p_size % 20 AS ad FROM part), x AS (SELECT s_suppkey * 10 AS a, s_suppkey * 10 + 5 AS b FROM supplier)
 SELECT pos FROM v WHERE chrom LIKE 'Brand#1%' AND qual >= 920 AND CASE WHEN pos % 2 = 0 THEN ad ELSE dp END >= 5 AND length(ref) <= 20 AND length(alts[1]) <= 20 AND length(alts[2]) <= 20 AND NOT EXISTS (SELECT 1 FROM x WHERE pos >= a AND pos < b)""")
def variant_chain(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand"), F.lit("c").alias("chrom"), F.col("p_name").alias("ref"), F.array("p_type", F.concat("p_name", "p_type")).alias("alts"), F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice")).alias("qual"), F.col("p_size").alias("dp"), (F.col("p_size") % 20).alias("ad"))
    excluded = table(spark, sf, "supplier").select(F.lit("c").alias("chrom"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 5).alias("end"))
    depth = F.when(F.col("pos") % 2 == 0, F.col("ad")).otherwise(F.col("dp"))
    return op.accepted(v, F.startswith("brand", F.lit("Brand#1")), depth, 920, 5, 20, excluded).select("pos")


@query("site_override", """WITH a AS (SELECT l_orderkey AS k, l_suppkey % 50 AS allele FROM lineitem), r AS (SELECT s_suppkey % 50 AS allele, s_nationkey AS site, substr(s_name, length(s_name), 1) AS base, 1000 + max(s_suppkey) AS o FROM supplier GROUP BY 1, 2, 3),
 c AS (SELECT l_orderkey AS k, l_partkey % 25 AS site, CAST(max(l_linenumber) AS VARCHAR) AS base FROM lineitem GROUP BY 1, 2), h AS (SELECT a.k, a.allele, min({'site': r.site, 'o': r.o}) AS m FROM (SELECT DISTINCT * FROM a) a JOIN r USING (allele) JOIN c ON c.k = a.k AND c.site = r.site AND c.base = r.base GROUP BY 1, 2)
 SELECT a.k, coalesce(h.m['o'], a.allele) AS allele, count(*) AS n FROM a LEFT JOIN h ON h.k = a.k AND h.allele = a.allele GROUP BY 1, 2""")
def site_override(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    s = table(spark, sf, "supplier")
    rules = s.groupBy((F.col("s_suppkey") % 50).alias("allele"), F.col("s_nationkey").cast("bigint").alias("site"), F.right("s_name", F.lit(1)).alias("base")).agg((F.max("s_suppkey") + 1000).alias("to"))
    calls = l.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 25).alias("site"), "l_linenumber").repartition("k").groupBy("k", "site").agg(F.max("l_linenumber").cast("string").alias("base"))
    out = op.override_by_base(l.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 50).alias("allele")), rules, calls, "k", "allele")
    return out.groupBy("k", "allele").agg(F.count("*").alias("n"))
