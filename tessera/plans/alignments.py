"""Bindings: alignments, regions, coordinates, depth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import sequence as fn
from tessera.operators import alignments as op
from tessera.operators import joining, scan

from .registry import days, micros, query, table
from .variants import QUALITY

DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
SPANS = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_custkey % 50 AS k, {DAY} AS s, {DAY} + 1 + o_orderkey % 9 AS e FROM orders"
MEETS = "EXISTS (SELECT 1 FROM x b WHERE b.o_orderstatus = 'P' AND a.k = b.k AND a.s < b.e AND a.e > b.s)"


def _spans(spark, sf):
    s = days("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_custkey") % 50).alias("k"), s.alias("s"), (s + 1 + F.col("o_orderkey") % 9).alias("e"))


@query("region_scan", f"WITH x AS ({SPANS}) SELECT o_orderkey FROM x a WHERE o_orderstatus = 'O' AND {MEETS}")
def region_scan(spark, sf):
    x = _spans(spark, sf)
    return op.overlapping(x.where("o_orderstatus = 'O'"), x.where("o_orderstatus = 'P'"), ["k"], "s", "e", 64).select("o_orderkey")


@query("interval_overlap_states", f"""WITH x AS ({SPANS}), a AS (SELECT o_orderkey, o_custkey % 60 AS k, s, e FROM x WHERE o_orderstatus = 'O'), t AS (SELECT CASE WHEN k NOT IN (SELECT k FROM x WHERE o_orderstatus = 'P') THEN 'absent' WHEN {MEETS} THEN 'overlap' ELSE 'apart' END AS state FROM a)
 SELECT s.state, count(t.state) AS n FROM (SELECT unnest(['absent', 'overlap', 'apart']) AS state) s LEFT JOIN t ON t.state = s.state GROUP BY 1""")
def interval_overlap_states(spark, sf):
    x = _spans(spark, sf)
    return op.overlap_states(x.where("o_orderstatus = 'O'").withColumn("k", F.col("o_custkey") % 60), x.where("o_orderstatus = 'P'"), ["k"], "s", "e", 64)


@query("alignment_view", f"WITH x AS ({SPANS}) SELECT o_orderkey FROM x a WHERE o_orderstatus = 'O' AND NOT {MEETS} AND CAST('0x' || left(md5('0:Customer#' || o_custkey), 8) AS BIGINT) < 0.5 * 4294967296")
def alignment_view(spark, sf):
    x = _spans(spark, sf)
    return op.overlapping(x.where("o_orderstatus = 'O'").where(op.sampled(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")), 0.5)), x.where("o_orderstatus = 'P'"), ["k"], "s", "e", 64, "left_anti").select("o_orderkey")


FLAG = "(l_orderkey * 7 + l_linenumber * 37) % 4096"
CIGAR = "CAST(l_linenumber AS VARCHAR) || 'S' || CAST(l_quantity AS BIGINT) || 'M2I' || l_linenumber || 'D5M'"


def _alignments(spark, sf):
    n = lambda c: F.col(c).cast("bigint").cast("string")
    cigar = F.concat(n("l_linenumber"), F.lit("S"), n("l_quantity"), F.lit("M2I"), n("l_linenumber"), F.lit("D5M"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("qname"), F.expr(FLAG).cast("bigint").alias("flag"), (F.col("l_suppkey") % 20).alias("rname"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("bigint").alias("mapq"), cigar.alias("cigar"),
        F.col("l_linenumber").alias("nm"), "l_extendedprice", "l_returnflag", "l_linestatus",
    )


@query("alignment_bed", f"""SELECT l_suppkey % 20 AS chrom, l_partkey AS start, l_partkey + CAST(l_quantity AS BIGINT) + l_linenumber + 5 AS "end", l_orderkey AS name, CAST(l_quantity AS BIGINT) AS score, CASE WHEN ({FLAG}) & 16 = 16 THEN '-' ELSE '+' END AS strand,
 round(l_linenumber / (CAST(l_quantity AS BIGINT) + 2 + l_linenumber + 5), 6) AS divergence FROM lineitem WHERE ({FLAG}) & 4 = 0""")
def alignment_bed(spark, sf):
    return op.to_bed(_alignments(spark, sf))


BASES = ("abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACN")
READS = f"""SELECT p_partkey, (p_partkey * 37) % 4096 AS f, translate(p_name, '{BASES[0]}', '{BASES[1]}') AS seq, translate(p_name, '{QUALITY[0]}', '{QUALITY[1].replace("'", "''")}') AS qual, p_brand, p_size FROM part"""


def _reads(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("qname"), ((F.col("p_partkey") * 37) % 4096).alias("flag"), F.translate("p_name", *BASES).alias("seq"), F.translate("p_name", *QUALITY).alias("qual"), F.col("p_brand").alias("rname"), F.col("p_size").alias("pos"))


@query("alignment_reads", f"""WITH r AS ({READS}) SELECT CASE WHEN (f >> 6) & 3 > 0 THEN p_partkey || '/' || ((f >> 6) & 3) ELSE CAST(p_partkey AS VARCHAR) END AS name,
 CASE WHEN f & 16 = 16 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN f & 16 = 16 THEN reverse(qual) ELSE qual END AS qual FROM r WHERE f & 2304 = 0""")
def alignment_reads(spark, sf):
    return op.to_reads(_reads(spark, sf))


@query("alignment_sam", f"""WITH r AS ({READS}) SELECT concat_ws(chr(9), p_partkey, f, p_brand, p_size + 1, 60, length(seq) || 'M', '*', 0, 0, seq, qual) AS line FROM r""")
def alignment_sam(spark, sf):
    return op.to_sam(_reads(spark, sf).withColumns({"mapq": F.lit(60), "cigar": F.concat(F.length("seq").cast("string"), F.lit("M"))}))


@query("alignment_revert", """SELECT event_id, CAST(event_id % 4096 & ~1024 AS BIGINT) AS flag, CASE WHEN event_id % 3 = 0 THEN 'Q' || event_id ELSE event_type END AS qual, 1 AS tags FROM events""")
def alignment_revert(spark, sf):
    one = F.create_map(F.lit("XX"), F.lit("1"))
    tags = F.when(F.col("event_id") % 3 == 0, F.map_concat(one, F.create_map(F.lit("OQ"), F.concat(F.lit("Q"), F.col("event_id").cast("string"))))).otherwise(one)
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4096).alias("flag"), F.col("event_type").alias("qual"), tags.alias("tags"))
    return op.revert(rows).select("event_id", "flag", "qual", F.size("tags").alias("tags"))


@query("flag_stats", f"""WITH r AS (SELECT ({FLAG}) AS f, l_extendedprice AS x FROM lineitem) SELECT count(*) AS total, count(*) FILTER (f & 4 = 0) AS mapped, count(*) FILTER (f & 16 = 16) AS reverse, count(*) FILTER (f & 512 = 512) AS failed, count(*) FILTER (f & 1024 = 1024) AS duplicates,
 count(*) FILTER (f & 1 = 1) AS paired, count(*) FILTER (f & 3 = 3) AS proper, count(*) FILTER (f & 1 = 1 AND f & 12 = 0) AS both_mapped, count(*) FILTER (f & 65 = 65) AS first, count(*) FILTER (f & 129 = 129) AS second, count(*) FILTER (f & 9 = 9 AND f & 4 = 0) AS singletons,
 round(avg(x) FILTER (f & 67 = 67 AND f & 12 = 0), 4) AS insert_mean, quantile_cont(x, 0.5) FILTER (f & 67 = 67 AND f & 12 = 0) AS insert_median FROM r""")
def flag_stats(spark, sf):
    return op.flag_counts(_alignments(spark, sf), "flag", F.col("l_extendedprice"))


@query("split_by_property", f"""WITH r AS (SELECT ({FLAG}) AS f, l_suppkey % 20 AS r, l_returnflag AS t FROM lineitem) SELECT 'mapped' AS property, CASE WHEN f & 4 = 4 THEN 'UNMAPPED' ELSE 'MAPPED' END AS value, count(*) AS n FROM r GROUP BY 2
 UNION ALL SELECT 'paired', CASE WHEN f & 1 = 1 THEN 'PAIRED_END' ELSE 'SINGLE_END' END, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'reference', CAST(r AS VARCHAR), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM r GROUP BY 2""")
def split_by_property(spark, sf):
    return op.split_values(_alignments(spark, sf), "flag", "rname", F.col("l_returnflag"))


@query("clip_candidates", f"""WITH r AS ({READS}), c AS (SELECT p_partkey, length(seq) AS n, p_size % 3 AS mapq, substr(qual, 1, p_size % 12) AS q FROM r)
 SELECT p_partkey FROM c WHERE length(q) > 0 AND length(q) / n >= 0.2 AND list_sum([CASE WHEN ord(x) - 33 >= 20 THEN 1 ELSE 0 END FOR x IN string_split(q, '')]) / length(q) >= 0.6 AND mapq >= 1""")
def clip_candidates(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.length("p_name").alias("n"), (F.col("p_size") % 3).alias("mapq"), F.substr(F.translate("p_name", *QUALITY), F.lit(1), F.col("p_size") % 12).alias("q"))
    return op.clip_candidates(rows, F.col("q"), F.col("n"), F.col("mapq"), share=0.6).select("p_partkey")


@query("mapping_errors", """WITH s AS (SELECT l_partkey, count(*) FILTER (l_quantity >= 20) AS n, count(*) FILTER (l_quantity >= 20 AND l_returnflag = 'R') AS d FROM lineitem GROUP BY 1)
 SELECT CAST(l_quantity AS BIGINT) AS quality, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem JOIN s USING (l_partkey) WHERE NOT (s.n >= 3 AND d / s.n > 0.35) GROUP BY 1""")
def mapping_errors(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("quality"), "l_returnflag")
    return op.mapping_errors(rows, ["l_partkey"], "quality", F.col("l_returnflag") == "R")


@query("contig_selection", """WITH r AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS i, CAST(l_quantity AS BIGINT) % 5 AS score, l_linenumber % 4 AS other, l_partkey % 60 AS o FROM lineitem), m AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS m FROM r)
 SELECT l_orderkey FROM m WHERE score = m GROUP BY 1 HAVING arg_min(o, i) >= 30 AND NOT bool_or(score = other)""")
def contig_selection(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * F.lit(10000000).cast("bigint") + F.col("l_partkey")).alias("i"), (F.col("l_quantity").cast("bigint") % 5).alias("score"), (F.col("l_linenumber") % 4).alias("other"), (F.col("l_partkey") % 60).alias("o"))
    return op.select_contigs(rows, "l_orderkey", "i", "score", "other", "o", 30)


@query("split_breaks", """WITH a AS (SELECT l_orderkey, l_linenumber * 40 AS qs, l_linenumber * 40 + CAST(max(l_quantity) AS BIGINT) AS qe, max(l_suppkey) % 3 AS t, CASE WHEN max(l_linestatus) = 'O' THEN '+' ELSE '-' END AS st, max(l_partkey) AS s, max(l_partkey) + CAST(max(l_quantity) AS BIGINT) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber),
 b AS (SELECT *, lag(t) OVER w AS bt, lag(st) OVER w AS bst, lag(s) OVER w AS bs, lag(e) OVER w AS be, lag(qe) OVER w AS bq FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY qs)),
 c AS (SELECT l_orderkey, qs - bq AS query_gap, CASE WHEN st = '+' THEN s - be ELSE bs - e END AS g, t, bt, st, bst FROM b WHERE bt IS NOT NULL), d AS (SELECT *, CASE WHEN t <> bt THEN 'X' WHEN st <> bst THEN 'V' WHEN g >= query_gap THEN 'D' ELSE 'I' END AS kind FROM c)
 SELECT l_orderkey, kind, query_gap, CASE WHEN kind IN ('D', 'I') THEN abs(g - query_gap) END AS size FROM d""")
def split_breaks(spark, sf):
    q = F.max("l_quantity").cast("bigint")
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_suppkey") % 3).alias("t"), F.when(F.max("l_linestatus") == "O", "+").otherwise("-").alias("st"), F.max("l_partkey").alias("s"), (F.max("l_partkey") + q).alias("e"), q.alias("q"))
    a = a.withColumn("qs", (F.col("l_linenumber") * 40).cast("bigint")).withColumn("qe", F.col("qs") + F.col("q"))
    return op.split_breaks(a, "l_orderkey", "qs", {"target": "t", "strand": "st", "start": "s", "end": "e", "query_end": "qe"})


@query("cigar_lift", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_partkey % 70 AS o, l_linenumber AS l, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN o < l THEN NULL WHEN o < l + q THEN p + o - l WHEN o < l + q + 2 THEN NULL WHEN o < l + q + 7 THEN p + o - 2 ELSE NULL END AS "at" FROM r""")
def cigar_lift(spark, sf):
    rows = _alignments(spark, sf).select(F.col("qname").alias("l_orderkey"), F.col("nm").alias("l_linenumber"), "pos", fn.cigar_ops(F.col("cigar")).alias("ops"))
    return rows.select("l_orderkey", "l_linenumber", op.lift(F.col("pos") % 70, F.col("ops"), F.col("pos")).alias("at"))


@query("fuzzy_dedupe", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e) AS i FROM (SELECT o_custkey % 100 AS k, {DAY} AS s, {DAY} + o_orderkey % 9 AS e FROM orders)),
 w AS (SELECT k, i, s, e, [{{'s': s, 'e': e}}] AS kept, true AS keep FROM n WHERE i = 1 UNION ALL
 SELECT k, i, s, e, CASE WHEN hit THEN old ELSE list_append(old, {{'s': s, 'e': e}}) END, NOT hit FROM (SELECT n.k, n.i, n.s, n.e, list_filter(w.kept, lambda x: n.s - x.s <= 5) AS old, len(list_filter(w.kept, lambda x: n.s - x.s <= 5 AND abs(n.e - x.e) <= 5)) > 0 AS hit FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1))
 SELECT k, s, e FROM w WHERE keep""")
def fuzzy_dedupe(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), s.alias("s"), (s + F.col("o_orderkey") % 9).alias("e"))
    return op.fuzzy_distinct(x, "k", "s", "e", 5)


@query("depth_bins", """WITH RECURSIVE h AS (SELECT event_type AS k, epoch_us(ts) // 21600000000 AS tt, count(*) AS d FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tt) AS i FROM h),
 w AS (SELECT k, i, tt, CAST(floor(d * 0.5 + 0.499) AS BIGINT) AS lo, CAST(floor(d * 1.5 + 0.499) AS BIGINT) AS hi, d, CAST(1 AS BIGINT) AS g FROM n WHERE i = 1 UNION ALL
 SELECT k, i, tt, CASE WHEN same THEN lo ELSE CAST(floor(d * 0.5 + 0.499) AS BIGINT) END, CASE WHEN same THEN hi ELSE CAST(floor(d * 1.5 + 0.499) AS BIGINT) END, d, CASE WHEN same THEN g ELSE g + 1 END FROM (SELECT n.k, n.i, n.tt, n.d, w.lo, w.hi, w.g, n.tt = w.tt + 1 AND n.d BETWEEN w.lo AND w.hi AS same FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1))
 SELECT k AS event_type, min(tt) AS start, max(tt) + 1 AS "end", CAST(sum(d) AS BIGINT) AS total FROM w GROUP BY k, g""")
def depth_bins(spark, sf):
    h = table(spark, sf, "events").groupBy("event_type", F.floor(micros("ts") / 21_600_000_000).alias("at")).agg(F.count("*").alias("d"))
    schema = StructType([h.schema["event_type"], *(StructField(c, LongType()) for c in ("start", "end", "total"))])
    return scan.scan_keys(h, ["event_type"], ["at"], ["at", "d"], scan.depth_runs(0.5), schema)


@query("hit_filter", """SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS differences, sum(l_quantity) AS aligned FROM lineitem WHERE l_quantity >= 25 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1""")
def hit_filter(spark, sf):
    listed = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return op.long_hits(table(spark, sf, "lineitem"), "l_partkey", "l_linenumber", "l_quantity", 25, listed)


@query("breakpoint_rules", """WITH r AS (SELECT p_partkey % 4 AS k, p_partkey AS a, p_partkey + p_size AS b FROM part WHERE p_type = 'SMALL') SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = l_suppkey % 4 AND l_partkey >= a AND l_partkey < b)""")
def breakpoint_rules(spark, sf):
    rules = table(spark, sf, "part").where("p_type = 'SMALL'").select((F.col("p_partkey") % 4).alias("k"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size")).alias("b"))
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 4).alias("k"))
    return joining.range_join(points, rules, ["k"], "l_partkey", "a", "b", 64, "left_anti").select("l_orderkey", "l_linenumber")


@query("zero_depth_share", "SELECT l_suppkey, round(avg(CASE WHEN l_quantity < 3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def zero_depth_share(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_quantity") < 3, 1.0).otherwise(0.0)), 6).alias("share"))


@query("named_properties", f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (({FLAG}) & 4 = 0 AND ({FLAG}) & 16 = 16 AND l_quantity >= 20 AND l_suppkey % 20 <> 3) OR (l_linestatus LIKE 'O%' AND ({FLAG}) & 1024 = 0 AND l_partkey < 50)""")
def named_properties(spark, sf):
    rows = _alignments(spark, sf).withColumns({"tags": F.create_map(F.lit("LS"), F.col("l_linestatus")), "l_linenumber": F.col("nm")})
    keep = op.named_filter({"isMapped": "true", "isReverseStrand": "true", "mapQuality": ">=20", "reference": "!3"}) | op.named_filter({"tag": "LS:O*", "isDuplicate": "false", "position": "<50"})
    return rows.where(keep).select(F.col("qname").alias("l_orderkey"), "l_linenumber")


@query("cycle_qualities", f"""WITH r AS ({READS}), c AS (SELECT i - 1 AS cycle, seq[CAST(i AS INT)] AS b, ord(qual[CAST(i AS INT)]) - 33 AS q FROM (SELECT seq, qual, unnest(range(1, length(seq) + 1)) AS i FROM r))
 SELECT cycle, count(*) AS n, round(avg(q), 4) AS mean, count(*) FILTER (q >= 20) AS high, count(*) FILTER (b IN ('G', 'C')) AS gc FROM c GROUP BY 1""")
def cycle_qualities(spark, sf):
    return op.cycle_qualities(_reads(spark, sf), "seq", "qual")


@query("called_insertions", """WITH c AS (SELECT p_partkey AS pos, p_brand AS chrom, left(p_name, 2) AS ref, p_retailprice AS qual, unnest([{'alt': left(p_name, 2) || p_type || p_name, 'len': p_size * 3}, {'alt': p_name || p_type || left(p_name, 2), 'len': p_size * 2}, {'alt': p_type, 'len': 99}]) AS x FROM part),
 l AS (SELECT chrom, pos, ref, x['alt'] AS alt FROM c WHERE qual >= 905 AND x['len'] >= 50 AND length(x['alt']) >= 15)
 SELECT chrom, pos + length(ref) AS pos, substr(alt, length(ref)) AS seq FROM l WHERE left(alt, 2) = ref UNION ALL SELECT chrom, pos, left(alt, length(alt) - length(ref)) FROM l WHERE right(alt, 2) = ref""")
def called_insertions(spark, sf):
    ref = F.left(F.col("p_name"), F.lit(2))
    calls = table(spark, sf, "part").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), ref.alias("ref"), F.array(F.concat(ref, "p_type", "p_name"), F.concat("p_name", "p_type", ref), F.col("p_type")).alias("alts"), F.array(F.col("p_size") * 3, F.col("p_size") * 2, F.lit(99)).alias("lens"), F.col("p_retailprice").alias("qual"))
    return op.called_insertions(calls, longest_ref=15, quality=905)


HIT = """SELECT l_orderkey AS read, l_linenumber AS ln, max(l_suppkey) AS ctg, max(l_partkey) AS start, CAST(max(l_quantity) AS BIGINT) AS q, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2"""


@query("hit_regroup", f"""WITH h0 AS ({HIT}), h AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY ln) - 1 AS hit, start + q + ln + 5 AS "end", CAST(floor(q + 5 - 5 * (greatest(s % 20, ln + 2) - ln - 2) - 12 - (ln + 2) + 0.499) AS BIGINT) AS score FROM h0),
 c AS (SELECT s_suppkey AS name, -1 - s_nationkey % 3 AS target, s_suppkey * 7 AS pos, s_nationkey % 2 = 1 AS rev, 1 + s_nationkey % 7 AS a, 50 + s_suppkey AS m FROM supplier WHERE s_acctbal > 4000),
 o AS (SELECT h.read, h.hit, c.*, CASE WHEN rev THEN a + 2 * m + 3 + 9000 - "end" ELSE start END AS lo, CASE WHEN rev THEN a + 2 * m + 3 + 9000 - start ELSE "end" END - 1 AS hi FROM h JOIN c ON c.name = h.ctg WHERE start < CASE WHEN rev THEN 0 ELSE a END + 2 * m + 3 + 9000 AND "end" > CASE WHEN rev THEN 0 ELSE a END),
 y AS (SELECT *, CASE WHEN lo < a THEN NULL WHEN lo < a + m THEN lo - a WHEN lo < a + m + 3 THEN m WHEN lo < a + 2 * m + 3 THEN lo - a - 3 WHEN lo < a + 2 * m + 9003 THEN lo - a + 1 END AS s1,
  CASE WHEN hi < a THEN NULL WHEN hi < a + m THEN hi - a WHEN hi < a + m + 3 THEN m WHEN hi < a + 2 * m + 3 THEN hi - a - 3 WHEN hi < a + 2 * m + 9003 THEN hi - a + 1 END AS e1 FROM o),
 l AS (SELECT read, hit, target, pos + s1 AS s, pos + e1 + 1 AS e FROM y WHERE s1 IS NOT NULL AND e1 IS NOT NULL),
 p AS (SELECT h.read, h.hit, h.ctg, h.q % 61 AS mapq, h.score, coalesce(l.target, h.ctg) AS pctg, coalesce(l.s, h.start) AS pstart, coalesce(l.e, h."end") AS pend, h.ctg IN (SELECT name FROM c) AS alt FROM h LEFT JOIN l USING (read, hit)),
 g AS (SELECT *, CASE WHEN pstart < max(pend) OVER (PARTITION BY read, pctg ORDER BY pstart, hit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY read ORDER BY pctg, pstart, hit) - 1 AS BIGINT) AS grp FROM g),
 b AS (SELECT read, grp, max(score) AS top, count(*) AS n, bool_or(alt) AS alt, bool_or(hit = 0) AS own, max(mapq) FILTER (hit = 0) AS kept, bool_or(alt) FILTER (hit = 0) AS kalt FROM i GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY top DESC, grp) AS rk, lead(top) OVER (PARTITION BY read ORDER BY top DESC, grp) AS next, bool_or(alt) OVER (PARTITION BY read) AS any_alt FROM b),
 f AS (SELECT read, grp, CASE WHEN any_alt AND n > 1 THEN CASE WHEN kalt THEN greatest(fresh, kept) ELSE least(fresh, kept) END ELSE kept END AS q FROM (SELECT *, CASE WHEN rk > 1 THEN 0 WHEN next IS NULL THEN 60 ELSE least(60, 6 * (top - next)) END AS fresh FROM t WHERE own))
 SELECT i.read, i.hit, i.ctg, i.pctg, i.pstart, i.pend, i.score, i.grp, i.grp = f.grp AS reported, CAST(CASE WHEN i.grp = f.grp THEN f.q ELSE i.mapq END AS BIGINT) AS mapq FROM i JOIN f USING (read)""")
def hit_regroup(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read"), "l_linenumber").agg(F.max("l_suppkey").alias("ctg"), F.max("l_partkey").alias("start"), F.max("l_quantity").cast("bigint").alias("q"))
    n = lambda c: F.col(c).cast("string")
    cigar = F.concat(n("l_linenumber"), F.lit("S"), n("q"), F.lit("M2I"), n("l_linenumber"), F.lit("D5M"))
    hit = F.row_number().over(Window.partitionBy("read").orderBy("l_linenumber")) - 1
    hits = rows.select("read", hit.alias("hit"), "ctg", "start", cigar.alias("cigar"), (F.col("ctg") % 20).alias("nm"), (F.col("q") % 61).alias("mapq"))
    s = table(spark, sf, "supplier").where("s_acctbal > 4000")
    a, m = (F.lit(1) + F.col("s_nationkey") % 7).cast("string"), (F.lit(50) + F.col("s_suppkey")).cast("string")
    contigs = s.select(F.col("s_suppkey").alias("name"), (F.lit(-1).cast("bigint") - F.col("s_nationkey") % 3).alias("target"), (F.col("s_suppkey") * 7).alias("pos"), (F.col("s_nationkey") % 2 == 1).alias("reverse"), F.concat(a, F.lit("S"), m, F.lit("M3I"), m, F.lit("M4D9000M")).alias("cigar"))
    return op.regroup_hits(hits, contigs)


@query("rule_scripts", f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (NOT (({FLAG}) & 1024 = 1024) AND (l_quantity >= 30 OR l_suppkey % 20 = 3)) OR (l_linestatus LIKE 'O%' AND ({FLAG}) & 16 = 16 AND NOT l_partkey >= 50)""")
def rule_scripts(spark, sf):
    rows = _alignments(spark, sf).withColumns({"tags": F.create_map(F.lit("LS"), F.col("l_linestatus")), "l_linenumber": F.col("nm")})
    script = """{"filters": [{"id": "copy", "isDuplicate": "true"}, {"id": "good", "mapQuality": ">=30"}, {"id": "three", "reference": "3"}, {"id": "open", "tag": "LS:O*", "isReverseStrand": "true"}, {"id": "far", "position": ">=50"}],
     "rule": "!copy & (good | three) | open & !far"}"""
    return rows.where(op.script_filter(script)).select(F.col("qname").alias("l_orderkey"), "l_linenumber")


DNA = f"translate(p_name, '{BASES[0]}', '{BASES[1]}')"


@query("sequence_difference", f"""WITH k AS (SELECT p_partkey, p_size, i - 1 AS tt, substr(q, CAST(i AS INT), 7) AS f FROM (SELECT p_partkey, p_size, {DNA} AS q, unnest(range(1, length(p_name) - 5)) AS i FROM part)), c AS (SELECT *, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS m FROM k),
 n AS (SELECT p_partkey, tt FROM c WHERE p_size % 2 = 0 AND m IN (SELECT m FROM c WHERE p_size % 2 = 0 GROUP BY 1 HAVING count(*) >= 2) AND m NOT IN (SELECT m FROM c WHERE p_size % 2 = 1)),
 g AS (SELECT *, CASE WHEN tt - lag(tt) OVER w <= 7 THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY p_partkey ORDER BY tt)), i AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey ORDER BY tt) AS g FROM g)
 SELECT p_partkey, min(tt) AS start, max(tt) + 7 AS "end", count(*) AS kmers FROM i GROUP BY p_partkey, g""")
def sequence_difference(spark, sf):
    from tessera.operators import sets

    p = table(spark, sf, "part").select("p_partkey", "p_size", F.translate("p_name", *BASES).alias("q"))
    return sets.sequence_difference(p.where("p_size % 2 = 0"), p.where("p_size % 2 = 1"), "p_partkey", "q", 7)


@query("pileup", f"""WITH r AS ({READS}), a AS (SELECT p_partkey, f, p_brand AS chrom, p_size * 3 AS pos, seq, qual, p_size % 3 AS s, 2 + p_size % 4 AS m FROM r WHERE f & 4 = 0), b AS (SELECT *, unnest(range(length(seq))) AS i FROM a),
 c AS (SELECT chrom, CASE WHEN i < s OR (i >= s + m AND i < s + m + 1) THEN NULL WHEN i < s + m THEN pos + i - s ELSE pos + i - s + 1 END AS p, pos AS st, CAST(p_partkey AS VARCHAR) AS name, CASE WHEN f & 16 = 16 THEN lower(seq[i + 1]) ELSE seq[i + 1] END AS x, qual[i + 1] AS q FROM b WHERE ord(qual[i + 1]) - 33 >= 5)
 SELECT chrom, CAST(p AS BIGINT) AS pos, count(*) AS depth, string_agg(x, '' ORDER BY st, name, x, q) AS bases, string_agg(q, '' ORDER BY st, name, x, q) AS quals FROM c WHERE p IS NOT NULL GROUP BY 1, 2""")
def pileup(spark, sf):
    s, m = F.col("pos") % 3, F.lit(2) + F.col("pos") % 4
    n = lambda c: c.cast("string")
    rest = F.length("seq") - s - m - 1
    cigar = F.concat(F.when(s > 0, F.concat(n(s), F.lit("S"))).otherwise(""), n(m), F.lit("M1I2D"), n(rest), F.lit("M"))
    rows = _reads(spark, sf).withColumns({"cigar": cigar, "mapq": F.lit(60)}).withColumn("pos", F.col("pos") * 3)
    return op.pileup(rows, base_quality=5)
