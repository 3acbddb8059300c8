"""Bindings: dense windows, drop-off regions, masked and patched alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregating
from tessera.operators import regions as op

from .registry import micros, query, table

MINUTE = 60_000_000


@query("dense_windows")
def dense_windows(spark, sf):
    # Minutes of a user's events since the first of all; no SQL for the path, the tests compare with one over every block.
    v = table(spark, sf, "events").select("user_id", F.floor(micros("ts") / MINUTE).alias("at"))
    first = v.agg(F.min("at").alias("__first"))  # one row
    at = v.join(F.broadcast(first)).select("user_id", (F.col("at") - F.col("__first")).alias("at"))
    counts = op.block_counts(at, "user_id", "at", 60)
    return op.dense_windows(counts, "user_id", 60, 24 * 14, 48, opened=-2.0).withColumn("density", F.round("density", 6))


@query("xdrop_regions", """WITH RECURSIVE s AS (SELECT p_partkey AS k, [contains('aeiou', c) FOR c IN string_split(p_name, '')] AS h FROM part),
 w(k, i, start, sc, top, e, found) AS (SELECT k, 1, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, [] FROM s UNION ALL
 SELECT k, CASE WHEN stop THEN e + 1 ELSE i + 1 END, CASE WHEN stop THEN 0 ELSE st END, CASE WHEN stop THEN 0 ELSE sc END, CASE WHEN stop THEN 0 ELSE top END, CASE WHEN stop THEN 0 ELSE e END, CASE WHEN stop THEN [{'s': st, 'e': e}] ELSE [] END FROM (
  SELECT *, st > 0 AND (i >= n OR sc <= 0 OR top - sc > 2) AS stop FROM (
   SELECT k, i, n, st, sc, greatest(top, sc) AS top, CASE WHEN sc > top THEN i ELSE e END AS e FROM (
    SELECT w.k, w.i, len(s.h) AS n, CASE WHEN w.start = 0 AND s.h[w.i] THEN w.i ELSE w.start END AS st, CASE WHEN s.h[w.i] THEN w.sc + 2.0 / 3 WHEN w.start > 0 THEN w.sc - 1 ELSE 0 END AS sc, w.top, w.e FROM w JOIN s ON s.k = w.k WHERE w.i <= len(s.h))))),
 r AS (SELECT k, unnest(found) AS x FROM w) SELECT k AS p_partkey, CAST(x['s'] - 1 AS BIGINT) AS start, CAST(x['e'] AS BIGINT) AS "end", CAST(list_sum([CASE WHEN y THEN 1 ELSE 0 END FOR y IN s.h[x['s']:x['e']]]) AS BIGINT) AS hits FROM r JOIN s USING (k) WHERE x['e'] - x['s'] + 1 >= 3""")
def xdrop_regions(spark, sf):
    return op.x_drop_regions(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "aeiou", 0.6, 2.0, 3)


PARTS = """SELECT l_orderkey AS q, l_linenumber AS ln, CAST(l_partkey % 100 AS BIGINT) AS s, CAST(l_partkey % 100 + max(l_quantity) AS BIGINT) AS e, max(l_suppkey) % 3 AS t, max(l_linestatus) AS st, CAST(l_partkey // 10 AS BIGINT) AS ts, CAST(max(l_suppkey) % 60 AS BIGINT) AS mq FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey"""
KEPT = f"""x AS ({PARTS}), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s - e, s, ln, t, st, ts, mq) AS i FROM x),
 w(q, i, kept, keep) AS (SELECT q, i, [{{'s': s, 'e': e}}], true FROM n WHERE i = 1 UNION ALL SELECT q, i, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': s, 'e': e}}) END, NOT hit FROM (
  SELECT n.q, n.i, n.s, n.e, w.kept, len(list_filter(w.kept, lambda y: least(n.e, y.e) - greatest(n.s, y.s) > 0.5 * (n.e - n.s))) > 0 AS hit FROM w JOIN n ON n.q = w.q AND n.i = w.i + 1)),
 k AS (SELECT n.* FROM w JOIN n USING (q, i) WHERE keep)"""


def _kept(spark, sf):
    q = F.max("l_quantity").cast("bigint")
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg((F.max("l_suppkey") % 3).alias("t"), F.max("l_linestatus").alias("st"), q.alias("n"), (F.max("l_suppkey") % 60).alias("mq"))
    x = parts.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") % 100).alias("s"), (F.col("l_partkey") % 100 + F.col("n")).alias("e"), "t", "st", F.floor(F.col("l_partkey") / 10).alias("ts"), "mq")
    return op.mask_alignments(x, "q", "s", "e", ["ln", "t", "st", "ts", "mq"])


@query("masked_alignments", f"WITH RECURSIVE {KEPT} SELECT q, ln, s, e FROM k")
def masked_alignments(spark, sf):
    return _kept(spark, sf).select("q", "ln", "s", "e")


@query("aligned_n50", f"WITH RECURSIVE {KEPT}, r AS (SELECT st, e - s AS n, sum(e - s) OVER (PARTITION BY st ORDER BY s - e) AS run, sum(e - s) OVER (PARTITION BY st) AS a FROM k) SELECT st, CAST(max(n) AS BIGINT) AS n50 FROM r WHERE run * 2 > a GROUP BY 1")
def aligned_n50(spark, sf):
    return aggregating.n50(_kept(spark, sf).select("st", (F.col("e") - F.col("s")).alias("n")), "st", "n")


@query("patched_breaks", f"""WITH RECURSIVE {KEPT}, o AS (SELECT *, ts + (e - s) AS te, row_number() OVER (PARTITION BY q ORDER BY t, ts, s) AS j FROM k),
 g AS (SELECT *, CASE WHEN t = lag(t) OVER v AND st = lag(st) OVER v AND abs(ts - lag(te) OVER v) < 50 AND abs(s - lag(e) OVER v) < 50 THEN 0 ELSE 1 END AS new FROM o WINDOW v AS (PARTITION BY q ORDER BY j)), i AS (SELECT *, sum(new) OVER (PARTITION BY q ORDER BY j) AS g FROM g),
 p AS (SELECT q, arg_max(e, j) - arg_min(s, j) AS n, arg_max(mq, j) AS mq FROM i GROUP BY q, g), c AS (SELECT q, count(*) AS a, count(*) FILTER (mq >= 10 AND n >= 0) AS b, count(*) FILTER (mq >= 10 AND n >= 100) AS c, count(*) FILTER (mq >= 10 AND n >= 200) AS d, count(*) FILTER (mq >= 10 AND n >= 500) AS e FROM p GROUP BY 1)
 SELECT CAST(sum(greatest(a - 1, 0)) AS BIGINT) AS "all", CAST(sum(greatest(b - 1, 0)) AS BIGINT) AS from_0, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS from_100, CAST(sum(greatest(d - 1, 0)) AS BIGINT) AS from_200, CAST(sum(greatest(e - 1, 0)) AS BIGINT) AS from_500 FROM c""")
def patched_breaks(spark, sf):
    rows = _kept(spark, sf).withColumn("te", F.col("ts") + F.col("e") - F.col("s"))
    joined = op.patch_alignments(rows, "q", "t", "st", ("ts", "te"), ("s", "e"), 50, "mq")
    return op.break_counts(joined, "q", F.col("e") - F.col("s"), "mq")
