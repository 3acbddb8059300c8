"""Bindings: graphs, orientations, spectral and segmentation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import bloom
from tessera.operators import graph as op
from tessera.operators import spectral

from .registry import days, micros, query, table

CHAINS = """WITH g AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) <= 150 THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 s AS (SELECT o_custkey, o_orderkey, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM g)"""


def _chains(spark, sf):
    """An edge between two orders of a customer that follow each other within 150 days."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    pairs = o.withColumns({"before": F.lag("o_orderkey").over(w), "gap": days("o_orderdate") - F.lag(days("o_orderdate")).over(w)})
    return pairs.where("gap <= 150").select(F.col("before").alias("a"), F.col("o_orderkey").alias("b"))


@query("components", f"""{CHAINS} SELECT node, component FROM (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, s) AS component, count(*) OVER (PARTITION BY o_custkey, s) AS n FROM s) WHERE n > 1""")
def components(spark, sf):
    return op.components(_chains(spark, sf), "a", "b")


@query("components_whole", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 997 AS a, 1000000 + l_partkey AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 w(node, label) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM s GROUP BY a UNION (SELECT s.b, min(v.label) FROM w v JOIN s ON s.a = v.node JOIN recurring.w u ON u.node = s.b WHERE v.label < u.label GROUP BY s.b)) SELECT node, label AS component FROM w""")
def components_whole(spark, sf):
    edges = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 997).alias("a"), (F.col("l_partkey") + 1000000).alias("b"))
    return op.components(edges, "a", "b")


@query("signed_components", """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b, s_nationkey % 2 AS f FROM supplier WHERE s_suppkey <> s_suppkey // 2),
 w(node, side) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT e.a, CAST((w.side + e.f) % 2 AS BIGINT) FROM w JOIN e ON e.b = w.node) SELECT node, CAST(0 AS BIGINT) AS component, side FROM w""")
def signed_components(spark, sf):
    # Numbers halved down to 0 make one tree over all suppliers.
    s = table(spark, sf, "supplier")
    edges = s.select("s_suppkey", F.floor(F.col("s_suppkey") / 2).alias("b"), (F.col("s_nationkey") % 2).alias("f")).where("s_suppkey <> b")
    return op.signed_components(edges, "s_suppkey", "b", "f")


@query("orientation_enum", """WITH b AS (SELECT l_orderkey, l_linenumber, round(sum(l_quantity - 25), 2) AS w FROM lineitem GROUP BY 1, 2), l AS (SELECT l_orderkey, list(w ORDER BY l_linenumber) AS w FROM b GROUP BY 1),
 m AS (SELECT l_orderkey, w, unnest(range(CAST(2 ** (len(w) - 1) AS BIGINT))) AS mask FROM l),
 s AS (SELECT l_orderkey, mask, round(coalesce(list_sum([w[i] * w[i + 1] * (CASE WHEN i > 1 AND (mask >> (i - 2)) & 1 = 1 THEN -1 ELSE 1 END) * (CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -1 ELSE 1 END) FOR i IN range(1, len(w))]), 0), 4) AS score FROM m),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, mask) AS rn FROM s) SELECT l_orderkey, mask, CAST(score AS DOUBLE) AS score FROM r WHERE rn = 1""")
def orientation_enum(spark, sf):
    # The SQL enumerates every mask of every order; an order has few lines.
    b = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(F.col("l_quantity") - 25), 2).alias("w"))
    best = op.orientations(b, "l_orderkey", "l_linenumber", "w")
    return best.select("l_orderkey", F.coalesce(F.conv("mask", 2, 10).cast("bigint"), F.lit(0).cast("bigint")).alias("mask"), "score")


@query("orientation_whole", """WITH RECURSIVE n AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, round(o_totalprice / 10000 - 15) AS w FROM orders),
 f(k, i, n, w, us, um, ds, dm) AS (SELECT k, i, n, w, CAST(0 AS DOUBLE), '', CAST('-inf' AS DOUBLE), '' FROM n WHERE i = 1 UNION ALL
 SELECT x.k, x.i, x.n, x.w, greatest(us + f.w * x.w, ds - f.w * x.w), CASE WHEN us + f.w * x.w > ds - f.w * x.w OR (us + f.w * x.w = ds - f.w * x.w AND um <= dm) THEN '0' || um ELSE '0' || dm END,
 greatest(us - f.w * x.w, ds + f.w * x.w), CASE WHEN us - f.w * x.w > ds + f.w * x.w OR (us - f.w * x.w = ds + f.w * x.w AND um <= dm) THEN '1' || um ELSE '1' || dm END FROM f JOIN n x ON x.k = f.k AND x.i = f.i + 1)
 SELECT k AS o_custkey, CASE WHEN us > ds OR (us = ds AND um <= dm) THEN um ELSE dm END AS mask, greatest(us, ds) AS score FROM f WHERE i = n""")
def orientation_whole(spark, sf):
    blocks = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 10000 - 15).alias("w"))
    return op.orientations(blocks, "o_custkey", "o_orderkey", "w")


@query("fiedler_halves")
def fiedler_halves(spark, sf):
    # A graph of at most 25 nations for each quarter: windows of bounded size, many groups.
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("quarter"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    trade = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("quarter", "a", "b").agg(F.sum("l_quantity").alias("w"))
    return op.fiedler_sides(trade, "quarter", "a", "b", "w")


def _trade(spark, sf):
    """Edges between nations for each quarter: what was sold with one status, and with the other."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("quarter"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("a"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    trade = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return trade.where("a <> b").groupBy("quarter", "a", "b").agg(of("R").alias("same"), of("A").alias("other"))


@query("recursive_bisection")
def recursive_bisection(spark, sf):
    # A graph of at most 25 nations for each quarter; eigenvectors are no SQL, the tests recurse plainly.
    found = spectral.recursive_bisection(_trade(spark, sf), ["quarter"], "a", "b", "same", "other")
    return found.withColumn("quality", F.round("quality", 4))


@query("link_solver", """WITH RECURSIVE m AS (SELECT s_suppkey AS node, s_suppkey // 4 AS k, s_suppkey % 4 AS i, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey % 2 END AS side FROM supplier),
 f AS (SELECT min(k) AS lo FROM m), l AS (SELECT a.k AS k, b.k AS up, sum(CASE WHEN (s.s_nationkey // 2 % 2 + a.side + b.side) % 2 = 1 THEN -(2 ** a.i) ELSE 2 ** a.i END) AS w FROM m a JOIN supplier s ON s.s_suppkey = a.node JOIN m b ON b.k = a.k // 2 AND b.i = a.i AND b.k < a.k GROUP BY 1, 2),
 t(k, root, turn) AS (SELECT DISTINCT k, k, 0 FROM m WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT l.k, t.root, CASE WHEN l.w < 0 THEN 1 - t.turn ELSE t.turn END FROM t JOIN l ON l.up = t.k)
 SELECT m.node, r.first AS block, CAST((m.side + t.turn) % 2 AS BIGINT) AS side FROM m JOIN t USING (k) JOIN (SELECT k, min(node) AS first FROM m GROUP BY 1) r ON r.k = t.root""")
def link_solver(spark, sf):
    # Four suppliers are a block; each supplier is linked to one of the block of half the number, so the blocks hang on a tree. Weights are powers of two: no tie.
    s = table(spark, sf, "supplier").select(F.lit("all").alias("g"), F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 4).alias("k"), (F.col("s_suppkey") % 4).alias("i"), F.col("s_nationkey").alias("n"))
    s = s.withColumn("side", F.when(F.col("i") == 0, 0).otherwise(F.col("n") % 2))
    members = s.withColumn("block", F.min("node").over(Window.partitionBy("k"))).select("g", "node", "block", "side")
    up = s.select("g", F.col("node").alias("b"), F.col("k").alias("__up"), "i")
    links = s.withColumn("__up", F.floor(F.col("k") / 2)).where("__up < k").join(up, ["g", "__up", "i"]).select("g", F.col("node").alias("a"), "b", (F.floor(F.col("n") / 2) % 2).alias("flip"), F.pow(F.lit(2.0), F.col("i")).alias("weight"))
    return spectral.link_blocks(members, links, "g").select("node", "block", "side")


@query("cbs_segments")
def cbs_segments(spark, sf):
    hours = table(spark, sf, "events").groupBy("event_type", (micros("ts") / 3_600_000_000).cast("bigint").alias("h")).agg(F.sum("value").alias("v"))
    return op.segments(hours, "event_type", "h", "v").withColumn("median", F.round("median", 4))


@query("bloom_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def bloom_semi(spark, sf):
    right = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return bloom.semi_join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), right, "l_partkey")
