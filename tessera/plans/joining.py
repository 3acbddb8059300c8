"""Bindings: joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import joining as op
from tessera.operators import aggregating, sets

from .registry import days, micros, query, table


@query("broadcast_dim_freq", """WITH f AS (SELECT c_nationkey, round(avg(c_acctbal), 4) AS freq FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
 SELECT r_name, c_mktsegment, count(*) AS n, round(sum(coalesce(freq, 0.0)), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 LEFT JOIN f USING (c_nationkey) WHERE coalesce(freq, 0.0) > 0 GROUP BY 1, 2""")
def broadcast_dim_freq(spark, sf):
    c = table(spark, sf, "customer")
    freq = c.where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("freq"))
    rows = op.lookup(c, freq, "c_nationkey", "freq", 0.0).where("freq > 0")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = rows.join(n, rows.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return named.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("freq"), 2).alias("total"))


@query("cascading_lookup", """WITH d AS (SELECT p_type || '|' || p_brand AS k, count(*) AS v FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part WHERE p_size > 48 GROUP BY 1)
 SELECT p_partkey, coalesce(a.v, b.v, CAST(p_partkey AS BIGINT)) AS found FROM part LEFT JOIN d a ON a.k = p_type || '|' || p_brand LEFT JOIN d b ON b.k = p_type""")
def cascading_lookup(spark, sf):
    p = table(spark, sf, "part")
    exact = p.where("p_size > 25").groupBy(F.concat_ws("|", "p_type", "p_brand").alias("k")).agg(F.count("*").alias("v"))
    dim = exact.union(p.where("p_size > 48").groupBy(F.col("p_type").alias("k")).agg(F.count("*").alias("v")))
    return op.cascading_lookup(p.select("p_partkey", "p_type", "p_brand"), dim, [F.concat_ws("|", "p_type", "p_brand"), F.col("p_type")], "k", "v", F.col("p_partkey")).select("p_partkey", "found")


@query("group_alias_explode", """SELECT p_brand AS member, CASE WHEN min(p_type) = 'ECONOMY' THEN p_brand ELSE min(p_type) END AS grp FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""")
def group_alias_explode(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("t"))
    packed = p.groupBy(F.when(F.col("t") == "ECONOMY", "").otherwise(F.col("t")).alias("grp")).agg(F.concat_ws("/", F.sort_array(F.collect_list("p_brand"))).alias("members"))
    return op.explode_aliases(packed, "members", "grp")


@query("adjacent_linkage", """SELECT a.l_orderkey, count(*) FILTER (a.l_returnflag = 'R' AND b.l_returnflag = 'R') AS n11, count(*) FILTER (a.l_returnflag = 'R' AND b.l_returnflag <> 'R') AS n10,
 count(*) FILTER (a.l_returnflag <> 'R' AND b.l_returnflag = 'R') AS n01, count(*) FILTER (a.l_returnflag <> 'R' AND b.l_returnflag <> 'R') AS n00
 FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) a
 JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1""")
def adjacent_linkage(spark, sf):
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    a, b = F.col("f") == "R", F.col("next_f") == "R"
    counts = [F.count_if(x).alias(n) for n, x in (("n11", a & b), ("n10", a & ~b), ("n01", ~a & b), ("n00", ~a & ~b))]
    return op.adjacent(one, "l_orderkey", "l_linenumber", ["f"]).groupBy("l_orderkey").agg(*counts)


@query("fragment_pairs", """WITH o AS (SELECT l_orderkey, l_partkey % 50 AS item, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
 SELECT a.item AS a, b.item AS b, count(*) AS n, round(sum(a.w * b.w), 2) AS weight FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.item < b.item GROUP BY 1, 2""")
def fragment_pairs(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("item"), "l_quantity")
    return op.pairs_within(rows, "l_orderkey", "item", "l_quantity").withColumn("weight", F.round("weight", 2))


SPANS = "SELECT event_id AS span_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 6 * 3600000000 AS e FROM events WHERE event_type = 'purchase'"


@query("range_overlap_join", f"""WITH s AS ({SPANS}) SELECT v.event_id, s.span_id FROM events v JOIN s ON v.user_id = s.user_id AND epoch_us(v.ts) >= s.s AND epoch_us(v.ts) < s.e WHERE v.event_type = 'click'""")
def range_overlap_join(spark, sf):
    v = table(spark, sf, "events").withColumn("at", micros("ts"))
    spans = v.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", F.col("at").alias("s"), (F.col("at") + 6 * 3_600_000_000).alias("e"))
    points = v.where("event_type = 'click'").select("event_id", "user_id", "at")
    return op.range_join(points, spans, ["user_id"], "at", "s", "e", 86_400_000_000).select("event_id", "span_id")


@query("range_semi_join", f"""WITH s AS ({SPANS}) SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND EXISTS (SELECT 1 FROM s WHERE v.user_id = s.user_id AND epoch_us(v.ts) >= s.s AND epoch_us(v.ts) < s.e)""")
def range_semi_join(spark, sf):
    v = table(spark, sf, "events").withColumn("at", micros("ts"))
    spans = v.where("event_type = 'purchase'").select("user_id", F.col("at").alias("s"), (F.col("at") + 6 * 3_600_000_000).alias("e"))
    return op.range_join(v.where("event_type = 'view'").select("event_id", "user_id", "at"), spans, ["user_id"], "at", "s", "e", 86_400_000_000, "left_semi").select("event_id")


@query("inner_score_merge", """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_suppkey, sum(l_quantity * l_discount) AS x FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
 SELECT l_suppkey, round(a.x + b.x, 2) AS score FROM a JOIN b USING (l_suppkey)""")
def inner_score_merge(spark, sf):
    half = F.when(F.col("l_linenumber") <= 3, 1).otherwise(2)
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(half == 1, F.col("l_quantity"))).alias("a"), F.sum(F.when(half == 2, F.col("l_quantity") * F.col("l_discount"))).alias("b"))
    return sums.where("a is not null and b is not null").select("l_suppkey", F.round(F.col("a") + F.col("b"), 2).alias("score"))


@query("theta_pairs", """WITH c AS (SELECT c_nationkey AS k, count(*) FILTER (c_acctbal >= 0) AS p, count(*) FILTER (c_acctbal < 0) AS m FROM customer GROUP BY 1)
 SELECT a.k AS i, b.k AS j, o AS pairing, CASE WHEN o = 0 THEN a.p * b.p + a.m * b.m ELSE a.p * b.m + a.m * b.p END AS score FROM c a JOIN c b ON a.k < b.k CROSS JOIN (SELECT unnest([0, 1]) AS o)""")
def theta_pairs(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("p"), F.count_if(F.col("c_acctbal") < 0).alias("m"))
    # At most one row per nation: the pair count is bounded by the dimension.
    a, b = (c.select(*[F.col(x).alias(f"{side}{x}") for x in ("k", "p", "m")]) for side in "ab")
    pairs = a.join(b, F.col("ak") < F.col("bk")).withColumn("pairing", F.explode(F.array(F.lit(0), F.lit(1))))
    straight, crossed = F.col("ap") * F.col("bp") + F.col("am") * F.col("bm"), F.col("ap") * F.col("bm") + F.col("am") * F.col("bp")
    return pairs.select(F.col("ak").alias("i"), F.col("bk").alias("j"), "pairing", F.when(F.col("pairing") == 0, straight).otherwise(crossed).alias("score"))


@query("outer_merge_fill", """SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def outer_merge_fill(spark, sf):
    o = table(spark, sf, "orders").withColumn("ym", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint"))
    parts = {s.lower(): o.where(F.col("o_orderstatus") == s).groupBy("ym").agg(F.count("*").alias("n")) for s in "OFP"}
    return op.merge_fill(parts, "ym", "n", 0)


@query("three_way_align", """WITH g AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) % 3 AS a, max(l_partkey) % 3 AS b FROM lineitem GROUP BY 1, 2)
 SELECT c.l_orderkey, NOT ((c.a IN (m.a, m.b) AND c.b IN (f.a, f.b)) OR (c.b IN (m.a, m.b) AND c.a IN (f.a, f.b))) AS conflict FROM g c JOIN g m ON m.l_orderkey = c.l_orderkey AND m.l_linenumber = 2
 JOIN g f ON f.l_orderkey = c.l_orderkey AND f.l_linenumber = 3 WHERE c.l_linenumber = 1""")
def three_way_align(spark, sf):
    g = table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_suppkey") % 3).alias("a"), (F.max("l_partkey") % 3).alias("b"))
    # One aggregation by order instead of two self-joins.
    of = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.struct("a", "b"))).alias(f"g{k}")
    wide = g.groupBy("l_orderkey").agg(of(1), of(2), of(3)).where("g1 is not null and g2 is not null and g3 is not null")
    pair = lambda k: (F.col(f"g{k}.a"), F.col(f"g{k}.b"))
    return wide.select("l_orderkey", op.mendelian_conflict(pair(1), pair(2), pair(3)).alias("conflict"))


@query("truth_vs_inferred", """WITH x AS (SELECT lang, (quality = 1) = (n_chars > 300) AS ok FROM labels JOIN documents USING (doc_id)) SELECT lang, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM x GROUP BY ROLLUP (lang)""")
def truth_vs_inferred(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    ok = (F.col("quality") == 1) == (F.col("n_chars") > 300)
    return x.withColumn("ok", F.when(ok, 1.0).otherwise(0.0)).rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("recall_precision", """WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM documents WHERE n_chars > 300)
 SELECT round(count(*) FILTER (t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) / count(t.doc_id), 6) AS recall, round(count(*) FILTER (t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) / count(p.doc_id), 6) AS prec FROM t FULL JOIN p ON t.doc_id = p.doc_id""")
def recall_precision(spark, sf):
    t = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("t"))
    p = table(spark, sf, "documents").where("n_chars > 300").select("doc_id", F.lit(1).alias("p"))
    both = F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull())
    return t.join(p, "doc_id", "full").agg(F.round(both / F.count("t"), 6).alias("recall"), F.round(both / F.count("p"), 6).alias("prec"))


@query("history_remap", """SELECT n_nationkey, coalesce(r_name || '_' || n_nationkey, n_name) AS name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0""")
def history_remap(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = n.join(r, (n.n_regionkey == r.r_regionkey) & (n.n_nationkey % 2 == 0), "left")
    return joined.select("n_nationkey", F.coalesce(F.concat("r_name", F.lit("_"), F.col("n_nationkey").cast("string")), "n_name").alias("name"))


@query("band_anti_join", """SELECT e.event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 3600000000)""")
def band_anti_join(spark, sf):
    v = table(spark, sf, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    return op.near_join(v.where("event_type = 'error'"), v.where("event_type = 'purchase'"), ["user_id"], "at", 3_600_000_000, "left_anti").select("event_id")


@query("update_overlay", """SELECT p_partkey, CASE WHEN p_size = 7 THEN round(p_retailprice * 2, 2) ELSE p_retailprice END AS p_retailprice FROM part""")
def update_overlay(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    new = p.where("p_size = 7").select("p_partkey", F.round(F.col("p_retailprice") * 2, 2).alias("p_retailprice"))
    return op.overlay(p, new, "p_partkey", ["p_retailprice"]).select("p_partkey", "p_retailprice")


@query("best_pairing", """WITH s AS (SELECT s_nationkey AS k, min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, min(c_acctbal) AS x, max(c_acctbal) AS y FROM customer GROUP BY 1)
 SELECT k, round(least(abs(a - x) + abs(b - y), abs(a - y) + abs(b - x)), 2) AS cost FROM s JOIN c USING (k)""")
def best_pairing(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("x"), F.max("c_acctbal").alias("y"))
    cost = {(p, q): F.abs(F.col(p) - F.col(q)) for p in "ab" for q in "xy"}
    return s.join(c, "k").select("k", F.round(op.best_pairing(cost), 2).alias("cost"))


@query("semi_list", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_list(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(r, "o_orderkey", "left_semi")


@query("anti_list", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_list(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(r, "o_orderkey", "left_anti")


@query("recursive_levels", """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
 w AS (SELECT node, CAST(0 AS BIGINT) AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.node, w.level + 1 FROM n JOIN w ON n.parent = w.node) SELECT node, level FROM w""")
def recursive_levels(spark, sf):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    nodes = [table(spark, sf, "region").select(tag("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")), table(spark, sf, "nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey")), table(spark, sf, "supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey"))]
    return op.levels(reduce(DataFrame.union, nodes), "node", "parent")


@query("set_algebra", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
 SELECT 'both' AS part, user_id FROM a INTERSECT SELECT 'both', user_id FROM b UNION ALL (SELECT 'first', user_id FROM a EXCEPT SELECT 'first', user_id FROM b) UNION ALL (SELECT 'second', user_id FROM b EXCEPT SELECT 'second', user_id FROM a)""")
def set_algebra(spark, sf):
    v = table(spark, sf, "events")
    return sets.algebra(v.where("event_type = 'error'").select("user_id"), v.where("event_type = 'purchase'").select("user_id"), "user_id")


@query("unique_to_one", "SELECT l_orderkey, min(s_nationkey) AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1")
def unique_to_one(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return sets.unique_to_one(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey"), "l_orderkey", "s_nationkey").withColumnRenamed("s_nationkey", "nation")


@query("interval_compare", """WITH x AS (SELECT o_custkey % 50 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, o_orderkey % 9 + 1 AS n, o_orderstatus AS t FROM orders),
 p AS (SELECT DISTINCT k, t, unnest(range(s, s + n)) AS day FROM x), d AS (SELECT k, day, string_agg(t, '' ORDER BY t) AS held FROM p GROUP BY 1, 2) SELECT k, held, count(*) AS n FROM d GROUP BY 1, 2""")
def interval_compare(spark, sf):
    s = days("o_orderdate")
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("k"), s.alias("s"), (s + F.col("o_orderkey") % 9 + 1).alias("e"), "o_orderstatus")
    return op.shared_lengths({t: x.where(F.col("o_orderstatus") == t) for t in "FOP"}, "k", "s", "e")


@query("combo_best", """WITH s AS (SELECT p_brand, p_type, avg(p_retailprice) AS x, sum(p_size) AS f FROM part GROUP BY 1, 2), r AS (SELECT p_brand, p_type, round(x, 2) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY round(x, 2) DESC, f DESC, p_type) AS rn FROM s)
 SELECT p_brand, p_type, score FROM r WHERE rn = 1""")
def combo_best(spark, sf):
    s = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 2).alias("score"), F.sum("p_size").alias("f"))
    return aggregating.best_combination(s, "p_brand", "p_type", "score", "f")


@query("two_source_mix", """SELECT doc_id, 'a' AS src FROM documents WHERE doc_id % 10 < 2 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 10 >= 2 AND (doc_id * 31) % 10 < 8""")
def two_source_mix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.where("doc_id % 10 < 2").withColumn("src", F.lit("a")).union(d.where("doc_id % 10 >= 2 and (doc_id * 31) % 10 < 8").withColumn("src", F.lit("b")))
