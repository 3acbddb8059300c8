"""Bindings: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregating as op

from .registry import days, micros, query, table


@query("weighted_identity", "SELECT l_suppkey, round(100 * (1 - sum(l_discount * l_quantity) / sum(l_quantity)) * (CASE WHEN l_suppkey % 2 = 0 THEN 1.1 ELSE 1.0 END), 4) AS score FROM lineitem GROUP BY 1")
def weighted_identity(spark, sf):
    rows = op.weighted_identity(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_discount") * F.col("l_quantity"), "l_quantity")
    return rows.select("l_suppkey", F.round(F.col("identity") * F.when(F.col("l_suppkey") % 2 == 0, 1.1).otherwise(1.0), 4).alias("score"))


@query("first_hit_dedupe", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, round(sum(value), 2) AS total, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1""")
def first_hit_dedupe(spark, sf):
    first = op.first_hit(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    return first.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("mode_first_seen", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS t, arg_min(event_id, ts) AS e FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t, e) AS rn FROM c)
 SELECT user_id, event_type, n FROM r WHERE rn = 1""")
def mode_first_seen(spark, sf):
    return op.mode_first_seen(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("trimmed_mean", """WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
 SELECT l_suppkey, round(avg(l_quantity), 6) AS mean FROM r WHERE i > 5 AND i <= n - 5 GROUP BY 1""")
def trimmed_mean(spark, sf):
    rows = op.trimmed_mean(table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_quantity", 5)
    return rows.withColumn("mean", F.round("mean", 6))


@query("allele_stats", """SELECT p_brand, round(avg(p_size), 6) AS mean, round(quantile_cont(p_size, 0.5), 6) AS median, round(avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END), 6) AS covered, count(*) AS n FROM part GROUP BY 1""")
def allele_stats(spark, sf):
    rows = op.depth_stats(table(spark, sf, "part"), "p_brand", "p_size", 10)
    return rows.select("p_brand", *[F.round(c, 6).alias(c) for c in ("mean", "median", "covered")], "n")


@query("phase_ratio", """WITH b AS (SELECT l_suppkey, l_linestatus = 'O' AS f, l_discount * 10 AS beta FROM lineitem) SELECT l_suppkey, round(avg(CASE WHEN f THEN 1 - beta ELSE beta END), 6) AS h1, round(1 - avg(CASE WHEN f THEN 1 - beta ELSE beta END), 6) AS h2 FROM b GROUP BY 1""")
def phase_ratio(spark, sf):
    rows = op.phase_ratio(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_discount") * 10, F.col("l_linestatus") == "O")
    return rows.select("l_suppkey", F.round("h1", 6).alias("h1"), F.round("h2", 6).alias("h2"))


@query("copy_number", """WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'R') AS r, avg(l_quantity) AS a FROM lineitem GROUP BY 1)
 SELECT l_suppkey, round(r / a, 6) AS ratio, CASE WHEN r / a < 0.1 THEN 0 WHEN r / a < 0.85 THEN 1 ELSE 2 END AS copies FROM m WHERE r IS NOT NULL""")
def copy_number(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"), F.avg("l_quantity").alias("a")).where("r is not null")
    ratio = F.col("r") / F.col("a")
    return m.select("l_suppkey", F.round(ratio, 6).alias("ratio"), op.copy_class(ratio).alias("copies"))


@query("loh_copies", """WITH s AS (SELECT l_suppkey, greatest(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 0.5) + 0.2 AS f FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, f / (1 - f) AS r FROM s WHERE f < 1), a AS (SELECT l_suppkey, (r * 2 + (r - 1) * (1 / 0.5 - 1)) / (1 + r) AS a FROM r)
 SELECT l_suppkey, greatest(0.0, least(round(a), 2.0)) AS major, greatest(0.0, least(round(2.0 - a), 2.0)) AS minor FROM a""")
def loh_copies(spark, sf):
    f = F.greatest(F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), F.lit(0.5)) + 0.2
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(f.alias("f")).where("f < 1")
    major, minor = op.allele_copies(F.col("f"), 1 - F.col("f"), F.lit(0.5), F.lit(2.0))
    return rows.select("l_suppkey", major.alias("major"), minor.alias("minor"))


SPAN = "SELECT o_custkey % 100 AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 20 + o_orderkey % 30 AS e FROM orders"


@query("breadth_depth", f"""WITH x AS ({SPAN}), p AS (SELECT k, unnest(range(greatest(s, 10000), least(e, 10400))) AS d FROM x), c AS (SELECT k, d, count(*) AS n FROM p GROUP BY 1, 2) SELECT k, round(count(*) / 400, 6) AS breadth, round(sum(n) / 400, 6) AS depth FROM c GROUP BY 1""")
def breadth_depth(spark, sf):
    s = days("o_orderdate")
    spans = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), s.alias("s"), (s + 20 + F.col("o_orderkey") % 30).alias("e"))
    return op.coverage(spans, "k", "s", "e", 10000, 10400).select("k", F.round("breadth", 6).alias("breadth"), F.round("depth", 6).alias("depth"))


@query("composition", """SELECT doc_id, length(text) - length(translate(text, 'aeiouAEIOU', '')) AS vowels, length(text) - length(translate(text, 'bcdfghjklmnpqrstvwxyz', '')) AS consonants, length(text) - length(translate(text, '0123456789', '')) AS digits FROM documents""")
def composition(spark, sf):
    classes = {"vowels": "aeiouAEIOU", "consonants": "bcdfghjklmnpqrstvwxyz", "digits": "0123456789"}
    return table(spark, sf, "documents").select("doc_id", *op.class_counts(F.col("text"), classes))


KMER = "SELECT substr(text, CAST(i AS INT), 5) AS kmer FROM (SELECT text, unnest(range(1, length(text) - 3)) AS i FROM benchmark WHERE length(text) >= 5)"


@query("kmer_count", f"SELECT kmer, count(*) AS n FROM ({KMER}) GROUP BY 1")
def kmer_count(spark, sf):
    return op.kmers(table(spark, sf, "benchmark"), "text", 5).groupBy("kmer").agg(F.count("*").alias("n"))


@query("kmer_hist", f"SELECT n, count(*) AS kmers FROM (SELECT kmer, count(*) AS n FROM ({KMER}) GROUP BY 1) GROUP BY 1")
def kmer_hist(spark, sf):
    return op.kmers(table(spark, sf, "benchmark"), "text", 5).groupBy("kmer").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("kmers"))


@query("per_position_qc", """WITH c AS (SELECT i - 1 AS pos, substr(text, CAST(i AS INT), 1) AS c FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM documents))
 SELECT pos, count(*) AS n, count(*) FILTER (contains('aeiou', c)) AS vowels, count(*) FILTER (contains('0123456789', c)) AS digits FROM c GROUP BY 1""")
def per_position_qc(spark, sf):
    return op.per_position(table(spark, sf, "documents"), "text", {"vowels": "aeiou", "digits": "0123456789"})


@query("per_position_whole", """WITH c AS (SELECT i - 1 AS pos, substr(text, CAST(i AS INT), 1) AS c FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM documents))
 SELECT pos, count(*) AS n, count(*) FILTER (contains('aeiou', c)) AS vowels, count(*) FILTER (contains('0123456789', c)) AS digits FROM c GROUP BY 1""")
def per_position_whole(spark, sf):
    return op.per_position(table(spark, sf, "documents"), "text", {"vowels": "aeiou", "digits": "0123456789"})


@query("tag_molecules", "SELECT user_id, event_type, min(epoch_us(ts)) AS first_at, max(epoch_us(ts)) AS last_at, count(*) AS n FROM events GROUP BY 1, 2")
def tag_molecules(spark, sf):
    v = table(spark, sf, "events").select("user_id", "event_type", micros("ts").alias("at"))
    return op.spans_by_tag(v, ["user_id", "event_type"], "at")


DELAY = "SELECT o_orderstatus AS k, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("insert_model", f"""WITH x AS ({DELAY}), q AS (SELECT k, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM x GROUP BY 1)
 SELECT k, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS sd, count(*) AS n FROM x JOIN q USING (k) WHERE d >= q1 - 0.5 * (q3 - q1) AND d <= q3 + 0.5 * (q3 - q1) GROUP BY 1""")
def insert_model(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("k"), "o_orderdate")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(o, "l_orderkey").select("k", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("d"))
    return op.fenced_mean(x, "k", "d", 0.5).select("k", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "mean", "sd")], "n")


@query("conflict_merge", """SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, min(event_type) AS event_type, least(round(sum(value), 2), 40.0) AS value FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1""")
def conflict_merge(spark, sf):
    v = table(spark, sf, "events").withColumn("day", days("ts"))
    return op.conflict_merge(v, ["user_id", "day"], "event_type", "value", 40.0).withColumn("value", F.round("value", 2))


@query("pair_genotype", """WITH o AS (SELECT l_partkey, l_suppkey % 20 AS s, min(l_discount * l_quantity) AS c FROM lineitem GROUP BY 1, 2)
 SELECT a.s AS i, b.s AS j, round(sum(least(a.c, b.c)), 2) AS cost, count(*) AS n FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.s <= b.s GROUP BY 1, 2""")
def pair_genotype(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_suppkey") % 20).alias("s"), (F.col("l_discount") * F.col("l_quantity")).alias("c"))
    return op.pair_cover(rows, "l_partkey", "s", "c")


@query("n50", """WITH r AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS run, sum(n_chars) OVER (PARTITION BY lang) AS a FROM documents) SELECT lang, max(n_chars) AS n50 FROM r WHERE run * 2 > a GROUP BY 1""")
def n50(spark, sf):
    return op.n50(table(spark, sf, "documents").select("lang", "n_chars"), "lang", "n_chars")


@query("an50", """WITH b AS (SELECT l_suppkey % 10 AS k, l_orderkey, max(l_partkey) - min(l_partkey) AS span, count(*) FILTER (l_linestatus = 'O') AS p, count(*) AS n FROM lineitem GROUP BY 1, 2),
 a AS (SELECT k, CAST(span * p AS DOUBLE) / n AS an, p, sum(n) OVER (PARTITION BY k) AS sites FROM b), r AS (SELECT k, an, sites, sum(p) OVER (PARTITION BY k ORDER BY an DESC) AS run FROM a)
 SELECT k, round(max(an), 4) AS an50 FROM r WHERE 2 * run > sites GROUP BY 1""")
def an50(spark, sf):
    b = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("k"), "l_orderkey").agg((F.max("l_partkey") - F.min("l_partkey")).alias("span"), F.count_if(F.col("l_linestatus") == "O").alias("p"), F.count("*").alias("n"))
    sites = b.groupBy("k").agg(F.sum("n").alias("sites"))
    return op.an50(b.join(sites, "k"), "k", "span", "p", "n", "sites").select("k", F.round("an50", 4).alias("an50"))


@query("truth_unpivot", """WITH w AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) SELECT y, 'o' AS status, o AS n FROM w UNION ALL SELECT y, 'f', f FROM w""")
def truth_unpivot(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return o.unpivot("y", ["o", "f"], "status", "n")


@query("wide_result", """SELECT CAST(month(o_orderdate) AS BIGINT) AS m, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS "O", coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS "F", coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS "P" FROM orders GROUP BY 1""")
def wide_result(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate").cast("bigint"))
    return o.groupBy("m").pivot("o_orderstatus", ["O", "F", "P"]).agg(F.round(F.sum("o_totalprice"), 2)).na.fill(0.0)


@query("string_agg_sorted", "SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def string_agg_sorted(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat_ws(",", F.sort_array(F.collect_list("s_name"))).alias("names"))


@query("block_vote_flip", """WITH v AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)
 SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'N' WHEN b > a THEN CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'R' END ELSE l_returnflag END AS side, count(*) AS n FROM lineitem JOIN v USING (l_suppkey) GROUP BY 1, 2""")
def block_vote_flip(spark, sf):
    return op.turned_by_vote(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("side")), "l_suppkey", "side", "R", "A")


@query("hmm_counts", """WITH t AS (SELECT l_orderkey, l_returnflag AS a, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS p FROM t WHERE b IS NOT NULL GROUP BY 1, 2""")
def hmm_counts(spark, sf):
    rows = op.transition_shares(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")
    return rows.withColumn("p", F.round("p", 6))
