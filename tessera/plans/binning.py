"""Bindings: assignment, filters and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import binning as op

from .registry import query, table


def _type_scores(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("score"))


TOP = """WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS score FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rn FROM s),
t AS (SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS f, max(CASE WHEN rn = 1 THEN score END) AS fs,
 max(CASE WHEN rn = 2 THEN event_type END) AS s2, coalesce(max(CASE WHEN rn = 2 THEN score END), 0.0) AS ss FROM r GROUP BY 1)"""


@query("bin_top_margin", f"{TOP} SELECT user_id, round(fs - ss, 4) AS lead, CASE WHEN round(fs - ss, 4) >= 50 THEN f ELSE 'REMOVE' END AS assigned FROM t")
def bin_top_margin(spark, sf):
    top = op.top_two(_type_scores(spark, sf), "user_id", "event_type", "score").withColumn("lead", F.round(F.col("first_score") - F.col("second_score"), 4))
    return top.select("user_id", "lead", F.when(F.col("lead") >= 50, F.col("first")).otherwise("REMOVE").alias("assigned"))


@query("bin_long_read_rules", f"""{TOP} SELECT user_id, CASE WHEN f = 'click' AND s2 = 'view' THEN 'click' WHEN f = 'view' AND s2 = 'click' THEN 'view'
 WHEN fs - ss >= 100 THEN f ELSE 'REMOVE' END AS assigned FROM t""")
def bin_long_read_rules(spark, sf):
    rules = [("click", "view", "click"), ("view", "click", "view")]
    return op.assign_by_rules(_type_scores(spark, sf), "user_id", "event_type", "score", rules, 100.0).select("user_id", "assigned")


@query("accept_filter", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 5 AND l_discount <= 0.06 AND l_returnflag <> 'R'
 AND (CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE l_extendedprice / 1000 END) >= 10""")
def accept_filter(spark, sf):
    by_mode = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(F.col("l_extendedprice") / 1000)
    rows = table(spark, sf, "lineitem").where((F.col("l_quantity") >= 5) & (F.col("l_discount") <= 0.06) & (F.col("l_returnflag") != "R"))
    return rows.where(by_mode >= 10).select("l_orderkey", "l_linenumber")


@query("property_filter_dsl", """SELECT l_orderkey, l_linenumber FROM lineitem
 WHERE ((l_quantity >= 40 AND l_returnflag = 'N') OR (l_tax < 0.02 AND NOT (l_linestatus = 'O'))) AND l_discount > 0.01""")
def property_filter_dsl(spark, sf):
    p = op.property_filter
    rule = {"and": [{"or": [{"and": [p("l_quantity:>=40"), p("l_returnflag:N")]}, {"and": [p("l_tax:<0.02"), {"not": p("l_linestatus:O")}]}]}, p("l_discount:>0.01")]}
    return table(spark, sf, "lineitem").where(op.compile_rules(rule)).select("l_orderkey", "l_linenumber")


FLAG = "(l_orderkey * 7 + l_linenumber * 37) % 4096"


@query("bitflag_filter", f"""SELECT l_orderkey, l_linenumber, CAST({FLAG} AS BIGINT) AS flag FROM lineitem
 WHERE ({FLAG}) & 1 = 1 AND ({FLAG}) & {0x904} = 0 AND l_quantity >= 20""")
def bitflag_filter(spark, sf):
    # Paired, and neither unmapped, secondary nor supplementary; a least mapping quality beside.
    rows = table(spark, sf, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber", F.expr(FLAG).cast("bigint").alias("flag"))
    return rows.where(op.flags("flag", need=1, lack=0x904))


@query("two_pass_max_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT avg(o_totalprice) + 4 * sqrt(avg(o_totalprice)) FROM orders)")
def two_pass_max_filter(spark, sf):
    return op.bounded_by_mean(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4).select("o_orderkey")


@query("top2_share", """WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC) AS rn FROM s)
 SELECT l_orderkey, round(sum(CASE WHEN rn <= 2 THEN w ELSE 0 END) / sum(w), 6) AS share FROM r GROUP BY 1 HAVING sum(CASE WHEN rn <= 2 THEN w ELSE 0 END) / sum(w) > 0.7""")
def top2_share(spark, sf):
    return op.top_share(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity", 2, 0.7).withColumn("share", F.round("share", 6))


@query("genotype_call", """WITH b AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS beta FROM lineitem GROUP BY 1)
 SELECT l_partkey, round(beta, 6) AS beta, CASE WHEN beta <= 0.2 THEN '0/0' WHEN beta >= 0.8 THEN '1/1' ELSE '0/1' END AS genotype,
 round(CASE WHEN beta > 0 AND beta < 1 THEN greatest(ln(beta / (1 - beta)), 0) ELSE 0 END, 6) AS imbalance FROM b""")
def genotype_call(spark, sf):
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    beta = table(spark, sf, "lineitem").groupBy("l_partkey").agg((returned / F.sum("l_quantity")).alias("beta"))
    imbalance = F.when((F.col("beta") > 0) & (F.col("beta") < 1), F.greatest(F.ln(F.col("beta") / (1 - F.col("beta"))), F.lit(0.0))).otherwise(0.0)
    return beta.select("l_partkey", F.round("beta", 6).alias("beta"), op.call_genotype("beta", 0.2).alias("genotype"), F.round(imbalance, 6).alias("imbalance"))


@query("filter_labels", """SELECT o_orderkey, CASE WHEN concat_ws(';', CASE WHEN o_totalprice > 400000 THEN 'DPhigh' END, CASE WHEN o_totalprice < 50000 THEN 'DPlow' END,
 CASE WHEN o_orderstatus = 'F' THEN 'FSfail' END) = '' THEN '.' ELSE concat_ws(';', CASE WHEN o_totalprice > 400000 THEN 'DPhigh' END, CASE WHEN o_totalprice < 50000 THEN 'DPlow' END,
 CASE WHEN o_orderstatus = 'F' THEN 'FSfail' END) END AS filter FROM orders""")
def filter_labels(spark, sf):
    tests = {"DPhigh": F.col("o_totalprice") > 400000, "DPlow": F.col("o_totalprice") < 50000, "FSfail": F.col("o_orderstatus") == "F"}
    return op.quality_labels(table(spark, sf, "orders"), tests).select("o_orderkey", "filter")


@query("two_criteria_select", """WITH q AS (SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
 s AS (SELECT s_nationkey, s_suppkey, s_acctbal, coalesce(qty, 0) AS qty FROM supplier LEFT JOIN q ON s_suppkey = l_suppkey),
 r AS (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r1, rank() OVER (PARTITION BY s_nationkey ORDER BY qty DESC) AS r2, max(qty) OVER (PARTITION BY s_nationkey) AS m FROM s),
 u AS (SELECT *, CASE WHEN r1 = 1 AND r2 = 1 THEN 1 WHEN qty >= 0.9 * m THEN 2 WHEN r1 = 1 THEN 3 END AS rule FROM r),
 v AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY rule, s_acctbal DESC, s_suppkey) AS rn FROM u WHERE rule IS NOT NULL)
 SELECT s_nationkey, s_suppkey, CAST(rule AS BIGINT) AS rule FROM v WHERE rn = 1""")
def two_criteria_select(spark, sf):
    qty = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("qty"))
    rows = table(spark, sf, "supplier").join(qty, "s_suppkey", "left").withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    return op.two_criteria(rows, "s_nationkey", "s_suppkey", "s_acctbal", "qty").select("s_nationkey", "s_suppkey", F.col("rule").cast("bigint"))


@query("rule_ladder_explode", """SELECT event_id, unnest(CASE WHEN event_type = 'error' AND value > 100 THEN ['alert', 'audit'] WHEN event_type = 'error' THEN ['audit']
 WHEN value > 50 THEN ['big'] ELSE ['other'] END) AS bin FROM events""")
def rule_ladder_explode(spark, sf):
    ladder = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.array(F.lit("alert"), F.lit("audit")))
        .when(F.col("event_type") == "error", F.array(F.lit("audit")))
        .when(F.col("value") > 50, F.array(F.lit("big")))
        .otherwise(F.array(F.lit("other")))
    )
    return table(spark, sf, "events").select("event_id", F.explode(ladder).alias("bin"))


@query("downsample_hash", "SELECT event_id FROM events WHERE (event_id * 2654435761) % 4294967296 < 0.3 * 4294967296")
def downsample_hash(spark, sf):
    return table(spark, sf, "events").where((F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296) < 0.3 * 4294967296).select("event_id")


@query("barcode_llr", """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS good, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
 SELECT l_orderkey, round(good * ln(0.7) + bad * ln(0.3) - (good + bad) * ln(0.5), 6) AS llr FROM c WHERE good * ln(0.7) + bad * ln(0.3) - (good + bad) * ln(0.5) < 0""")
def barcode_llr(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("good"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    llr = F.col("good") * F.ln(F.lit(0.7)) + F.col("bad") * F.ln(F.lit(0.3)) - (F.col("good") + F.col("bad")) * F.ln(F.lit(0.5))
    return c.withColumn("llr", llr).where("llr < 0").select("l_orderkey", F.round("llr", 6).alias("llr"))


@query("topk_then_filter", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) WHERE o_orderstatus = 'F'")
def topk_then_filter(spark, sf):
    top = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("bool_all_any", """WITH g AS (SELECT l_orderkey, l_linestatus, bool_and(l_quantity > 10) AS ok FROM lineitem GROUP BY 1, 2)
 SELECT o_custkey, bool_or(ok) AS perfect FROM g JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def bool_all_any(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.bool_and(F.col("l_quantity") > 10).alias("ok"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return g.join(o, "l_orderkey").groupBy("o_custkey").agg(F.bool_or("ok").alias("perfect"))
