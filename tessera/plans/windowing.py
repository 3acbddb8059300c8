"""Bindings: window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import aggregating
from tessera.operators import windowing as op

from .registry import days, micros, query, table

HOUR = 3_600_000_000
SESSIONS = """WITH g AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS tt, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS s FROM g)"""


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("at"))


@query("session_molecules", f"{SESSIONS} SELECT user_id, min(tt) AS first_at, max(tt) AS last_at, count(*) AS n FROM s GROUP BY user_id, s")
def session_molecules(spark, sf):
    return op.sessions(_events(spark, sf), "user_id", "at", 12 * HOUR, ["event_id"])


@query("session_min_reads", f"{SESSIONS} SELECT user_id, min(tt) AS first_at, max(tt) AS last_at, count(*) AS n FROM s GROUP BY user_id, s HAVING count(*) > 1 AND max(tt) - min(tt) <= 216000000000")
def session_min_reads(spark, sf):
    return op.sessions(_events(spark, sf), "user_id", "at", 12 * HOUR, ["event_id"]).where(f"n > 1 and last_at - first_at <= {60 * HOUR}")


@query("rolling_mask", """WITH h AS (SELECT epoch_us(ts) // 3600000000 AS h, count(*) AS c FROM events GROUP BY 1), d AS (SELECT unnest(range((SELECT min(h) FROM h), (SELECT max(h) FROM h) + 1)) AS pos),
 m AS (SELECT pos, avg(coalesce(c, 0)) OVER b AS m, count(*) OVER b AS k FROM d LEFT JOIN h ON h = pos WINDOW b AS (ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT pos - 20 AS s, pos AS e FROM m WHERE k = 20 AND m < (SELECT avg(coalesce(c, 0)) FROM d LEFT JOIN h ON h = pos)),
 g AS (SELECT *, CASE WHEN s < max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) OVER (ORDER BY s, e) AS g FROM g)
 SELECT min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY g""")
def rolling_mask(spark, sf):
    hours = _events(spark, sf).groupBy((F.col("at") / HOUR).cast("bigint").alias("pos")).agg(F.count("*").alias("c"))
    # The hour spine is as long as the time covered, not as the events; the mean over it is one row.
    spine = hours.agg(F.min("pos").alias("a"), F.max("pos").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("pos"))
    dense = spine.join(hours, "pos", "left").select(F.lit("all").alias("chrom"), "pos", F.coalesce("c", F.lit(0)).alias("depth"))
    mean = dense.agg(F.avg("depth").alias("least"))
    low = op.rolling_mean(dense, "chrom", "pos", "depth", 20).where("seen = 20").join(F.broadcast(mean), F.col("mean") < F.col("least"))
    return op.merge_ranges(low.select("chrom", (F.col("pos") - 20).alias("start"), F.col("pos").alias("end")), "chrom", "start", "end").drop("chrom")


@query("low_depth_by_key", """WITH d AS (SELECT o_custkey % 10 AS k, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS pos, o_totalprice AS depth FROM orders),
 m AS (SELECT *, avg(depth) OVER b AS m, count(*) OVER b AS c FROM d WINDOW b AS (PARTITION BY k ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), f AS (SELECT k, pos - 5 AS s, pos AS e FROM m WHERE c = 5 AND m < 180000),
 g AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e) AS g FROM g)
 SELECT k, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY k, g""")
def low_depth_by_key(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("k"), "o_orderkey", F.col("o_totalprice").alias("depth"))
    # Row numbers from ranges of orders: no key is sorted by one task.
    d = op.totals_below(o.withColumn("one", F.lit(1)), ["k"], "o_orderkey", "one").withColumn("pos", F.col("below") + 1)
    return op.rolling_below(d, "k", "pos", "depth", 5, 180000)


@query("rank_ties", "SELECT s_nationkey, s_suppkey FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000) DESC) AS r FROM supplier) WHERE r = 1")
def rank_ties(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 1000).alias("score"))
    return op.tied_best(s, "s_nationkey", "score").select("s_nationkey", "s_suppkey")


@query("break_points", "SELECT user_id, event_id, b AS before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND b <> event_type")
def break_points(spark, sf):
    return op.changes(_events(spark, sf), "user_id", ["at", "event_id"], "event_type").select("user_id", "event_id", "before")


@query("run_pack", """WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM o), r AS (SELECT l_orderkey, min(l_linenumber) AS s, count(*) AS n FROM i GROUP BY l_orderkey, g)
 SELECT l_orderkey, string_agg(s || ':' || n, ' ' ORDER BY s) AS runs FROM r GROUP BY 1""")
def run_pack(spark, sf):
    return op.pack_runs(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("dup_suffix", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def dup_suffix(spark, sf):
    return op.number_duplicates(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("switch_errors", """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1), s AS (SELECT user_id, epoch_us(ts) AS tt, event_id, (value > med) = (event_id % 2 = 0) AS ok FROM events JOIN m USING (event_type)),
 f AS (SELECT user_id, row_number() OVER w AS i, ok <> lag(ok) OVER w AS flip FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tt, event_id)), g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM f WHERE flip), r AS (SELECT user_id, count(*) AS n FROM g GROUP BY user_id, g)
 SELECT user_id, CAST(sum(n) AS BIGINT) AS flips, CAST(sum(n // 2) AS BIGINT) AS mismatches, CAST(sum(n % 2) AS BIGINT) AS switches FROM r GROUP BY 1""")
def switch_errors(spark, sf):
    v = _events(spark, sf)
    m = aggregating.exact_percentiles(v, ["event_type"], "value", {"med": 0.5})
    s = v.join(m, "event_type").withColumn("ok", (F.col("value") > F.col("med")) == (F.col("event_id") % 2 == 0))
    return op.switch_errors(s, "user_id", ["at", "event_id"], "ok")


@query("interp_asof", """WITH k AS (SELECT user_id AS u, epoch_us(ts) AS x, avg(value) AS y FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), p AS (SELECT event_id, user_id, epoch_us(ts) AS tt FROM events WHERE event_type = 'click'),
 a AS (SELECT p.*, k.x AS x0, k.y AS y0 FROM p ASOF LEFT JOIN k ON p.user_id = k.u AND p.tt >= k.x), b AS (SELECT a.*, k.x AS x1, k.y AS y1 FROM a ASOF LEFT JOIN k ON a.user_id = k.u AND a.tt < k.x)
 SELECT event_id, round(coalesce(y0 + (y1 - y0) * (tt - x0) / (x1 - x0), y0, y1), 4) AS interpolated FROM b""")
def interp_asof(spark, sf):
    v = _events(spark, sf)
    points = v.where("event_type = 'click'").select("event_id", "user_id", "at")
    known = v.where("event_type = 'purchase'").select("user_id", F.col("at").alias("x"), "value")
    return op.interpolate(points, known, "user_id", "at", "x", "value").select("event_id", F.round("interpolated", 4).alias("interpolated"))


@query("deltas", """WITH d AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT event_id, round(d, 4) AS delta, round((1 - exp(-2 * abs(d) / 100)) / 2, 6) AS recombination FROM d WHERE d IS NOT NULL""")
def deltas(spark, sf):
    from tessera.functions.sequence import haldane

    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    d = _events(spark, sf).select("event_id", (F.col("value") - F.lag("value").over(w)).alias("d")).where("d is not null")
    return d.select("event_id", F.round("d", 4).alias("delta"), F.round(haldane(F.abs("d")), 6).alias("recombination"))


ORDERS = "SELECT o_custkey % 200 AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 5 + o_orderkey % 20 AS BIGINT) AS e FROM orders"


def _intervals(spark, sf):
    s = days("o_orderdate")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("k"), s.alias("s"), (s + 5 + F.col("o_orderkey") % 20).alias("e"))


@query("interval_merge", f"""WITH x AS ({ORDERS}), g AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x), i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM g)
 SELECT k, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY k, g""")
def interval_merge(spark, sf):
    return op.merge_intervals(_intervals(spark, sf), "k", "s", "e")


@query("tie_rank", """SELECT event_type, round(sum(r), 1) AS rank_sum FROM (SELECT event_type, user_id, rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2.0 AS r FROM events) WHERE user_id % 2 = 0 GROUP BY 1""")
def tie_rank(spark, sf):
    v = _events(spark, sf).withColumn("v", F.round("value"))
    return op.average_rank(v, "event_type", "v").where("user_id % 2 = 0").groupBy("event_type").agg(F.round(F.sum("avg_rank"), 1).alias("rank_sum"))


@query("elementary_segments", f"""WITH x AS ({ORDERS}), v AS (SELECT k, s AS tt, 1 AS d FROM x UNION ALL SELECT k, e, -1 FROM x), g AS (SELECT k, tt, sum(d) AS d FROM v GROUP BY 1, 2),
 p AS (SELECT k, tt AS start, lead(tt) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS cover FROM g WINDOW w AS (PARTITION BY k ORDER BY tt)) SELECT * FROM p WHERE "end" IS NOT NULL AND cover > 0""")
def elementary_segments(spark, sf):
    return op.elementary_segments(_intervals(spark, sf), "k", "s", "e")


@query("offset_rebase", """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
 SELECT c_custkey, CAST(off + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS idx FROM customer JOIN o ON c_nationkey = k""")
def offset_rebase(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # One row per nation, then a small window over all of them.
    off = op.running_offset(c.groupBy("c_nationkey").agg(F.count("*").alias("n")), ["c_nationkey"], F.col("n")).select("c_nationkey", "offset")
    return c.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).join(off, "c_nationkey").select("c_custkey", (F.col("offset") + F.col("i")).cast("bigint").alias("idx"))


@query("sliding_blocks", """WITH n AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_quantity FROM lineitem), w AS (SELECT l_suppkey, unnest(CASE WHEN i // 140 > 0 AND i % 140 < 60 THEN [i // 140, i // 140 - 1] ELSE [i // 140] END) AS win, l_quantity FROM n)
 SELECT l_suppkey, win, count(*) AS n, round(sum(l_quantity), 2) AS total FROM w GROUP BY 1, 2""")
def sliding_blocks(spark, sf):
    # Windows of 200 rows that overlap by 60: a row is in the window of its step and, in the first 60, in the one before.
    n = op.sliding_windows(table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 200, 60)
    return n.groupBy("l_suppkey", "win").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("greedy_dedupe", """WITH RECURSIVE o AS (SELECT user_id AS k, epoch_us(ts) AS tt, event_id FROM events WHERE event_type = 'error'), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tt, event_id) AS i FROM o),
 w AS (SELECT k, i, tt AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.k, n.i, CASE WHEN n.tt - w.last >= 7200000000 THEN n.tt ELSE w.last END, n.tt - w.last >= 7200000000 FROM w JOIN n ON n.k = w.k AND n.i = w.i + 1)
 SELECT n.k AS user_id, n.event_id FROM w JOIN n USING (k, i) WHERE kept""")
def greedy_dedupe(spark, sf):
    v = _events(spark, sf).where("event_type = 'error'")
    return op.greedy_apart(v, "user_id", "at", "event_id", 2 * HOUR).select("user_id", "event_id")


@query("sliding_heterozygosity", """SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rate FROM events""")
def sliding_heterozygosity(spark, sf):
    w = Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(-9, 0)
    return _events(spark, sf).select("event_id", F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).over(w), 6).alias("rate"))
