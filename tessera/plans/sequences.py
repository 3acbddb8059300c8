"""Bindings: sequence functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sequence as fn
from tessera.operators.windowing import next_row

from .registry import query, table


@query("cigar_parse", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 5 AS matched, CAST(l_quantity AS BIGINT) + 5 + 2 + l_linenumber + l_orderkey % 3 + 4 AS block FROM lineitem)
 SELECT l_orderkey, l_linenumber, matched, block, round((matched - 1) / block, 6) AS identity FROM c""")
def cigar_parse(spark, sf):
    n = lambda c: F.col(c).cast("bigint").cast("string")
    # Clips and padding: neither S nor H is in the block, N and P are.
    cigar = F.concat(n("l_linenumber"), F.lit("H7S"), n("l_quantity"), F.lit("M2I"), n("l_linenumber"), F.lit("D5M"), (F.col("l_orderkey") % 3).cast("string"), F.lit("N4P"), n("l_quantity"), F.lit("S3H"))
    ops = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.cigar_ops(cigar).alias("ops"))
    return ops.select("l_orderkey", "l_linenumber", fn.ops_length(F.col("ops"), fn.MATCH).alias("matched"), fn.ops_length(F.col("ops"), fn.BLOCK).alias("block"), fn.identity(F.col("ops"), F.lit(1)).alias("identity"))


@query("rle_roundtrip", """WITH n AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem),
 s AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, f ORDER BY i) AS g FROM n),
 r AS (SELECT l_orderkey, f, g, count(*) AS n, min(i) AS i FROM s GROUP BY 1, 2, 3) SELECT l_orderkey, string_agg(n || f, '' ORDER BY i) AS rle, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def rle_roundtrip(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda x: x["l_returnflag"]), "").alias("s"))
    rle = fn.run_lengths(F.col("s"))
    back = F.array_join(F.zip_with(F.regexp_extract_all(rle, F.lit(r"(\d+)([A-Z])"), F.lit(1)), F.regexp_extract_all(rle, F.lit(r"(\d+)([A-Z])"), F.lit(2)), lambda n, c: F.repeat(c, n.cast("int"))), "")
    return s.select("l_orderkey", rle.alias("rle"), F.length(F.when(back == F.col("s"), back)).cast("bigint").alias("n"))


NEIGHBOURS = "SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part"


def _neighbours(spark, sf):
    """Each part's name with the next one's."""
    named = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    return next_row(named, "p_partkey", ["a"], 100_000).where("next_a is not null").select("p_partkey", "a", F.col("next_a").alias("b"))


@query("revcomp_edit", f"""WITH p AS ({NEIGHBOURS}) SELECT p_partkey, least(levenshtein(a, b), levenshtein(a, reverse(translate(b, 'ACGTRYMKVBHDacgtrymkvbhd', 'TGCAYRKMBVDHtgcayrkmbvdh')))) AS d FROM p WHERE b IS NOT NULL""")
def revcomp_edit(spark, sf):
    return _neighbours(spark, sf).select("p_partkey", fn.edit_distance(F.col("a"), F.col("b")).cast("bigint").alias("d"))


@query("variant_trim", f"""WITH p AS ({NEIGHBOURS}), t AS (SELECT p_partkey, a, b, least(list_max([CASE WHEN right(a, CAST(i AS INT)) = right(b, CAST(i AS INT)) THEN i ELSE 0 END FOR i IN range(0, least(length(a), length(b)) + 1)]), least(length(a), length(b)) - 1) AS tail FROM p WHERE b IS NOT NULL),
 r AS (SELECT p_partkey, left(a, CAST(length(a) - tail AS INT)) AS r, left(b, CAST(length(b) - tail AS INT)) AS a FROM t), h AS (SELECT p_partkey, r, a, least(list_max([CASE WHEN left(r, CAST(i AS INT)) = left(a, CAST(i AS INT)) THEN i ELSE 0 END FOR i IN range(0, least(length(r), length(a)) + 1)]), least(length(r), length(a)) - 1) AS head FROM r)
 SELECT p_partkey, CAST(100 + head AS INT) AS pos, substr(r, CAST(head AS INT) + 1) AS ref, substr(a, CAST(head AS INT) + 1) AS alt FROM h""")
def variant_trim(spark, sf):
    trimmed = _neighbours(spark, sf).select("p_partkey", fn.trim_variant(F.lit(100), F.col("a"), F.col("b")).alias("v"))
    return trimmed.select("p_partkey", F.col("v.pos").cast("int").alias("pos"), "v.ref", "v.alt")


@query("binomial_gate", """WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY 1) SELECT user_id, n, k, round(1 - coalesce(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9)) FOR i IN range(0, k)]), 0), 5) AS tail FROM c""")
def binomial_gate(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    return c.select("user_id", "n", "k", F.round(fn.binomial_tail(F.col("n"), F.col("k"), 0.1), 5).alias("tail"))


@query("phred_math", """SELECT event_id, round(pow(10, -value / 10), 6) AS p, round(greatest(-value / 50, -1) + log10(1 + pow(10, -abs(-value / 50 + 1))) - log10(2), 6) AS lm FROM events""")
def phred_math(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(fn.from_phred(v), 6).alias("p"), F.round(fn.log_mean(-v / 50, F.lit(-1.0)), 6).alias("lm"))


@query("name_normalise", """SELECT p_partkey, translate(regexp_replace('HLA-' || p_brand || '*01:02:03', '^HLA-', ''), '*:', '__') AS name, split_part(p_brand || ':01:02', ':', 1) || ':' || split_part(p_brand || ':01:02', ':', 2) AS two FROM part""")
def name_normalise(spark, sf):
    full = F.concat(F.lit("HLA-"), F.col("p_brand"), F.lit("*01:02:03"))
    return table(spark, sf, "part").select("p_partkey", fn.normal_name(full).alias("name"), fn.two_fields(F.concat("p_brand", F.lit(":01:02"))).alias("two"))


@query("quality_bins", "SELECT CASE WHEN p_size >= 40 THEN 40 WHEN p_size >= 35 THEN 35 WHEN p_size >= 30 THEN 30 WHEN p_size >= 25 THEN 25 WHEN p_size >= 20 THEN 20 WHEN p_size >= 10 THEN 10 WHEN p_size >= 2 THEN 2 ELSE 0 END AS bin, count(*) AS n FROM part GROUP BY 1")
def quality_bins(spark, sf):
    return table(spark, sf, "part").groupBy(fn.quality_bin(F.col("p_size")).alias("bin")).agg(F.count("*").alias("n"))


@query("sequence_complexity", "SELECT item_id, len(list_distinct([substr(text, CAST(i AS INT), 4) FOR i IN range(1, length(text) - 2)])) AS kinds FROM benchmark")
def sequence_complexity(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fn.complexity(F.col("text"), 4).cast("bigint").alias("kinds"))


@query("json_rows", """SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS js FROM events""")
def json_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("js"))


@query("log_scrape", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(regexp_extract(url, '([0-9]+)', 1)) AS digits FROM pages""")
def log_scrape(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.length(F.regexp_extract(url, "([0-9]+)", 1)).cast("bigint").alias("digits"))


@query("props_parse", """SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) // 10 AS k, count(*) AS n FROM events GROUP BY 1""")
def props_parse(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy(F.floor(k / 10).alias("k")).agg(F.count("*").alias("n"))


@query("parity_split", "SELECT l_orderkey, l_linenumber, CASE WHEN (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) % 2 = 1 THEN 'fwd' ELSE 'rev' END AS mate FROM lineitem")
def parity_split(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.row_number().over(w) % 2 == 1, "fwd").otherwise("rev").alias("mate"))
