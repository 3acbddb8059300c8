"""Set operations between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import reverse_complement


def algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(part, key): keys in both, only the first and only the second. One aggregation gives all three."""
    side = a.select(key, F.lit(1).alias("s")).union(b.select(key, F.lit(2)))
    flags = side.groupBy(key).agg(F.bool_or(F.col("s") == 1).alias("a"), F.bool_or(F.col("s") == 2).alias("b"))
    return flags.select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("part"), key)


def kmer_positions(df: DataFrame, key: str, seq: str, k: int, canonical) -> DataFrame:
    """(key, at, kmer): the canonical form of the k-mer at each position of a sequence."""
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    rows = df.where(F.length(seq) >= k).select(key, F.posexplode(F.transform(starts, lambda i: F.substr(F.col(seq), i, F.lit(k)))).alias("at", "__k"))
    return rows.select(key, F.col("at").cast("bigint").alias("at"), canonical(F.col("__k")).alias("kmer"))


def sequence_difference(first: DataFrame, second: DataFrame, key: str, seq: str, k: int, canonical=None, least: int = 2) -> DataFrame:
    """(key, start, end, kmers): stretches of the first collection's sequences that only k-mers cover which it holds ``least`` times or more and the second nowhere.

    ``canonical``: the form in which both strands of a k-mer are equal, by default
    the lesser of it and its reverse complement.
    """
    canonical = canonical or (lambda c: F.least(c, reverse_complement(c)))
    own = kmer_positions(first, key, seq, k, canonical)
    counts = own.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("kmer")
    other = kmer_positions(second, key, seq, k, canonical).select("kmer")
    novel = own.join(counts.join(other, "kmer", "left_anti"), "kmer")
    w = Window.partitionBy(key).orderBy("at")
    # Covered positions run on while the next k-mer begins where the last one ends, at the latest.
    marked = novel.withColumn("__new", F.when(F.col("at") - F.lag("at").over(w) <= k, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    return marked.groupBy(key, "__g").agg(F.min("at").alias("start"), (F.max("at") + k).alias("end"), F.count("*").alias("kmers")).drop("__g")


def unique_to_one(df: DataFrame, element: str, group: str) -> DataFrame:
    """Elements seen in exactly one group, with that group; min and max agree, so no distinct count is needed."""
    ends = df.groupBy(element).agg(F.min(group).alias(group), F.max(group).alias("__hi"))
    return ends.where(F.col(group) == F.col("__hi")).drop("__hi")
