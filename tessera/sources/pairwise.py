"""Reader of pairwise text alignments: blocks of Query and Sbjct lines under headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.sequence import reverse_complement, run_lengths
from tessera.operators.windowing import join_on, running_total
from tessera.sources.text import numbered_lines

#: The lines that carry something.
QUERY, SUBJECT, SCORE, STRAND = r"^Query=\s*(\S+)", r"^>\s*(\S+)", r"Score\s*=\s*(\S+) bits.*Expect(?:\(\d+\))?\s*=\s*([^\s,]+)", r"Strand\s*=\s*\S+?\s*/\s*(\S+)"
ROW = r"^(Query|Sbjct):?\s+(\d+)\s*(\S+)\s+(\d+)"


def pairwise_alignments(spark: SparkSession, path: str) -> DataFrame:
    """A row per alignment block, as ``sources.text.sam`` has them: qname, flag, rname, pos (from 0), cigar, seq, score, evalue.

    Which query, subject and block a line belongs to are running counts of their
    headers over ranges of lines; a block's rows are its own group. Gaps of the
    query are D, of the subject I; what lies before the first query base is a
    hard clip. On the minus strand the CIGAR and the sequence are turned round.
    """
    lines = numbered_lines(spark, path)
    counted = lines
    for name, pattern in (("q", QUERY), ("s", SUBJECT), ("block", SCORE)):
        counted = running_total(counted, ["file"], "line", F.col("value").rlike(pattern).cast("bigint"), name=name)
    # A long query name goes on alone in the next line.
    heads = counted.where(F.col("value").rlike(QUERY)).select("file", "q", "line", F.regexp_extract("value", QUERY, 1).alias("head"))
    more = counted.where(F.col("value").rlike(r"^[^>\s]\S*$")).select("file", (F.col("line") - 1).alias("line"), F.col("value").alias("more"))
    queries = join_on(heads, more, ["file", "line"], "left").select("file", "q", F.concat("head", F.coalesce("more", F.lit(""))).alias("qname"))
    subjects = counted.where(F.col("value").rlike(SUBJECT)).select("file", "s", F.regexp_extract("value", SUBJECT, 1).alias("rname"))

    part = lambda k: F.regexp_extract("value", ROW, k)
    row = F.when(F.col("value").rlike(ROW), F.struct("line", part(1).alias("side"), part(2).cast("bigint").alias("start"), part(3).alias("bases"), part(4).cast("bigint").alias("end")))
    blocks = counted.where("block > 0").groupBy("file", "block").agg(
        F.min("q").alias("q"), F.min("s").alias("s"), F.sort_array(F.collect_list(row)).alias("rows"),
        F.max(F.when(F.col("value").rlike(SCORE), F.struct(F.regexp_extract("value", SCORE, 1).alias("bits"), F.regexp_extract("value", SCORE, 2).alias("expect")))).alias("head"),
        F.bool_or(F.regexp_extract("value", STRAND, 1) == "Minus").alias("minus"),
    )
    rows = lambda side: F.filter("rows", lambda r: r["side"] == side)
    text = lambda side: F.array_join(F.transform(rows(side), lambda r: r["bases"]), "")
    sides = blocks.where(F.size(rows("Query")) > 0).select(
        "file", "q", "s", "head", "minus", text("Query").alias("a"), text("Sbjct").alias("b"), rows("Query")[0]["start"].alias("qbeg"),
        F.when(F.col("minus"), F.element_at(rows("Sbjct"), -1)["end"]).otherwise(rows("Sbjct")[0]["start"]).alias("pos"),
    )
    letters = lambda c: F.split(F.col(c), "")
    ops = F.zip_with(letters("a"), letters("b"), lambda x, y: F.when(x == "-", "D").when(y == "-", "I").otherwise("M"))
    turned = F.when(F.col("minus"), F.reverse(ops)).otherwise(ops)
    clip = F.when(F.col("qbeg") > 1, F.concat((F.col("qbeg") - 1).cast("string"), F.lit("H"))).otherwise("")
    body = run_lengths(F.array_join(turned, ""))
    seq = F.translate("a", "-", "")
    out = sides.select(
        "file", "q", "s", F.when(F.col("minus"), 16).otherwise(0).alias("flag"), (F.col("pos") - 1).alias("pos"), F.when(F.col("minus"), F.concat(body, clip)).otherwise(F.concat(clip, body)).alias("cigar"),
        F.when(F.col("minus"), reverse_complement(seq)).otherwise(seq).alias("seq"), F.floor(F.col("head.bits").cast("double") + 0.499).alias("score"), F.when(F.startswith("head.expect", F.lit("e")), F.concat(F.lit("1"), "head.expect")).otherwise(F.col("head.expect")).cast("double").alias("evalue"),
    )
    named = join_on(join_on(out, queries, ["file", "q"]), subjects, ["file", "s"])
    return named.select("qname", "flag", "rname", "pos", "cigar", "seq", "score", "evalue")
