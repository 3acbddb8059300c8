"""Writers of line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windowing import pack_runs


def fastq_record(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_fastq(reads: DataFrame, path: str, by: str | None = None) -> None:
    """Gzipped FASTQ, one folder per value of ``by``."""
    rows = reads.select(*([by] if by else []), fastq_record(F.col("name"), F.col("seq"), F.col("qual")).alias("value"))
    writer = rows.write.option("compression", "gzip")
    (writer.partitionBy(by) if by else writer).text(path)


def constant_quality(sequences: DataFrame, quality: int = 40) -> DataFrame:
    """FASTA rows as reads of one quality."""
    return sequences.select("name", "seq", F.repeat(F.lit(chr(33 + quality)), F.length("seq")).alias("qual"))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")).write.text(path)


def write_bed(spans: DataFrame, path: str) -> None:
    spans.select("chrom", "start", "end").orderBy("chrom", "start", "end").write.option("sep", "\t").csv(path)


def info_text(info: Column) -> Column:
    """The INFO column of a map; a flag has no value."""
    return F.coalesce(F.nullif(F.array_join(F.transform(F.map_entries(info), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"), F.lit("")), F.lit("."))


def write_vcf(variants: DataFrame, path: str, sample: str) -> None:
    """Records with genotype and phase set, ascending; headers go into a first line of their own file order.

    ``id``, ``filter``, ``info`` (a map) and ``fields`` (the sample's, a map) are
    carried over where ``variants`` has them; GT and PS come from their columns.
    """
    own = lambda c, other, text=F.col: text(F.col(c) if text is info_text else c) if c in variants.columns else F.lit(other)
    alleles = F.transform("gt", lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    gt = F.when(F.col("phased"), F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))
    others = F.map_entries(F.map_filter("fields", lambda k, v: ~k.isin("GT", "PS"))) if "fields" in variants.columns else F.array()
    listed = lambda part: F.transform(others, lambda e: e[part]) if "fields" in variants.columns else F.array().cast("array<string>")
    keys, values = (F.coalesce(listed(p), F.array().cast("array<string>")) for p in ("key", "value"))
    fields = F.array_join(F.concat(F.array(F.lit("GT")), keys, F.array(F.lit("PS"))), ":"), F.array_join(F.concat(F.array(gt), values, F.array(F.col("ps").cast("string"))), ":")
    value = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), own("id", "."), "ref", F.array_join("alts", ","), F.coalesce(F.col("qual").cast("string"), F.lit(".")), own("filter", "PASS"), own("info", ".", info_text), *fields)
    head = variants.sparkSession.createDataFrame([("##fileformat=VCFv4.2", -2), (f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}", -1)], "value string, pos int")
    rows = head.select(F.lit("").alias("chrom"), "pos", "value").unionByName(variants.select("chrom", F.col("pos").cast("int").alias("pos"), value.alias("value")))
    rows.orderBy("chrom", "pos").select("value").write.text(path)


def write_fragments(sites: DataFrame, path: str) -> None:
    """Fragments as runs of neighbouring sites, ``start:length`` each."""
    pack_runs(sites, "name", "site").select(F.concat_ws(" ", "name", "runs").alias("value")).write.text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Reports and metrics: delimited text with a header."""
    rows.write.option("sep", sep).option("header", True).csv(path)


def write_frequencies(rows: DataFrame, path: str, sites: int) -> None:
    """(file, freq) lines and a last one that gives the number of heterozygous sites."""
    lines = rows.select(F.lit(0).alias("i"), F.concat_ws(" ", "file", F.round("freq", 6).cast("string")).alias("value"))
    tail = rows.sparkSession.createDataFrame([(1, f"# The number of heterozygous variants is {sites}")], "i int, value string")
    lines.unionByName(tail).orderBy("i", "value").select("value").write.text(path)


#: Columns of the copy-number report.
COPY_REPORT = ("sample", "gene", "first", "second", "freq1", "freq2", "sites", "purity", "ploidy", "copies1", "copies2", "loss")


def write_copies(rows: DataFrame, path: str) -> None:
    """The report of haplotype copies, one line a sample and gene."""
    rows.select(*COPY_REPORT).orderBy("sample", "gene").write.option("sep", "\t").option("header", True).csv(path)
