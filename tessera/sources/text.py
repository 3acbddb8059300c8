"""Readers of line formats. Intervals become 0-based and half-open here, whatever the file says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.alignments import overlapping
from tessera.operators.windowing import running_total

BLAST6 = "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
PAF = "qname string, qlen int, qstart int, qend int, strand string, tname string, tlen int, tstart int, tend int, matches int, block int, mapq int"


def _tsv(spark: SparkSession, path: str, schema: str, comment: str | None = "#", header: bool = False, sep: str = "\t") -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number from 0 within the file.

    Rows keep their file order inside a partition; the first line of each
    partition comes from a running total over one row per partition.
    """
    order = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), order.alias("id"), "value")
    part = F.shiftright("id", 33)
    counts = lines.groupBy("file", part.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    w = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", "part", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    return lines.withColumn("part", part).join(bases, ["file", "part"]).select("file", (F.col("id") - F.col("first") + F.col("base")).alias("line"), "value")


def read_name(header: Column) -> Column:
    """Name without ``@`` and without ``/1`` or ``/2``."""
    return F.regexp_replace(F.split(F.regexp_replace(header, "^@", ""), r"\s")[0], "/[12]$", "")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of plain or gzipped FASTQ; four lines are a record."""
    lines = numbered_lines(spark, path).withColumns({"record": F.floor(F.col("line") / 4), "k": F.col("line") % 4})
    field = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return lines.groupBy("file", "record").agg(read_name(field(0)).alias("name"), field(1).alias("seq"), field(3).alias("qual")).select("name", "seq", "qual")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq); a record begins at a line that begins with ``>``, lines before the first are left out."""
    head = F.startswith("value", F.lit(">"))
    lines = running_total(numbered_lines(spark, path), ["file"], "line", head.cast("bigint"), name="record").where("record > 0")
    title = F.max(F.when(head, F.rtrim(F.translate("value", "\r", " "))))
    body = F.sort_array(F.collect_list(F.when(~head, F.struct("line", F.regexp_replace("value", r"\s", "").alias("part")))))
    records = lines.groupBy("file", "record").agg(title.alias("title"), F.array_join(F.transform(body, lambda x: x["part"]), "").alias("seq"))
    return records.select(F.regexp_extract("title", r"^>(\S*)", 1).alias("name"), F.trim(F.regexp_extract("title", r"^>\S*\s?(.*)$", 1)).alias("description"), "seq")


def first_of_each(entries: Column) -> Column:
    """A map of (key, value) entries; of a key that is repeated the first entry counts."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def region(text: Column) -> Column:
    """``chr:start-end`` (1-based, closed) as (chrom, start, end), half-open; without a range all of it."""
    m = lambda k: F.regexp_extract(text, r"^([^:]+)(?::(\d+)-(\d+))?$", k)
    return F.struct(m(1).alias("chrom"), (m(2).try_cast("bigint") - 1).alias("start"), m(3).try_cast("bigint").alias("end"))


def fetch(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """Subsequences of (chrom, start, end) regions."""
    named = sequences.select(F.col("name").alias("chrom"), "seq")
    return regions.join(named, "chrom").select("chrom", "start", "end", F.substr("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with flags, CIGAR and tags; header lines (``@XX`` and a tab) are dropped, ``pos`` is 0-based."""
    f = F.split("value", "\t")
    tags = first_of_each(F.transform(F.slice(f, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.regexp_replace(t, "^..:.:", "").alias("value"))))
    return spark.read.text(path).where(~F.col("value").rlike("^@[A-Z]{2}\t")).where(F.size(f) >= 11).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[6].alias("rnext"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags")
    )


def paf(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, PAF, comment=None).withColumn("identity", F.round(F.col("matches") / F.col("block"), 6))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row per record and sample column 1: alleles, quality, INFO as map, FORMAT fields as map, genotype and phase set."""
    f = F.split("value", "\t")
    info = F.transform(F.split("info", ";"), lambda x: F.struct(F.split(x, "=")[0].alias("key"), F.get(F.split(x, "=", 2), F.lit(1)).alias("value")))
    rows = spark.read.text(path).where("value not like '#%'").where(F.size(f) >= 8).select(
        f[0].alias("chrom"), (f[1].cast("int") - 1).alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), f[5].try_cast("double").alias("qual"), f[6].alias("filter"), f[7].alias("info"),
        F.when(F.size(f) >= 10, first_of_each(F.transform(F.split(f[8], ":"), lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get(F.split(F.get(f, F.lit(9)), ":"), i), F.lit("")).alias("value"))))).alias("fields"),
    )
    gt = F.col("fields")["GT"]
    return rows.withColumns({
        "info": first_of_each(info), "gt": F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int")), "phased": F.contains(gt, F.lit("|")),
        "ad": F.transform(F.split(F.col("fields")["AD"], ","), lambda a: a.try_cast("int")), "ps": F.coalesce(F.col("fields")["PS"].try_cast("int"), F.lit(0)),
    })


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alts, sample, gt, phased, ad, dp, ps): a row per record and sample, the samples' names from the header line."""
    lines = spark.read.text(path)
    head = lines.where("value like '#CHROM%'").first()
    names = head["value"].split("\t")[9:] if head else []
    f, keys = F.split("value", "\t"), F.split(F.col("format"), ":")
    rows = lines.where("value not like '#%'").where(F.size(f) >= 9 + len(names)).select(f[0].alias("chrom"), (f[1].cast("int") - 1).alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), f[8].alias("format"), F.explode(F.array(*[F.struct(F.lit(n).alias("sample"), f[9 + i].alias("v")) for i, n in enumerate(names)])).alias("s"))
    # Trailing fields may be left out: they are null.
    field = lambda k: F.get(F.split("s.v", ":"), (F.array_position(keys, k) - 1).cast("int"))
    numbers = lambda c: F.transform(F.split(c, ","), lambda a: a.try_cast("int"))
    gt = field("GT")
    return rows.select("chrom", "pos", "ref", "alts", F.col("s.sample").alias("sample"), F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int")).alias("gt"), F.contains(gt, F.lit("|")).alias("phased"), numbers(field("AD")).alias("ad"), field("DP").try_cast("int").alias("dp"), F.coalesce(field("PS").try_cast("int"), F.lit(0)).alias("ps"))


def blast(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, BLAST6)


def depth(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, pos int, depth int").withColumn("pos", F.col("pos") - 1)


def bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, start bigint, end bigint, name string")


def contig_index(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "name string, length bigint, offset bigint, bases int, width int").select("name", "length")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Linked-site fragments: (name, kind, barcode, mate, insert, site, allele, quality), one row per site; sites are 0-based.

    A line is ``n name [more fields] start alleles start alleles ... qualities``; how many more fields a dialect has follows from the length of the line.
    Of three more the first is the kind: 1 (mate pairs over long ranges) is followed by the mate's first site and the insert size, 2 (linked reads) by the barcode.
    """
    f = F.split(F.trim("value"), r"\s+")
    n = f[0].cast("int")
    head = F.size(f) - 2 * n - 1
    extra = lambda k: F.when(head >= 5, F.get(f, F.lit(k)))
    kind = extra(2).try_cast("int")
    facts = [kind.alias("kind"), F.when(kind == 2, extra(3)).alias("barcode"), F.when(kind == 1, extra(3).try_cast("int") - 1).alias("mate"), F.when(kind == 1, extra(4).try_cast("int")).alias("insert")]
    lines = spark.read.text(path).where("trim(value) <> ''").select(f[1].alias("name"), *facts, F.slice(f, head + 1, n * 2).alias("runs"), F.element_at(f, head + n * 2 + 1).alias("quals"), n.alias("n"))
    sites = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.transform(F.split(F.get("runs", i * 2 + 1), ""), lambda c, j: F.struct((F.get("runs", i * 2).cast("int") - 1 + j).alias("site"), c.alias("allele")))))
    facts = ["name", "kind", "barcode", "mate", "insert"]
    return lines.select(*facts, "quals", F.posexplode(sites).alias("k", "s")).select(*facts, "s.site", F.col("s.allele").try_cast("int").alias("allele"), (F.ascii(F.substr("quals", F.col("k") + 1, F.lit(1))) - 33).alias("quality"))


def matrix_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, same, other, w00, w01, w10, w11): site pairs with a weight for each pair of alleles, and the summed weight of equal and of different ones; sites are 0-based."""
    f = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(path).where(F.size(f) >= 6).select((f[0].cast("bigint") - 1).alias("a"), (f[1].cast("bigint") - 1).alias("b"), *(f[i].cast("double").alias(n) for i, n in enumerate(("w00", "w01", "w10", "w11"), 2)))
    return pairs.select("a", "b", (F.col("w00") + F.col("w11")).alias("same"), (F.col("w01") + F.col("w10")).alias("other"), "w00", "w01", "w10", "w11")


def dimension(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Frequency, nomenclature and allele lists."""
    return _tsv(spark, path, schema, header=header, sep=sep)


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), "[ \t]+")
    names = ("family", "id", "dad", "mom", "sex", "phenotype")
    return spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])


def trios(people: DataFrame) -> DataFrame:
    """(child, mom, dad) of which all three are listed."""
    ids = people.select("id")
    known = people.select(F.col("id").alias("child"), "mom", "dad").join(ids.withColumnRenamed("id", "mom"), "mom", "left_semi")
    return known.join(ids.withColumnRenamed("id", "dad"), "dad", "left_semi").select("child", "mom", "dad")


def breakpoints(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """Breakpoints whose ends are on one sequence, without those that touch an excluded (chrom, start, end)."""
    rows = _tsv(spark, path, "chrom string, start bigint, strand string, chrom2 string, end bigint, strand2 string, seq string").where("chrom = chrom2")
    if excluded is None:
        return rows
    return overlapping(rows, excluded, ["chrom"], "start", "end", 1 << 13, "left_anti")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``key=value`` lines."""
    return spark.read.text(path).where("value not like '#%' and value like '%=%'").select(F.trim(F.regexp_extract("value", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("value"))


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "position bigint, rate double, cm double", header=True, sep=" ")


def time_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, cpu_hours, peak_gb) scraped from the logs of the time command."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    user, system, peak = number(r"User time \(seconds\): ([0-9.]+)"), number(r"System time \(seconds\): ([0-9.]+)"), number(r"Maximum resident set size \(kbytes\): ([0-9]+)")
    return logs.select("file", F.round((user + system) / 3600, 6).alias("cpu_hours"), F.round(peak / 1024 / 1024, 6).alias("peak_gb"))


def allele_calls(spark: SparkSession, path: str) -> DataFrame:
    """Diploid calls with a column for each allele, as ``vcf`` rows: chrom, pos, ref, alts, qual, dp, ad (reference, alternate reads), gt, gq.

    Fixed places of the tab separated columns: 2 sequence, 3 begin, 5 zygosity,
    6 kind, 7 reference, 8 and 9 alleles (``?`` unknown), 10 and 11 their scores,
    21 and 22 their reads, 24 all reads. Lines that are no calls, or that say
    reference, go; alleles of unequal lengths get an ``N`` before them.
    """
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").rlike("^[0-9]") & (F.size(f) > 24)).select(f.alias("f")).where("f[5] <> 'no-call' and f[6] <> 'ref'")
    uneven = (F.length(F.col("f")[7]) != F.length(F.col("f")[8])) | (F.length(F.col("f")[7]) != F.length(F.col("f")[9]))
    allele = lambda i: F.when(uneven & (F.col("f")[i] != "?"), F.concat(F.lit("N"), F.col("f")[i])).otherwise(F.col("f")[i])
    number = lambda i: F.coalesce(F.col("f")[i].try_cast("int"), F.lit(0))
    named = rows.select(F.col("f")[2].alias("chrom"), number(3).alias("pos"), allele(7).alias("ref"), allele(8).alias("a"), allele(9).alias("b"), number(10).alias("qa"), number(11).alias("qb"), number(21).alias("ra"), number(22).alias("rb"), number(24).alias("dp"))
    known_a, known_b = F.col("a") != "?", F.col("b") != "?"
    other_a, other_b = known_a & (F.col("a") != F.col("ref")), known_b & (F.col("b") != F.col("ref"))
    alts = F.array_distinct(F.array_compact(F.array(F.when(other_a, F.col("a")), F.when(other_b, F.col("b")))))
    when = lambda t, c: F.when(t, F.col(c)).otherwise(0)
    # Reads of an allele that both say are counted once.
    alternate = when(other_a & ~(other_b & (F.col("a") == F.col("b"))), "ra") + when(other_b, "rb")
    place = lambda known, c: F.when(known, F.when(F.col(c) == F.col("ref"), 0).otherwise(F.array_position(alts, F.col(c))).cast("int"))
    gt = F.when(known_a & known_b, F.array_sort(F.array(place(known_a, "a"), place(known_b, "b")))).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))
    return named.where(known_a | known_b).select("chrom", "pos", "ref", alts.alias("alts"), F.greatest(when(other_a, "qa"), when(other_b, "qb")).cast("double").alias("qual"), "dp", F.array(when(known_a & ~other_a, "ra") + when(known_b & ~other_b, "rb"), alternate).alias("ad"), gt.alias("gt"), F.least("qa", "qb").alias("gq"))
