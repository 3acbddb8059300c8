"""Operators on variants, alignments and linked fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions.sequence import cigar_ops
from tessera.operators import scan
from tessera.operators.joining import near_join, range_join
from tessera.operators.windowing import merge_ranges
from tessera.storage import settle


def structural(filter_: Column, kind: Column, length: Column, genotype: Column, least: int = 150) -> Column:
    """Passed deletions or insertions of ``least`` bases or more that are carried."""
    return (filter_ == "PASS") & kind.isin("DEL", "INS") & (F.abs(length) >= least) & genotype.isin("0/1", "1/1")


def evaluate(truth: DataFrame, calls: DataFrame, keys: list[str], at: str, distance: int, counted: Column | None = None) -> DataFrame:
    """One row: TP and FN of the truth, FP of the calls, with rates in percent; rows that are not ``counted`` still serve as matches."""
    counted = F.lit(True) if counted is None else counted
    t = truth.where(counted)
    fn = near_join(t, calls, keys, at, distance, "left_anti").agg(F.count("*").alias("fn"))
    fp = near_join(calls.where(counted), truth, keys, at, distance, "left_anti").agg(F.count("*").alias("fp"))
    both = t.agg(F.count("*").alias("t")).join(fn).join(fp).join(calls.where(counted).agg(F.count("*").alias("c")))  # one row each
    rate = lambda a, b: F.round(100 * F.try_divide(F.col(a), F.col(b)), 4)
    return both.select((F.col("t") - F.col("fn")).alias("tp"), "fn", "fp", rate("fn", "t").alias("fnr"), rate("fp", "c").alias("fdr"))


def genotype_from_likelihoods(pl: Column, het_prior: float = 30.0) -> Column:
    """(gt, gq) of the three phred likelihoods of two alleles, hets charged with a prior; gq is the second best less the best."""
    charged = F.transform(pl, lambda x, i: x.cast("double") + F.when(i == 1, het_prior).otherwise(0.0))
    low = F.array_sort(charged)
    names = F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1"))
    return F.struct(F.element_at(names, F.array_position(charged, low[0]).cast("int")).alias("gt"), F.round(low[1] - low[0]).alias("gq"))


def one_per_allele(variants: DataFrame, alts: str, start: str, ref: str) -> DataFrame:
    """A half-open interval row per alternate allele."""
    return variants.select("*", F.posexplode(alts).alias("allele", "alt")).withColumns({"allele": F.col("allele") + 1, "end": F.col(start) + F.length(ref)})


def strata(calls: DataFrame, quality: str, classes: dict[str, Column]) -> DataFrame:
    """Per quality: count of each class, and the counts of all rows of this quality or better."""
    bins = calls.groupBy(quality).agg(*[F.count_if(c).alias(n) for n, c in classes.items()])
    w = Window.orderBy(F.desc(quality)).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct quality
    return bins.select(quality, *classes, *[F.sum(n).over(w).alias(f"cum_{n}") for n in classes])


def support(observations: DataFrame, site: list[str], allele: str, reverse: Column) -> DataFrame:
    """Counts per site and allele, in all and by strand."""
    return observations.groupBy(*site, allele).agg(F.count("*").alias("n"), F.count_if(~reverse).alias("forward"), F.count_if(reverse).alias("backward"))


def consensus(observations: DataFrame, site: list[str], allele: str, least: int) -> DataFrame:
    """Majority allele of each site with ``least`` observations or more; the smaller allele of equals."""
    counts = observations.groupBy(*site, allele).agg(F.count("*").alias("n"))
    return counts.groupBy(*site).agg(F.min(F.struct((-F.col("n")).alias("neg"), allele)).alias("b"), F.sum("n").alias("depth")).where(F.col("depth") >= least).select(*site, F.col(f"b.{allele}").alias(allele), (-F.col("b.neg")).alias("n"), "depth")


def called_alleles(observations: DataFrame, site: list[str], allele: str, base_quality: str, map_quality: str, least: int = 1, least_base: int = 0, least_map: int = 0, seed: int | None = None) -> DataFrame:
    """(site, allele, n, depth) of observations good enough: the majority allele, or with ``seed`` that of one observation drawn by a hash of the site and its number."""
    good = observations.where((F.col(base_quality) >= least_base) & (F.col(map_quality) >= least_map))
    if seed is None:
        return consensus(good, site, allele, least)
    counts = good.groupBy(*site, allele).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*site).orderBy(allele)
    drawn = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in site])), F.lit(8)), 16, 10).cast("bigint")
    runs = counts.withColumns({"__end": F.sum("n").over(by), "depth": F.sum("n").over(Window.partitionBy(*site))}).withColumn("__d", drawn % F.col("depth"))
    return runs.where((F.col("depth") >= least) & (F.col("__d") < F.col("__end")) & (F.col("__d") >= F.col("__end") - F.col("n"))).select(*site, allele, "n", "depth")


def accepted(variants: DataFrame, chrom: Column, depth: Column, quality: float, least_depth: float, longest: int = 150, excluded: DataFrame | None = None) -> DataFrame:
    """Variants (chrom, pos, ref, alts, qual) of one sequence with a known quality, depth by the caller's mode, alleles of ``longest`` bases at most, outside of ``excluded`` (chrom, start, end)."""
    short = (F.length("ref") <= longest) & F.forall("alts", lambda a: F.length(a) <= longest)
    rows = variants.where(chrom & F.col("qual").isNotNull() & (F.col("qual") >= quality) & (depth >= F.greatest(F.lit(least_depth), F.lit(1))) & short)
    return rows if excluded is None else range_join(rows, excluded, ["chrom"], "pos", "start", "end", 64, "left_anti")


def override_by_base(alleles: DataFrame, rules: DataFrame, calls: DataFrame, key: str, allele: str) -> DataFrame:
    """``alleles`` with those that a rule (allele, site, base, to) names replaced where the key's call at the rule's site (key, site, base) is the rule's base; of several rules the first by site."""
    # A key's alleles and calls first, both dealt by key: rules are many for an allele, and most name sites that the key has no call of.
    own = alleles.select(key, F.col(allele).alias("allele")).repartition(key).distinct()
    hit = own.join(calls.select(key, "site", "base"), key).join(settle(rules), ["allele", "site", "base"])
    first = hit.groupBy(key, "allele").agg(F.min(F.struct("site", "to")).alias("r")).select(key, F.col("allele").alias(allele), F.col("r.to").alias("__to"))
    return alleles.join(first, [key, allele], "left").select(*[F.coalesce("__to", allele).alias(allele) if c == allele else F.col(c) for c in alleles.columns])


def informative(fragments: DataFrame, name: str, site: str, least: int = 2) -> DataFrame:
    """Fragments that cover ``least`` different sites or more."""
    return fragments.groupBy(name).agg(F.count_distinct(site).alias("sites")).where(F.col("sites") >= least)


def consistent(observations: DataFrame, name: str, block: str, side: str, support_share: float = 0.65, block_share: float = 0.65) -> DataFrame:
    """Fragments of whose phase blocks more than ``block_share`` have ``support_share`` of their sites on one side."""
    per_block = observations.groupBy(name, block).agg(F.avg(F.col(side).cast("double")).alias("m"))
    clear = F.avg(F.when(F.greatest(F.col("m"), 1 - F.col("m")) >= support_share, 1.0).otherwise(0.0))
    return per_block.groupBy(name).agg(clear.alias("share")).where(F.col("share") > block_share)


def mates(reads: DataFrame, name: str, first: Column, columns: list[str]) -> DataFrame:
    """Both mates of a name in one row; of several firsts (or seconds) the smallest."""
    side = lambda test, tag: F.min(F.when(test, F.struct(*columns))).alias(tag)
    return reads.groupBy(name).agg(side(first, "r1"), side(~first, "r2")).where("r1 is not null and r2 is not null")


def membership(sources: dict[str, DataFrame], key: str, start: str, end: str) -> DataFrame:
    """Segments with the pattern of sources that cover them (one character a source), by a sweep."""
    rows = reduce(DataFrame.unionByName, [d.select(key, F.lit(i).alias("__src"), start, end) for i, d in enumerate(sources.values())])
    ends = rows.select(key, "__src", F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    events = ends.groupBy(key, F.col("x.at").alias("at")).agg(*[F.sum(F.when(F.col("__src") == i, F.col("x.d")).otherwise(0)).alias(f"d{i}") for i in range(len(sources))])
    w = Window.partitionBy(key).orderBy("at")
    pattern = F.concat(*[F.when(F.sum(f"d{i}").over(w) > 0, "1").otherwise("0") for i in range(len(sources))])
    parts = events.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), pattern.alias("pattern"))
    return parts.where("end is not null").where(F.contains("pattern", F.lit("1")))


def apply_variants(reference: DataFrame, variants: DataFrame, chrom: str, seq: str) -> DataFrame:
    """Sequences with (pos, ref, alt) put in, last first so that places stay right; variants must not overlap."""
    lists = variants.groupBy(chrom).agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt")), asc=False).alias("v"))
    put = F.aggregate(F.coalesce("v", F.array().cast("array<struct<pos:bigint,ref:string,alt:string>>")), F.col(seq), lambda s, x: F.overlay(s, x["alt"], (x["pos"] + 1).cast("int"), F.length(x["ref"])))
    return reference.join(lists.select(chrom, F.transform("v", lambda x: F.struct(x["pos"].cast("bigint").alias("pos"), x["ref"].alias("ref"), x["alt"].alias("alt"))).alias("v")), chrom, "left").select(chrom, put.alias(seq))


def homopolymers(seq: Column, least: int) -> Column:
    """Lengths of runs of one letter of ``least`` or more, in order."""
    return F.transform(F.regexp_extract_all(seq, F.lit(rf"((\S)\2{{{least - 1},}}+)"), F.lit(1)), lambda r: F.length(r))


def best_quality_span(qual: Column, limit: float = 0.05, least: int = 30) -> Column:
    """(start, end) of the stretch with the greatest sum of ``limit`` - error probability (quality 3 at least); where that is
    shorter than ``least``, the ``least`` bases of the greatest summed quality; all of a string that is no longer than that."""
    q = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    n = F.length(qual)
    start = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in (("i", 0, "int"), ("run", 0.0, "double"), ("begin", 0, "int"), ("best", 0.0, "double"), ("s", 0, "int"), ("e", least, "int"))])

    def step(a: Column, x: Column) -> Column:
        run = a["run"] + (limit - F.pow(F.lit(10.0), -F.greatest(x, F.lit(3)) / 10))
        better, lost, i = run > a["best"], run < 0, a["i"] + 1
        pick = lambda test, new, old: F.when(test, new).otherwise(old)
        return F.struct(i.alias("i"), pick(lost, F.lit(0.0), run).alias("run"), pick(lost, i, a["begin"]).alias("begin"), pick(better, run, a["best"]).alias("best"), pick(better, a["begin"], a["s"]).alias("s"), pick(better, i, a["e"]).alias("e"))

    stretch = F.aggregate(q, start, step, lambda a: F.struct(a["s"].alias("start"), a["e"].alias("end")))
    total = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + x)
    first = total(F.slice(q, 1, least))
    # Windows by the place of their first base, the sum carried along.
    window = F.struct(first.alias("sum"), first.alias("best"), F.lit(0).alias("at"))

    def slide(a: Column, i: Column) -> Column:
        now = a["sum"] + F.element_at(q, i + least) - F.element_at(q, i)
        return F.struct(now.alias("sum"), F.greatest(now, a["best"]).alias("best"), F.when(now > a["best"], i).otherwise(a["at"]).alias("at"))

    best = F.aggregate(F.sequence(F.lit(1), n - least), window, slide, lambda a: F.struct(a["at"].alias("start"), (a["at"] + least).alias("end")))
    return F.when(n <= least, F.struct(F.lit(0).alias("start"), n.alias("end"))).when(stretch["end"] - stretch["start"] >= least, stretch).otherwise(best)


def grown_regions(df: DataFrame, key: str, start: str, end: str, size: int, gap: int) -> DataFrame:
    """(key, s, e, bases): regions that take intervals in order until they hold more than ``size`` bases and the next lies more than ``gap`` away.

    What lies no more than ``gap`` apart is one region whatever its size, and is
    merged over ranges first; only such pieces are scanned in order.
    """
    picked = df.select(key, F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).withColumn("bases", F.col("e") - F.col("s"))
    pieces = merge_ranges(picked.withColumn("e", F.col("e") + gap + 1), key, "s", "e", sums=("bases",)).withColumn("e", F.col("e") - gap - 1)
    schema = StructType([picked.schema[key], *(StructField(c, LongType()) for c in ("s", "e", "bases"))])
    return scan.scan_keys(pieces, [key], ["s"], ["s", "e", "bases"], scan.gathered(size), schema)


def keep_best_of_overlaps(df: DataFrame, key: str, start: str, end: str, score: str) -> DataFrame:
    """(key, s, e, q): rows in order, of two neighbours that overlap the better (the earlier of equals)."""
    picked = df.select(key, F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"), F.col(score).cast("double").alias("q"))
    return scan.scan_keys(picked, [key], ["s", "e", "q"], ["s", "e", "q"], scan.best_of_overlaps, picked.schema)


def clip_breakpoints(df: DataFrame, cigar: str, pos: str, least: int = 150) -> DataFrame:
    """(…, op, at, length): clips, insertions and deletions of ``least`` bases or more with their place on the reference."""
    kind = "array<struct<op:string,at:bigint,length:bigint>>"
    begin = F.struct(F.col(pos).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        n = p["n"]
        hit = F.struct(p["op"].alias("op"), a["at"].alias("at"), n.alias("length"))
        return F.struct((a["at"] + F.when(p["op"].isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("at"), F.when(p["op"].isin("S", "H", "I", "D") & (n >= least), F.array_append(a["out"], hit)).otherwise(a["out"]).cast(kind).alias("out"))

    return df.select("*", F.explode(F.aggregate(cigar_ops(F.col(cigar)), begin, step, lambda a: a["out"])).alias("x")).select(*df.columns, "x.*")


#: Positions of a bin in which the samples' records meet.
SITE_BIN = 64


def flatten_samples(variants: DataFrame, sample: str, chrom: str, pos: str, ref: str, alts: str, gt: str) -> DataFrame:
    """(sample, chrom, pos, ref, alt, gt): a row for each base in which a sample's phased alleles differ from the reference, alleles numbered by the site.

    ``alts`` is an array, ``gt`` like ``0|1``. An allele is compared base by base as
    far as all alleles of the record reach. A site's alleles are those of all
    samples, in the order of samples; where a sample's second-listed allele is
    meant, ``alt`` lists both and ``gt`` counts by the site.
    """
    one, two = F.get(alts, F.lit(0)), F.get(alts, F.lit(1))
    both = F.contains(gt, F.lit("2"))
    reach = F.least(F.length(ref), F.length(one), F.when(both, F.length(two)))
    bin_ = lambda c: F.floor(c / SITE_BIN)
    cut = lambda c: F.substr(c, (F.col("__from") - F.col("__p") + 1).cast("int"), F.col("__n").cast("int"))
    at = lambda c: F.substr(F.col(c), F.col("__i"), F.lit(1))
    records = variants.where(reach > 0).select(sample, chrom, F.col(pos).alias("__p"), F.col(gt).alias("__g"), both.alias("two"), F.col(ref).alias("__r"), one.alias("__a"), F.when(both, two).otherwise(one).alias("__b"), reach.alias("__reach"))
    pieces = records.select("*", F.explode(F.sequence(bin_(F.col("__p")), bin_(F.col("__p") + F.col("__reach") - 1))).alias("__bin")).withColumn("__from", F.greatest(F.col("__p"), F.col("__bin") * SITE_BIN))
    pieces = pieces.withColumn("__n", F.least(F.col("__p") + F.col("__reach"), (F.col("__bin") + 1) * SITE_BIN) - F.col("__from"))
    pieces = pieces.select(sample, chrom, "__p", "__g", "two", "__bin", "__from", "__n", *(cut(F.col(c)).alias(c) for c in ("__r", "__a", "__b"))).where("__a <> __r or __b <> __r")
    # Records are dealt once, by bins of positions, and become bases where they arrive.
    spread = pieces.repartition(chrom, "__bin").select("*", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i"))
    rows = spread.select(sample, chrom, "__bin", "__p", "__g", "two", (F.col("__from") + F.col("__i") - 1).alias("pos"), at("__r").alias("r"), at("__a").alias("a"), at("__b").alias("b")).where("a <> r or b <> r")
    # Which alleles remain at this base, and the genotype in them.
    g = F.when(~F.col("two"), F.col("__g")).when(F.col("a") == F.col("b"), "1|1").when(F.col("b") == F.col("r"), F.translate("__g", "2", "0")).when(F.col("a") == F.col("r"), F.translate("__g", "12", "01")).otherwise(F.col("__g"))
    pair = (F.col("a") != F.col("b")) & (F.col("b") != F.col("r")) & (F.col("a") != F.col("r"))
    first = F.when((F.col("a") == F.col("r")) & (F.col("b") != F.col("r")), F.col("b")).otherwise(F.col("a"))
    bases = rows.where(F.col(chrom).isNotNull()).select(sample, chrom, "__bin", "pos", "__p", F.col("r").alias("ref"), first.alias("x"), F.when(pair, F.col("b")).alias("y"), g.alias("gt"))
    fields = [bases.schema[c] for c in (chrom, "__bin", "pos", sample, "ref")] + [StructField(c, StringType()) for c in ("alt", "gt")]
    made = scan.scan_keys(bases, [chrom, "__bin"], ["pos", sample, "__p", "x", "y"], ["pos", sample, "__p", "ref", "x", "y", "gt"], scan.numbered_by_site, StructType(fields), dealt=True)
    return made.select(sample, chrom, "pos", "ref", "alt", "gt")
