"""Operators on alignments: regions, views, conversions, checks, coordinates."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import cigar_ops, ops_length, reverse_complement
from tessera.operators.aggregating import exact_percentiles
from tessera.operators.binning import COMPARE, property_filter
from tessera.operators.joining import bins, span_level

#: Flag bits: paired, unmapped, reverse, first, second, secondary, failed, duplicate, supplementary.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 128, 256, 512, 1024, 2048
#: Operations that take up reference, and read, bases.
ON_REFERENCE, ON_READ = "MDN=X", "MIS=X"


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def overlapping(rows: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, width: int, how: str = "left_semi") -> DataFrame:
    """Rows whose half-open span meets one of ``spans`` (same columns), or with ``left_anti`` those whose does not.

    Only the distinct spans of both sides are cut into bins and compared;
    repeated rows are all kept or all dropped. A pair meets in bins of the level
    of its longer span, so each side is cut once for its own level and once for
    each higher one that the other side has.
    """
    def levelled(df: DataFrame) -> DataFrame:
        return df.select(*keys, start, end).where(F.col(start) < F.col(end)).distinct().withColumn("__level", span_level(start, end, width))

    sides = levelled(rows), levelled(spans)
    # One number a level, and few levels: the logarithm of the longest span.
    levels = [sorted(r[0] for r in side.select("__level").distinct().collect()) for side in sides]

    def binned(side: int, mark: str) -> DataFrame:
        mine, others = F.col("__level"), levels[1 - side]
        at = F.array_distinct(F.concat(F.when(mine >= min(others, default=0), F.array(mine)).otherwise(F.array().cast("array<int>")), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda v: v > mine)))
        cut = sides[side].withColumn("__at", F.explode(at)).withColumn("__bin", F.explode(bins(start, end, F.col("__at"), width)))
        return cut.select(*(F.col(c).alias(f"{mark}{c}") for c in [*keys, start, end, "__at", "__bin"]))

    equal = [F.col(k) == F.col(f"__o_{k}") for k in [*keys, "__at", "__bin"]]
    meet = reduce(Column.__and__, equal) & (F.col(start) < F.col(f"__o_{end}")) & (F.col(end) > F.col(f"__o_{start}"))
    hit = binned(0, "").join(binned(1, "__o_"), meet, "left_semi").select(*keys, start, end).distinct()
    return rows.join(hit, [*keys, start, end], how)


def overlap_states(rows: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """(state, n): rows whose key has no span (``absent``), that meet a span (``overlap``) or none (``apart``)."""
    known = rows.join(spans.select(*keys).distinct(), keys, "left_semi")
    met = overlapping(known, spans, keys, start, end, width)
    counts = reduce(DataFrame.union, [d.agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, d in enumerate((rows, known, met))])
    of = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    states = F.array(*[F.struct(F.lit(s).alias("state"), n.alias("n")) for s, n in (("absent", of(0) - of(1)), ("overlap", of(2)), ("apart", of(1) - of(2)))])
    return counts.agg(states.alias("s")).select(F.inline("s"))


def sampled(name: Column, rate: float, seed: int = 0) -> Column:
    """Whether a name (text or number) is in a sample of ``rate``, by the first 32 bits of the MD5 of seed and name; rows of a name go together."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name.cast("string")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") < F.lit(rate * (1 << 32))


def to_bed(rows: DataFrame) -> DataFrame:
    """(chrom, start, end, name, score, strand, divergence) of mapped alignments: the span from the CIGAR, NM per aligned base."""
    ops = cigar_ops(F.col("cigar"))
    mapped = rows.where(~has(F.col("flag"), UNMAPPED)).withColumn("__ops", ops)
    return mapped.select(
        F.col("rname").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + ops_length(F.col("__ops"), ON_REFERENCE)).alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"),
        F.when(has(F.col("flag"), REVERSE), "-").otherwise("+").alias("strand"), F.round(F.col("nm") / ops_length(F.col("__ops"), "MID=X"), 6).alias("divergence"),
    )


def to_reads(rows: DataFrame) -> DataFrame:
    """(name, seq, qual) of primary alignments as they were read: reverse strands turned back, mates named ``/1`` and ``/2``."""
    flag = F.col("flag")
    turn = has(flag, REVERSE)
    mate = F.shiftright(flag, 6).bitwiseAND(F.lit(3))
    primary = rows.where(flag.bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0)
    return primary.select(F.when(mate > 0, F.concat_ws("/", "qname", mate.cast("string"))).otherwise(F.col("qname")).alias("name"), F.when(turn, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turn, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def to_sam(rows: DataFrame) -> DataFrame:
    """The eleven columns of each alignment as a text line, positions from 1; those of the mate (``rnext``, ``mate_pos``, ``insert_size``) where ``rows`` has them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    mate = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    own = [mate(v, o) if c in rows.columns else F.lit(o) for c, v, o in (("rnext", F.col("rnext"), "*"), ("mate_pos", F.col("mate_pos") + 1, "0"), ("insert_size", F.col("insert_size"), "0"))]
    return rows.select(F.concat_ws("\t", text("qname"), text("flag"), text("rname"), (F.col("pos") + 1).cast("string"), text("mapq"), text("cigar"), *own, text("seq"), text("qual")).alias("line"))


def pileup(rows: DataFrame, base_quality: int = 0, map_quality: int = 0) -> DataFrame:
    """(chrom, pos, depth, bases, quals): what the reads of mapped alignments say at each reference position, in the order of their starts and names; bases of the reverse strand are small."""
    ops = cigar_ops(F.col("cigar"))
    mapped = rows.where(~has(F.col("flag"), UNMAPPED) & (F.col("mapq") >= map_quality)).withColumn("__ops", ops)
    places = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.struct(lift(i, F.col("__ops"), F.col("pos")).alias("at"), F.substr("seq", i + 1, F.lit(1)).alias("b"), F.substr("qual", i + 1, F.lit(1)).alias("q")))
    one = mapped.where(F.length("seq") > 0).select(F.col("rname").alias("chrom"), F.col("pos").alias("__s"), "qname", has(F.col("flag"), REVERSE).alias("r"), F.explode(places).alias("x")).where("x.at is not null")
    one = one.where(F.ascii("x.q") - 33 >= base_quality).select("chrom", F.col("x.at").alias("pos"), F.struct("__s", "qname", F.when(F.col("r"), F.lower("x.b")).otherwise(F.upper("x.b")).alias("b"), F.col("x.q").alias("q")).alias("o"))
    listed = one.groupBy("chrom", "pos").agg(F.sort_array(F.collect_list("o")).alias("o"))
    return listed.select("chrom", "pos", F.size("o").cast("bigint").alias("depth"), F.array_join(F.transform("o", lambda x: x["b"]), "").alias("bases"), F.array_join(F.transform("o", lambda x: x["q"]), "").alias("quals"))


def revert(rows: DataFrame, keep_duplicates: bool = False, keep_qualities: bool = False) -> DataFrame:
    """The original qualities from tag OQ, which goes, and no duplicate marks."""
    out = rows if keep_qualities else rows.withColumns({"qual": F.coalesce(F.col("tags")["OQ"], F.col("qual")), "tags": F.map_filter("tags", lambda k, v: k != "OQ")})
    return out if keep_duplicates else out.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~DUPLICATE)))


def flag_counts(rows: DataFrame, flag: str, insert: Column) -> DataFrame:
    """One row: counts of alignments by flag, and mean and median of the insert sizes of proper first mates."""
    f = F.col(flag)
    both = has(f, PAIRED) & ~has(f, UNMAPPED) & ~has(f, MATE_UNMAPPED)
    tests = {
        "mapped": ~has(f, UNMAPPED), "reverse": has(f, REVERSE), "failed": has(f, FAILED), "duplicates": has(f, DUPLICATE), "paired": has(f, PAIRED), "proper": has(f, PAIRED | PROPER),
        "both_mapped": both, "first": has(f, PAIRED | FIRST), "second": has(f, PAIRED | SECOND), "singletons": has(f, PAIRED | MATE_UNMAPPED) & ~has(f, UNMAPPED),
    }
    size = F.when(has(f, PAIRED | PROPER | FIRST) & both, insert)
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(t).alias(n) for n, t in tests.items()), F.round(F.avg(size), 4).alias("insert_mean")).withColumn("__k", F.lit(0))
    median = exact_percentiles(rows.select(F.lit(0).alias("__k"), size.alias("__size")), ["__k"], "__size", {"insert_median": 0.5})
    return counts.join(median, "__k", "left").drop("__k")


def split_values(rows: DataFrame, flag: str, reference: str, tag: Column) -> DataFrame:
    """(property, value, n): how many alignments a split by each property puts into each part."""
    f = F.col(flag)
    parts = {"mapped": F.when(has(f, UNMAPPED), "UNMAPPED").otherwise("MAPPED"), "paired": F.when(has(f, PAIRED), "PAIRED_END").otherwise("SINGLE_END"), "reference": F.col(reference).cast("string"), "tag": tag.cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in parts.items()])).alias("p")
    return rows.select(pairs).groupBy("p.property", "p.value").agg(F.count("*").alias("n"))


def clip_candidates(rows: DataFrame, clipped: Column, length: Column, mapq: Column, ratio: float = 0.2, good: int = 20, share: float = 0.8, least: int = 1) -> DataFrame:
    """Reads whose clipped part (its quality string) is ``ratio`` of the read or more, of good qualities to ``share``, and mapped well enough."""
    fine = F.size(F.filter(F.split(clipped, ""), lambda c: (c != "") & (F.ascii(c) - 33 >= good)))
    n = F.length(clipped)
    return rows.where((n > 0) & (n / length >= ratio) & (fine / n >= share) & (mapq >= least))


def mapping_errors(observations: DataFrame, site: list[str], quality: str, wrong: Column, high: int = 20, least: int = 3, most: float = 0.35) -> DataFrame:
    """(quality, n, errors) of observed bases, without sites of which more than ``most`` of ``least`` or more good bases differ: those are variants."""
    marked = observations.withColumns({"__w": wrong, "__h": F.col(quality) >= high})
    sites = marked.groupBy(*site).agg(F.count_if("__h").alias("__n"), F.count_if(F.col("__h") & F.col("__w")).alias("__d"))
    variant = sites.where((F.col("__n") >= least) & (F.col("__d") / F.col("__n") > most)).select(*site)
    return marked.join(variant, site, "left_anti").groupBy(quality).agg(F.count("*").alias("n"), F.count_if("__w").alias("errors"))


def select_contigs(rows: DataFrame, contig: str, order: str, score: str, second: str, overlap: str, least: int) -> DataFrame:
    """Contigs whose best alignment overlaps an exon by ``least`` and none of whose best ones has an equally good other place."""
    best = rows.withColumn("__m", F.max(score).over(Window.partitionBy(contig))).where(F.col(score) == F.col("__m"))
    kept = best.groupBy(contig).agg(F.min_by(overlap, order).alias("o"), F.bool_or(F.coalesce(F.col(score) == F.col(second), F.lit(False))).alias("tied"))
    return kept.where((F.col("o") >= least) & ~F.col("tied")).select(contig)


def split_breaks(parts: DataFrame, query: str, start: str, columns: dict[str, str]) -> DataFrame:
    """Neighbouring alignments of one query by their place on it: (query, kind, gap), kind X for another target, V for the other strand, else I or D by which side has the larger gap.

    ``columns``: names of target, strand, the target's start and end, and the end on the query.
    """
    w = Window.partitionBy(query).orderBy(start)
    before = {k: F.lag(c).over(w) for k, c in columns.items()}
    rows = parts.select(query, *(F.col(c).alias(k) for k, c in columns.items()), F.col(start).alias("__s"), *(v.alias(f"b_{k}") for k, v in before.items())).where("b_target is not null")
    on_query = F.col("__s") - F.col("b_query_end")
    on_target = F.when(F.col("strand") == "+", F.col("start") - F.col("b_end")).otherwise(F.col("b_start") - F.col("end"))
    kind = F.when(F.col("target") != F.col("b_target"), "X").when(F.col("strand") != F.col("b_strand"), "V").when(on_target >= on_query, "D").otherwise("I")
    return rows.select(query, kind.alias("kind"), on_query.alias("query_gap"), F.when(kind.isin("D", "I"), F.abs(on_target - on_query)).alias("size"))


def lift(offset: Column, ops: Column, pos: Column) -> Column:
    """Reference position of a read's ``offset`` under a parsed CIGAR that begins at ``pos``; null in an insertion or clip, and beyond the end."""
    start = F.struct(offset.cast("bigint").alias("left"), pos.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("found"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        reads, refers = F.contains(F.lit(ON_READ), x["op"]), F.contains(F.lit(ON_REFERENCE), x["op"])
        here = ~s["done"] & reads & (s["left"] < x["n"])
        return F.struct(
            F.when(reads, s["left"] - x["n"]).otherwise(s["left"]).alias("left"), F.when(refers, s["at"] + x["n"]).otherwise(s["at"]).alias("at"),
            F.when(here & refers, s["at"] + s["left"]).otherwise(s["found"]).alias("found"), (s["done"] | here).alias("done"),
        )

    return F.aggregate(ops, start, step, lambda s: s["found"])


def fuzzy_distinct(rows: DataFrame, key: str, start: str, end: str, slack: int) -> DataFrame:
    """Spans in order without those within ``slack`` of a kept one at both ends."""
    from pyspark.sql.types import LongType, StructField, StructType

    from tessera.operators import scan

    def fold(own):
        kept: list[tuple] = []
        for s, e in own:
            kept = [k for k in kept if s - k[0] <= slack]
            if not any(abs(e - k[1]) <= slack for k in kept):
                kept.append((s, e))
                yield s, e

    picked = rows.select(key, F.col(start).cast("bigint").alias(start), F.col(end).cast("bigint").alias(end))
    return scan.scan_keys(picked, [key], [start, end], [start, end], fold, StructType([picked.schema[key], StructField(start, LongType()), StructField(end, LongType())]))


def _flag(bits: int, set_: bool = True):
    return lambda: has(F.col("flag"), bits) if set_ else ~has(F.col("flag"), bits)


#: The named properties of an alignment that a filter may test.
PROPERTIES = {
    "alignmentFlag": lambda: F.col("flag"), "cigar": lambda: F.col("cigar"), "insertSize": lambda: F.col("insert_size"), "isDuplicate": _flag(DUPLICATE), "isFailedQC": _flag(FAILED), "isFirstMate": _flag(FIRST),
    "isMapped": _flag(UNMAPPED, False), "isMateMapped": _flag(MATE_UNMAPPED, False), "isMateReverseStrand": _flag(32), "isPaired": _flag(PAIRED), "isPrimaryAlignment": _flag(SECONDARY, False), "isProperPair": _flag(PROPER),
    "isReverseStrand": _flag(REVERSE), "isSecondMate": _flag(SECOND), "isSingleton": lambda: has(F.col("flag"), PAIRED | MATE_UNMAPPED) & ~has(F.col("flag"), UNMAPPED), "length": lambda: F.length("seq"), "mapQuality": lambda: F.col("mapq"),
    "matePosition": lambda: F.col("mate_pos"), "mateReference": lambda: F.col("rnext"), "name": lambda: F.col("qname"), "position": lambda: F.col("pos"), "queryBases": lambda: F.col("seq"), "reference": lambda: F.col("rname"),
}


def named_filter(properties: dict[str, str]) -> Column:
    """All of ``{property: test}``: ``true`` or ``false``, a number behind ``>=``, ``<``, ``!`` and so on, or text with ``*`` at an end; ``tag`` is ``XX:test``.

    Such predicates combine by ``&``, ``|`` and ``~`` and are pushed into the scan where they are on columns.
    """
    tests = []
    for name, text in properties.items():
        key, _, rest = text.partition(":")
        value, text = (F.col("tags")[key], rest) if name == "tag" else (PROPERTIES[name](), text)
        if text.lower() in ("true", "false"):
            tests.append(value if text.lower() == "true" else ~value)
        else:
            rule = property_filter(f"x:{text}")
            tests.append(COMPARE[rule["op"]](value.try_cast("double") if isinstance(rule["value"], float) else value.cast("string"), rule["value"]))
    return reduce(Column.__and__, tests)


def cycle_qualities(rows: DataFrame, seq: str, qual: str, high: int = 20) -> DataFrame:
    """(cycle, n, mean, high, gc) over all reads: mean quality, bases of good quality, and G or C at each position."""
    pairs = F.posexplode(F.arrays_zip(F.split(seq, "").alias("b"), F.split(qual, "").alias("q")))
    one = rows.where(F.length(seq) > 0).select(pairs.alias("cycle", "x")).select("cycle", "x.b", (F.ascii("x.q") - 33).alias("q"))
    return one.groupBy(F.col("cycle").cast("bigint").alias("cycle")).agg(F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("mean"), F.count_if(F.col("q") >= high).alias("high"), F.count_if(F.col("b").isin("G", "C")).alias("gc"))


def called_insertions(calls: DataFrame, least: int = 50, longest_ref: int = 30, quality: float = 100) -> DataFrame:
    """(chrom, pos, seq) of long insertions among a call's alternates: those that begin with the reference base(s) stand behind them, those that end with them before."""
    rows = calls.where(F.col("qual") >= quality).select("chrom", "pos", "ref", F.explode(F.arrays_zip("alts", "lens")).alias("x")).select("chrom", "pos", "ref", F.col("x.alts").alias("alt"), F.col("x.lens").alias("len"))
    n, m = F.length("ref"), F.length("alt")
    long = rows.where((F.col("len") >= least) & (m >= longest_ref))
    behind = long.where(F.startswith("alt", "ref")).select("chrom", (F.col("pos") + n).alias("pos"), F.substr("alt", n, m).alias("seq"))
    return behind.union(long.where(F.endswith("alt", "ref")).select("chrom", "pos", F.substr("alt", F.lit(1), m - n)))


#: Score of a match, and costs of a mismatch, of opening a gap and of each base of it.
MATCH, MISMATCH, GAP_OPEN, GAP_BASE = 1, 4, 6, 1
#: Fixed value: the highest mapping quality that groups of hits give.
BEST_QUALITY = 60


def hit_score(ops: Column, nm: Column) -> Column:
    """Score of an alignment from its parsed CIGAR and its differences, which are as many as its gap bases at least."""
    gaps = ops_length(ops, "ID")
    count = F.size(F.filter(ops, lambda x: x["op"].isin("I", "D")))
    differences = F.greatest(nm, gaps)
    return F.floor((MATCH * ops_length(ops, "M") - (MATCH + MISMATCH) * (differences - gaps) - GAP_OPEN * count - GAP_BASE * gaps) / MATCH + 0.499)


def place_under(ops: Column, offset: Column) -> Column:
    """How far into the target the base at ``offset`` of a contig lies (an inserted one where its insertion stands); null in a clip and beyond the end."""
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("found"))

    def step(s: Column, o: Column) -> Column:
        reads, refers = o["op"].isin("M", "I", "S", "H"), o["op"].isin("M", "D", "N")
        here = reads & (s["y"] <= offset) & (offset < s["y"] + o["n"])
        at = F.when(o["op"] == "M", s["x"] + offset - s["y"]).when(o["op"] == "I", s["x"])
        return F.struct((s["x"] + F.when(refers, o["n"]).otherwise(0)).alias("x"), (s["y"] + F.when(reads, o["n"]).otherwise(0)).alias("y"), F.when(here, at).otherwise(s["found"]).alias("found"))

    return F.aggregate(ops, start, step, lambda s: s["found"])


def regroup_hits(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """(read, hit, ctg, pctg, pstart, pend, score, grp, reported, mapq): hits on alternate contigs seen at their place in the primary assembly.

    ``hits``: read, hit (0: the reported one), ctg, start, cigar, nm, mapq;
    ``contigs``: how alternate contigs lie on the primary: name, target, pos,
    reverse, cigar. A hit is lifted by the first of its contig's alignments that
    it meets and whose clips it does not fall into. Hits of a read whose lifted
    spans overlap, one after the other, are a group. If the reported hit's group
    holds others, the quality is 6 for each point by which its best score leads
    the next group's (60 where there is none, 0 where it does not lead), raised to
    that of an alternate hit or lowered to that of a primary one. Reads without
    a hit on a contig keep their quality.
    """
    ops = cigar_ops(F.col("cigar"))
    own = hits.withColumn("__ops", ops).withColumns({"end": F.col("start") + ops_length(F.col("__ops"), "MDN"), "score": hit_score(F.col("__ops"), F.col("nm"))}).drop("__ops", "cigar")
    clipped = lambda c, i: F.when(F.element_at(c, i)["op"].isin("S", "H"), F.element_at(c, i)["n"]).otherwise(0)
    alt = contigs.select("name", "target", "pos", "reverse", ops.alias("__c"))
    first = F.when(F.col("reverse"), clipped(F.col("__c"), -1)).otherwise(clipped(F.col("__c"), 1))
    alt = alt.select(F.col("name").alias("ctg"), F.struct(first.alias("first"), "pos", "target", "reverse", ops_length(F.col("__c"), "MI").alias("aligned"), ops_length(F.col("__c"), "MISH").alias("all"), F.col("__c").alias("ops")).alias("a"))
    # A row a contig, so that a hit stays one row.
    placed = own.join(alt.groupBy("ctg").agg(F.collect_list("a").alias("__alts")), "ctg", "left")

    def lifted(a: Column) -> Column:
        met = (F.col("start") < a["first"] + a["aligned"]) & (F.col("end") > a["first"])
        low = F.when(a["reverse"], a["all"] - F.col("end")).otherwise(F.col("start"))
        high = F.when(a["reverse"], a["all"] - F.col("start")).otherwise(F.col("end")) - 1
        place = lambda offset: F.when(met, a["pos"] + place_under(a["ops"], offset))
        return F.struct(a["first"].alias("first"), a["pos"].alias("pos"), a["target"].alias("target"), place(low).alias("s"), (place(high) + 1).alias("e"))

    inside = F.filter(F.transform("__alts", lifted), lambda l: l["s"].isNotNull() & l["e"].isNotNull())
    placed = placed.withColumn("l", F.array_min(inside))
    placed = placed.select("read", "hit", "ctg", "mapq", "score", F.coalesce("l.target", "ctg").alias("pctg"), F.coalesce("l.s", "start").alias("pstart"), F.coalesce("l.e", "end").alias("pend"), F.col("__alts").isNotNull().alias("__alt"))
    # The first window deals the hits by read and sorts them; the others find them so.
    by = Window.partitionBy("read").orderBy("pctg", "pstart", "hit")
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.max("pend").over(Window.partitionBy("read", "pctg").orderBy("pstart", "hit").rowsBetween(Window.unboundedPreceding, -1))
    grouped = placed.withColumn("__any", F.bool_or("__alt").over(all_)).withColumn("__new", F.when(F.col("pstart") < reach, 0).otherwise(1)).withColumn("grp", F.sum("__new").over(by) - 1)
    group, read = Window.partitionBy("read", "grp"), Window.partitionBy("read")
    best = grouped.withColumns({"__top": F.max("score").over(group), "__n": F.count("*").over(group)})
    # The reported hit with its group, then what the other groups reach.
    best = best.withColumn("g", F.max(F.when(F.col("hit") == 0, F.struct("grp", F.col("__n").alias("n"), F.col("__top").alias("top"), "mapq", "__alt"))).over(read))
    best = best.withColumns({"__next": F.max(F.when(F.col("grp") != F.col("g.grp"), F.col("__top"))).over(read), "__tied": F.bool_or((F.col("grp") < F.col("g.grp")) & (F.col("__top") == F.col("g.top"))).over(read)})
    lead = F.when(F.col("__next").isNull(), BEST_QUALITY).otherwise(F.least(F.lit(BEST_QUALITY), 6 * (F.col("g.top") - F.col("__next"))))
    fresh = F.when((F.col("__next") > F.col("g.top")) | F.col("__tied"), 0).otherwise(lead)
    kept = F.col("g.mapq")
    quality = F.when(F.col("__any") & (F.col("g.n") > 1), F.when(F.col("g.__alt"), F.greatest(fresh, kept)).otherwise(F.least(fresh, kept))).otherwise(kept)
    reported = F.col("grp") == F.col("g.grp")
    return best.select("read", "hit", "ctg", "pctg", "pstart", "pend", "score", "grp", reported.alias("reported"), F.when(reported, quality.cast("bigint")).otherwise(F.col("mapq")).alias("mapq"))


def rule_script(filters: dict[str, Column], rule: str) -> Column:
    """One predicate from named ones and a rule: names with ``!``, ``&``, ``|`` and parentheses, ``!`` before ``&`` before ``|``; an empty rule is any of them."""
    if not rule.strip():
        return reduce(Column.__or__, filters.values())
    signs = re.findall(r"[!&|()]|[^\s!&|()]+", rule)
    at = 0

    def take(*expected: str) -> str | None:
        nonlocal at
        if at < len(signs) and (not expected or signs[at] in expected):
            at += 1
            return signs[at - 1]
        return None

    def one() -> Column:
        if take("!"):
            return ~one()
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError(f"no closing parenthesis in rule: {rule}")
            return inner
        name = take()
        if name not in filters:
            raise ValueError(f"no filter {name!r} in rule: {rule}")
        return filters[name]

    def both() -> Column:
        out = one()
        while take("&"):
            out = out & one()
        return out

    def either() -> Column:
        out = both()
        while take("|"):
            out = out | both()
        return out

    found = either()
    if at < len(signs):
        raise ValueError(f"unexpected {signs[at]!r} in rule: {rule}")
    return found


def script_filter(script: str) -> Column:
    """The predicate of a JSON script: ``{"filters": [{"id": name, property: test, ...}], "rule": text}``, or the properties of one filter alone."""
    parsed = json.loads(script)
    if "filters" not in parsed:
        return named_filter(parsed)
    named = {f.get("id", f"filter{i}"): named_filter({k: v for k, v in f.items() if k != "id"}) for i, f in enumerate(parsed["filters"], 1)}
    return rule_script(named, parsed.get("rule", ""))


def long_hits(hits: DataFrame, allele: str, differences: str, length: str, least: int, excluded: DataFrame) -> DataFrame:
    """(allele, differences, aligned) summed over hits of ``least`` aligned bases or more, without the alleles of ``excluded``."""
    kept = hits.where(F.col(length) >= least).join(excluded, allele, "left_anti")
    return kept.groupBy(allele).agg(F.sum(differences).alias("differences"), F.sum(length).alias("aligned"))
