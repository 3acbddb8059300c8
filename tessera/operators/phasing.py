"""Operators on phase sets, annotations and call sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.statistics import fisher_exact
from tessera.operators.graph import signed_components
from tessera.operators.joining import mendelian_conflict


def block_votes(first: DataFrame, second: DataFrame, site: str, block: str, hap: str) -> DataFrame:
    """(a, b, shared, same, flip) of blocks of two phasings that share sites; flip where fewer than half agree."""
    a = first.select(site, F.col(block).alias("a"), F.col(hap).alias("__x"))
    b = second.select(site, F.col(block).alias("b"), F.col(hap).alias("__y"))
    votes = a.join(b, site).groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("__x") == F.col("__y")).alias("same"))
    return votes.withColumn("flip", F.col("same") * 2 < F.col("shared"))


def merge_phasings(first: DataFrame, second: DataFrame, site: str, block: str, hap: str) -> DataFrame:
    """(node, component, side): blocks of two phasings (their numbers differ) joined over shared sites; side 1 is to be turned."""
    votes = block_votes(first, second, site, block, hap)
    return signed_components(votes.withColumn("f", F.col("flip").cast("bigint")), "a", "b", "f")


def recombinations(rows: DataFrame, block: str, position: str, transmission: str, cost: str) -> DataFrame:
    """(block, before, after, and the two parents' sides before and after, cost) where a block's transmission changes, from its third position on."""
    w = Window.partitionBy(block).orderBy(position)
    seen = rows.withColumns({"__i": F.row_number().over(w), "__p": F.lag(position).over(w), "__t": F.lag(transmission).over(w)}).where((F.col("__i") >= 3) & (F.col("__t") != F.col(transmission)))
    side = lambda c: [(F.col(c) % 2), F.floor(F.col(c) / 2)]
    (f0, m0), (f1, m1) = side("__t"), side(transmission)
    return seen.select(block, F.col("__p").alias("before"), F.col(position).alias("after"), f0.alias("father_before"), f1.alias("father_after"), m0.alias("mother_before"), m1.alias("mother_after"), cost)


def pair_log_odds(observations: DataFrame, fragment: str, site: str, allele: str, error: Column) -> DataFrame:
    """(a, b, same, opposite) of site pairs: summed log10 likelihood that two alleles of a fragment agree, or differ, over all its pairs of sites."""
    one = observations.groupBy(fragment, site).agg(F.max(allele).alias("x"), F.max(error).alias("p"))
    a, b = (one.select(fragment, F.col(site).alias(k), F.col("x").alias(f"x{k}"), F.col("p").alias(f"p{k}")) for k in "ab")
    right = (1 - F.col("pa")) * (1 - F.col("pb")) + F.col("pa") * F.col("pb")
    agree = F.when(F.col("xa") == F.col("xb"), right).otherwise(1 - right)
    return a.join(b, fragment).where("a < b").groupBy("a", "b").agg(F.sum(F.log10(agree)).alias("same"), F.sum(F.log10(1 - agree)).alias("opposite"))


def annotate(sites: DataFrame, counts: tuple[str, str, str, str]) -> DataFrame:
    """Depth, least alternate depth of a strand, percent of alternate reads and phred-scaled strand bias of (reference forward, reverse, alternate forward, reverse) counts."""
    rf, rr, af, ar = (F.col(c) for c in counts)
    depth, alt = rf + rr + af + ar, af + ar
    bias = fisher_exact(rf, rr, af, ar)
    share = F.when(depth == 0, 0).otherwise(F.floor(100 * alt / depth + 0.499))
    # Fixed value: probabilities too small to print count as no bias.
    phred = F.floor(F.when(bias < 1e-10, 0.0).otherwise(-4.343 * F.ln(bias)) + 0.499)
    return sites.withColumns({"dp": depth, "ds": F.least(af, ar), "ab": share, "fs": phred})


def difference_counts(first: DataFrame, second: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """(class, fp, tp): what a haploid sample calls heterozygous is false; what the other calls beyond that counts as true."""
    sides = first.agg(*[F.count_if(t).alias(f"a_{c}") for c, t in classes.items()]).join(second.agg(*[F.count_if(t).alias(f"b_{c}") for c, t in classes.items()]))  # one row each
    return sides.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"a_{c}").alias("fp"), (F.col(f"b_{c}") - F.col(f"a_{c}")).alias("tp")) for c in classes])).alias("x")).select("x.*")


def merge_partners(rows):
    """Fold over (start, end, partial): a partial record and the next partial one that overlaps it become one; others stay. Yields (start, end, records)."""
    held = None
    for s, e, partial in rows:
        if held is not None:
            if partial and s < held[1]:
                yield held[0], max(held[1], e), 2
                held = None
                continue
            yield *held, 1
            held = None
        if partial:
            held = (s, e)
        else:
            yield s, e, 1
    if held is not None:
        yield *held, 1


def best_groups(hits: DataFrame, gene: str, allele: str, contig: str, mismatches: str, group: str) -> DataFrame:
    """Per gene the commonest group of the alleles with the fewest summed mismatches on any contig, and the first such allele."""
    sums = hits.groupBy(gene, allele, group, contig).agg(F.sum(mismatches).alias("m")).groupBy(gene, allele, group).agg(F.min("m").alias("m"))
    best = sums.groupBy(gene).agg(F.min("m").alias("__best"))
    votes = sums.join(best, gene).where("m = __best").groupBy(gene, group).agg(F.count("*").alias("n"), F.min(allele).alias(allele))
    return votes.groupBy(gene).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(allele), F.col(group))).alias("b")).select(gene, F.col(f"b.{allele}").alias(allele), F.col(f"b.{group}").alias(group), (-F.col("b.k")).alias("n"))


def shared_by_most(rows: DataFrame, option: str, group: str) -> DataFrame:
    """(option, n): the options that the most groups have."""
    counts = rows.groupBy(option).agg(F.count_distinct(group).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("__m"))), F.col("n") == F.col("__m")).drop("__m")


def flip_penalties(observations: DataFrame, fragment: str, block: str, site: str, agrees: str) -> DataFrame:
    """(block, site, n, weight, change) of the sites of a block by the fragments that cover several of them.

    A fragment speaks for a block's phase by the share of its sites that agree.
    ``weight`` is the mean, over a site's fragments, of what speaks for turning
    the site: the share where the site disagrees, one less it where it agrees.
    ``change`` is how the weights of the block's other sites move if the site is
    turned: below zero, turning it makes them fit better. A fragment's share
    moves by one over its sites, for or against each of them, so its sums over
    sites are enough: no pair of sites is made.
    """
    sign = F.when(F.col(agrees), 1.0).otherwise(-1.0)
    rows = observations.select(fragment, block, site, F.col(agrees).alias("__a"), sign.alias("__s"))
    shares = rows.groupBy(fragment, block).agg(F.count("*").alias("__t"), F.avg(F.col("__a").cast("double")).alias("__share")).where("__t > 1")
    seen = rows.join(shares, [fragment, block])
    sites = seen.groupBy(block, site).agg(F.count("*").alias("n"), F.avg(F.when(F.col("__a"), 1 - F.col("__share")).otherwise(F.col("__share"))).alias("weight"))
    weighed = seen.join(sites.select(block, site, "n"), [block, site])
    sums = weighed.groupBy(fragment, block).agg(F.sum(F.col("__s") / F.col("n")).alias("__sum"))
    moved = weighed.join(sums, [fragment, block]).groupBy(block, site).agg(F.sum(F.col("__s") / F.col("__t") * (F.col("__sum") - F.col("__s") / F.col("n"))).alias("change"))
    return sites.join(moved, [block, site])


def parent_votes(sites: DataFrame, block: str, child: tuple[str, str], mother: tuple[str, str], father: tuple[str, str]) -> DataFrame:
    """(block, side0, side1, turn): a child's heterozygous sites at which one parent has a single allele vote for the side that puts it onto that parent's haplotype; ``turn`` where more vote for the other.

    The first haplotype of the child stands for the father's. Sites at which no
    assignment of alleles fits the parents do not vote.
    """
    c0, c1 = map(F.col, child)
    pair = lambda p: tuple(map(F.col, p))
    single = lambda p: F.when(F.col(p[0]) == F.col(p[1]), F.col(p[0]))
    fits = ~mendelian_conflict((c0, c1), pair(mother), pair(father)) & (c0 != c1)
    from_father, from_mother = single(father), single(mother)
    straight = F.coalesce(F.when(from_father == c0, 0).when(from_father == c1, 1), F.when(from_mother == c1, 0).when(from_mother == c0, 1))
    votes = sites.where(fits).groupBy(block).agg(F.count_if(straight == 0).alias("side0"), F.count_if(straight == 1).alias("side1"))
    return votes.withColumn("turn", F.col("side1") > F.col("side0"))


def flip_scores(fragments: DataFrame, name: str, block: str, agrees: str) -> DataFrame:
    """(block, keep, turn, flip): summed log10 odds of fragments for a block's phase and against it; ``agrees`` is the probability that an observation fits."""
    per = fragments.groupBy(name, block).agg(F.sum(F.log10(agrees)).alias("k"), F.sum(F.log10(1 - F.col(agrees))).alias("t"))
    return per.groupBy(block).agg(F.sum("k").alias("keep"), F.sum("t").alias("turn")).withColumn("flip", F.col("turn") > F.col("keep"))
