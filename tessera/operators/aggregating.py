"""Aggregations: weighted identity, modes, trimmed means, coverage, copy numbers, compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import reverse_complement
from tessera.operators.windowing import join_on, totals_below


def first_hit(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """``value`` of the first row of each key by ``order``; ``min_by`` needs no sort of the group."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def mode_first_seen(df: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """Most frequent value of each key; of equals the one first seen by ``order``."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("seen"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "seen", value)).alias("b")).select(key, F.col(f"b.{value}").alias(value), (-F.col("b.neg")).alias("n"))


def trimmed_mean(df: DataFrame, key: str, order: list, value: str, ends: int) -> DataFrame:
    """Mean of a key's values without the first and last ``ends`` rows by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(key))})
    return ranked.where((F.col("__i") > ends) & (F.col("__i") <= F.col("__n") - ends)).groupBy(key).agg(F.avg(value).alias("mean"))


def depth_stats(df: DataFrame, key: str, value: str, above: float = 0) -> DataFrame:
    """Mean, exact median, share above a bound, and count."""
    stats = df.groupBy(key).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > above, 1.0).otherwise(0.0)).alias("covered"), F.count("*").alias("n"))
    return join_on(stats, exact_percentiles(df, [key], value, {"median": 0.5}), [key], "left").select(key, "mean", "median", "covered", "n")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of each key, exact: equal values are counted first, and ranks come from ranges of values, so no task holds a key's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ranked = totals_below(counts, keys, value, "__c", "__below")
    total = ranked.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    at = lambda q: (F.col("__n") - 1) * F.lit(q)
    held = lambda rank: F.max(F.when((F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__c")), F.col(value)))
    line = lambda q: held(F.floor(at(q))) + (held(F.ceil(at(q))) - held(F.floor(at(q)))) * (F.max(at(q)) - F.floor(F.max(at(q))))
    return join_on(ranked, total, keys).groupBy(*keys).agg(*(line(q).alias(name) for name, q in shares.items()))


def phase_ratio(df: DataFrame, key: str, beta: Column, first: Column) -> DataFrame:
    """Shares of two haplotypes: the mean of beta, taken from the other side where the first haplotype has the reference."""
    ratio = F.avg(F.when(first, 1 - beta).otherwise(beta))
    return df.groupBy(key).agg(ratio.alias("h1"), (1 - ratio).alias("h2"))


def copy_class(ratio: Column, low: float = 0.1, high: float = 0.85) -> Column:
    """0, 1 or 2 copies by the ratio to the baseline."""
    return F.when(ratio < low, 0).when(ratio < high, 1).otherwise(2)


def allele_copies(major: Column, minor: Column, purity: Column, ploidy: Column) -> tuple[Column, Column]:
    """Copies of the major and minor haplotype from their shares, tumour purity and ploidy, rounded and clamped to [0, ploidy]."""
    r = major / minor
    a = (r * ploidy + (r - 1) * (1 / purity - 1)) / (1 + r)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.round(x), ploidy))
    return clamp(a), clamp(ploidy - a)


def coverage(spans: DataFrame, key: str, start: str, end: str, low: int, high: int) -> DataFrame:
    """Breadth and mean depth over [low, high) of half-open spans by a sweep of their ends: no position is made a row."""
    clipped = spans.select(key, F.greatest(start, F.lit(low)).alias("s"), F.least(end, F.lit(high)).alias("e")).where("s < e")
    events = clipped.select(key, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(key, "x.*")
    deltas = events.groupBy(key, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    parts = deltas.select(key, F.sum("d").over(w).alias("depth"), (F.lead("at").over(w) - F.col("at")).alias("len"))
    size = high - low
    return parts.groupBy(key).agg((F.sum(F.when(F.col("depth") > 0, F.col("len"))) / size).alias("breadth"), (F.sum(F.col("depth") * F.col("len")) / size).alias("depth"))


def class_counts(text: Column, classes: dict[str, str]) -> list[Column]:
    """How many characters of ``text`` are in each class (a string of characters): two lengths and a translate, no regex."""
    return [(F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint").alias(name) for name, chars in classes.items()]


def kmers(df: DataFrame, text: str, k: int) -> DataFrame:
    """One row (kmer) per position; the positions are made and counted in one stage."""
    starts = F.sequence(F.lit(1), F.length(text) - (k - 1))
    return df.where(F.length(text) >= k).select(F.explode(F.transform(starts, lambda i: F.substr(text, i, F.lit(k)))).alias("kmer"))


def per_position(df: DataFrame, text: str, classes: dict[str, str]) -> DataFrame:
    """Counts of character classes at each position of the whole texts."""
    chars = df.select(F.posexplode(F.split(F.col(text), "")).alias("pos", "c")).where("c <> ''")
    return chars.groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.count("*").alias("n"), *[F.count_if(F.contains(F.lit(set_), F.col("c"))).alias(name) for name, set_ in classes.items()])


def fenced_mean(df: DataFrame, key: str, value: str, fence: float = 1.5) -> DataFrame:
    """Quartiles, then mean and deviation of the values inside the quartiles widened by ``fence`` times their distance."""
    q = exact_percentiles(df, [key], value, {"q1": 0.25, "q3": 0.75})
    inside = join_on(df, q, [key]).where((F.col(value) >= F.col("q1") - fence * (F.col("q3") - F.col("q1"))) & (F.col(value) <= F.col("q3") + fence * (F.col("q3") - F.col("q1"))))
    return inside.groupBy(key).agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def spans_by_tag(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, first_at, last_at, n) of the rows that carry the same tags."""
    return df.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))


def text_in_order(df: DataFrame, key: str, order: list[str], text: str, separator: str, name: str) -> DataFrame:
    """(key, name): a key's texts in order (equal places by text), joined."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__x"))))
    return df.groupBy(key).agg(F.array_join(F.transform(listed, lambda p: p["__x"]), separator).alias(name))


def distinct_in_order(df: DataFrame, key: str, value: str, order: list[str], separator: str, name: str) -> DataFrame:
    """(key, name): a key's different values by their first places, joined; combined before the shuffle, so repeated values cost nothing."""
    first = df.groupBy(key, value).agg(*(F.min(c).alias(c) for c in order))
    return text_in_order(first, key, order, value, separator, name)


def transition_shares(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(a, b, n, p): how often state b follows a within a key, and the share of all that follows a."""
    steps = df.select(F.col(state).alias("a"), F.lead(state).over(Window.partitionBy(key).orderBy(*order)).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return steps.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))  # a row a pair of states


def turned_by_vote(df: DataFrame, key: str, side: str, first, second, count: str = "n") -> DataFrame:
    """(key, side, n): a key's rows by side, with both sides exchanged where more are on the ``second``; other sides stay."""
    counts = df.groupBy(key, side).agg(F.count("*").alias("__n"))
    of = lambda v: F.sum(F.when(F.col(side) == v, F.col("__n")).otherwise(0))
    votes = counts.groupBy(key).agg((of(second) > of(first)).alias("__turn"))
    turned = F.when(F.col("__turn") & (F.col(side) == first), second).when(F.col("__turn") & (F.col(side) == second), first).otherwise(F.col(side))
    return counts.join(votes, key).groupBy(key, turned.alias(side)).agg(F.sum("__n").alias(count))


def grid(df: DataFrame, **parameters: list) -> DataFrame:
    """Every row with every combination of the parameters' values."""
    for name, values in parameters.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def best_combination(df: DataFrame, group: str, option: str, score: str, second: str) -> DataFrame:
    """(group, option, score): the option of the highest score, of equals of the higher second criterion, then the smallest."""
    best = df.groupBy(group).agg(F.max(F.struct(score, second)).alias("__m"))
    ties = df.join(best, group).where((F.col(score) == F.col(f"__m.{score}")) & (F.col(second) == F.col(f"__m.{second}")))
    return ties.groupBy(group).agg(F.min(option).alias(option), F.first(score).alias(score))


def strand_kmers(df: DataFrame, seq: str, k: int, high: Column) -> DataFrame:
    """(kmer, n, high): k-mers of both strands as one, how often they occur and how often in good quality."""
    rows = df.where(F.length(seq) >= k).select(high.alias("__h"), F.explode(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(F.col(seq), i, F.lit(k)))).alias("__f"))
    return rows.groupBy(F.least("__f", reverse_complement(F.col("__f"))).alias("kmer")).agg(F.count("*").alias("n"), F.count_if("__h").alias("high"))


def conflict_merge(df: DataFrame, keys: list[str], allele: str, quality: str, cap: float) -> DataFrame:
    """Keys whose alleles agree, with the summed quality up to ``cap``; keys with two alleles go."""
    g = df.groupBy(*keys).agg(F.min(allele).alias(allele), F.max(allele).alias("__hi"), F.sum(quality).alias("q"))
    return g.where(F.col(allele) == F.col("__hi")).select(*keys, allele, F.least(F.col("q"), F.lit(cap)).alias(quality))


def pair_cover(df: DataFrame, item: str, option: str, cost: str) -> DataFrame:
    """Option pairs i <= j with the summed smaller cost over the items that both have, ranked."""
    one = df.groupBy(item, option).agg(F.min(cost).alias("c"))
    a, b = one.select(item, F.col(option).alias("i"), F.col("c").alias("ci")), one.select(item, F.col(option).alias("j"), F.col("c").alias("cj"))
    sums = a.join(b, item).where("i <= j").groupBy("i", "j").agg(F.sum(F.least("ci", "cj")).alias("cost"), F.count("*").alias("n"))
    return sums.withColumn("cost", F.round("cost", 2))


def n50(df: DataFrame, key: str, length: str) -> DataFrame:
    """The length at which the running total of descending lengths first passes half of all; lengths are counted first, so a window has a row a length."""
    counts = df.groupBy(key, length).agg((F.count("*") * F.col(length)).alias("__s"))
    w = Window.partitionBy(key).orderBy(F.desc(length))
    run = counts.withColumns({"run": F.sum("__s").over(w), "all": F.sum("__s").over(Window.partitionBy(key))})
    return run.where(F.col("run") * 2 > F.col("all")).groupBy(key).agg(F.max(length).alias("n50"))


def an50(df: DataFrame, key: str, span: str, phased: str, within: str, sites: str) -> DataFrame:
    """The adjusted span (span times the phased share of its sites) at which blocks in descending order first hold more than half of a key's ``sites`` in phased ones; no row for a key that never does."""
    blocks = df.where(F.col(within) > 0).select(key, (F.col(span) * F.col(phased) / F.col(within)).alias("an50"), F.col(phased).alias("__p"), F.col(sites).alias("__n"))
    counts = blocks.groupBy(key, "an50").agg(F.sum("__p").alias("__s"))
    whole = blocks.groupBy(key).agg(F.sum("__p").alias("__all"), F.max("__n").alias("__n"))
    passed = join_on(totals_below(counts, [key], "an50", "__s"), whole, [key]).where(2 * (F.col("__all") - F.col("below")) > F.col("__n"))
    return passed.groupBy(key).agg(F.max("an50").alias("an50"))


def weighted_identity(df: DataFrame, key: str, mismatches: Column, length: str) -> DataFrame:
    """100 * (1 - mismatches / length) over all rows of a key."""
    return df.groupBy(key).agg((100 * (1 - F.sum(mismatches) / F.sum(length))).alias("identity"))
