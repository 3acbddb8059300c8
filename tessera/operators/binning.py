"""Assignment by best score with a margin, filters and genotype calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_two(scores: DataFrame, key: str, option: str, score: str) -> DataFrame:
    """Per key: first and second option by score (option breaks ties) and both scores; a missing second scores 0.

    One aggregation per key over its options (few per key: they were summed before).
    """
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("neg"), F.col(option).alias("o")))), 1, 2)
    best = scores.groupBy(key).agg(ranked.alias("b"))
    return best.select(key, F.col("b")[0]["o"].alias("first"), (-F.col("b")[0]["neg"]).alias("first_score"), F.get("b", F.lit(1))["o"].alias("second"), F.coalesce(-F.get("b", F.lit(1))["neg"], F.lit(0.0)).alias("second_score"))


def assign_by_margin(scores: DataFrame, key: str, option: str, score: str, margin: float, none: str = "REMOVE") -> DataFrame:
    """Best option of a key if it leads the second by ``margin`` or more, else ``none``."""
    lead = F.col("first_score") - F.col("second_score")
    return top_two(scores, key, option, score).withColumn("assigned", F.when(lead >= margin, F.col("first")).otherwise(F.lit(none)))


def assign_by_rules(scores: DataFrame, key: str, option: str, score: str, rules: list[tuple[str, str, str]], margin: float, none: str = "REMOVE") -> DataFrame:
    """As ``assign_by_margin``, but ordered rules (first, second, outcome) come before the margin."""
    top = assign_by_margin(scores, key, option, score, margin, none)
    ladder = reduce(lambda acc, r: acc.when((F.col("first") == r[0]) & (F.col("second") == r[1]), F.lit(r[2])), rules, F.when(F.lit(False), F.lit(none)))
    return top.withColumn("assigned", ladder.otherwise(F.col("assigned")))


def ends_identity(alignments: DataFrame, read: str, allele: str, matched: str, length: str, ends: int = 2) -> DataFrame:
    """Identity of (read, allele) over its aligned ends; a pair with fewer ends scores 0."""
    sums = alignments.groupBy(read, allele).agg(F.sum(matched).alias("m"), F.sum(length).alias("l"), F.count("*").alias("n"))
    return sums.select(read, allele, F.when(F.col("n") < ends, 0.0).otherwise(F.col("m") / F.col("l")).alias("identity"))


#: Operators of a rule; a rule is {"and": [...]}, {"or": [...]}, {"not": rule} or {"column": ..., "op": ..., "value": ...}.
COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "startswith": Column.startswith, "contains": Column.contains, "endswith": Column.endswith}


def compile_rules(rule: dict) -> Column:
    """A nested rule as one predicate, which the optimiser can push into the scan."""
    if "and" in rule:
        return reduce(Column.__and__, map(compile_rules, rule["and"]))
    if "or" in rule:
        return reduce(Column.__or__, map(compile_rules, rule["or"]))
    if "not" in rule:
        return ~compile_rules(rule["not"])
    return COMPARE[rule["op"]](F.col(rule["column"]), rule["value"])


def property_filter(text: str) -> dict:
    """A rule from ``column:>=3``, ``column:!x`` (not equal), ``column:x*``, ``column:*x`` or ``column:x``; numbers compare as numbers."""
    column, _, value = text.partition(":")
    for sign in (">=", "<=", ">", "<", "!"):
        if value.startswith(sign):
            op, value = {"!": "!="}.get(sign, sign), value[len(sign) :]
            break
    else:
        op = "contains" if len(value) > 2 and value[0] == value[-1] == "*" else "endswith" if value.startswith("*") else "startswith" if value.endswith("*") else "="
        value = value.strip("*") if op != "=" else value
    try:
        return {"column": column, "op": op, "value": float(value)}
    except ValueError:
        return {"column": column, "op": op, "value": value}


def flags(flag: str | Column, need: int = 0, lack: int = 0) -> Column:
    """All bits of ``need`` set and none of ``lack``."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return (flag.bitwiseAND(F.lit(need)) == need) & (flag.bitwiseAND(F.lit(lack)) == 0)


def bounded_by_mean(df: DataFrame, value: str, roots: float) -> DataFrame:
    """Rows up to mean + ``roots`` * sqrt(mean); the one-row aggregate is joined by broadcast."""
    bound = df.agg((F.avg(value) + roots * F.sqrt(F.avg(value))).alias("__bound"))
    return df.join(F.broadcast(bound), F.col(value) <= F.col("__bound")).drop("__bound")


def top_share(df: DataFrame, key: str, option: str, weight: str, n: int, least: float) -> DataFrame:
    """Keys whose ``n`` heaviest options hold more than ``least`` of the key's weight."""
    sums = df.groupBy(key, option).agg(F.sum(weight).alias("w"))
    lists = sums.groupBy(key).agg(F.sort_array(F.collect_list("w"), asc=False).alias("ws"), F.sum("w").alias("total"))
    share = F.aggregate(F.slice("ws", 1, n), F.lit(0.0), lambda a, x: a + x) / F.col("total")
    return lists.select(key, share.alias("share")).where(F.col("share") > least)


def call_genotype(beta: str | Column, cut: float) -> Column:
    """0/0 up to ``cut``, 1/1 from 1 - ``cut``, else 0/1."""
    beta = F.col(beta) if isinstance(beta, str) else beta
    return F.when(beta <= cut, "0/0").when(beta >= 1 - cut, "1/1").otherwise("0/1")


def quality_labels(df: DataFrame, labels: dict[str, Column], name: str = "filter") -> DataFrame:
    """All failed labels joined by ``;``, ``.`` if none."""
    joined = F.concat_ws(";", *[F.when(test, F.lit(label)) for label, test in labels.items()])
    return df.withColumn(name, F.when(joined == "", ".").otherwise(joined))


def two_criteria(df: DataFrame, group: str, key: str, first: str, second: str) -> DataFrame:
    """Per group the key best in both criteria; if none is, the best by the first whose second is within a tenth, else the best by the first."""
    ranks = df.withColumns({"r1": F.rank().over(Window.partitionBy(group).orderBy(F.desc(first))), "r2": F.rank().over(Window.partitionBy(group).orderBy(F.desc(second))), "top2": F.max(second).over(Window.partitionBy(group))})
    rule = F.when((F.col("r1") == 1) & (F.col("r2") == 1), 1).when(F.col(second) >= 0.9 * F.col("top2"), 2).when(F.col("r1") == 1, 3)
    ranked = ranks.withColumn("rule", rule).where("rule is not null")
    best = Window.partitionBy(group).orderBy("rule", F.desc(first), key)
    return ranked.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "r1", "r2", "top2")
