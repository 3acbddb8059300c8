"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. A pattern's matches and the texts between them come
from ``regexp_extract_all`` and ``split`` with the same expression; running
lengths of both give code-point offsets, and the text around a match is its
context. Possessive quantifiers keep the matcher from recursing on long runs,
and a look-behind (or the end of the last match, ``\\G``) keeps it from
starting again inside a run that already failed; neither changes a match.

Kinds: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits, Luhn),
``phone`` (8 to 15 digits) are the base. ``iban`` (country's length, mod-97), ``amex`` (15 digits
from 34 or 37, Luhn) and ``ssn`` (3-2-4 digits) are added where validator and context
words reach the score asked for.

Score: 0.5 for the pattern, 0.3 for a passed checksum, 0.2 for a context word
within 40 characters before or behind (behind as far as the end of the gap
that follows the next match). Base spans stay whatever their score.

Spans of one kind never overlap and have different starts; spans of different
kinds may, and all stay, also those that start alike. Texts are scanned whole,
a very long one in one task; time grows with its length and its matches.

A null or empty text has no span, repeated rows are scanned alike, an empty
table gives an empty result, and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import documents

CONTEXT_CHARS = 40
#: Matches whose spans are gathered together.
BLOCK = 512
#: Least score of a span that is not in the base.
LEAST_SCORE = 0.7


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    rows = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(rows, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: the first four characters go last, letters count from 10."""
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda ch: F.when(ch.rlike("[0-9]"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    step = lambda a, ch: F.when(value(ch) < 10, (a * 10 + value(ch)) % 97).otherwise((a * 100 + value(ch)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _length_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


#: Length of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "RU", 32: "LC",
}
_LISTED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?+[A-Z0-9]){{{n - 4}}}" for n, c in sorted(IBAN_LENGTHS.items()))
#: A listed country's length, up to 34 characters for others. Only the head is consumed, so a candidate that fails hides none that begins inside it.
IBAN = rf"(?<![A-Za-z0-9])(?=((?:{_LISTED}|(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"
IBAN_HEAD = 4

#: kind: pattern, a cheap test that a text can hold it, validator (None: the pattern is all), whether it is a checksum, context words.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), None, False, "mail|contact|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.contains("."), _octets, False, "ip|host|server|address"),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++", None, lambda m: F.when(_length_between(_digits(m), 16, 19), luhn(_digits(m))).otherwise(False), True, "card|visa|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: _length_between(_digits(m), 8, 15), False, "phone|tel|call|fax"),
    "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda m: mod97(F.regexp_replace(m, " ", "")), True, "iban|account|konto|compte|cuenta"),
    "amex": (r"(?<![0-9])3[47][0-9]{2}[\x20-]?+[0-9]{6}[\x20-]?+[0-9]{5}(?![0-9])", lambda t: t.rlike("3[47][0-9]{2}"), lambda m: luhn(_digits(m)), True, "card|amex|karte|carte|tarjeta"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), None, False, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, score): confirmed matches of one kind, ascending.

    The time is linear in the text but for the arrays of confirmed spans, which are copied as
    they grow; they are gathered in blocks of ``BLOCK`` matches, and blocks in one array.
    """
    pattern, may, valid, checksum, context = KINDS[kind]
    ahead = kind == "iban"
    none, blocks = F.array().cast(SPAN), F.array().cast(f"array<{SPAN}>")

    def rows(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        # A match looked ahead for begins its own following gap.
        near = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(CONTEXT_CHARS))
        behind = lambda i: F.left(F.concat(near(F.get(gaps, i + 1)), near(F.get(hits, i + 1)), near(F.get(gaps, i + 2))), F.lit(CONTEXT_CHARS))
        return F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit"), behind(i).alias("behind")))

    def walk(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        confirmed = F.lit(True) if valid is None else valid(row["hit"])
        eaten = F.substring(row["hit"], 1, IBAN_HEAD) if ahead else row["hit"]
        # The gap begins behind the last match, the context may begin before it.
        before = F.right(F.concat(state["tail"], F.right(row["gap"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat_ws(" ", before, row["behind"])).rlike(rf"\b(?:{context})")
        score = F.lit(0.8 if checksum else 0.5) + F.when(near, 0.2).otherwise(0.0)
        span = lambda score: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        more = let(score, lambda s: F.when(F.lit(kind in BASE) | (s >= LEAST_SCORE), F.array_append(state["out"], span(s))).otherwise(state["out"]))
        tail = F.right(F.concat(before, F.right(eaten, F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        return F.struct((start + F.length(eaten)).alias("at"), tail.alias("tail"), F.when(confirmed, more).otherwise(state["out"]).alias("out"))

    def walk_block(state: Column, block: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("out"))
        end = lambda s: F.struct(s["at"].alias("at"), s["tail"].alias("tail"), F.array_append(state["out"], s["out"]).alias("out"))
        return let(F.aggregate(block, begin, walk), end)

    def walk_all(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(BLOCK))
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail"), blocks.alias("out"))
        return F.aggregate(F.transform(numbers, lambda n: F.slice(rows, n + 1, BLOCK)), begin, walk_block, lambda s: F.flatten(s["out"]))

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))).alias("hits"))
    able = may(text) if may else text.rlike(pattern)
    return F.when(able, let(found, lambda f: let(rows(f), walk_all))).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``docs`` with ``pii``, an array of (kind, start, end, score) by kind as listed, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans(text, k) for k in kinds]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "pii")
    of = lambda kind: F.filter("pii", lambda x: x["kind"] == kind)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
