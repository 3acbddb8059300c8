"""Functions on sequences, CIGAR strings, qualities and probabilities, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the nucleotide codes.
CODES, COMPLEMENTS = "ACGTRYMKVBHDacgtrymkvbhd", "TGCAYRKMBVDHtgcayrkmbvdh"
OPS = r"(\d+)([MIDNSHP=X])"


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, CODES, COMPLEMENTS))


def edit_distance(a: Column, b: Column) -> Column:
    """The smaller Levenshtein distance to the sequence or its reverse complement."""
    return F.least(F.levenshtein(a, b), F.levenshtein(a, reverse_complement(b)))


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op), from one pass over the string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(OPS), F.lit(0)), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")))


def ops_length(ops: Column, kinds: str) -> Column:
    """Summed lengths of the operations in ``kinds`` of a parsed CIGAR."""
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, p: a + F.when(F.contains(F.lit(kinds), p["op"]), p["n"]).otherwise(0))


def cigar_lengths(cigar: Column, kinds: str) -> Column:
    """Summed lengths of the operations in ``kinds``."""
    return ops_length(cigar_ops(cigar), kinds)


#: Operations of a match and of the aligned block: all but clips.
MATCH, BLOCK = "M", "MIDNP=X"


def identity(ops: Column, nm: Column) -> Column:
    """(matches - mismatches) / block length of a parsed CIGAR, to six digits."""
    return F.round((ops_length(ops, MATCH) - nm) / ops_length(ops, BLOCK), 6)


def divergence_identity(nm: Column, matched: Column) -> Column:
    """1 - mismatch rate (to six digits) of a long read."""
    return 1 - F.round(nm / matched, 6)


def cigar_expand(cigar: Column) -> Column:
    """``3M1I`` as ``MMMI``."""
    return F.array_join(F.transform(cigar_ops(cigar), lambda x: F.repeat(x["op"], x["n"].cast("int"))), "")


def run_lengths(s: Column) -> Column:
    """``MMMI`` as ``3M1I``: each run is one match of a back reference."""
    runs = F.regexp_extract_all(s, F.lit(r"((.)\2*+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def haldane(cm: Column) -> Column:
    """Recombination probability of a distance in centimorgans."""
    return (1 - F.exp(-2 * cm / 100)) / 2


def to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def from_phred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def log_mean(a: Column, b: Column) -> Column:
    """log10 of the mean of 10**a and 10**b without overflow."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b))) - F.log10(F.lit(2.0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i), i)), lambda i: i.isNotNull())
    return F.array_max(same)


def trim_variant(pos: Column, ref: Column, alt: Column) -> Column:
    """(pos, ref, alt) without the shared suffix, then without the shared prefix; one base stays of each."""
    short = lambda a, b: F.least(F.length(a), F.length(b)) - 1
    tail = F.greatest(F.lit(0), F.least(common_prefix(F.reverse(ref), F.reverse(alt)), short(ref, alt)))
    r, a = F.substr(ref, F.lit(1), F.length(ref) - tail), F.substr(alt, F.lit(1), F.length(alt) - tail)
    head = F.greatest(F.lit(0), F.least(common_prefix(r, a), short(r, a)))
    return F.struct((pos + head).alias("pos"), F.substr(r, head + 1, F.length(r)).alias("ref"), F.substr(a, head + 1, F.length(a)).alias("alt"))


def complexity(s: Column, k: int) -> Column:
    """Number of different k-mers."""
    return F.when(F.length(s) >= k, F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))))).otherwise(0)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), by a fold over the logarithms of its terms, which do not vanish for large n."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log(1 - p))

    def step(s: Column, i: Column) -> Column:
        t = s["t"] + F.ln((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (s["c"] + F.when(i >= k, F.exp(t)).otherwise(0.0)).alias("c"))

    start = F.struct(first.alias("t"), F.when(k <= 0, F.exp(first)).otherwise(F.lit(0.0)).alias("c"))
    return F.when(n < 1, F.when(k <= 0, 1.0).otherwise(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, step, lambda s: F.least(s["c"], F.lit(1.0))))


def odd_kmer_length(genome: Column) -> Column:
    """The odd k of int(log2 g) + 1."""
    k = F.floor(F.log2(genome)) + 1
    return k + (1 - k % 2)


def normal_name(name: Column) -> Column:
    """Allele name without the locus prefix, ``*`` and ``:`` as ``_``."""
    return F.translate(F.regexp_replace(name, "^HLA-", ""), "*:", "__")


def two_fields(name: Column) -> Column:
    return F.array_join(F.slice(F.split(name, ":"), 1, 2), ":")


def quality_bin(q: Column, edges: tuple[int, ...] = (2, 10, 20, 25, 30, 35, 40)) -> Column:
    """The greatest edge not above a quality; the default edges are the bins of eight that sequencers report."""
    out = F.lit(0)
    for e in edges:
        out = F.when(q >= e, e).otherwise(out)
    return out


#: A nucleotide code is the set of its bases (A 1, C 2, G 4, T 8), here at the place of that number.
BASE_SETS = "XACMGRSVTWYHKDBN"


def merge_bases(a: Column, b: Column, how: str = "union", draw: Column | None = None) -> Column:
    """Two sequences base by base, as far as the shorter reaches: ``union`` or ``intersect`` of the sets that their codes stand for, ``mask`` (intersection, small where one is N) or ``random``.

    A base is small where the result is uncertain: no common base, one of both
    small (``union``), both small (else). ``random``: of two different sets one
    base is drawn by the bits of ``draw`` (a number for the pair of sequences) mixed with the position.
    """
    n = F.least(F.length(a), F.length(b))
    letters = lambda s: F.split(F.substr(s, F.lit(1), n), "")

    def code(c: Column) -> Column:
        at = F.instr(F.lit(BASE_SETS), F.upper(c)) - 1
        return F.when(at > 0, at).otherwise(15)

    big = lambda c: c != F.lower(c)

    def one(x: Column, y: Column) -> Column:
        p, q = code(x), code(y)
        both, any_ = p.bitwiseAND(q), p.bitwiseOR(q)
        found = {"union": any_, "intersect": both, "mask": both}[how]
        sure = {"union": big(x) & big(y), "intersect": (big(x) | big(y)) & (both > 0), "mask": (big(x) | big(y)) & (both > 0) & (p < 15) & (q < 15)}[how]
        base = F.substr(F.lit(BASE_SETS), found + 1, F.lit(1))
        return F.when(sure, base).otherwise(F.lower(base))

    def drawn(x: Column, y: Column, i: Column) -> Column:
        p, q = code(x), code(y)
        both, any_ = p.bitwiseAND(q), p.bitwiseOR(q)
        bits = F.ascii(F.md5(F.concat_ws(":", draw.cast("string"), i.cast("string"))))
        ones = lambda c: F.bit_count(c)
        heads, larger = bits % 2 == 1, F.floor(bits / 2) % 2 == 1
        low, high = any_.bitwiseAND(-any_), F.pow(F.lit(2), F.floor(F.log2(any_.cast("double")))).cast("int")
        found = F.when((ones(p) == 1) & (ones(q) == 1), any_).when((ones(p) + ones(q) == 3) & (both > 0), F.when(heads, both).otherwise(any_)).when((ones(p) == 2) & (p == q), F.when(heads, F.when(larger, high).otherwise(low)).otherwise(any_))
        base = F.substr(F.lit(BASE_SETS), F.coalesce(found, p) + 1, F.lit(1))
        return F.when(found.isNotNull() & big(x) & big(y), base).otherwise(F.lower(base))

    if how == "random":
        triples = F.arrays_zip(letters(a).alias("x"), letters(b).alias("y"))
        return F.array_join(F.transform(triples, lambda t, i: drawn(t["x"], t["y"], i)), "")
    return F.array_join(F.zip_with(letters(a), letters(b), one), "")


#: Words for true and false.
TRUE, FALSE = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def boolean(text: Column) -> Column:
    """A flag from its word; null for any other."""
    return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)


def masked(seq: Column, start: Column, size: int, letter: str = "N") -> Column:
    """Upper case, with ``size`` characters from ``start`` (0-based) on replaced."""
    return F.overlay(F.upper(seq), F.lit(letter * size), start + 1, F.lit(size))


def agreed(a: Column, b: Column, letter: str = "N") -> Column:
    """Where two sequences agree, their character, else ``letter``; as long as the shorter."""
    n = F.least(F.length(a), F.length(b))
    letters = lambda s: F.split(F.substr(s, F.lit(1), n), "")
    return F.array_join(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, x).otherwise(letter)), "")
