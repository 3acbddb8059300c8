"""Fill-in-middle: a text is cut at two token boundaries and its parts change places behind marks.

Tokens come from the tokenizers library's ``Split`` pre-tokenizer, which needs
no training: each match of ``TOKEN`` stays a piece of its own (``isolated``),
and a piece carries its code-point offsets. The offsets of a text, closed by
its length, are one array: its length gives n, and the offsets at the two drawn
ranks slice the text. A text of more than ``SLICE`` characters is matched slice
by slice; slices end where a token always ends (a word before white space), so
the memory of the matcher is bounded by the longest word, and cuts are the same.

The draws are the first four 8-digit groups of SHA-256(``seed:doc_id``): two
ranks, whether the text is changed, and which form it takes.

* plain: the text; also if it is empty or holds a mark.
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle.
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

No mark begins inside another and no text that is changed holds one, so the
marks of an output are found again and ``restored`` is the exact text.

A null text is empty (n = 0, plain). A null doc_id is drawn as an empty
number. Rows with one doc_id share their draws; repeated rows come out alike.
Very long texts are taken whole. Other columns stay, those named as a new one
is are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, free_name
from ._words import slabs

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Where a token ends whatever follows: behind a word, before white space.
WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
#: Characters matched at a time.
SLICE = 1 << 18
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Tokens:
    """Code-point offsets of the tokens of a text."""

    def __init__(self, pattern: str = TOKEN, size: int = SLICE):
        from tokenizers import Regex, pre_tokenizers

        self.split, self.size = pre_tokenizers.Split(Regex(pattern), "isolated"), size

    def offsets(self, text: str) -> np.ndarray:
        """Where each token begins, then where the last one ends: n + 1 numbers, one if there is no token."""
        begins, at = [], 0
        while at < len(text):
            ends = WORD_END.search(text, at + self.size - 1) if at + self.size < len(text) else None
            to = ends.end() if ends else len(text)
            begins.append(at + np.fromiter((where[0] for _, where in self.split.pre_tokenize_str(text[at:to])), np.int64))
            at = to
        return np.concatenate([*begins, np.array([len(text)])])


def arrange(prefix: str, middle: str, suffix: str, form: str) -> str:
    """The parts of a text in the order of ``form``."""
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == PSM else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 hexadecimal digits, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (null if plain) and output in place of the text.

    ``rate``: percent of texts to be changed; ``spm_rate``: percent of those in the order suffix, prefix, middle.
    """
    new = [f.split()[0] for f in CUT.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in (*new, text_col.lower())]
    whole = free_name(docs, "whole")

    def cut(text: str, h: list[int], tokens: Tokens) -> tuple:
        at = tokens.offsets(text)
        n = len(at) - 1
        if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return n, PLAIN, None, None, text
        form = SPM if h[3] % 100 < spm_rate else PSM
        a, b = (int(at[i]) for i in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        return n, form, a, b - a, arrange(text[:a], text[a:b], text[b:], form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slabs(batches, whole):
            text, *drawn = (c.to_pylist() for c in batch.columns[len(keep) :])
            rows = [cut(t, h, tokens) for t, h in zip(text, zip(*drawn, strict=True), strict=True)]
            made = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *new])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), text.alias(whole), *(h.alias(f"{whole}{i}") for i, h in enumerate(draws(F.col(id_col), seed))))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, kept + CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    part = lambda i: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(i))
    # Before the first mark stands nothing; behind the last one the middle.
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir, "doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS i, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
         WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(u[greatest(i, j) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
