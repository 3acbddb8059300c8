r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.
``locate`` renders successive prefixes of a conversation and compares
consecutive outputs: a turn's span is what its prefix adds. If an output does
not begin with the one before, the template rewrites history, and the turn is
reported so. Rendering the same prefix once more with a marker as its last
text gives the place of the text inside the span, without knowing the
template.

``marked`` is the template used here. A turn is ``### role: text</turn>`` and a
line end; inside role and text a backslash stands before every control string
(``\``, ``###``, ``</turn>``, and ``:`` in a role), so that ``parse`` gets back
exactly what went in.

Turns are ordered by turn number (null first), then role and text, so repeated
rows each count. A null text or role is empty. Rows of a null conv_id are one
conversation. An empty table gives an empty result; other columns are ignored.
Rows are shuffled by conversation and streamed in order; a task holds one
conversation at a time, a very long text with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise

Turn = tuple[str, str]
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
BODY = r"(?:\\(?:\\|###|</turn>|:)|[^\\<]|<(?!/turn>))*"
TURN = re.compile(rf"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ({BODY})</turn>\n", re.DOTALL)
#: A text that no template writes itself.
MARKER = "\ue0f1"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    return "".join(f"### {escape(role).replace(':', '\\:')}: {escape(text)}</turn>\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def locate(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """(rendered conversation, (start, end, text start, text end) of each turn, turns at which history was rewritten).

    Spans of turns that a later prefix rewrote are (-1, -1, -1, -1): what they
    were is no longer in the text.
    """
    before, spans, rewritten = "", [], []
    for i in range(1, len(turns) + 1):
        now = template(turns[:i])
        if not now.startswith(before):
            rewritten.append(i - 1)
            common = next((k for k, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            spans = [s if s[1] <= common else (-1, -1, -1, -1) for s in spans]
            begin = max([common, *(s[1] for s in spans)])
        else:
            begin = len(before)
        probe = template([*turns[: i - 1], (turns[i - 1][0], MARKER)])
        at = probe.find(MARKER, begin)
        end = len(now) - (len(probe) - at - len(MARKER)) if at >= 0 else -1
        spans.append((begin, len(now), at, end) if at >= 0 and end >= at else (begin, len(now), -1, -1))
        before = now
    return before, spans, rewritten


FORMATTED = "conv_id long, formatted string, spans array<struct<start: int, end: int, loss: boolean>>, rewritten array<int>"


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = marked, learn: str = "assistant") -> DataFrame:
    """One row per conversation: its text, the span of every turn's text with whether it is learned, and turns that rewrote history."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(span), pa.list_(pa.int32())))], ["conv_id", "formatted", "spans", "rewritten"])

        size = 0
        for conv, own in groupby(turns(), key=lambda r: r[0]):
            conversation = [(role or "", text or "") for _, role, text in own]
            text, spans, rewritten = locate(conversation, template)
            held.append((conv, text, [{"start": s, "end": e, "loss": role == learn} for (role, _), (_, _, s, e) in zip(conversation, spans, strict=True)], rewritten))
            size += len(text)
            if size > 4 << 20:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    picked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    sorted_rows = picked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")
    return sorted_rows.mapInArrow(run, FORMATTED)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: formatted conversations to digests of what the text and its mask hold."""
    for batch in batches:
        out = []
        for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans if s["loss"] and s["start"] >= 0)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)


HARD = r"\### Assistant: </turn> ok"

#: The same columns from the turns themselves: escaping adds a backslash to every control string, and a colon of a role.
SQL = rf"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
 o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM t),
 s AS (SELECT *, 14 + length(r) + len(regexp_extract_all(r, '\\|###|</turn>')) + length(r) - length(replace(r, ':', '')) + length(x) + len(regexp_extract_all(x, '\\|###|</turn>')) AS n FROM o)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(length(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant')), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    formatted = materialise(format_conversations(rows.unionByName(planted)), "conversations")
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
