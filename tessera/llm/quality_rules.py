"""Quality rules: a linear-chain CRF labels lines as content or boilerplate, the share of content decides.

Features of a line are a few binary properties of its words and symbols. The
CRF (emission weights per state, transition and start weights) is trained by
gradient ascent on the conditional log-likelihood with forward-backward in
numpy, over a bounded sample of labelled documents; the label of a document is
the distant label of its lines, and repeated lines count as boilerplate.
Viterbi decodes every line of every document; the share of words that stand in
content lines is compared with ``LEAST_SHARE``.

A null or empty text has no words: it fails the base rules. Of clashing labels
of a document the greatest counts. Labels of texts of more than ``SAMPLE_CHARS``
(see ``_store``) characters are not learned from; a very long text is judged
whole, alone in its batch. Of equally good paths the one with boilerplate at
the latest line where they differ is taken. Without labelled rows the prior
weights below are used as they are. Repeated rows are judged alike; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents, sample_texts
from ._words import bounds, buffers, hashes, shingles, slabs

#: Labelled documents in the training sample, at most.
SAMPLE_DOCS = 400
LEAST_SHARE = 0.5
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
NAMES = ("bias", "words<4", "words>=8", "symbols>0.02", "symbols>0.1", "digits>0.15", "letters<0.7", "ends with stop", "starts with capital", "repeat of a line", "repeated words>0.3", "short words>0.25", "mean word>9", "symbol word>0.2")
#: Weights of content over boilerplate before any training.
PRIOR = np.array([0.8, -0.3, 0.4, -1.0, -1.5, -0.6, -1.0, 0.5, 0.3, -1.5, -1.0, 0.5, -0.3, -1.0])


class Lines:
    """Per-row base counts and per-line features of one text column."""

    def __init__(self, text: pa.Array):
        data, off = buffers(text)
        n = len(off) - 1
        start, end, row = bounds(data, off)
        h = hashes(data, start, end, lower=False)
        self.first_word = np.searchsorted(row, np.arange(n + 1))
        self.n_words = np.diff(self.first_word)
        total = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        chars = total((data & 0xC0) != 0x80)
        symbol, letter, digit = total(SYMBOLS[data]), total(LETTERS[data]), total(DIGITS[data])
        word_chars = chars[end] - chars[start]
        per_row = lambda v: np.diff(total(v)[self.first_word])
        self.word_chars = per_row(word_chars)
        self.n_symbols = symbol[off[1:]] - symbol[off[:-1]]
        self.n_repeat_words, repeated = self._repeats(h, row)
        # Lines: a newline ends one, a row ends one.
        breaks = np.flatnonzero(data == 10)
        line_start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
        line_start = line_start[line_start < len(data)]
        line_row = np.searchsorted(off[1:], line_start, side="right")
        line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), off[line_row + 1])
        line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10))
        w0 = np.searchsorted(start, line_start)
        w1 = np.searchsorted(start, line_end)
        has = w1 > w0
        line_start, line_end, line_row, w0, w1 = (x[has] for x in (line_start, line_end, line_row, w0, w1))
        self.line_row, self.line_words = line_row, w1 - w0
        same = self._seen_before(hashes(data, line_start, line_end, lower=False), line_row)
        self.n_dup_lines = np.bincount(line_row[same], minlength=n)
        size = np.maximum(line_end - line_start, 1)
        words = np.maximum(w1 - w0, 1)
        cum_rep, cum_short, cum_sym = total(repeated), total(word_chars <= 3), total(symbol[end] > symbol[start])
        ink = np.maximum((letter[line_end] - letter[line_start]) + (symbol[line_end] - symbol[line_start]) + (digit[line_end] - digit[line_start]), 1)
        last, head = data[end[w1 - 1] - 1] if len(w1) else data[:0], data[start[w0]] if len(w0) else data[:0]
        symbols = (symbol[line_end] - symbol[line_start]) / size
        self.x = np.stack(
            [
                np.ones(len(words)), words < 4, words >= 8, symbols > 0.02, symbols > 0.1,
                (digit[line_end] - digit[line_start]) / ink > 0.15, (letter[line_end] - letter[line_start]) / size < 0.7,
                np.isin(last, np.frombuffer(b".!?", np.uint8)), (head >= 65) & (head <= 90) | (head >= 0xC0), same,
                (cum_rep[w1] - cum_rep[w0]) / words > 0.3, (cum_short[w1] - cum_short[w0]) / words > 0.25,
                (chars[line_end] - chars[line_start]) / words > 9, (cum_sym[w1] - cum_sym[w0]) / words > 0.2,
            ], axis=1,
        ).astype(np.float64)
        self.first_line = np.searchsorted(line_row, np.arange(n + 1))

    @staticmethod
    def _seen_before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether an equal value stands earlier in the same row."""
        order = np.lexsort((np.arange(len(h)), h, row))
        out = np.zeros(len(h), bool)
        if len(h):
            out[order[1:]] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        return out

    def _repeats(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words inside 3-word windows that occur twice or more in their row."""
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            grams = shingles(h, 3)
            inside = row[:-2] == row[2:]
            at, key, owner = np.flatnonzero(inside), grams[inside], row[:-2][inside]
            order = np.lexsort((key, owner))
            k, o = key[order], owner[order]
            again = np.zeros(len(k), bool)
            equal = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
            again[1:] |= equal
            again[:-1] |= equal
            hit = at[order[again]]
            for d in range(3):
                covered[hit + d] = True
        return np.bincount(row[covered], minlength=len(self.n_words)), covered


class ChainCrf:
    """Two states (0 boilerplate, 1 content); weights of content over boilerplate, transitions, start."""

    def __init__(self, weights: np.ndarray | None = None, trans: np.ndarray | None = None, start: np.ndarray | None = None):
        self.weights = PRIOR.copy() if weights is None else weights
        self.trans = np.array([[0.7, -0.7], [-0.7, 0.7]]) if trans is None else trans
        self.start = np.zeros(2) if start is None else start

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 40, rate: float = 1.5, l2: float = 1e-3) -> ChainCrf:
        """Gradient ascent on the mean log-likelihood of the label sequences (x [lines, features], y [lines])."""
        lines = max(1, sum(len(y) for _, y in docs))
        for _ in range(steps):
            gw, gt, gs = -l2 * (self.weights - PRIOR), -l2 * self.trans, -l2 * self.start
            for x, y in docs:
                p, pair = self._marginals(x)
                gw = gw + (y - p[:, 1]) @ x / lines
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                gt = gt + (seen - pair) / lines
                gs = gs + (np.eye(2)[y[0]] - p[0]) / len(docs) / 10
            self.weights, self.trans, self.start = self.weights + rate * gw, self.trans + rate * gt, self.start + rate * gs
        return self

    def _marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        t = np.exp(self.trans)
        n = len(x)
        f, b = np.empty((n, 2)), np.ones((n, 2))
        f[0] = np.exp(self.start) * e[0]
        f[0] /= f[0].sum()
        for i in range(1, n):
            f[i] = (f[i - 1] @ t) * e[i]
            f[i] /= f[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        p /= p.sum(axis=1, keepdims=True)
        pair = np.zeros((2, 2))
        if n > 1:
            q = f[:-1, :, None] * t[None] * (e[1:] * b[1:])[:, None, :]
            pair = (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return p, pair

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of many documents at once, all of them a line further in each step. Document i has lines first[i]:first[i + 1]."""
        emit = x @ self.weights
        sizes = np.diff(first)
        out = np.zeros(len(x), np.int8)
        back = np.zeros((len(x), 2), np.int8)
        order = np.argsort(-sizes, kind="stable")
        longest_first, begin = sizes[order], first[:-1][order]
        score = np.tile(self.start, (len(order), 1))
        alive = int((longest_first > 0).sum())
        score[:alive, 1] += emit[begin[:alive]]
        final = np.zeros((len(order), 2))
        for step in range(1, int(longest_first[0]) + 1 if len(order) else 0):
            now = int(np.searchsorted(-longest_first, -step, side="left"))
            final[now:alive] = score[now:alive]
            alive = now
            if not alive:
                break
            via = score[:alive, :, None] + self.trans[None]
            at = begin[:alive] + step
            back[at] = via.argmax(axis=1)
            score[:alive] = via.max(axis=1)
            score[:alive, 1] += emit[at]
        state = final.argmax(axis=1)
        for step in range(int(longest_first[0]) - 1 if len(order) else -1, -1, -1):
            n = int(np.searchsorted(-longest_first, -step, side="left"))
            at = begin[:n] + step
            out[at] = state[:n]
            if step:
                state[:n] = back[at, state[:n]]
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> ChainCrf:
    """A CRF of at most ``sample`` labelled documents, chosen by a hash of doc_id."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = sample_texts(docs, known, sample).toPandas()
    crf = ChainCrf()
    if rows.empty:
        return crf
    rows = rows.sort_values("doc_id", kind="stable")
    lines = Lines(pa.array(rows["text"], pa.string()))
    y = rows["quality"].to_numpy(np.int64)
    sequences = []
    for i, label in enumerate(y):
        x = lines.x[lines.first_line[i] : lines.first_line[i + 1]]
        if len(x):
            sequences.append((x, np.where(x[:, NAMES.index("repeat of a line")] > 0, 0, label).astype(np.int64)))
    return crf.fit(sequences) if sequences else crf


def label_lines(docs: DataFrame, crf: ChainCrf, least_share: float = LEAST_SHARE, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the base counts, ``content_share`` (of words) and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "__text", 2 << 20):
            lines = Lines(batch.column(len(keep)))
            state = crf.decode(lines.x, lines.first_line)
            content = np.bincount(lines.line_row, weights=state * lines.line_words, minlength=batch.num_rows)
            share = content / np.maximum(lines.n_words, 1)
            failed = (lines.n_words < LEAST_WORDS) | (100 * lines.n_repeat_words > MOST_REPEATED_PERCENT * lines.n_words)
            numbers = [pa.array(getattr(lines, c).astype(np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *numbers, pa.array(failed), pa.array(share), pa.array(~failed & (share >= least_share))], [*keep, *names, "base_failed", "content_share", "kept"])

    bounded_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, content_share double, kept boolean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    crf = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return label_lines(docs, crf)
