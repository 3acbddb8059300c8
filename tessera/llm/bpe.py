"""BPE encoding and decoding by forced-boundary splitting.

A merge joins two neighbouring symbols into a vocabulary token, so a cut
between two bytes whose pair occurs inside no token can never be merged over.
Such pairs, read off the vocabulary once, mark certain cuts, at two levels:

* In a whole slab of texts at once, by a table of byte pairs: white space
  (which the pre-tokenizer drops) and pairs that are no token's and that end a
  pre-token (a letter before a mark, either beside a digit, and so on).
* In one pre-token, in the byte-level alphabet, before its merges. The last
  fragment carries the end-of-word suffix, others are merged without it.

Every piece of a slab is encoded on its own and remembered (see ``_tokens``);
the ids of the pieces are concatenated. ASCII letters are compared in lower
case, as the normaliser makes them so. Decoding puts the texts of the ids
together.

Texts that are null encode as empty. Special tokens written in a text are
recognised, as the library does; such a text is one piece. A very long text is
a slab of its own. Repeated rows are encoded alike, other columns ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import bounded_batches, documents
from ._tokens import BLANK, BREAK, DIGIT, LETTER, MARK, QUOTE, Pieces, letter_table, list_offsets, load, pair_table, segments
from ._words import SPACE, buffers, remembered, slabs

#: Neighbouring classes of bytes between which a pre-token ends, whatever stands around them.
ENDS = {(LETTER, MARK), (LETTER, QUOTE), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, MARK), (DIGIT, QUOTE), (MARK, LETTER), (MARK, DIGIT)}


def forced_pairs(tokens: list[str], suffix: str) -> set[str]:
    """Pairs of neighbouring characters inside some token; any other pair forces a cut."""
    inside: set[str] = set()
    for t in tokens:
        body = t.removesuffix(suffix) if suffix else t
        inside.update(map("".join, zip(body, body[1:])))
    return inside


class FragmentEncoder:
    """Encodes pieces of text, and whole slabs by their pieces."""

    def __init__(self, path: str):
        from tokenizers import models

        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = re.compile("|".join(map(re.escape, specials))) if specials else None
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.inside = forced_pairs(list(model["vocab"]), suffix)
        self.last = self.tokenizer.model
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges) if suffix else self.last
        self.letters = letter_table(self.pretokens)
        self.simple = re.compile(f"[{''.join(map(chr, self.letters))}]+").fullmatch
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.value = pa.array([t for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])], pa.string())
        # Printable ASCII stands for itself in the byte-level alphabet.
        free = pair_table(lambda a, b: (a, b) in ENDS)
        free[[256 * a + b for a in range(0x21, 0x7F) for b in range(0x21, 0x7F) if chr(a) + chr(b) in self.inside]] = False
        white = pair_table(lambda a, b: (a in (BLANK, BREAK)) != (b in (BLANK, BREAK)))
        self.cuts = free | white
        self.pieces = Pieces(lambda new: [self.piece(p) for p in new])

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text in the byte-level alphabet."""
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def fragments(self, text: str) -> list[int]:
        """Ids of one pre-token, cut at every forced pair."""
        if all(map(self.inside.__contains__, map(add, text, text[1:]))):
            return [t.id for t in self.last.tokenize(text)]
        out, begin = [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.inside:
                out += self.inner.tokenize(text[begin:i])
                begin = i
        return [t.id for t in out + self.last.tokenize(text[begin:])]

    def piece(self, text: str) -> list[int]:
        """Ids of a piece: one pre-token of plain letters, or any text."""
        if self.simple(text):
            return self.fragments(text.translate(self.letters))
        ids, at = [], 0
        for m in [*self.any_special.finditer(text), None] if self.any_special and "<|" in text else [None]:
            ids += [t for word in self.pretokens(text[at : m.start() if m else len(text)]) for t in self.fragments(word)]
            if m:
                ids.append(self.special_id[m[0]])
                at = m.end()
        return ids

    def encode(self, text: pa.Array) -> pa.ListArray:
        """Ids of every row of a text column."""
        data, start, end, first, left = segments(text, self.cuts, whole="<|")
        alone = np.zeros(len(start), bool)
        alone[first[:-1][left]] = True
        keep = alone | ~SPACE[data[start]]
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        ids, size = self.pieces.ids(data, start[keep], end[keep], alone[keep], lower=True)
        return pa.ListArray.from_arrays(pa.array(list_offsets(first, size), pa.int32()), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text of every list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.value.take(ids.values)), " ")


@remembered
def fragment_encoder(path: str) -> FragmentEncoder:
    """The encoder of this tokenizer in this worker process; what it remembers outlives a task, until one of another operator runs there."""
    return FragmentEncoder(path)


ENCODED = "ids array<int>, decoded string"


def encode_bpe(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` and ``decoded``, each of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fragment_encoder(tokenizer_path)
        for batch in slabs(batches, "__text", 1 << 20, keep=True):
            ids = encoder.encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, encoder.decode(ids)], [*keep, "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}, {ENCODED}")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, ids, decoded) to counts and SHA-256."""
    sha = lambda data, off: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    for batch in batches:
        lists = batch.column(1)
        off = lists.offsets.to_numpy()
        ids = sha(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), off)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(ids, pa.string()), pa.array(sha(*buffers(batch.column(2))), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_bpe(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: every document with its ids in place of its text, and its other columns."""
    import public_tokenizers

    others = tuple(c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens", "decoded"))
    rows = encode_bpe(docs, public_tokenizers.path("word_bpe_49k.json"), keep=others)
    return rows.select(*others, F.size("ids").cast("long").alias("n_tokens"), "ids")
