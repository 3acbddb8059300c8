"""Whole slabs of text cut into pieces that a tokenizer treats independently, and the token ids of those pieces.

A slab is the concatenated UTF-8 bytes of some rows. Two 256 x 256 tables say
which neighbouring bytes a token never crosses; numpy cuts the slab there.
Equal pieces are encoded once and remembered, and the ids of a slab are one
gather from the remembered ids. Pieces are equal by the 64-bit hash of their
bytes (see ``_words``); a piece of more than ``LONGEST`` bytes is neither
hashed nor remembered.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._words import SPACE, buffers, hashes, remembered

#: Pieces that a worker remembers, at most (about 40 bytes each), and bytes of a piece that is remembered.
MOST_PIECES, LONGEST = 400_000, 64
#: Classes of bytes: unknown (not ASCII, or control characters), space, other white space, letter, digit, apostrophe, mark.
OTHER, BLANK, BREAK, LETTER, DIGIT, QUOTE, MARK = range(7)
CLASS = np.full(256, OTHER, np.int8)
CLASS[0x21:0x7F] = MARK
CLASS[SPACE.nonzero()[0]] = BREAK
CLASS[0x20] = BLANK
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[0x27] = QUOTE
#: Classes that are no white space whatever follows.
INK = (LETTER, DIGIT, QUOTE, MARK)


@remembered
def load(path: str):
    """The tokenizer of a JSON file that Spark distributed or that every machine has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pair_table(test: Callable[[int, int], bool]) -> np.ndarray:
    """For each pair of byte classes (256 * first + second byte): ``test`` of the classes."""
    classes = np.array([[test(a, b) for b in range(7)] for a in range(7)])
    return classes[CLASS[:, None], CLASS[None, :]].ravel()


def segments(text: pa.Array, between: np.ndarray, ahead: np.ndarray | None = None, whole: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each piece, first piece of each row and the total, whether a row is left whole).

    A cut is between two bytes whose pair is in ``between``, before the first
    byte of a pair that is in ``ahead``, and at each row. Rows that hold the
    string ``whole`` are one piece.
    """
    data, offsets = buffers(text)
    left = pc.fill_null(pc.match_substring(text, whole), False).to_numpy(zero_copy_only=False) if whole else np.zeros(len(text), bool)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        pair = data[:-1].astype(np.int32) << 8
        pair |= data[1:]
        edge = offsets[1:-1]
        pair[edge[(edge > 0) & (edge < len(data))] - 1] = 0
        cut[1:-1] = between[pair]
        if ahead is not None:
            cut[:-2] |= ahead[pair]
    for row in np.flatnonzero(left):
        cut[offsets[row] : offsets[row + 1]] = False
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    return data, edges[:-1], edges[1:], np.searchsorted(edges[:-1], offsets), left


class Pieces:
    """Ids of pieces, by the hash of a piece, kept across slabs and tasks of a worker process.

    ``encode`` gives the ids of each of a list of strings. When there is no
    room, pieces that came in one slab only are forgotten first.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = MOST_PIECES):
        self.encode, self.most = encode, most
        self.forget(np.zeros(0, bool))

    def forget(self, keep: np.ndarray) -> None:
        if not keep.any():
            self.key, self.size, self.slabs = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)
            return
        self.key, self.slabs, size = self.key[keep], self.slabs[keep], self.size[keep]
        self.flat = self.gather(np.flatnonzero(keep))[0]
        self.begin, self.size = np.cumsum(size, dtype=np.int64) - size, size

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each) of remembered pieces."""
        return _gather(self.flat, self.begin[at], self.size[at])

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each piece). ``alone``: pieces that are not to be remembered."""
        alone = alone | (end - start > LONGEST)
        coded = pa.array(hashes(data, start, end, lower)).dictionary_encode()
        code, key = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
        if alone.any():
            # Each a key of its own, behind the others.
            code[alone] = len(key) + np.arange(alone.sum())
        shared = np.zeros(len(key), bool)
        shared[code[~alone]] = True
        example = np.zeros(len(key) + alone.sum(), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == key[inside]
        raw = data.tobytes()
        text = lambda k: [raw[start[i] : end[i]].decode() for i in example[k].tolist()]
        new = np.flatnonzero(shared & ~known)
        fresh = self.encode(text(np.concatenate([new, np.arange(len(key), len(example))])))
        size = np.array([len(x) for x in fresh], np.int32)
        flat = np.concatenate([self.flat, *_chunks(fresh)])
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        of_begin, of_size = np.zeros(len(example), np.int64), np.zeros(len(example), np.int32)
        of_begin[:len(key)][known], of_size[:len(key)][known] = self.begin[place[known]], self.size[place[known]]
        of_begin[new], of_size[new] = begin[: len(new)], size[: len(new)]
        of_begin[len(key) :], of_size[len(key) :] = begin[len(new) :], size[len(new) :]
        out = _gather(flat, of_begin[code], of_size[code])
        self.slabs[place[known & shared]] += 1
        self._remember(key[new], size[: len(new)], flat[: len(self.flat) + int(size[: len(new)].sum())])
        return out

    def _remember(self, key: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if len(self.key) + len(key) > self.most:
            again = self.slabs > 1
            old = len(self.flat)
            self.forget(again if again.sum() * 2 <= self.most else np.zeros(len(again), bool))
            flat = np.concatenate([self.flat, flat[old:]])
            if len(self.key) + len(key) > self.most:
                return
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        self.key, self.size, self.begin = np.insert(self.key, at, key[order]), np.insert(self.size, at, size[order]), np.insert(self.begin, at, begin[order])
        self.slabs, self.flat = np.insert(self.slabs, at, np.ones(len(key), np.int32)), flat


def _chunks(lists: list[list[int]]) -> list[np.ndarray]:
    return [np.fromiter((t for x in lists for t in x), np.int32)] if lists else []


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(size, dtype=np.int64)
    at = np.repeat(begin - (stop - size), size)
    at += np.arange(len(at))
    return flat[at], size


def list_offsets(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Offsets of the ids of each row: ``first`` piece of each row and the total, ``size`` of each piece."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])[first]


def letter_table(pretokens) -> dict[int, str]:
    """Code point of each Latin letter that NFC leaves alone -> its text in the byte-level alphabet, after normalisation."""
    return {ord(c): "".join(pretokens(c)) for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº"}
