import collections
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_ops import empty, folder, texts  # noqa: F401  (fixtures)

from tessera.llm import collocations, fill_in_middle, packing, queries


# --- packing


def plain_best_two_fit(lengths, capacity):
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(max(fits))
            own.append(max(fits))
            gap -= max(fits)
        if gap and len(own) > 1:
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[:i] if min(own) < a + b <= gap + min(own)]
            if pairs:
                least, (_, a, b) = min(own), max(pairs)
                own.remove(least)
                own += [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, least])
        bins.append(tuple(sorted(own)))
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 60), st.lists(st.integers(1, 1000), max_size=60))
def test_equal_bins_at_once_are_the_same_bins(capacity, numbers):
    lengths = [1 + x % capacity for x in numbers]
    patterns = packing.best_two_fit(np.bincount(np.array(lengths, int), minlength=capacity + 1))
    got = [tuple(sorted(x for x, k in used.items() for _ in range(k))) for bins, used in patterns for _ in range(bins)]
    assert sorted(got) == plain_best_two_fit(lengths, capacity)


def test_two_smaller_ones_take_the_place_of_the_smallest():
    # 6 and 3 leave a gap of 1; without the 3, two documents of 2 fill the bin.
    assert plain_best_two_fit([6, 3, 2, 2], 10) == [(2, 2, 6), (3,)]
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11)) == [(1, {6: 1, 2: 2}), (1, {3: 1})]


def test_a_plan_is_as_small_as_the_table_of_lengths():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 1_000_000), 1, 4096).astype(int)
    patterns = packing.best_two_fit(np.bincount(lengths, minlength=4097))
    assert len(packing.places(patterns)) < 5 * 4096
    assert sum(bins for bins, _ in patterns) <= 1.001 * lengths.sum() / 4096 + 1


def check_packing(rows, docs, encode, capacity, end_id):
    """Rows (doc_id, piece, start, length, crc, sequence_id, offset) hold every id once, in sequences without gaps."""
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    held = collections.Counter()
    for i, text in docs:
        ids = [*encode(text or ""), end_id]
        cut = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        want = [(k, k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i])
        assert got == want
        held.update(map(len, cut))
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(tuple(sorted(n for _, n in own)) for own in spans.values()) == plain_best_two_fit(list(held.elements()), capacity)


def test_op11_packs_every_id_once(spark, folder):  # noqa: F811
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = queries.QUERIES["op11_best_fit_packing"](spark, folder).collect()
    check_packing(rows, list(enumerate(texts())), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 4096, 1)


def test_sequences_are_the_packed_ids(spark, folder):  # noqa: F811
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("source", "offset")
    packed = packing.pack_documents(docs.repartition(7), public_tokenizers.path("word_bpe_49k.json"), capacity=200, keep=("doc_id", "lang", "ids", "offset", "n_chars"))
    assert packed.columns == ["doc_id", "lang", "n_chars", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows, made = packed.collect(), {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert {r["sequence_id"] for r in rows} == set(made) and all(len(r["ids"]) <= 200 and sum(r["lengths"]) == len(r["ids"]) for r in made.values())
    for r in rows:
        assert made[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]


# --- fill in the middle


TOKENS = re.compile(fill_in_middle.TOKEN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x85\xa0ab<>"), st.characters(codec="utf-8")), max_size=80), st.integers(1, 9))
def test_offsets_are_those_of_the_matches(text, size):
    want = [*(m.start() for m in TOKENS.finditer(text)), len(text)]
    for tokens in (fill_in_middle.Tokens(), fill_in_middle.Tokens(size=size)):
        assert tokens.offsets(text).tolist() == want


def plain_fim(doc_id, text):
    import hashlib

    text = text or ""
    tokens = TOKENS.findall(text)
    n, h = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, brute.sha(text), brute.sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if spm else "psm", len(p), len(m), brute.sha(out), brute.sha(text)


def test_op12_against_the_plain_version(spark, folder):  # noqa: F811
    rows = queries.QUERIES["op12_fill_in_middle"](spark, folder).collect()
    want = dict(enumerate(texts()))
    assert len(rows) == len(want) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r)[1:] == plain_fim(r["doc_id"], want[r["doc_id"]])


def test_fill_in_middle_marks_nulls_and_other_columns(spark):
    docs = [(i, t, "o") for i in range(40) for t in ("a <P> b", "<S", "P>x<", "a<b<M c", "  ", None)] + [(None, "one two three", "o")]
    df = spark.createDataFrame(docs, "doc_id long, text string, output string").withColumnRenamed("text", "body")
    made = fill_in_middle.fill_in_middle(df, text_col="body", rate=100)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("text", fill_in_middle.restored(made["output"], made["form"])).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((i, t or "") for i, t, _ in docs)
    assert all((r["form"] == "plain") == (r["text"] in ("", "a <P> b")) for r in back)
    assert all(r["form"] == "plain" for r in fill_in_middle.fill_in_middle(df, text_col="body", rate=0).collect())


def test_a_very_long_text_is_sliced(spark):
    text = "word " * 200_000 + "x" * 300_000 + " end"
    r = fill_in_middle.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string"), rate=100, spm_rate=0).first()
    assert r["n"] == 200_002 and r["form"] == "psm" and len(r["output"]) == len(text) + 9


# --- collocations


def plain_collocations(docs, least, cover=50, top=2000, depth=3):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, depth + 1) for i in range(len(w) - n + 1))
    long = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    held = collections.Counter()
    for (lang, w), a in long.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                held[lang, w[i : i + n]] = max(held[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in long.items():
        if not (held[lang, w] and 100 * held[lang, w] >= cover * a):
            score, _, left, right = min((10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, totals[lang], -score) for lang, rows in out.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def corpus(n=160):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["é", "😀x", "a<b", "#"]
    docs = []
    for i in range(n):
        parts = [rng.choice(["of the one", "new york city", rng.choice(words), "Of The"]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["en", "de", None, "und", ""]), "".join(parts)))
    return docs + [("en", None), ("en", ""), (None, " \t\n"), ("en", "of the one " * 3000), ("xx", "a b")]


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_collocations_against_the_plain_version(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = plain_collocations(docs, 10)
    assert want and {len(w[2].split()) for w in want} == {2, 3}
    assert rows_of(collocations.collocations(df)) == want


@pytest.mark.parametrize("fan", [2, 64])
def test_ranges_and_steps_of_merging_change_nothing(spark, monkeypatch, fan):
    monkeypatch.setattr(collocations, "MARK", 32)
    docs = corpus()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    assert rows_of(collocations.collocations(df, least=3, top=40, chunk=600, nodes=300, fan=fan)) == plain_collocations(docs, 3, top=40)


def test_four_words_and_other_names(spark):
    docs = [("en", "a b c d e a b c d, a b c d")] * 4 + [("en", "a b x")] * 9
    df = spark.createDataFrame([(t, lang, 1) for lang, t in docs], "body string, tongue string, n long")
    assert rows_of(collocations.collocations(df, "body", "tongue", depth=4, least=3)) == plain_collocations(docs, 3, depth=4)


def test_tries_survive_dumping_and_cutting():
    rng = random.Random(3)
    parts = [pa.array([" ".join(rng.choices("abcdefgh", k=30)) for _ in range(20)]) for _ in range(4)]
    tries = [collocations.count_trie(p, 3) for p in parts]
    whole = collocations.count_trie(pa.concat_arrays(parts), 3)
    same = lambda a, b: a.words.equals(b.words) and all((x == y).all() for p, q in zip((a.parent, a.word, a.count), (b.parent, b.word, b.count)) for x, y in zip(p, q))
    assert same(collocations.merge([collocations.Trie.load(t.dump()) for t in tries]), whole)
    codes = np.sort(np.concatenate([c for c, _ in whole.codes("en")]))
    edges = np.unique(codes[50::50])
    found = collections.Counter()
    for r, t in collocations.cut(whole, "en", edges, (0, len(edges))):
        for batch in collocations.phrases(t, "en", edges, r, 1):
            found.update((tuple(w), n) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    assert sum(found.values()) == len(whole) == len(found)


def test_counts_past_64_bits_are_exact(spark):
    big = 3_000_000_019
    found = spark.createDataFrame([("en", ["a"], 4 * big, []), ("en", ["b"], 5 * big, []), ("en", ["a", "b"], big, [4 * big])], "lang string, words array<string>, occurrences long, lefts array<long>")
    r = collocations.scored(collocations.candidates(found, 2), 50).collect()
    assert [(x["a"], x["l"], x["r"], x["score"]) for x in r] == [(big, 4 * big, 5 * big, 1_000_000 * big * big // (20 * big * big))]
