"""What the methods add to the base of a query, and learned queries row by row, on planted documents."""

import base64
import collections
import json
import math
import random
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def planted(rng, items):
    """(text, [(kind, start, end)]) of prose with some of ``items`` (kind, before, item, counts) at known places."""
    text, spans = "", []
    for kind, before, item, counts in rng.sample(items, rng.randint(0, len(items))):
        text += " ".join(rng.choices(["river", "é😀", "walks", "under"], k=rng.randint(14, 20))) + f" {before} "
        if counts:
            spans.append((kind, len(text), len(text) + len(item)))
        text += item + " "
    return text + "end", spans


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op3_added_spans(spark, tmp_path):
    rng = random.Random(21)
    items = [
        ("iban", "konto", "DE89370400440532013000", True), ("iban", "zz", "GB82 WEST 1234 5698 7654 32", True), ("iban", "account", "DE89370400440532013001", False), ("amex", "amex", "378282246310005", True), ("amex", "amex", "378282246310006", False),
        ("ssn", "ssn", "123-45-6789", True), ("ssn", "xx", "123-45-6789", False), ("ssn", "ssn", "900-45-6789", False),
    ]
    docs = [planted(rng, items) for _ in range(60)]
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_pii"](spark, write(spark, tmp_path, [(i, t) for i, (t, _) in enumerate(docs)])).collect()}
    order = ["email", "ip", "card", "phone", "iban", "amex", "ssn"]
    for i, (text, spans) in enumerate(docs):
        base = [tuple(x.split(":")) for x in brute.pii(text).split(",") if x]
        want = [*((k, int(s), int(e)) for k, s, e in base), *spans]
        assert rows[i]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(want, key=lambda x: (order.index(x[0]), x[1])))
    assert sum(len(s) for _, s in docs) > 60


def test_op8_added_spans(spark, tmp_path):
    rng = random.Random(22)
    b64 = lambda data: base64.urlsafe_b64encode(data).rstrip(b"=").decode()
    part = lambda x: b64(json.dumps(x).encode())
    ed = bytes.fromhex("302e020100300506032b657004220420") + rng.randbytes(32)
    key = base64.b64encode(ed).decode()
    items = [
        ("jwt", "see", f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'a'})}.{b64(rng.randbytes(32))}", True), ("jwt", "see", f"{part({'typ': 'JWT'})}.{part({'sub': 'a'})}.{b64(rng.randbytes(32))}", False),
        ("der", "see", key, True), ("der", "see", base64.b64encode(b"\x31" + ed[1:]).decode(), False), ("key", "see", f"-----BEGIN PRIVATE KEY-----\n{key}\n-----END PRIVATE KEY-----", True), ("key", "see", f"-----BEGIN PRIVATE KEY-----\n{key[:-8]}\n-----END PRIVATE KEY-----", False),
    ]
    docs = [planted(rng, items) for _ in range(60)]
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_secrets"](spark, write(spark, tmp_path, [(i, t) for i, (t, _) in enumerate(docs)])).collect()}
    for i, (_, spans) in enumerate(docs):
        added = [x for x in rows[i]["spans"].split(",") if x and x.split(":")[0] in ("jwt", "der", "key", "ssh")]
        assert added == [f"{k}:{s}:{e}" for k, s, e in spans]
    assert sum(len(s) for _, s in docs) > 60


@given_tables
def test_op9_scores_by_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_quality_classifier"](spark, SF).collect()}
    assert len({round(r["score"], 6) for r in rows.values()}) > 100
    for i, text in docs.collect():
        ids = [x for own in quality_classifier.features(pa.array([text], pa.string()))[0] for x in own.tolist()]
        z = sum(float(model.parts[x]) for x in ids) / max(len(ids), 1) + model.bias
        assert rows[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert rows[i]["predicted"] == int(rows[i]["score"] >= 0.3)


@given_tables
def test_op10_verdicts_line_by_line(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    crf = quality_rules.train(docs, labels)
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, SF).collect()}
    for i, text in docs.collect():
        lines = quality_rules.Lines(pa.array([text], pa.string()))
        n, best = len(lines.x), np.zeros(2)
        state = []
        if n:
            # Plain Viterbi, one line after the other.
            emit, back = lines.x @ crf.weights, []
            best = crf.start + np.array([0.0, emit[0]])
            for e in emit[1:]:
                via = best[:, None] + crf.trans
                back.append(via.argmax(axis=0))
                best = via.max(axis=0) + np.array([0.0, e])
            state = [int(best.argmax())]
            for b in reversed(back):
                state.append(int(b[state[-1]]))
            state.reverse()
        words = [len(brute.WORD.findall(x)) for x in (text or "").split("\n")]
        words = [w for w in words if w]
        share = sum(w for w, s in zip(words, state, strict=True) if s) / max(sum(words), 1)
        assert rows[i]["content_share"] == pytest.approx(share)
        assert rows[i]["kept"] == (not rows[i]["base_failed"] and share >= quality_rules.LEAST_SHARE)
    assert len({r["kept"] for r in rows.values()}) == 2


def test_op1_learns_from_each_kind_of_position_once():
    from tessera.llm import _words, interpolated_lm

    rng = np.random.default_rng(5)
    keys = rng.integers(0, 300, 2000).astype(np.uint64) << np.uint64(55)
    assert (_words.distinct(keys) == np.array(sorted(set(keys.tolist())), np.uint64)).all() and len(_words.distinct(keys[:0])) == 0
    one = rng.integers(0, 4, 900).astype(np.uint32)
    two = np.minimum(one, rng.integers(0, 3, 900)).astype(np.uint32)
    counts, begin = [one, two, np.minimum(two, rng.integers(0, 2, 900)).astype(np.uint32)], np.arange(900) % 30 == 0
    times, unseen, *columns = interpolated_lm.seen(counts, begin)
    own, contexts = columns[:3], columns[3:]
    want, low = collections.Counter(), np.zeros((3, interpolated_lm.BUCKETS), int)
    for p in np.flatnonzero(~begin).tolist():
        here, before = [int(c[p]) for c in counts], [0, int(one[p - 1]), int(two[p - 1])]
        height = max((k for k in (1, 2, 3) if here[k - 1]), default=0)
        want[tuple(here[:height] + before[1:height])] += 1
        for k in range(height, 3):
            low[k][interpolated_lm.bucket_of(np.array(before[k])) if k else 0] += 1
    got = {}
    for i, n in enumerate(times.tolist()):
        kind = tuple(int(c[i]) for c in own if i < len(c)) + tuple(int(c[i]) for c in contexts if i < len(c))
        got[kind] = n
    assert got == dict(want) and len(times) == len(want) < 100
    assert (unseen.reshape(3, -1) == low).all()
    assert [len(x) for x in interpolated_lm.seen([c[:0] for c in counts], begin[:0])] == [0, 72, 0, 0, 0, 0, 0]
