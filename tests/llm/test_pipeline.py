import brute
import pytest

import corpus_pipeline
from tessera.llm import decontamination, jaccard_join, quality_classifier, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_columns_stay_and_rows_only_go(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.count() <= now.count()
        now = out


def test_run_gives_ids_of_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_classifier_stage_drops_what_it_scores_low(spark, docs):
    kept = {r["doc_id"] for r in quality_classifier.stage(spark, docs, SF).select("doc_id").collect()}
    scores = quality_classifier.op9_quality_classifier(spark, SF).collect()
    assert kept == {r["doc_id"] for r in scores if r["predicted"] == 1}


def test_join_stage_keeps_one_of_each_group(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = [r["doc_id"] for r in jaccard_join.stage(spark, docs, SF).select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, c in brute.jaccard_components(rows).values()})


def test_decontamination_and_secret_stages(spark, docs):
    leaked = {r["doc_id"] for r in decontamination.op4_decontamination(spark, SF).collect()}
    assert {r["doc_id"] for r in decontamination.stage(spark, docs, SF).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - leaked
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in secrets.stage(spark, docs, SF).collect():
        assert not brute.secret_spans(r["text"])
        if not secrets.scan(before[r["doc_id"]]["text"])[1]:
            assert r == before[r["doc_id"]]


def test_stages_accept_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_with_odd_rows_and_columns(spark):
    """No lang or source, names that clash with ours, nulls, empty and repeated rows, one long text."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near, "a", 1, 0.5), (2, near + " more", "b", 1, 0.5), (2, near + " more", "b", 1, 0.5), (None, None, None, None, None), (3, "", "c", 1, 0.5), (None, near, "d", 1, 0.5), (4, "x y " * 50_000, "e", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string, copies int, quality double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema and out.count() <= len(rows), name
    kept = [r["rid"] for r in jaccard_join.stage(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted(["a", None, "c", "e"], key=str)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.columns == ["doc_id", "rid", "copies", "quality", "n_tokens", "ids"] and ids.count() == len(rows)


def test_what_a_worker_remembers_goes_with_the_next_stage():
    """Encoders of the last stage would stay beside every other stage's memory in workers that serve all of them."""
    import public_tokenizers
    import pyarrow as pa

    from tessera.llm import _tokens, _words, bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    one = bpe.fragment_encoder(path)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None])], ["text"])
    assert [b.num_rows for b in _words.slabs(iter([batch]), keep=True)] == [2] and bpe.fragment_encoder(path) is one
    assert [b.num_rows for b in _words.slabs(iter([batch]))] == [2]
    assert not bpe.fragment_encoder.cache_info().currsize and not _tokens.load.cache_info().currsize
    _words.words(pa.array(["x" * (_words.STEP + 5)]))
    assert len(_words._POWERS[0]) > _words.STEP
    _words.give_back()
    assert not _words._POWERS


def test_stages_import_no_pandas_in_workers():
    import subprocess
    import sys

    code = "import sys; from tessera.llm import bpe, decontamination, jaccard_join, quality_classifier, secrets; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.split()[-1:] == ["False"]


def _chained(plan, above=False):
    """Whether a task of a physical plan feeds one Python worker from another."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _chained(plan.initialPlan(), above)
    python = "InArrow" in name or "InPandas" in name
    if python and above:
        return True
    below = "Exchange" not in name and (above or python)
    return any(_chained(plan.children().apply(i), below) for i in range(plan.children().size()))


def test_a_task_of_the_join_needs_one_worker(spark, docs, monkeypatch):
    """Workers stay with the executor, idle ones too, so each that a task needs besides its own is memory for all later stages."""
    plans, write = [], jaccard_join.materialise

    def seen(df, name, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan()))
        return write(df, name, **options)

    monkeypatch.setattr(jaccard_join, "materialise", seen)
    out = jaccard_join.stage(spark, docs.union(docs.limit(5)), SF)
    plans.append(("result", out._jdf.queryExecution().executedPlan()))
    assert {"links", "lists", "result"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if _chained(plan)] == []
