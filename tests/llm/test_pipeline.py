"""Every pipeline stage by itself on its own input, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from inkweave.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(staged):
    for before, after in staged[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, staged):
    before, after = staged[0]
    bad = {r["doc_id"] for r in toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad


def test_lines_go_and_documents_stay(staged):
    before, after = staged[1]
    assert before.count() == after.count()
    seen = []
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        left = []
        for line in r["text"].split("\n"):
            s = set(line.split())
            if not s or not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        assert kept[r["doc_id"]] == "\n".join(left)
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_document_of_each_class_stays(spark, staged):
    from inkweave.llm.prob_minhash import near_duplicates

    before, after = staged[2]
    assert {r["doc_id"] for r in after.collect()} == {r["class_id"] for r in near_duplicates(before).collect()}


def test_leaks_go(spark, staged):
    before, after = staged[3]
    items = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before.collect() if any(" ".join(w) in " ".join(r["text"].split()) for w in items)}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} >= bad


def test_run(spark, staged):
    got = {(r["doc_id"], r["taken"]) for r in cp.run(spark, SF).collect()}
    assert got == {(r["doc_id"], r["taken"]) for r in staged[-1][1].collect()}
    assert all(t >= 0 for _, t in got)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
