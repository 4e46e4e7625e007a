"""A corpus pipeline of five stages; each works on all documents that the one before kept.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: lines similar to an earlier line go (documents stay, shorter); 3. near-duplicates: one document of each
class stays, the one with the smallest doc_id. 4. decontamination: documents that leak a benchmark item go.
5. mixing: words taken from each document for the target weights of the sources.

n_chars is kept true to the text. Columns besides those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import decontaminate as _decon
from inkweave.llm import line_dedup as _lines
from inkweave.llm import mixing as _mix
from inkweave.llm import prob_minhash as _near
from inkweave.llm import toxicity as _tox
from inkweave.llm.common import materialise, workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = _tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_".join(["score", *docs.columns])  # a name that no column has
    return _tox.score(docs, weights, name).where(F.col(name) < 0.5).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _lines.cut_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decon.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _mix.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
]

#: SQL can't express the learnt scores of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, folder, f"stage-{i}")
    return docs
