"""Operator 4, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (first 4, 5 and 6 bytes, so that inflected forms share a weight), word pairs and
pairs that skip one word (lower-case, punctuation cut off), hashed into 2**20 coordinates; a text has a feature or
not. FTRL-proximal gives every coordinate its own learning rate and, through L1, leaves most weights exactly zero,
so the weights that are broadcast are bounded by the number of coordinates whatever the corpus holds.

The fit takes a bounded sample of labelled rows: of those with the smallest md5 of doc_id, at most `most_rows`
(default 12,000) rows and `most_bytes` (default 48 MB) of text. Scoring reads every whole text.

Cases: null or blank text has no features, so its score is that of the intercept; a row with null label or doc_id
isn't learnt from; repeated doc_ids are learnt from once (smallest text first) and each scored; without any label to
learn from all scores are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .common import documents

BITS = 20
STEMS = (4, 5, 6)
MOST_ROWS, MOST_BYTES = 12_000, 48 << 20
_U = np.uint64
#: What follows or opens a word is no part of it.
_CUT = bytes(c if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, document) of each n-gram and skip-gram of a slice of texts, by document."""
    t = bk.Texts(pc.utf8_lower(col.cast(pa.large_string())) if not pa.types.is_large_binary(col.type) else col)
    t.data = np.frombuffer(_CUT, np.uint8)[t.data]
    t.find_words()
    prefix = t.byte_prefix()
    h = bk.spans_hash(prefix, t.start, t.end)
    doc = np.repeat(np.arange(t.n), np.diff(t.wb))
    out, of = [h], [doc]
    for size in STEMS:
        out.append(bk.spans_hash(prefix, t.start, np.minimum(t.start + size, t.end)) ^ _U(0x5BF03635))
        of.append(doc)
    for skip in (1, 2):
        if len(h) > skip:
            same = doc[skip:] == doc[:-skip]
            out.append(bk.mix(h[:-skip] * _U(3) + h[skip:] * _U(5) + _U(skip))[same])
            of.append(doc[skip:][same])
    return (np.concatenate(out) >> _U(64 - BITS)).astype(np.int64), np.concatenate(of)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept; rows: the coordinates of each example."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            err = p - labels[i]
            g = err
            root = np.sqrt(ni + g * g)
            z[at] += g - (root - np.sqrt(ni)) / alpha * w
            n[at] += g * g
            zb += err - (np.sqrt(nb + err * err) - np.sqrt(nb)) / alpha * wb
            nb += err * err
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-zb / ((beta + np.sqrt(nb)) / alpha))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one bounded sample in, the non-zero weights out; coordinate -1 is the intercept."""
    ids, rows, labels = [], [], []
    for b in bk.slices(batches, "text"):
        at, doc = features(b.column(2))
        per = np.bincount(doc, minlength=b.num_rows)
        order = np.argsort(doc, kind="stable")
        rows += [np.unique(part) for part in np.split(at[order], np.cumsum(per)[:-1])]
        ids += b.column(0).to_pylist()
        labels += b.column(1).to_pylist()
    order = np.argsort(np.asarray(ids, np.int64), kind="stable")
    y = np.asarray(labels, float)[order] if rows else np.zeros(0)
    if not rows:
        return
    w, bias = ftrl([rows[i] for i in order], y)
    keep = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(keep, -1), pa.int64()), pa.array(np.append(w[keep], bias))], ["at", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> dict[int, float]:
    """{coordinate: weight}, learnt only from labelled rows that aren't held out; {} if there are none."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = text.join(picked, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    order = F.md5(F.col("doc_id").cast("string"))
    # a bounded sample: at most most_rows rows stand in this window
    from pyspark.sql import Window

    upto = F.sum(F.octet_length("text")).over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "toxic", "text")
    return {r["at"]: r["weight"] for r in sample.coalesce(1).mapInArrow(_fit, "at long, weight double").collect()}


def _score(weights, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = weights.value
        w = np.zeros(1 << BITS)
        if have:
            keys = np.fromiter(have, np.int64)
            w[keys[keys >= 0]] = np.fromiter(have.values(), float)[keys >= 0]
        for b in bk.slices(batches, "text"):
            col = b.column(b.schema.get_field_index("text"))
            at, doc = features(col)
            live = w[at] != 0
            once = np.unique((doc[live] << BITS) | at[live])
            s = np.bincount(once >> BITS, weights=w[once & ((1 << BITS) - 1)], minlength=b.num_rows) + have.get(-1, 0.0)
            score = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35))) if have else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])

    return run


def score(docs: DataFrame, weights: dict[int, float], name: str = "score") -> DataFrame:
    """docs with the score of column text in a new column `name`."""
    spark = docs.sparkSession
    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(weights), name), fields)


def toxicity(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels, **limits))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
