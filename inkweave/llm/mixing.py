"""Operator 9, mixing sources to target weights (native): Efraimidis-Spirakis sampling to token budgets.

Each source gets a target of words. A target holds whole epochs of the source first; what is left of it is filled
in the order of Efraimidis-Spirakis keys, -ln(u) / quality weight, u depending on the doc_id and the seed alone.
The prefix sums over that order are taken in two steps, so that a hot source never meets in one task: keys fall in
bins of about equal weight, the bins of a source are summed and accumulated (a row per source and bin), and a
window runs inside one bin of one source only. The document at the end of a budget gives just its leading words.

Cases: null text has size 0 and takes 0; null source is a source of its own, last in order; sources of size 0 have
target 0; equal keys are ordered by doc_id (nulls first), then by size, and rows that repeat in all of these take
words in any order, with the same sums; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, unit_uniform, word_count, workspace

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS, BINS, SEED = 1.5, 2, 1024, "mix-1"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds target: weights repeat over the sources by code point (null last) and share
    `share` of all sizes; a target stops at `most` times its source and the rest is shared anew by weight.

    Solved at once: sources reach their cap in the order of cap / weight, so the level of the others follows from
    running sums. One row per source passes here, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth + 1)
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * most)
    out = out.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(every).cast("double") * share)
    out = out.withColumn("capped", F.sum("cap").over(by_ratio)).withColumn("used", F.sum("weight").over(by_ratio)).withColumn("all_w", F.sum("weight").over(every))
    # with all sources up to this one capped, the level of the others; this one is capped if its ratio is below its own level
    out = out.withColumn("level", (F.col("total") - (F.col("capped") - F.col("cap"))) / (F.col("all_w") - (F.col("used") - F.col("weight"))))
    out = out.withColumn("held", F.col("ratio") <= F.col("level"))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(every), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum(F.when(F.col("held"), F.col("weight"))).over(every), F.lit(0.0)))
    return out.withColumn("target", F.round(F.when(F.col("held"), F.col("cap")).otherwise(F.col("weight") * rest), 6)).select("source", "source_size", "target")


def quality_weight(size: Column, chars: Column) -> Column:
    """Weight in (0, 1] of a document: 1 where words have 5.5 characters with their gap, less for odd lengths."""
    per = F.greatest(chars.cast("double"), F.lit(1.0)) / F.greatest(size.cast("double"), F.lit(1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(F.ln(per / F.lit(5.5))))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), then source, epochs (whole ones) and sample_key."""
    folder = workspace(docs.sparkSession)
    size = word_count("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    u = unit_uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    base = base.withColumn("sample_key", -F.ln(u) / quality_weight(F.col("size"), F.col("chars")))
    base = base.withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("sample_key"))) * bins).cast("int")).drop("chars")
    slim = materialise(base, folder, "keys")
    per_bin = slim.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    plan = targets(per_bin.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, share, most)
    plan = plan.withColumn("budget", F.round("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("left", F.when(F.col("source_size") > 0, F.col("budget") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0).cast("long")))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bin.withColumn("start", F.coalesce(F.sum("in_bin").over(before), F.lit(0).cast("long"))).alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "bin", "start", "source_size", "target", "epochs", "left")
    inside = Window.partitionBy("source", "bin").orderBy("sample_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = slim.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    joined = ranked.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bin") == F.col("s.bin")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("r.size"), F.col("left") - F.col("start") - F.col("prior")))
    return joined.select("doc_id", F.col("r.size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("r.size") + part).cast("long").alias("taken"), F.col("r.source").alias("source"), "epochs", "sample_key")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(text), 0) AS chars,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), k AS (
  SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + abs(ln(greatest(chars::DOUBLE, 1) / greatest(size::DOUBLE, 1) / 5.5::DOUBLE)))) AS sample_key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_w FROM w
), h AS (
  SELECT *, ratio <= (total - (sum(cap) OVER o - cap)) / (all_w - (sum(weight) OVER o - weight)) AS held FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, round(CASE WHEN held THEN cap ELSE weight *
         (total - coalesce(sum(cap) FILTER (WHERE held) OVER (), 0)) / (all_w - coalesce(sum(weight) FILTER (WHERE held) OVER (), 0)) END, 6) AS target FROM h
), b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b
), x AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.sample_key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - prior)) AS BIGINT) AS taken FROM x
"""
