"""Methods of two papers that mean the same, backed by what stands next to them in their graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..shared import removed, shared_folder, written
from .similar import cosine_join, question_threshold


def _norm(label: Column) -> Column:
    return F.lower(F.trim(label))


def method_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, method, type, norm, id, v of the datasets and questions one edge away from each method, in either direction."""
    both = edges.select("paper_id", F.inline(F.array(F.struct(F.col("source").alias("method"), F.col("target").alias("id")), F.struct(F.col("target").alias("method"), F.col("source").alias("id"))))).distinct()
    methods = nodes.where("type = 'Method'").select("paper_id", F.col("id").alias("method"))
    near = nodes.where(F.col("type").isin("Dataset", "ResearchQuestion")).select("paper_id", "id", "type", _norm(F.col("label")).alias("norm"), "v")
    return both.join(methods, ["paper_id", "method"]).join(near, ["paper_id", "id"])


def _ends(df: DataFrame, s: str) -> DataFrame:
    return df.select(F.col("paper_id").alias(f"paper_{s}"), F.col("method").alias(s), "type", "norm", F.col("id").alias(f"near_{s}"))


def resonance(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """Pairs (paper_a, a, paper_b, b of methods) with what backs each: dataset or question (a neighbour of the same label),
    similar_question (neighbours whose cosine reaches the threshold of their labels), the first of these; the others have no row."""
    near = method_neighbours(nodes, edges)
    return _backed(pairs, near, _alike(near, dims))


def _alike(near: DataFrame, dims: int) -> DataFrame:
    """paper_a, near_a, paper_b, near_b of the questions next to methods that are alike."""
    least = min(m.QUESTION_SIMILAR, m.QUESTION_SIMILAR_ENGLISH)
    asked = near.where("type = 'ResearchQuestion'").select(F.lit(0).alias("all"), F.struct("paper_id", "id", "norm").alias("q"), "v", F.lit(least - 1e-9).alias("t")).distinct()
    alike = cosine_join(asked.withColumnRenamed("q", "a"), asked.withColumnRenamed("q", "b"), ["all"], dims).where(F.col("cosine") >= question_threshold(F.col("a.norm"), F.col("b.norm")))
    return alike.select(F.col("a.paper_id").alias("paper_a"), F.col("a.id").alias("near_a"), F.col("b.paper_id").alias("paper_b"), F.col("b.id").alias("near_b"))


def _backed(pairs: DataFrame, near: DataFrame, alike: DataFrame) -> DataFrame:
    key = ["paper_a", "a", "paper_b", "b"]
    shared = pairs.select(*key).join(_ends(near, "a"), ["paper_a", "a"]).join(_ends(near, "b"), ["paper_b", "b", "type", "norm"]).select(*key, F.when(F.col("type") == "Dataset", 1).otherwise(2).alias("why"))
    side = lambda s: _ends(near.where("type = 'ResearchQuestion'"), s).drop("type", "norm")
    meant = alike.join(side("a"), ["paper_a", "near_a"]).join(side("b"), ["paper_b", "near_b"]).join(pairs.select(*key), key, "left_semi").select(*key, F.lit(3).alias("why"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("dataset", "question", "similar_question")]), F.min("why"))
    return shared.unionByName(meant).groupBy(*key).agg(names.alias("backed_by"))


#: Cosines at which the search for the best pair of two papers stops to see which have one.
RUNGS = (0.997, 0.99, 0.975, 0.95, 0.92)


def best_method_pairs(nodes: DataFrame, edges: DataFrame, dims: int, threshold: float = m.METHOD_SIMILAR, rungs: tuple[float, ...] = RUNGS) -> DataFrame:
    """paper_a, paper_b (smaller first), a, b, cosine, backed_by: of the methods of other labels whose cosine is at least
    `threshold` the most similar pair that J07 backs; ties by ids. Papers without one have no row.

    Equal methods of several papers (label and vector) meet as one. The search goes down the rungs: two papers that have a backed
    pair at one rung have their best there, and only the others go on to the pairs between it and the next, the last of which is
    `threshold`. So all pairs of methods are made for those papers only that have no backed pair before.
    """
    spark, folder = nodes.sparkSession, shared_folder(nodes.sparkSession)
    nodes = written(nodes.where(F.col("type").isin("Method", "Dataset", "ResearchQuestion")).select("paper_id", "id", "label", "type", "v"), folder, "nodes")
    near = written(method_neighbours(nodes, edges), folder, "near")
    alike = written(_alike(near, dims), folder, "alike")
    methods = written(nodes.where("type = 'Method' and v is not null").select("paper_id", "id", _norm(F.col("label")).alias("norm"), "v").distinct(), folder, "methods")
    papers = methods.select("paper_id").distinct()
    open_ = papers.withColumnRenamed("paper_id", "paper_a").join(papers.withColumnRenamed("paper_id", "paper_b"), F.col("paper_a") < F.col("paper_b"))
    open_, out, above = written(open_, folder, "open-0"), None, None
    for n, rung in enumerate([*[r for r in sorted(rungs, reverse=True) if r > threshold], threshold]):
        still = open_.select(F.explode(F.array("paper_a", "paper_b")).alias("paper_id")).distinct()
        here = methods.join(still, "paper_id", "left_semi")
        sorts = here.select(F.lit(0).alias("all"), F.struct("norm", "v").alias("q"), "v", F.lit(rung - 1e-9).alias("t")).distinct()
        met = cosine_join(sorts.withColumnRenamed("q", "a"), sorts.withColumnRenamed("q", "b"), ["all"], dims).where((F.col("cosine") >= rung) & (F.col("a.norm") != F.col("b.norm")))
        met = met if above is None else met.where(F.col("cosine") < above)
        for s in ("a", "b"):
            met = met.join(here.select(F.struct("norm", "v").alias(s), F.col("paper_id").alias(f"paper_{s}"), F.col("id").alias(f"id_{s}")), s)
        met = met.select("paper_a", F.col("id_a").alias("a"), "paper_b", F.col("id_b").alias("b"), "cosine").join(open_, ["paper_a", "paper_b"], "left_semi")
        pairs = written(met, folder, f"pairs-{n}")
        backed = pairs.join(_backed(pairs, near, alike), ["paper_a", "a", "paper_b", "b"])
        best = backed.groupBy("paper_a", "paper_b").agg(F.min_by(F.struct("a", "b", "cosine", "backed_by"), F.struct(-F.col("cosine"), "a", "b")).alias("m"))
        best = written(best.select("paper_a", "paper_b", "m.*"), folder, f"best-{n}")
        out, above = best if out is None else out.unionByName(best), rung
        open_ = written(open_.join(best, ["paper_a", "paper_b"], "left_anti"), folder, f"open-{n + 1}")
        removed(spark, folder, f"pairs-{n}", f"open-{n}")
        if open_.isEmpty():
            break
    return out
