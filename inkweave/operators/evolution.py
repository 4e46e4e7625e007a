"""Claim evolution of pairs of papers, as a staged plan over all pairs at once.

Each pair goes through the stages in order and ends at the first that fails, with its reason and phase: questions or
theses on both sides; a pair of them that is similar enough; a claim on either side, which is the paper's primary claim
or finding or, where it has none, the `top_k` chunks nearest to its aligned question. Every stage is a join on papers;
the alignment is a vector join that keeps the best of two papers, and chunks are only looked at for papers without a claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from .graph import degrees
from .similar import cosine_join, question_threshold


def primary_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, claim: the label of each paper's first claim or finding: with a description, of most edges, longest, by id."""
    d = nodes.where(F.col("type").isin("Claim", "Finding")).join(degrees(edges, 1), ["paper_id", "id"], "left")
    order = F.struct(F.coalesce(F.trim("description") == "", F.lit(True)), -F.coalesce("degree", F.lit(0)), -F.length(F.trim("label")), "id")
    return d.groupBy("paper_id").agg(F.min_by("label", order).alias("claim"))


def aligned(pairs: DataFrame, questions: DataFrame, dims: int) -> DataFrame:
    """paper_a, paper_b, a, b (ids and labels as structs, with the vector): the most similar questions of each pair (ties by ids), if
    their cosine reaches the threshold of their labels."""
    least = min(m.QUESTION_SIMILAR, m.QUESTION_SIMILAR_ENGLISH)
    side = questions.select(F.lit(0).alias("all"), F.struct("paper_id", "id", "label", "v").alias("q"), "v", F.lit(least - 1e-9).alias("t"), F.col("paper_id").alias("g"))
    met = cosine_join(side.withColumnRenamed("q", "a"), side.withColumnRenamed("q", "b"), ["all"], dims, best="group").where(F.col("cosine") >= least)
    met = met.select(F.col("a.paper_id").alias("paper_a"), F.col("b.paper_id").alias("paper_b"), "a", "b", "cosine").join(pairs, ["paper_a", "paper_b"], "left_semi")
    best = met.groupBy("paper_a", "paper_b").agg(F.min_by(F.struct("a", "b", "cosine"), F.struct(-F.col("cosine"), "a.id", "b.id")).alias("m"))
    return best.where(F.col("m.cosine") >= question_threshold(F.col("m.a.label"), F.col("m.b.label"))).select("paper_a", "paper_b", "m.a", "m.b")


def nearest_chunks(asked: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """pair, paper_id, found: the texts of the top_k chunks of the paper nearest to v (squared distance, then chunk_id), a line each."""
    far = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = asked.join(chunks.select("paper_id", "chunk_id", "text", F.col("v").alias("w")), "paper_id").withColumn("far", far)
    nth = F.row_number().over(Window.partitionBy("pair", "paper_id").orderBy("far", "chunk_id"))
    best = near.withColumn("nth", nth).where((F.col("nth") <= top_k) & (F.trim("text") != "")).groupBy("pair", "paper_id").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("texts"))
    return best.select("pair", "paper_id", F.array_join(F.transform("texts", lambda x: x["text"]), "\n").alias("found"))


def _summary(a: Column, b: Column) -> Column:
    return F.when(a == b, F.format_string(m.SAME_QUESTION, a)).otherwise(F.format_string(m.NEAR_QUESTIONS, a, b))


def _evidence(a: Column, b: Column) -> Column:
    both = F.format_string(m.BOTH_CLAIMS, a, b)
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull(), F.format_string(m.ONLY_CLAIM_A, a)).otherwise(F.format_string(m.ONLY_CLAIM_B, b))


def claim_evolution(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, dims: int, top_k: int = 3) -> DataFrame:
    """paper_a, paper_b, status, reason, phase, question_a, question_b, claim_a, claim_b, summary, evidence: a row for each pair.

    pairs: paper_a, paper_b (different ones); nodes: paper_id, id, label, type, description, v; chunks: paper_id, chunk_id, text, v.
    """
    questions = nodes.where(F.col("type").isin("ResearchQuestion", "Thesis"))
    asks = questions.select("paper_id").distinct()
    pairs = pairs.distinct().withColumn("pair", F.struct("paper_a", "paper_b"))
    for s in ("a", "b"):
        pairs = pairs.join(asks.select(F.col("paper_id").alias(f"paper_{s}"), F.lit(True).alias(f"asks_{s}")), f"paper_{s}", "left")
    out = pairs.join(aligned(pairs, questions, dims), ["paper_a", "paper_b"], "left")
    claims = primary_claims(nodes, edges)
    for s in ("a", "b"):
        out = out.join(claims.select(F.col("paper_id").alias(f"paper_{s}"), F.col("claim").alias(f"own_{s}")), f"paper_{s}", "left")
    open_ = [out.where(F.col(s).isNotNull() & F.col(f"own_{s}").isNull()).select("pair", F.col(f"paper_{s}").alias("paper_id"), F.col(f"{s}.v").alias("v")) for s in ("a", "b")]
    found = nearest_chunks(open_[0].unionByName(open_[1]), chunks, top_k)
    for s in ("a", "b"):
        here = found.select("pair", F.col("paper_id").alias(f"paper_{s}"), F.col("found").alias(f"found_{s}"))
        out = out.join(here, ["pair", f"paper_{s}"], "left").withColumn(f"claim_{s}", F.coalesce(f"own_{s}", f"found_{s}"))
    stages = [  # (failed, reason, phase)
        (F.col("asks_a").isNull() | F.col("asks_b").isNull(), "MISSING_REQUIRED_NODES", "NODE_PRECHECK"),
        (F.col("a").isNull(), "RQ_GATE_FAILED", "RQ_ALIGNMENT"),
        (F.col("claim_a").isNull() & F.col("claim_b").isNull(), "NO_RECALLABLE_CLAIMS", "CLAIM_RECALL"),
    ]
    reason = F.coalesce(*[F.when(failed, why) for failed, why, _ in stages])
    phase = F.coalesce(*[F.when(failed, at) for failed, _, at in stages])
    ready = reason.isNull()
    qa, qb, ca, cb = F.col("a.label"), F.col("b.label"), F.col("claim_a"), F.col("claim_b")
    when = lambda c: F.when(ready, c)
    return out.select(
        "paper_a", "paper_b", F.when(ready, "ready").otherwise("insufficient_data").alias("status"), reason.alias("reason"), phase.alias("phase"), qa.alias("question_a"), qb.alias("question_b"),
        when(ca).alias("claim_a"), when(cb).alias("claim_b"), when(_summary(qa, qb)).alias("summary"), when(_evidence(ca, cb)).alias("evidence"),
    )
