"""Graph operators over nodes (paper_id, id, label, type) and edges (paper_id, id, source, target, type, rationale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..shared import shared_folder, written


def endpoints(edges: DataFrame) -> DataFrame:
    """paper_id, id of both ends of every edge."""
    return edges.select("paper_id", F.explode(F.array("source", "target")).alias("id"))


def quality_gate(nodes: DataFrame, edges: DataFrame, coverage: float = m.MIN_SUPPORTS_COVERAGE, isolated: float = m.MAX_ISOLATED_RATIO, generic: float = m.MAX_GENERIC_RATIO) -> DataFrame:
    """Rationale coverage of SUPPORTS edges, isolated nodes, generic edges, and the verdict with its reasons."""
    supports = F.col("type") == "SUPPORTS"
    e = edges.groupBy("paper_id").agg(F.count("*").alias("n_edges"), F.count(F.when(supports, 1)).alias("n_supports"), F.count(F.when(supports & (F.trim("rationale") != ""), 1)).alias("n_rationale"), F.count(F.when(F.col("type") == "RELATES_TO", 1)).alias("n_generic"))
    n = nodes.groupBy("paper_id").agg(F.count("*").alias("n_nodes"))
    lone = nodes.join(endpoints(edges).distinct(), ["paper_id", "id"], "left_anti").groupBy("paper_id").agg(F.count("*").alias("n_isolated"))
    r = n.join(e, "paper_id", "left").join(lone, "paper_id", "left").fillna(0)
    r = r.withColumn("supports_coverage", F.round(F.coalesce(F.try_divide("n_rationale", "n_supports"), F.lit(1.0)), 6)).withColumn("isolated_ratio", F.round(F.coalesce(F.try_divide("n_isolated", "n_nodes"), F.lit(0.0)), 6)).withColumn("generic_ratio", F.round(F.coalesce(F.try_divide("n_generic", "n_edges"), F.lit(0.0)), 6))
    reasons = F.concat_ws(",", F.when(F.col("supports_coverage") < coverage, "supports_rationale_coverage"), F.when(F.col("isolated_ratio") > isolated, "isolated_node_ratio"), F.when(F.col("generic_ratio") > generic, "generic_edge_ratio"))
    return r.select("paper_id", "n_nodes", "n_edges", "supports_coverage", "isolated_ratio", "generic_ratio", (reasons == "").alias("passed"), reasons.alias("reasons"))


def violations(nodes: DataFrame, edges: DataFrame, node_types=m.STEM_NODE_TYPES, edge_types=m.STEM_EDGE_TYPES) -> DataFrame:
    """paper_id, rule (1 duplicate node, 2 duplicate edge, 3 dangling end, 4 node type, 5 edge type), n."""
    folder = shared_folder(nodes.sparkSession)
    one = lambda d, rule, n=F.count("*"): d.groupBy("paper_id").agg(n.alias("n")).select("paper_id", F.lit(rule).alias("rule"), "n")
    twice = lambda d, rule: one(d.groupBy("paper_id", "id").count().where("count > 1"), rule)
    ends = endpoints(edges).groupBy("paper_id", "id").agg(F.count("*").alias("k"))
    dangling = one(ends.join(nodes.select("paper_id", "id").distinct(), ["paper_id", "id"], "left_anti"), 3, F.sum("k"))
    odd_node = one(nodes.where(~F.col("type").isin(*node_types)), 4)
    odd_edge = one(edges.where(F.col("type").isin(*m.FORBIDDEN_EDGE_TYPES) | ~(F.col("type").isin(*edge_types) | F.col("type").rlike(m.DYNAMIC_EDGE_TYPE))), 5)
    out = odd_node.unionByName(odd_edge)
    for rule, step in ((1, twice(nodes, 1)), (2, twice(edges, 2)), (3, dangling)):  # one shuffle of the edges at a time
        out = out.unionByName(written(step, folder, f"rule-{rule}"))
    return out


def core_edge_flags(edges: DataFrame, span: Column) -> DataFrame:
    """Missing confidence is MEDIUM and flagged; edges of core types without rationale or span are incomplete."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    lacks = F.col("type").isin(*m.CORE_EDGE_TYPES) & (empty(F.col("rationale")) | empty(span))
    return edges.withColumn("confidence_missing", F.col("confidence").isNull()).withColumn("confidence", F.coalesce("confidence", F.lit("MEDIUM"))).withColumn("incomplete", lacks)


def degrees(edges: DataFrame, loops: int = 2) -> DataFrame:
    """A10: incident edges per node; a self-loop adds `loops` (2 or 1)."""
    ends = endpoints(edges) if loops == 2 else edges.select("paper_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return ends.groupBy("paper_id", "id").agg(F.count("*").alias("degree"))


def with_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with source_label and target_label (the id where the node is missing) and the relation text."""
    names = nodes.select("paper_id", "id", "label")
    side = lambda end: names.select("paper_id", F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    out = edges.join(side("source"), ["paper_id", "source"], "left").join(side("target"), ["paper_id", "target"], "left")
    out = out.withColumn("source_label", F.coalesce("source_label", "source")).withColumn("target_label", F.coalesce("target_label", "target"))
    text = F.concat(F.col("source_label"), F.lit(" --["), F.col("type"), F.lit("]--> "), F.col("target_label"), F.when(F.trim(F.coalesce("rationale", F.lit(""))) != "", F.concat(F.lit(". Rationale: "), F.col("rationale"))).otherwise(""))
    return out.withColumn("relation_text", text)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among ids (paper_id, id)."""
    keep = lambda end: ids.select("paper_id", F.col("id").alias(end)).distinct()
    return edges.join(keep("source"), ["paper_id", "source"], "left_semi").join(keep("target"), ["paper_id", "target"], "left_semi")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours of every node that exist."""
    both = edges.select("paper_id", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select("paper_id", F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    return both.join(nodes.select("paper_id", F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("type").alias("other_type")), ["paper_id", "other"])


def neighbour_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """paper_id, id, other_type, n: the number of neighbours() of each node by type. Each end is joined with the nodes in a
    step of its own, and repeats go where the join has put them, so disk holds one shuffle of the edges."""
    folder, out = shared_folder(nodes.sparkSession), None
    pairs = edges.where("source <> target").select("paper_id", F.least("source", "target").alias("id"), F.greatest("source", "target").alias("other"))
    # loops are met once; of an edge that lacks an end the other one is still a neighbour
    rest = edges.where("source = target or source is null or target is null").select("paper_id", F.when(F.col("source") == F.col("target"), F.col("source")).alias("id"), F.coalesce("source", "target").alias("other"))
    types = nodes.groupBy("paper_id", F.col("id").alias("other"), F.col("type").alias("other_type")).agg(F.count("*").alias("k"))
    for n, way in enumerate((pairs.unionByName(rest), pairs.select("paper_id", F.col("other").alias("id"), F.col("id").alias("other")))):
        step = way.join(types, ["paper_id", "other"]).groupBy("paper_id", "other", "id", "other_type").agg(F.max("k").alias("k"))
        step = written(step.groupBy("paper_id", "id", "other_type").agg(F.sum("k").alias("n")), folder, f"way-{n}")
        out = step if out is None else out.unionByName(step)
    return out.groupBy("paper_id", "id", "other_type").agg(F.sum("n").alias("n"))


def literal_overlap(nodes: DataFrame, kind: str) -> DataFrame:
    """For papers a < b, labels of type `kind` that both have (by lower trimmed label), first node of each side."""
    norm = F.lower(F.trim("label"))
    first = nodes.where(F.col("type") == kind).groupBy("paper_id", norm.alias("norm")).agg(F.min("id").alias("id"))
    a = first.select(F.col("paper_id").alias("paper_a"), "norm", F.col("id").alias("node_a"))
    b = first.select(F.col("paper_id").alias("paper_b"), "norm", F.col("id").alias("node_b"))
    return a.join(b, "norm").where("paper_a < paper_b")


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """First edge (smallest id) of each (source, target, type)."""
    w = Window.partitionBy("paper_id", "source", "target", "type").orderBy("id")
    return edges.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def richest_edge(edges: DataFrame) -> DataFrame:
    """Of equal (source, target) the edge of longest rationale, then smallest id."""
    w = Window.partitionBy("paper_id", "source", "target").orderBy(F.length(F.coalesce("rationale", F.lit(""))).desc(), "id")
    return edges.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def primary_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each type the node of most edges, then longest label, then smallest id."""
    d = nodes.join(degrees(edges, 1), ["paper_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("paper_id", "type").orderBy(F.col("degree").desc(), F.length(F.trim("label")).desc(), "id")
    return d.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def top_nodes(nodes: DataFrame, edges: DataFrame, most: int = m.MAX_SKELETON_NODES) -> DataFrame:
    """W04 without the component step (see clusters.skeleton): the `most` nodes of highest degree of each paper, ties by id."""
    d = nodes.join(degrees(edges), ["paper_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("paper_id").orderBy(F.col("degree").desc(), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def two_hops(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node ids, edge ids) around seeds (paper_id, id): edges incident to the frontier of two rounds. Each end is joined
    with the frontier in a step of its own, so disk holds one shuffle of the edges."""
    folder = shared_folder(edges.sparkSession)
    seen = frontier = written(seeds.select("paper_id", "id").distinct(), folder, "seeds")
    met = None
    for n in range(2):
        hits = []
        for end, other in (("source", "target"), ("target", "source")):
            step = edges.select("paper_id", F.col("id").alias("edge_id"), F.col(end).alias("id"), F.col(other).alias("other"))
            hits.append(written(step.join(frontier, ["paper_id", "id"]).select("paper_id", "edge_id", "other"), folder, f"hits-{n}-{end}"))
        step = hits[0].unionByName(hits[1])
        hit = step.select("paper_id", "edge_id")
        met = hit if met is None else met.unionByName(hit)
        reached = step.select("paper_id", F.col("other").alias("id")).distinct()
        frontier = written(reached.join(seen, ["paper_id", "id"], "left_anti"), folder, f"frontier-{n}")
        seen = seen.unionByName(frontier)
    return seen, written(met.distinct(), folder, "met")


def fold_leaves(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(kept nodes with the number of leaves folded into them, kept edges).

    Nodes without edges go; nodes of `kinds` with one edge fold into their neighbour, unless that is such a leaf too.
    """
    d = nodes.join(degrees(edges), ["paper_id", "id"]).withColumn("leaf", (F.col("degree") == 1) & F.col("type").isin(*kinds))
    ends = edges.select("paper_id", F.col("source").alias("id"), F.col("target").alias("parent")).unionByName(edges.select("paper_id", F.col("target").alias("id"), F.col("source").alias("parent")))
    folds = d.where("leaf").join(ends, ["paper_id", "id"]).join(d.where("not leaf").select("paper_id", F.col("id").alias("parent")), ["paper_id", "parent"], "left_semi")
    folded = folds.groupBy("paper_id", F.col("parent").alias("id")).agg(F.count("*").alias("n_folded"))
    kept = d.join(folds.select("paper_id", "id"), ["paper_id", "id"], "left_anti").join(folded, ["paper_id", "id"], "left").select("paper_id", "id", "label", "type", F.coalesce("n_folded", F.lit(0)).alias("n_folded"))
    return kept, induced(edges, kept)


def merge_by_label(nodes: DataFrame) -> DataFrame:
    """Nodes of one normalised label and type: representative (smallest id), aliases, their number."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("label")), r"[^\w\s]", ""), r"\s+", " "))
    return nodes.groupBy("paper_id", norm.alias("norm"), "type").agg(F.min("id").alias("id"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("aliases"), F.count("*").alias("n_aliases"))
