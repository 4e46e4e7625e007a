"""Clusters of nodes: id remap, cluster merge, edge dedupe, skeletons, bridges. Nodes and edges as in operators.graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..shared import shared_folder, written
from .components import components
from .graph import degrees, induced
from .similar import cosine_join, similar_pairs


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ends without a leading '#', then mapped through ids (paper_id, id, root; identity where absent); loops go."""
    out = edges
    for end in ("source", "target"):
        out = out.withColumn(end, F.ltrim(F.col(end), F.lit("#")))
        out = out.join(ids.select("paper_id", F.col("id").alias(end), F.col("root").alias(f"__{end}")), ["paper_id", end], "left")
        out = out.withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out.where("source <> target").select(edges.columns)


def deduped(edges: DataFrame) -> DataFrame:
    """Of equal (source, target, type) the edge of the longest rationale, the first of equals (by id, then rationale); new ids e{n}_{type} in the
    order in which the keys were first seen (by id, then key), numbered within a paper."""
    key = ["paper_id", "source", "target", "type"]
    best = edges.groupBy(*key).agg(F.min("id").alias("seen"), F.min_by("rationale", F.struct(-F.length(F.coalesce("rationale", F.lit(""))), "id", "rationale")).alias("rationale"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("seen", "source", "target", "type")) - 1
    return best.withColumn("id", F.concat(F.lit("e"), nth.cast("string"), F.lit("_"), F.col("type"))).select("paper_id", "id", "source", "target", "type", "rationale")


def merged(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """One node for each cluster of ids (paper_id, id, root): the root's label, its aliases in order, different labels."""
    placed = nodes.join(ids, ["paper_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    own = F.max(F.when(F.col("id") == F.col("root"), F.col("label")))
    return placed.groupBy("paper_id", "root").agg(own.alias("label"), F.array_sort(F.collect_list(F.when(F.col("id") != F.col("root"), F.col("id")))).alias("aliases"), F.array_join(F.array_sort(F.collect_set("label")), " | ").alias("labels"))


def unions(pairs: DataFrame) -> DataFrame:
    """Transitive closure of pairs (paper_id, a, b): paper_id, id, root (the smallest id)."""
    ends = pairs.select("paper_id", F.explode(F.array("a", "b")).alias("id")).distinct()
    return components(ends, pairs.select("paper_id", F.col("a").alias("source"), F.col("b").alias("target")))


def skeleton(nodes: DataFrame, edges: DataFrame, most: int = m.MAX_SKELETON_NODES) -> tuple[DataFrame, DataFrame]:
    """The `most` nodes of highest degree (a loop counts twice; ties by id) of each paper's largest component
    (ties: the one of the smallest id), and the edges among them. Edges with an end that is no node count nowhere."""
    edges = induced(edges, nodes)
    roots = components(nodes, edges)
    inside = nodes.join(roots.join(_largest(roots), ["paper_id", "root"], "left_semi"), ["paper_id", "id"])
    d = inside.join(degrees(edges), ["paper_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("paper_id").orderBy(F.col("degree").desc(), "id")
    kept = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("root")
    return kept, induced(edges, kept)


def _largest(roots: DataFrame) -> DataFrame:
    """paper_id, root of each paper's largest component (ties: the smallest root)."""
    sizes = roots.groupBy("paper_id", "root").agg(F.count("*").alias("n"))
    return sizes.groupBy("paper_id").agg(F.min(F.struct(-F.col("n"), "root")).alias("g")).select("paper_id", F.col("g.root").alias("root"))


def bridges(members: DataFrame, dims: int, threshold: float = m.BRIDGE_THRESHOLD) -> DataFrame:
    """Members (paper_id, id, root, degree, v): the representative (highest degree, then greatest id) of every
    component but the largest, joined with the most similar member of the largest (ties: smallest id) from `threshold` on;
    paper_id, root, n (size of the component), source, target, cosine. Without a vector there is no bridge.

    The search is the join of operators.similar, which keeps the best of each tile only; of equal vectors the smallest id meets.
    """
    sizes = members.groupBy("paper_id", "root").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "v"), F.struct("degree", "id")).alias("rep"))
    main = _largest(members)
    lone = sizes.join(main, ["paper_id", "root"], "left_anti").select("paper_id", F.struct("root", "n", F.col("rep.id").alias("source")).alias("a"), F.col("rep.v").alias("v"), F.lit(threshold - 1e-9).alias("t"))
    inside = members.join(main, ["paper_id", "root"]).groupBy("paper_id", "v").agg(F.min("id").alias("b")).withColumn("t", F.lit(threshold - 1e-9))
    found = cosine_join(lone, inside, ["paper_id"], dims, best="row").where(F.col("cosine") >= threshold)
    best = found.groupBy("paper_id", "a").agg(F.min(F.struct(-F.col("cosine"), "b")).alias("m"))
    return best.select("paper_id", "a.root", "a.n", "a.source", F.col("m.b").alias("target"), (-F.col("m.col1")).alias("cosine"))


def thresholds(type_: Column, paradigm: str = "STEM") -> Column:
    """The cosine over which nodes of a type merge."""
    own = m.MERGE_THRESHOLDS[paradigm]
    out = F.lit(own["Concept"])
    for kind, t in own.items():
        if kind != "Concept":
            out = F.when(type_ == kind, t).otherwise(out)
    return out


def elected(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (paper_id, id, root) with each cluster's root elected: by rank of the type, then degree, confidence and id."""
    rank = F.lit(m.DEFAULT_ROOT_PRIORITY)
    for kind, at in m.ROOT_PRIORITY.items():
        rank = F.when(F.col("type") == kind, at).otherwise(rank)
    known = ids.join(nodes.select("paper_id", "id", "type", "confidence"), ["paper_id", "id"]).join(degrees(edges), ["paper_id", "id"], "left")
    order = F.struct(rank, -F.coalesce("degree", F.lit(0)), -F.coalesce("confidence", F.lit(0.0)), "id")
    best = known.groupBy("paper_id", "root").agg(F.min_by("id", order).alias("elected"))
    return ids.join(best, ["paper_id", "root"]).select("paper_id", "id", F.col("elected").alias("root"))


def fused(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """A09 in full: one node for each cluster of ids: label and type of the root, the longest span (the root's of equals, then
    by id), the highest confidence, the different descriptions in order of their first node, the number of aliases, and the
    vector of the first node. aliases() has the nodes that were merged away, a row each."""
    placed = nodes.join(ids, ["paper_id", "id"])
    own = F.col("id") == F.col("root")
    text = F.trim("description")
    told = placed.where(text != "").groupBy("paper_id", "root", text.alias("d")).agg(F.min("id").alias("at"))
    told = told.groupBy("paper_id", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), " | ").alias("description"))
    span = F.when(F.col("source_span") != "", F.col("source_span"))
    one = placed.groupBy("paper_id", "root").agg(
        F.max(F.when(own, F.col("label"))).alias("label"), F.max(F.when(own, F.col("type"))).alias("type"), F.min_by(span, F.when(span.isNotNull(), F.struct(-F.length(span), ~own, "id"))).alias("source_span"),
        F.max("confidence").alias("confidence"), (F.count("*") - 1).alias("n_aliases"), F.min_by("v", "id").alias("v"),
    )
    return one.join(told, ["paper_id", "root"], "left").withColumnRenamed("root", "id")


def aliases(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """paper_id, root, id, label, type, source_span of every node that was merged into another."""
    return nodes.join(ids, ["paper_id", "id"]).where("id <> root").select("paper_id", "root", "id", "label", "type", "source_span")


def rewired(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (paper_id, id, source, target, type, label, rationale, source_span) between roots: loops go, of equal (source, target,
    type, label) the one of the longest rationale, then the longest span, then the first id stays; new ids e{n}_{type}."""
    out = edges
    for end in ("source", "target"):
        to = ids.select("paper_id", F.col("id").alias(end), F.col("root").alias("to"))
        out = out.join(to, ["paper_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    size = lambda c: -F.length(F.coalesce(F.col(c), F.lit("")))
    key = ["paper_id", "source", "target", "type", "label"]
    best = out.where("source <> target").groupBy(*key).agg(F.min("id").alias("seen"), F.min_by(F.struct("rationale", "source_span"), F.struct(size("rationale"), size("source_span"), "id")).alias("e"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("seen", "source", "target", "type", "label"))
    return best.withColumn("n", nth).select("paper_id", F.concat(F.lit("e"), F.col("n").cast("string"), F.lit("_"), F.lower("type")).alias("id"), "n", "source", "target", "type", "label", "e.rationale", "e.source_span")


def semantic_merge(nodes: DataFrame, edges: DataFrame, dims: int, paradigm: str = "STEM", bridge: float = m.BRIDGE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and id map (paper_id, id, root) after synonyms of one paper and type are merged and islands bridged.

    nodes: paper_id, id, label, type, description, source_span, confidence, v (a vector of `dims` components; without one a node
    neither merges nor bridges). Links are the pairs over the type's threshold, clusters their components; roots are elected,
    nodes fused, edges rewired; then each component but the largest gets an edge from its representative to the most similar
    node of the largest one, numbered on by size; of edges with equal (source, target, type) the first stays.
    """
    spark, folder = nodes.sparkSession, shared_folder(nodes.sparkSession)
    nodes, edges = written(nodes, folder, "nodes"), written(edges, folder, "edges")
    pairs = similar_pairs(nodes.select("paper_id", "type", "id", "v", thresholds(F.col("type"), paradigm).alias("t")), ["paper_id", "type"], dims)
    links = written(pairs.select("paper_id", F.col("a").alias("source"), F.col("b").alias("target")), folder, "links")
    ids = written(elected(nodes, edges, components(nodes, links)), folder, "ids")
    kept, wired = written(fused(nodes, ids), folder, "fused"), written(rewired(edges, ids), folder, "rewired")
    linked = induced(wired, kept)
    members = components(kept, linked).join(degrees(wired), ["paper_id", "id"], "left").join(kept.select("paper_id", "id", "v"), ["paper_id", "id"]).withColumn("degree", F.coalesce("degree", F.lit(0)))
    found = bridges(written(members, folder, "members"), dims, bridge)
    most = wired.groupBy("paper_id").agg(F.max("n").alias("most"))
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("n").desc(), "root"))
    new = found.withColumn("nth", nth).join(most, "paper_id", "left").withColumn("n", F.col("nth") + F.coalesce("most", F.lit(0)))
    none = F.lit(None).cast("string")
    new = new.select("paper_id", F.concat(F.lit("e"), F.col("n").cast("string"), F.lit(f"_{m.BRIDGE_TYPE.lower()}")).alias("id"), "n", "source", "target", F.lit(m.BRIDGE_TYPE).alias("type"), F.lit(m.BRIDGE_LABEL).alias("label"), none.alias("rationale"), none.alias("source_span"), F.round("cosine", 4).alias("similarity"))
    every = wired.withColumn("similarity", F.lit(None).cast("double")).unionByName(new)
    firsts = every.groupBy("paper_id", "source", "target", "type").agg(F.min("n").alias("n"))
    return kept, every.join(firsts, ["paper_id", "source", "target", "type", "n"], "left_semi"), ids


def resonance(a: str, b: str, kinds: tuple[str, ...], nodes: DataFrame) -> DataFrame:
    """J07, literal half: papers that share a label of type `a` and, as columns, whether they share one of each of `kinds`."""
    norm = nodes.where(F.col("type").isin(a, *kinds)).select("paper_id", "type", F.lower(F.trim("label")).alias("norm")).distinct()
    left, right = norm.select(F.col("paper_id").alias("paper_a"), "type", "norm"), norm.select(F.col("paper_id").alias("paper_b"), "type", "norm")
    per = left.join(right, ["type", "norm"]).where("paper_a < paper_b").groupBy("paper_a", "paper_b").agg(F.max(F.col("type") == a).alias("anchored"), *[F.max(F.col("type") == k).alias(f"{b}_{k.lower()}") for k in kinds])
    return per.where("anchored").drop("anchored")


def embedding_text(type_: Column, sub: Column, label: Column, description: Column) -> Column:
    """H13, fixed format."""
    or_none = lambda c: F.when(c != "", c)
    return F.concat(F.lit("类型: "), type_, F.lit(" | 细分类别: "), F.coalesce(or_none(sub), F.lit("General")), F.lit(" | 核心概念: "), F.trim(label), F.coalesce(F.concat(F.lit(" | 语义定义: "), or_none(description)), F.lit("")))
