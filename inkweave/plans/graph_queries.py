"""Registered queries over graph G1."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..operators import graph as g
from ..registry import query
from ..sources.fixtures import GRAPH_SQL, edges, graph, nodes

G = f"WITH {GRAPH_SQL}"
_types = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("a02_quality_gate", G + """, e AS (
  SELECT paper_id, count(*) AS n_edges, count(*) FILTER (WHERE type = 'SUPPORTS') AS n_supports,
         count(*) FILTER (WHERE type = 'SUPPORTS' AND trim(rationale) <> '') AS n_rationale, count(*) FILTER (WHERE type = 'RELATES_TO') AS n_generic FROM edges GROUP BY paper_id
), n AS (
  SELECT paper_id, count(*) AS n_nodes, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.paper_id = nodes.paper_id AND nodes.id IN (e.source, e.target))) AS n_isolated FROM nodes GROUP BY paper_id
), r AS (
  SELECT paper_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN coalesce(n_supports, 0) = 0 THEN 1.0 ELSE n_rationale::DOUBLE / n_supports END, 6) AS supports_coverage,
         round(n_isolated::DOUBLE / n_nodes, 6) AS isolated_ratio, round(CASE WHEN coalesce(n_edges, 0) = 0 THEN 0.0 ELSE n_generic::DOUBLE / n_edges END, 6) AS generic_ratio FROM n LEFT JOIN e USING (paper_id)
), v AS (
  SELECT *, concat_ws(',', CASE WHEN supports_coverage < 0.5 THEN 'supports_rationale_coverage' END, CASE WHEN isolated_ratio > 0.4 THEN 'isolated_node_ratio' END, CASE WHEN generic_ratio > 1.0 THEN 'generic_edge_ratio' END) AS reasons FROM r
) SELECT paper_id, n_nodes, n_edges, supports_coverage, isolated_ratio, generic_ratio, reasons = '' AS passed, reasons FROM v""".replace(
    "count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.paper_id = nodes.paper_id AND nodes.id IN (e.source, e.target))) AS n_isolated FROM nodes GROUP BY paper_id",
    "count(*) FILTER (WHERE x.id IS NULL) AS n_isolated FROM nodes LEFT JOIN (SELECT DISTINCT paper_id, id FROM (SELECT paper_id, source AS id FROM edges UNION ALL SELECT paper_id, target FROM edges)) x USING (paper_id, id) GROUP BY paper_id",
))
def quality_gate(spark, sf):
    return g.quality_gate(*graph(spark, sf))


@query("p03_graph_violations", G + f""", bad AS (
  SELECT * FROM nodes WHERE NOT (paper_id % 5 = 0 AND type = 'Dataset') UNION ALL SELECT * FROM nodes WHERE paper_id % 7 = 0 AND type = 'Method' UNION ALL SELECT paper_id, 'x' || paper_id, 'odd', 'Thesis' FROM nodes WHERE type = 'Dataset' AND label LIKE '%#1%'
), v AS (
  SELECT paper_id, 1 AS rule FROM bad GROUP BY paper_id, id HAVING count(*) > 1
  UNION ALL SELECT paper_id, 2 FROM edges GROUP BY paper_id, id HAVING count(*) > 1
  UNION ALL SELECT paper_id, 3 FROM (SELECT paper_id, source AS id FROM edges UNION ALL SELECT paper_id, target FROM edges) x WHERE (paper_id, id) NOT IN (SELECT paper_id, id FROM bad)
  UNION ALL SELECT paper_id, 4 FROM bad WHERE type NOT IN ({_types(m.STEM_NODE_TYPES)})
) SELECT paper_id, rule, count(*) AS n FROM v GROUP BY paper_id, rule""")
def graph_violations(spark, sf):
    n = nodes(spark, sf)
    odd = n.where("type = 'Dataset' and label like '%#1%'").select("paper_id", F.concat(F.lit("x"), F.col("paper_id").cast("string")).alias("id"), F.lit("odd").alias("label"), F.lit("Thesis").alias("type"))
    bad = n.where("not (paper_id % 5 = 0 and type = 'Dataset')").unionByName(n.where("paper_id % 7 = 0 and type = 'Method'")).unionByName(odd)
    return g.violations(bad, edges(spark, sf))


@query("a10_degree", G + " SELECT paper_id, id, count(*) AS degree FROM (SELECT paper_id, source AS id FROM edges UNION ALL SELECT paper_id, target FROM edges) GROUP BY paper_id, id")
def degree(spark, sf):
    return g.degrees(edges(spark, sf))


@query("j01_relation_text", G + """ SELECT e.paper_id, e.id, coalesce(s.label, e.source) || ' --[' || e.type || ']--> ' || coalesce(t.label, e.target) || CASE WHEN trim(coalesce(rationale, '')) <> '' THEN '. Rationale: ' || rationale ELSE '' END AS relation_text
FROM edges e LEFT JOIN nodes s ON s.paper_id = e.paper_id AND s.id = e.source LEFT JOIN nodes t ON t.paper_id = e.paper_id AND t.id = e.target""")
def relation_text(spark, sf):
    return g.with_labels(nodes(spark, sf), edges(spark, sf)).select("paper_id", "id", "relation_text")


@query("j02_dangling_edges", G + """, few AS (SELECT * FROM nodes WHERE type <> 'Dataset')
SELECT paper_id, count(*) AS n_edges, count(*) FILTER (WHERE (paper_id, source) IN (SELECT paper_id, id FROM few) AND (paper_id, target) IN (SELECT paper_id, id FROM few)) AS n_kept FROM edges GROUP BY paper_id""")
def dangling(spark, sf):
    e = edges(spark, sf)
    kept = g.induced(e, nodes(spark, sf).where("type <> 'Dataset'")).groupBy("paper_id").agg(F.count("*").alias("n_kept"))
    return e.groupBy("paper_id").agg(F.count("*").alias("n_edges")).join(kept, "paper_id", "left").select("paper_id", "n_edges", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("j04_literal_overlap", G + """, f AS (SELECT paper_id, lower(trim(label)) AS norm, min(id) AS id FROM nodes WHERE type = 'Method' GROUP BY 1, 2)
SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, a.norm, a.id AS node_a, b.id AS node_b FROM f a JOIN f b ON a.norm = b.norm AND a.paper_id < b.paper_id""")
def literal_overlap(spark, sf):
    return g.literal_overlap(nodes(spark, sf), "Method")


@query("j05_label_intersection", G + """, d AS (SELECT DISTINCT paper_id, lower(trim(label)) AS norm FROM nodes WHERE type = 'Dataset')
SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS n_shared FROM d a JOIN d b ON a.norm = b.norm AND a.paper_id < b.paper_id GROUP BY 1, 2""")
def label_intersection(spark, sf):
    return g.literal_overlap(nodes(spark, sf), "Dataset").groupBy("paper_a", "paper_b").agg(F.count("*").alias("n_shared"))


@query("j06_one_hop", G + """, b AS (SELECT DISTINCT paper_id, source AS id, target AS other FROM edges UNION SELECT paper_id, target, source FROM edges)
SELECT b.paper_id, b.id, n.type AS other_type, count(*) AS n FROM b JOIN nodes n ON n.paper_id = b.paper_id AND n.id = b.other GROUP BY 1, 2, 3""")
def one_hop(spark, sf):
    return g.neighbour_types(*graph(spark, sf))


@query("a08_parallel_edges", G + " SELECT paper_id, source, target, type, min(id) AS id FROM edges GROUP BY 1, 2, 3, 4")
def parallel_edges(spark, sf):
    return g.collapse_parallel(edges(spark, sf)).select("paper_id", "source", "target", "type", "id")


@query("w03_richest_edge", G + " SELECT paper_id, source, target, id FROM edges QUALIFY row_number() OVER (PARTITION BY paper_id, source, target ORDER BY length(coalesce(rationale, '')) DESC, id) = 1")
def richest_edge(spark, sf):
    return g.richest_edge(edges(spark, sf)).select("paper_id", "source", "target", "id")


DEG = ", d AS (SELECT paper_id, id, count(*) AS degree FROM (SELECT paper_id, source AS id FROM edges UNION ALL SELECT paper_id, target FROM edges WHERE source <> target) GROUP BY 1, 2), nd AS (SELECT n.*, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (paper_id, id))"


@query("w01_primary_nodes", G + DEG + " SELECT paper_id, type, id, degree FROM nd QUALIFY row_number() OVER (PARTITION BY paper_id, type ORDER BY degree DESC, length(trim(label)) DESC, id) = 1")
def primary_nodes(spark, sf):
    return g.primary_nodes(nodes(spark, sf), edges(spark, sf)).select("paper_id", "type", "id", "degree")


@query("w02_cluster_root", G + DEG + " SELECT paper_id, lower(label) AS cluster, id FROM nd QUALIFY row_number() OVER (PARTITION BY paper_id, lower(label) ORDER BY CASE type WHEN 'Method' THEN 0 WHEN 'Dataset' THEN 1 ELSE 2 END, degree DESC, id) = 1")
def cluster_root(spark, sf):
    from pyspark.sql import Window

    n = nodes(spark, sf).join(g.degrees(edges(spark, sf), 1), ["paper_id", "id"], "left").withColumn("cluster", F.lower("label"))
    w = Window.partitionBy("paper_id", "cluster").orderBy(F.when(F.col("type") == "Method", 0).when(F.col("type") == "Dataset", 1).otherwise(2), F.coalesce("degree", F.lit(0)).desc(), "id")
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("paper_id", "cluster", "id")


@query("w04_skeleton_top", G + DEG + " SELECT paper_id, id, degree, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY degree DESC, id) AS INT) AS rank FROM nd QUALIFY rank <= 300")
def skeleton_top(spark, sf):
    return g.top_nodes(nodes(spark, sf), edges(spark, sf)).select("paper_id", "id", "degree", "rank")


@query("g03_two_hop_subgraph", G + """, seed AS (SELECT paper_id, id FROM nodes WHERE type = 'Method' AND label LIKE '%7'), b AS (
  SELECT paper_id, id AS eid, source AS id, target AS other FROM edges UNION ALL SELECT paper_id, id, target, source FROM edges
), s1 AS (SELECT b.* FROM b JOIN seed USING (paper_id, id)), f1 AS (SELECT DISTINCT paper_id, other AS id FROM s1 EXCEPT SELECT * FROM seed),
s2 AS (SELECT b.* FROM b JOIN f1 USING (paper_id, id)), f2 AS (SELECT DISTINCT paper_id, other AS id FROM s2 EXCEPT SELECT * FROM seed EXCEPT SELECT * FROM f1),
n AS (SELECT paper_id, count(*) AS n_nodes FROM (SELECT * FROM seed UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY 1),
e AS (SELECT paper_id, count(DISTINCT eid) AS n_edges FROM (SELECT paper_id, eid FROM s1 UNION ALL SELECT paper_id, eid FROM s2) GROUP BY 1)
SELECT paper_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e USING (paper_id)""")
def two_hop(spark, sf):
    n, e = graph(spark, sf)
    seen, met = g.two_hops(n.where("type = 'Method' and label like '%7'"), e)
    return seen.groupBy("paper_id").agg(F.count("*").alias("n_nodes")).join(met.groupBy("paper_id").agg(F.count("*").alias("n_edges")), "paper_id", "left").select("paper_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("g04_fold_leaves", G + """, e AS (SELECT * FROM edges WHERE type IN ('ADDRESSES', 'EVALUATED_ON')), x AS (SELECT paper_id, source AS id, target AS parent FROM e UNION ALL SELECT paper_id, target, source FROM e),
dg AS (SELECT paper_id, id, count(*) AS degree FROM x GROUP BY 1, 2), d AS (SELECT n.*, degree, degree = 1 AND type IN ('Claim', 'Dataset') AS leaf FROM nodes n JOIN dg USING (paper_id, id)),
fo AS (SELECT d.paper_id, d.id, x.parent FROM d JOIN x USING (paper_id, id) JOIN d p ON p.paper_id = d.paper_id AND p.id = x.parent AND NOT p.leaf WHERE d.leaf)
SELECT paper_id, d.id, d.type, (SELECT count(*) FROM fo WHERE fo.paper_id = d.paper_id AND fo.parent = d.id) AS n_folded FROM d WHERE (paper_id, id) NOT IN (SELECT paper_id, id FROM fo)""")
def fold_leaves(spark, sf):
    kept, _ = g.fold_leaves(nodes(spark, sf), edges(spark, sf).where("type in ('ADDRESSES', 'EVALUATED_ON')"), ("Claim", "Dataset"))
    return kept.select("paper_id", "id", "type", "n_folded")


@query("a06_merge_nodes", G + r""" SELECT paper_id, trim(regexp_replace(regexp_replace(lower(trim(label)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS norm, type, min(id) AS id, string_agg(DISTINCT id, ',' ORDER BY id) AS aliases, count(*) AS n_aliases FROM nodes GROUP BY 1, 2, 3""")
def merge_nodes(spark, sf):
    return g.merge_by_label(nodes(spark, sf))


@query("a24_type_histogram", G + " SELECT paper_id, type, count(*) AS n FROM nodes GROUP BY 1, 2")
def type_histogram(spark, sf):
    return nodes(spark, sf).groupBy("paper_id", "type").agg(F.count("*").alias("n"))


@query("p01_type_filter", G + " SELECT paper_id, id, label FROM nodes WHERE type IN ('Claim', 'Finding')")
def type_filter(spark, sf):
    return nodes(spark, sf).where(F.col("type").isin("Claim", "Finding")).select("paper_id", "id", "label")


@query("p02_entities", G + " SELECT paper_id, id, label || ' (type: ' || type || ').' AS description FROM nodes")
def entities(spark, sf):
    return nodes(spark, sf).select("paper_id", "id", F.concat("label", F.lit(" (type: "), "type", F.lit(").")).alias("description"))


@query("p09_incomplete_core_edges", G + " SELECT paper_id, id, coalesce(rationale, '') = '' AS incomplete FROM edges WHERE type IN ('SUPPORTS', 'CONTRADICTS', 'EXPLAINS') AND coalesce(rationale, '') = ''")
def incomplete_core(spark, sf):
    bare = F.coalesce("rationale", F.lit("")) == ""
    return edges(spark, sf).where(F.col("type").isin("SUPPORTS", "CONTRADICTS", "EXPLAINS") & bare).select("paper_id", "id", bare.alias("incomplete"))


@query("a01_keyword_score", G + " SELECT paper_id, id, CAST(contains(lower(label || ' ' || type), 'order') AS INT) + CAST(contains(lower(label || ' ' || type), 'claim') AS INT) + CAST(contains(lower(label || ' ' || type), '7') AS INT) AS score FROM nodes")
def keyword_score(spark, sf):
    text = F.lower(F.concat_ws(" ", "label", "type"))
    return nodes(spark, sf).select("paper_id", "id", F.size(F.filter(F.array(F.lit("order"), F.lit("claim"), F.lit("7")), lambda k: F.contains(text, k))).alias("score"))


@query("w08_next_edge_index", G + r""" SELECT paper_id, coalesce(max(TRY_CAST(nullif(regexp_extract(id, '^u(\d+)_', 1), '') AS BIGINT)) + 1, count(*) + 1) AS next_index FROM edges GROUP BY 1""")
def next_edge_index(spark, sf):
    n = F.regexp_extract("id", r"^u(\d+)_", 1).try_cast("long")
    return edges(spark, sf).groupBy("paper_id").agg(F.coalesce(F.max(n) + 1, F.count("*") + 1).alias("next_index"))


@query("s09_visual_export", G + " SELECT paper_id, id, '{\"label\":\"' || label || '\",\"type\":\"' || type || '\"}' AS data FROM nodes")
def visual_export(spark, sf):
    return nodes(spark, sf).select("paper_id", "id", F.to_json(F.struct("label", "type")).alias("data"))


@query("u01_evidence_pools", G + " SELECT paper_id, id, min(pool) AS pool FROM (SELECT paper_id, id, 1 AS pool FROM nodes WHERE type = 'ResearchQuestion' UNION ALL SELECT paper_id, id, 2 FROM nodes WHERE type IN ('Claim', 'ResearchQuestion')) GROUP BY 1, 2")
def evidence_pools(spark, sf):
    n = nodes(spark, sf)
    pool = n.where("type = 'ResearchQuestion'").select("paper_id", "id", F.lit(1).alias("pool")).unionByName(n.where("type in ('Claim', 'ResearchQuestion')").select("paper_id", "id", F.lit(2).alias("pool")))
    return pool.groupBy("paper_id", "id").agg(F.min("pool").alias("pool"))


@query("h33_labelled_context", G + " SELECT paper_id, type || ': ' || string_agg(label, ', ' ORDER BY label) AS section FROM (SELECT DISTINCT paper_id, type, label FROM nodes WHERE type IN ('Method', 'Dataset')) GROUP BY paper_id, type")
def labelled_context(spark, sf):
    n = nodes(spark, sf).where("type in ('Method', 'Dataset')")
    return n.groupBy("paper_id", "type").agg(F.concat("type", F.lit(": "), F.array_join(F.array_sort(F.collect_set("label")), ", ")).alias("section")).select("paper_id", "section")


@query("e17_method_overlap", G + """, f AS (SELECT paper_id, lower(trim(label)) AS norm, type, min(id) AS id FROM nodes WHERE type IN ('Method', 'Dataset') GROUP BY 1, 2, 3),
p AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) FILTER (WHERE a.type = 'Method') AS n_methods, count(*) FILTER (WHERE a.type = 'Dataset') AS n_datasets FROM f a JOIN f b ON a.norm = b.norm AND a.type = b.type AND a.paper_id < b.paper_id GROUP BY 1, 2),
ps AS (SELECT DISTINCT paper_id FROM nodes)
SELECT x.paper_id AS paper_a, y.paper_id AS paper_b, coalesce(n_methods, 0) AS n_methods, coalesce(n_datasets, 0) AS n_datasets, CASE WHEN coalesce(n_methods, 0) + coalesce(n_datasets, 0) = 0 THEN 'NO_OVERLAP' ELSE 'overlap' END AS status
FROM ps x JOIN ps y ON x.paper_id < y.paper_id LEFT JOIN p ON p.paper_a = x.paper_id AND p.paper_b = y.paper_id""")
def method_overlap(spark, sf):
    n = nodes(spark, sf)
    both = g.literal_overlap(n, "Method").select("paper_a", "paper_b", F.lit(1).alias("m"), F.lit(0).alias("d")).unionByName(g.literal_overlap(n, "Dataset").select("paper_a", "paper_b", F.lit(0).alias("m"), F.lit(1).alias("d")))
    per = both.groupBy("paper_a", "paper_b").agg(F.sum("m").alias("n_methods"), F.sum("d").alias("n_datasets"))
    papers = n.select("paper_id").distinct()
    pairs = papers.select(F.col("paper_id").alias("paper_a")).join(papers.select(F.col("paper_id").alias("paper_b")), F.col("paper_a") < F.col("paper_b"))
    return pairs.join(per, ["paper_a", "paper_b"], "left").fillna(0).withColumn("status", F.when(F.col("n_methods") + F.col("n_datasets") == 0, "NO_OVERLAP").otherwise("overlap"))
