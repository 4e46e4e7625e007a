"""Registered queries of question routing, citations, answer evaluation and cross-paper comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import routing
from ..functions import text as t
from ..operators import graph as g
from ..registry import query
from ..sources.fixtures import GRAPH_SQL, TURNS_SQL, edges, nodes, table, turns

Q, G = f"WITH {TURNS_SQL}", f"WITH {GRAPH_SQL}"

#: English words of the routing rules for the SQL (conversations of the fixtures are English): fixed values.
CROSS = ("compare to", "compare with", "compared to", "compared with", "versus", " vs ", " vs.")
DETAIL = ("dataset", "accuracy", "f1-score", "table", "figure", "parameter", "baseline", "metric", "hyperparameter", "p-value", "p value", "mnist", "imagenet", "resnet", "experiment", "page", "method", "detail")

ASK = """ask AS (SELECT conv_id, turn, question || (['', ' compared with another', ' which dataset?', ' 95.5% of it', ' give a summary', ' overview of x-101'])[1 + (conv_id + turn) % 6] AS q FROM qa)"""


def _ask(spark, sf):
    more = F.element_at(F.array(*[F.lit(x) for x in ("", " compared with another", " which dataset?", " 95.5% of it", " give a summary", " overview of x-101")]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return turns(spark, sf).select("conv_id", "turn", F.concat("question", more).alias("q"))


@query("p17_question_scale", Q + ", " + ASK + f""" SELECT conv_id, turn, CASE WHEN {' OR '.join(f"contains(lower(q), '{w}')" for w in CROSS)} THEN 'cross_paper' WHEN trim(q) = '' THEN 'summary' WHEN regexp_matches(lower(q), '\\b({'|'.join(DETAIL)})\\b') OR regexp_matches(q, '\\b\\d+(\\.\\d+)?%?') THEN 'detail' ELSE 'summary' END AS scale FROM ask""")
def question_scale(spark, sf):
    return _ask(spark, sf).select("conv_id", "turn", routing.question_scale(F.col("q")).alias("scale"))


@query("p16_cross_paper_intent", Q + ", " + ASK + f""" SELECT conv_id, turn, ({' OR '.join(f"contains(lower(q), '{w}')" for w in CROSS)}) OR regexp_matches(lower(q), '\\b[a-z][a-z0-9]*-\\d{{3,}}\\b') AS intent FROM ask""")
def cross_paper_intent(spark, sf):
    """Asked of a paper p-1."""
    return _ask(spark, sf).select("conv_id", "turn", routing.cross_paper(F.col("q"), F.lit("p-1")).alias("intent"))


@query("p20_rejected_questions", Q + ", " + ASK + f""" SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(f"contains(lower(q), '{w}')" for w in CROSS)}) AS n_rejected FROM ask GROUP BY 1""")
def rejected_questions(spark, sf):
    return _ask(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(routing.cross_paper(F.col("q")), 1)).alias("n_rejected"))


@query("p18_scale_coercion", "SELECT page_id, CASE x WHEN 'skeleton' THEN 'summary' WHEN 'cross' THEN 'cross_paper' WHEN 'detail' THEN 'detail' END AS scale FROM (SELECT page_id, (['skeleton', 'cross', 'detail', 'odd'])[1 + page_id % 4] AS x FROM pages)")
def scale_coercion(spark, sf):
    x = F.element_at(F.array(*[F.lit(v) for v in ("skeleton", "cross", "detail", "odd")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.when(x == "skeleton", "summary").when(x == "cross", "cross_paper").when(x == "detail", "detail").alias("scale"))


CITE = "c AS (SELECT conv_id, turn, '[CITE:chunk: p' || conv_id || ' : chunk : ' || turn % 3 || ']' AS raw, 'p' || conv_id || '_chunk_' || turn AS legacy FROM qa)"


@query("h17_citation_ids", Q + ", " + CITE + r" SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(raw, '^\[+|\]+$', '', 'g'), '^CITE:chunk:', '')), '\s*:\s*', ':', 'g') AS id, regexp_replace(legacy, '^(.+)_chunk_(\d+)$', '\1:chunk:\2') AS from_legacy FROM c")
def citation_ids(spark, sf):
    c = turns(spark, sf)
    raw = F.concat(F.lit("[CITE:chunk: p"), F.col("conv_id").cast("string"), F.lit(" : chunk : "), (F.col("turn") % 3).cast("string"), F.lit("]"))
    legacy = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_chunk_"), F.col("turn").cast("string"))
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\[+|\]+$", ""), "^CITE:chunk:", "")), r"\s*:\s*", ":")
    return c.select("conv_id", "turn", clean.alias("id"), F.regexp_replace(legacy, r"^(.+)_chunk_(\d+)$", "$1:chunk:$2").alias("from_legacy"))


@query("h22_citation_parse", Q + r""", x AS (SELECT conv_id, turn, unnest(regexp_extract_all('see [CITE:edge:e' || turn || '] and [CITE:n' || conv_id || '] or [CITE:page:3]', '\[CITE:([^\]]+)\]', 1)) AS body FROM qa) SELECT conv_id, turn, CASE WHEN starts_with(body, 'edge:') THEN 'edge' WHEN starts_with(body, 'chunk:') THEN 'chunk' WHEN starts_with(body, 'page:') THEN 'page' ELSE 'node' END AS kind, regexp_replace(body, '^(edge|chunk|page):', '') AS ref FROM x""")
def citation_parse(spark, sf):
    said = F.concat(F.lit("see [CITE:edge:e"), F.col("turn").cast("string"), F.lit("] and [CITE:n"), F.col("conv_id").cast("string"), F.lit("] or [CITE:page:3]"))
    x = turns(spark, sf).select("conv_id", "turn", F.explode(F.regexp_extract_all(said, F.lit(r"\[CITE:([^\]]+)\]"), F.lit(1))).alias("body"))
    kind = F.when(F.col("body").startswith("edge:"), "edge").when(F.col("body").startswith("chunk:"), "chunk").when(F.col("body").startswith("page:"), "page").otherwise("node")
    return x.select("conv_id", "turn", kind.alias("kind"), F.regexp_replace("body", "^(edge|chunk|page):", "").alias("ref"))


@query("h21_sanitise", Q + r" SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace('**' || answer || '`', '`', ''), '\*{2,}', '', 'g'), ' {2,}', ' ', 'g')) AS digest FROM qa")
def sanitise(spark, sf):
    said = F.concat(F.lit("**"), "answer", F.lit("`"))
    return turns(spark, sf).select("conv_id", "turn", F.md5(F.regexp_replace(F.regexp_replace(F.replace(said, F.lit("`"), F.lit("")), r"\*{2,}", ""), " {2,}", " ")).alias("digest"))


@query("h10_classifier_input", "SELECT doc_id, substr(concat_ws(chr(10) || chr(10), 'Title: ' || nullif(source, 'src3'), 'Abstract: ' || nullif(text, ''), 'Keywords: ' || nullif(lang, 'en')), 1, 12000) AS input FROM documents")
def classifier_input(spark, sf):
    part = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    return table(spark, sf, "documents").select("doc_id", F.substring(F.concat_ws("\n\n", part("Title", F.nullif("source", F.lit("src3"))), part("Abstract", F.nullif("text", F.lit(""))), part("Keywords", F.nullif("lang", F.lit("en")))), 1, 12000).alias("input"))


@query("h26_usage_fallback", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END), ''), nullif(lang, 'en'), 'no usage given') AS usage FROM documents")
def usage_fallback(spark, sf):
    first = F.nullif(F.trim(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(first, F.nullif("lang", F.lit("en")), F.lit("no usage given")).alias("usage"))


@query("p29_chunk_preview", "SELECT d.doc_id, CASE WHEN p.page_id IS NOT NULL THEN 'ready' WHEN d.doc_id % 2 = 0 THEN 'indexing' ELSE 'hallucinated_id' END AS state, substr(p.url, 1, 120) AS preview FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def chunk_preview(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "pages"), F.col("page_id") == F.col("doc_id"), "left")
    return d.select("doc_id", F.when(F.col("page_id").isNotNull(), "ready").when(F.col("doc_id") % 2 == 0, "indexing").otherwise("hallucinated_id").alias("state"), F.substring("url", 1, 120).alias("preview"))


@query("p31_conflict_type", G + ", t AS (SELECT paper_id, min(label) AS label FROM nodes WHERE type = 'Method' GROUP BY 1) SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, CASE WHEN lower(trim(a.label)) = lower(trim(b.label)) THEN 'none' ELSE 'potential' END AS conflict FROM t a JOIN t b ON a.paper_id < b.paper_id")
def conflict_type(spark, sf):
    first = nodes(spark, sf).where("type = 'Method'").groupBy("paper_id").agg(F.min("label").alias("label"))
    a, b = (first.select(F.col("paper_id").alias(f"paper_{n}"), F.col("label").alias(n)) for n in "ab")
    return a.join(b, F.col("paper_a") < F.col("paper_b")).select("paper_a", "paper_b", F.when(F.lower(F.trim("a")) == F.lower(F.trim("b")), "none").otherwise("potential").alias("conflict"))


@query("e15_lens_clash", G + """, d AS (SELECT paper_id, id, count(*) AS degree FROM (SELECT paper_id, source AS id FROM edges UNION ALL SELECT paper_id, target FROM edges WHERE source <> target) GROUP BY 1, 2),
l AS (SELECT n.paper_id, n.label FROM nodes n LEFT JOIN d USING (paper_id, id) WHERE type = 'Method' QUALIFY row_number() OVER (PARTITION BY n.paper_id ORDER BY coalesce(degree, 0) DESC, length(trim(label)) DESC, n.id) = 1)
SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, a.label AS lens_a, b.label AS lens_b, CASE WHEN lower(trim(a.label)) = lower(trim(b.label)) THEN 'none' ELSE 'analytical_framework' END AS clash FROM l a JOIN l b ON a.paper_id < b.paper_id""")
def lens_clash(spark, sf):
    first = g.primary_nodes(nodes(spark, sf).where("type = 'Method'"), edges(spark, sf)).select("paper_id", "label")
    a, b = (first.select(F.col("paper_id").alias(f"paper_{n}"), F.col("label").alias(f"lens_{n}")) for n in "ab")
    clash = F.when(F.lower(F.trim("lens_a")) == F.lower(F.trim("lens_b")), "none").otherwise("analytical_framework")
    return a.join(b, F.col("paper_a") < F.col("paper_b")).withColumn("clash", clash)


@query("a16_chunk_recall", Q + ", x AS (SELECT conv_id, turn, turn % 4 AS found, 1 + turn % 3 AS expected FROM qa) SELECT conv_id, round(avg(least(found, expected)::DOUBLE / expected), 6) AS recall, bool_and(least(found, expected)::DOUBLE / expected >= 0.5 - 1e-9) AS floor_met FROM x GROUP BY 1")
def chunk_recall(spark, sf):
    found, expected = F.col("turn") % 4, 1 + F.col("turn") % 3
    r = F.least(found, expected) / expected
    return turns(spark, sf).groupBy("conv_id").agg(F.round(F.avg(r), 6).alias("recall"), F.bool_and(r >= 0.5 - 1e-9).alias("floor_met"))


@query("a18_judgments", Q + ", x AS (SELECT conv_id, CASE (turn + length(answer)) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'hallucinated' ELSE 'redundant' END AS label FROM qa) SELECT conv_id, count(*) FILTER (WHERE label = 'hallucinated') > 0 AS hallucination, CASE WHEN count(*) FILTER (WHERE label <> 'redundant') = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE label = 'supported')::DOUBLE / count(*) FILTER (WHERE label <> 'redundant'), 4) END AS consistency FROM x GROUP BY 1")
def judgments(spark, sf):
    k = (F.col("turn") + F.length("answer")) % 3
    x = turns(spark, sf).select("conv_id", F.when(k == 0, "supported").when(k == 1, "hallucinated").otherwise("redundant").alias("label"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return x.groupBy("conv_id").agg((n("label = 'hallucinated'") > 0).alias("hallucination"), F.coalesce(F.round(F.try_divide(n("label = 'supported'"), n("label <> 'redundant'")), 4), F.lit(1.0)).alias("consistency"))


@query("a20_hallucination_rate", Q + ", x AS (SELECT contains(answer, 'q') AS fuse, length(answer) % 5 = 0 AS judge FROM qa) SELECT round(avg(CASE WHEN fuse OR judge THEN 1.0 ELSE 0.0 END), 6) AS mean_rate, count(*) FILTER (WHERE fuse OR judge) = 0 AS passed FROM x")
def hallucination_rate(spark, sf):
    hit = F.contains("answer", F.lit("q")) | (F.length("answer") % 5 == 0)
    return turns(spark, sf).agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("mean_rate"), (F.count(F.when(hit, 1)) == 0).alias("passed"))


@query("a21_guardrails", Q + " SELECT conv_id, turn, contains(answer, 'the') AS required, NOT contains(answer, 'und') AS allowed, contains(answer, 'the') AND NOT contains(answer, 'und') AS passed FROM qa")
def guardrails(spark, sf):
    every = F.forall(F.array(F.lit("the")), lambda p: F.contains("answer", p))
    none = ~F.exists(F.array(F.lit("und")), lambda p: F.contains("answer", p))
    return turns(spark, sf).select("conv_id", "turn", every.alias("required"), none.alias("allowed"), (every & none).alias("passed"))


@query("a26_head_quality", "SELECT doc_id, CAST(length(source) BETWEEN 4 AND 200 AS INT) + CAST(n_chars > 500 AS INT) + CAST(length(lang) = 2 AS INT) + CAST(NOT contains(lower(text), 'license') AS INT) AS score FROM documents")
def head_quality(spark, sf):
    tests = (F.length("source").between(4, 200), F.col("n_chars") > 500, F.length("lang") == 2, ~F.contains(F.lower("text"), F.lit("license")))
    return table(spark, sf, "documents").select("doc_id", sum((x.cast("int") for x in tests), F.lit(0)).alias("score"))


@query("k08_text_caps", Q + " SELECT conv_id, turn, '- ' || substr(question, 1, 200) AS relation, substr(answer, 1, 300) || ' (p.' || turn || ')' AS chunk FROM qa")
def text_caps(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.concat(F.lit("- "), F.substring("question", 1, 200)).alias("relation"), F.concat(F.substring("answer", 1, 300), F.lit(" (p."), F.col("turn").cast("string"), F.lit(")")).alias("chunk"))


@query("u03_number_difference", "SELECT event_id FROM events WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'view' AND f.user_id = events.user_id AND abs(f.value - events.value) <= greatest(0.01 * greatest(abs(f.value), abs(events.value)), 1e-9))")
def number_difference(spark, sf):
    e = table(spark, sf, "events")
    want, have = e.where("event_type = 'click'").alias("w"), e.where("event_type = 'view'").alias("h")
    return want.join(have, (F.col("w.user_id") == F.col("h.user_id")) & t.close(F.col("w.value"), F.col("h.value")), "left_anti").select("event_id")


E12 = Q + ", " + ASK + """, s AS (SELECT conv_id, turn, conv_id % 10 AS label, length(q) > 150 AS skip FROM ask), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), b AS (SELECT label, min(vec_id) AS probe FROM e GROUP BY 1),
r AS (SELECT b.label, e.vec_id, row_number() OVER (PARTITION BY b.label ORDER BY round(list_distance(p.v, e.v) ** 2, 4), e.vec_id) AS rank FROM b JOIN e p ON p.vec_id = b.probe JOIN e ON e.label = b.label)
SELECT conv_id, turn, vec_id, CAST(rank AS INT) AS rank, CASE WHEN vec_id IS NULL THEN 'graph_only' ELSE 'hybrid' END AS mode FROM s LEFT JOIN r ON r.label = s.label AND NOT skip AND rank <= 3"""


@query("e12_hybrid_retrieval", E12)
def hybrid_retrieval(spark, sf):
    """The nearest vectors of each question; questions of over 150 characters, and those without vectors, have one graph-only row."""
    from .text_queries import _l2

    label = F.when(F.length("q") <= 150, (F.col("conv_id") % 10).cast("int"))
    asked = _ask(spark, sf).select("conv_id", "turn", label.alias("label"))
    e = table(spark, sf, "embeddings")
    probe = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("x"))
    near = e.join(probe, "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.round(_l2(F.col("x"), F.col("embedding")), 4), "vec_id"))).where("rank <= 3")
    return asked.join(near, "label", "left").select("conv_id", "turn", "vec_id", "rank", F.when(F.col("vec_id").isNull(), "graph_only").otherwise("hybrid").alias("mode"))


@query("e12_hybrid_retrieval_all", E12)
def hybrid_retrieval_all(spark, sf):
    """The same under the name it had beside a query that left long questions out."""
    return hybrid_retrieval(spark, sf)
