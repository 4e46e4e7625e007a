"""Registered queries of stores, pointers, evaluation tables and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as c
from ..operators import graph as g
from ..operators import stores as s
from ..registry import ORACLES, query
from ..sources.fixtures import GRAPH_SQL, STATUS_SQL, edges, graph, nodes, status_events, table
from . import graph_queries  # noqa: F401  (registers the SQL of the gate)
from .text_queries import _cos

G = f"WITH {GRAPH_SQL}"
ST = f"WITH {STATUS_SQL}"
GATE = ORACLES["a02_quality_gate"]


def _gate(spark, sf):
    return g.quality_gate(*graph(spark, sf))


@query("a03_isolated_ratio", f"SELECT paper_id, isolated_ratio FROM ({GATE})")
def isolated_ratio(spark, sf):
    return _gate(spark, sf).select("paper_id", "isolated_ratio")


@query("a04_generic_ratio", f"SELECT paper_id, generic_ratio FROM ({GATE})")
def generic_ratio(spark, sf):
    return _gate(spark, sf).select("paper_id", "generic_ratio")


@query("a05_gate_verdict", f"SELECT paper_id, passed, reasons FROM ({GATE})")
def gate_verdict(spark, sf):
    return _gate(spark, sf).select("paper_id", "passed", "reasons")


@query("a07_edge_dedupe", G + """, k AS (SELECT paper_id, source, target, type, min(id) AS seen, arg_min(coalesce(rationale, chr(0)), (-length(coalesce(rationale, '')), id)) AS r FROM edges GROUP BY 1, 2, 3, 4)
SELECT paper_id, 'e' || (row_number() OVER (PARTITION BY paper_id ORDER BY seen, source, target, type) - 1) || '_' || type AS id, source, target, type, CASE WHEN r <> chr(0) THEN r END AS rationale FROM k""")
def edge_dedupe(spark, sf):
    return c.deduped(edges(spark, sf))


CLUSTER = """, cl AS (SELECT paper_id, id, min(id) OVER (PARTITION BY paper_id, split_part(label, ' ', 1)) AS root FROM nodes WHERE type = 'Evidence')"""


def _clusters(spark, sf):
    """Evidence nodes whose labels open with one word are a cluster."""
    n = nodes(spark, sf).where("type = 'Evidence'").withColumn("w", F.split_part("label", F.lit(" "), F.lit(1)))
    low = n.groupBy("paper_id", "w").agg(F.min("id").alias("root"))
    return n.join(low, ["paper_id", "w"]).select("paper_id", "id", "root")


@query("j03_id_remap", G + CLUSTER + """, e AS (SELECT e.paper_id, e.id, coalesce(x.root, source) AS source, coalesce(y.root, target) AS target, type FROM edges e LEFT JOIN cl x ON x.paper_id = e.paper_id AND x.id = source LEFT JOIN cl y ON y.paper_id = e.paper_id AND y.id = target)
SELECT paper_id, id, source, target, type FROM e WHERE source <> target""")
def id_remap(spark, sf):
    marked = edges(spark, sf).withColumn("source", F.concat(F.lit("#"), "source"))
    return c.remapped(marked, _clusters(spark, sf)).select("paper_id", "id", "source", "target", "type")


@query("a09_cluster_merge", G + CLUSTER + """ SELECT n.paper_id, cl.root, max(label) FILTER (WHERE n.id = cl.root) AS label, coalesce(string_agg(n.id, ',' ORDER BY n.id) FILTER (WHERE n.id <> cl.root), '') AS aliases, string_agg(DISTINCT label, ' | ' ORDER BY label) AS labels FROM nodes n JOIN cl USING (paper_id, id) GROUP BY 1, 2""")
def cluster_merge(spark, sf):
    out = c.merged(nodes(spark, sf).where("type = 'Evidence'"), _clusters(spark, sf))
    return out.withColumn("aliases", F.array_join("aliases", ","))


@query("g02_union_find", """WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal - lag(c_acctbal) OVER w AS gap FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey)),
i AS (SELECT *, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY a, c_custkey) AS island FROM (SELECT p.*, c.c_acctbal AS a FROM p JOIN customer c USING (c_custkey))),
r AS (SELECT CAST(c_nationkey AS BIGINT) AS paper_id, c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment, island) AS root, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, island) AS n FROM i) SELECT paper_id, CAST(id AS VARCHAR) AS id, CAST(root AS VARCHAR) AS root FROM r WHERE n > 1""")
def union_find(spark, sf):
    """Customers of one nation and segment whose balances follow one another by 300 or less are one group."""
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")
    t = table(spark, sf, "customer").withColumn("b", F.lag("c_custkey").over(w)).withColumn("gap", F.col("c_acctbal") - F.lag("c_acctbal").over(w))
    key = lambda k: F.lpad(F.col(k).cast("string"), 12, "0")  # noqa: E731  ids in the order of their numbers
    pairs = t.where("gap <= 300").select(F.col("c_nationkey").cast("long").alias("paper_id"), key("c_custkey").alias("a"), key("b").alias("b"))
    return c.unions(pairs).select("paper_id", F.col("id").cast("long").cast("string").alias("id"), F.col("root").cast("long").cast("string").alias("root"))


@query("h35_cosine", "SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(_cos(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("j07_topology_resonance", G + """, n AS (SELECT DISTINCT paper_id, type, lower(trim(label)) AS norm FROM nodes), p AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, a.type FROM n a JOIN n b ON a.type = b.type AND a.norm = b.norm AND a.paper_id < b.paper_id)
SELECT paper_a, paper_b, bool_or(type = 'Dataset') AS shares_dataset, bool_or(type = 'ResearchQuestion') AS shares_researchquestion FROM p GROUP BY 1, 2 HAVING bool_or(type = 'Method')""")
def topology_resonance(spark, sf):
    return c.resonance("Method", "shares", ("Dataset", "ResearchQuestion"), nodes(spark, sf))


@query("j17_induced_edges", G + """ SELECT e.paper_id, e.id FROM edges e JOIN nodes a ON a.paper_id = e.paper_id AND a.id = source AND a.type IN ('Method', 'Dataset') JOIN nodes b ON b.paper_id = e.paper_id AND b.id = target AND b.type IN ('Method', 'Dataset')""")
def induced_edges(spark, sf):
    return g.induced(edges(spark, sf), nodes(spark, sf).where("type in ('Method', 'Dataset')")).select("paper_id", "id")


@query("h13_embedding_text", G + """ SELECT paper_id, id, '类型: ' || type || ' | 细分类别: General | 核心概念: ' || trim(label) || CASE WHEN type = 'Method' THEN ' | 语义定义: ' || label ELSE '' END AS text FROM nodes""")
def embedding_text(spark, sf):
    described = F.when(F.col("type") == "Method", F.col("label")).otherwise("")
    return nodes(spark, sf).select("paper_id", "id", c.embedding_text(F.col("type"), F.lit(""), F.col("label"), described).alias("text"))


@query("u02_intersection_recall", G + """, gold AS (SELECT DISTINCT paper_id, l_partkey AS k FROM it WHERE o_orderstatus = 'F'), got AS (SELECT DISTINCT paper_id, l_partkey AS k FROM it WHERE l_returnflag = 'R') SELECT paper_id, count(*) AS n_gold, round(count(got.k)::DOUBLE / count(*), 6) AS recall FROM gold LEFT JOIN got USING (paper_id, k) GROUP BY 1""")
def intersection_recall(spark, sf):
    from ..sources.fixtures import _items

    it = _items(spark, sf)
    pick = lambda cond: it.where(cond).select("paper_id", "l_partkey").distinct()
    hit = pick("o_orderstatus = 'F'").join(pick("l_returnflag = 'R'").withColumn("hit", F.lit(1)), ["paper_id", "l_partkey"], "left")
    return hit.groupBy("paper_id").agg(F.count("*").alias("n_gold"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@query("p25_finalize_contract", G + """, b AS (SELECT paper_id, count(*) AS n, count(DISTINCT id) AS u FROM nodes GROUP BY 1), d AS (SELECT e.paper_id, count(*) AS n_dangling FROM edges e LEFT JOIN nodes x ON x.paper_id = e.paper_id AND x.id = source LEFT JOIN nodes y ON y.paper_id = e.paper_id AND y.id = target WHERE x.id IS NULL OR y.id IS NULL GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS paper_id, coalesce(n, 0) > 0 AND n = u AND coalesce(n_dangling, 0) = 0 AS accepted FROM nation LEFT JOIN b ON b.paper_id = n_nationkey LEFT JOIN d ON d.paper_id = n_nationkey""")
def finalize_contract(spark, sf):
    papers = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("paper_id"))
    n, e = nodes(spark, sf), edges(spark, sf)
    has = n.select("paper_id").distinct().withColumn("has", F.lit(True))
    bad = g.violations(n, e).where("rule in (1, 3)").select("paper_id").distinct().withColumn("bad", F.lit(True))
    return papers.join(has, "paper_id", "left").join(bad, "paper_id", "left").select("paper_id", (F.coalesce("has", F.lit(False)) & ~F.coalesce("bad", F.lit(False))).alias("accepted"))


@query("p08_core_edge_flags", G + """ SELECT paper_id, id, coalesce(CASE WHEN rationale = 'A' THEN 'HIGH' END, 'MEDIUM') AS confidence, rationale IS DISTINCT FROM 'A' AS confidence_missing, type IN ('SUPPORTS', 'CONTRADICTS', 'EXPLAINS') AND coalesce(rationale, '') = '' AS incomplete FROM edges""")
def core_edge_flags(spark, sf):
    e = edges(spark, sf).withColumn("confidence", F.when(F.col("rationale") == "A", "HIGH"))
    return g.core_edge_flags(e, F.col("rationale")).select("paper_id", "id", "confidence", "confidence_missing", "incomplete")


@query("s11_insert_absent", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 3 = 0")
def insert_absent(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return s.insert_absent(p.where("p_partkey % 3 <> 0"), p.withColumn("p_name", F.upper("p_name")), ["p_partkey"])


@query("s11_delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return s.delete(table(spark, sf, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("s21_vector_upsert", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def vector_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return s.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("s23_clean_metadata", """SELECT doc_id, '{' || CASE WHEN lang <> 'es' THEN '"lang":"' || lang || '",' ELSE '' END || '"n":"' || n_chars || '","source":"' || source || '"}' AS meta FROM documents""")
def clean_metadata(spark, sf):
    d = table(spark, sf, "documents")
    fields = F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.when(F.col("lang") != "es", F.col("lang")))
    return d.select("doc_id", s.clean_metadata(fields).alias("meta"))


@query("s25_active_run", ST + ", a AS (SELECT paper_id, arg_max(status, event_id) AS run FROM st GROUP BY 1) SELECT st.paper_id, event_id FROM st JOIN a ON a.paper_id = st.paper_id AND a.run = status WHERE a.run <> 'failed'")
def active_run(spark, sf):
    """A paper's last status is its active run; 'failed' stands for a revoked one."""
    st = status_events(spark, sf).withColumnRenamed("status", "run_id")
    last = st.groupBy("paper_id").agg(F.max_by("run_id", "event_id").alias("run_id")).withColumn("run_id", F.when(F.col("run_id") != "failed", F.col("run_id")).otherwise(" "))
    return s.visible(st, last).select("paper_id", "event_id")


@query("s34_page_envelope", """WITH p AS (SELECT r_regionkey AS k, r_name AS n FROM region ORDER BY r_regionkey LIMIT 3 OFFSET 1) SELECT '{"data":{"items":[' || string_agg('{"id":' || k || ',"name":"' || n || '"}', ',' ORDER BY k) || '],"total":' || (SELECT count(*) FROM region) || ',"offset":1,"limit":3}}' AS body FROM p""")
def page_envelope(spark, sf):
    r = table(spark, sf, "region")
    return s.envelope(s.page(r, [F.col("r_regionkey")], 1, 3), F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), r, 1, 3)


@query("s34_envelopes", """SELECT event_id, '{"data":{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"},"meta":{"request_id":"' || md5(CAST(event_id AS VARCHAR)) || '"}}' AS body FROM events""")
def envelopes(spark, sf):
    """The answer to a request for each event."""
    e = table(spark, sf, "events")
    return e.select("event_id", s.success(F.struct("event_id", "user_id", "event_type"), F.md5(F.col("event_id").cast("string"))).alias("body"))


@query("s42_prefer_text", "SELECT CAST(doc_id AS VARCHAR) AS stem, '/corpus/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.pdf' END AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def prefer_text(spark, sf):
    """Files of a corpus by name: text for every third document, PDF for every second, a picture for all."""
    d = table(spark, sf, "documents")
    name = lambda kind: F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(kind)).alias("path")
    return s.prefer(d.where("doc_id % 3 = 0").select(name(".txt")).unionByName(d.where("doc_id % 2 = 0").select(name(".pdf"))).unionByName(d.select(name(".png"))), ("txt", "pdf"))


@query("k05_oldest_stuck", ST + ", l AS (SELECT paper_id, max(ts) AS ts, arg_max(status, event_id) AS status FROM st GROUP BY 1) SELECT paper_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since FROM l WHERE status = 'processing' ORDER BY ts, paper_id LIMIT 200")
def oldest_stuck(spark, sf):
    last = status_events(spark, sf).groupBy("paper_id").agg(F.max("ts").alias("ts"), F.max_by("status", "event_id").alias("status"))
    return s.page(last.where("status = 'processing'"), [F.col("ts"), F.col("paper_id")], 0, 200).select("paper_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("t07_two_wave_wipe", ST + ", w AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM st WHERE status = 'failed'), x AS (SELECT event_id, t, unnest([0, 1, 2, 3]) AS wave, unnest([0, 120, 125, 130]) AS d FROM w) SELECT event_id, CAST(wave AS INTEGER) AS wave, t + d AS due, CASE WHEN wave = 0 THEN t + d ELSE CAST(ceil((t + d) / 30.0) * 30 AS BIGINT) END AS polled FROM x")
def two_wave_wipe(spark, sf):
    return s.wipe_times(status_events(spark, sf).where("status = 'failed'").select("event_id", "ts"), "ts").select("event_id", "wave", "due", F.col("polled").cast("long").alias("polled"))


@query("t20_drain_rounds", ST + ", l AS (SELECT paper_id, arg_max(status, event_id) AS status FROM st GROUP BY 1), r AS (SELECT paper_id, row_number() OVER (ORDER BY paper_id) AS n FROM l WHERE status IN ('processing', 'indexing')) SELECT paper_id, CAST((n - 1) // 20 + 1 AS INTEGER) AS round FROM r WHERE n <= 1000")
def drain_rounds(spark, sf):
    last = status_events(spark, sf).groupBy("paper_id").agg(F.max_by("status", "event_id").alias("status"))
    return s.drained(last.where("status in ('processing', 'indexing')").select("paper_id"), [F.col("paper_id")], 20)


#: Reasons of degraded context in rising priority; higher numbers win.
PRIORITY = {"pending": 0, "processing": 1, "indexing": 2, "ready": 3, "failed": 4}


@query("a28_degradation_merge", ST + ", p AS (SELECT * FROM (VALUES ('pending', 0), ('processing', 1), ('indexing', 2), ('ready', 3), ('failed', 4)) v(status, k)), f AS (SELECT CAST(ts AS DATE) AS d, paper_id, min(event_id) AS i FROM st GROUP BY 1, 2), u AS (SELECT d, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY i) AS papers FROM f GROUP BY 1) SELECT CAST(d AS VARCHAR) AS report, arg_max(status, (k, -event_id)) AS reason, any_value(papers) AS papers FROM (SELECT CAST(ts AS DATE) AS d, status, event_id FROM st) JOIN p USING (status) JOIN u USING (d) GROUP BY d")
def degradation_merge(spark, sf):
    """A day's status events as profiles of one paper each."""
    st = status_events(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("report"), F.col("event_id").alias("seq"), F.col("status").alias("reason"), F.array(F.col("paper_id").cast("string")).alias("papers"))
    return s.merged_degradation(st, PRIORITY).select("report", "reason", F.array_join("papers", ",").alias("papers"))


@query("a11_precision_recall", "SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(count(*) FILTER (WHERE quality = 0), 0), 4) AS alarm_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def precision_recall(spark, sf):
    cases = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("actual"))
    return s.precision_recall(cases, ["lang"])


@query("a12_margins", "WITH x AS (SELECT user_id, event_type = 'purchase' AS p, value, 50.0 AS theta FROM events WHERE event_type IN ('purchase', 'error')) SELECT user_id, round(min(value - theta) FILTER (WHERE p), 4) AS min_margin, round(min(theta - value) FILTER (WHERE NOT p), 4) AS min_safety, round((min(value) FILTER (WHERE p) + max(value) FILTER (WHERE NOT p)) / 2, 4) AS suggested FROM x GROUP BY 1")
def margins(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('purchase', 'error')")
    return s.margins(e.select("user_id", (F.col("event_type") == "purchase").alias("positive"), F.col("value").alias("score"), F.lit(50.0).alias("theta")), ["user_id"])


@query("h29_first_text", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), ''), nullif(trim(url), ''), 'none') AS text FROM (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages)")
def first_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", s.first_text(F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1)), F.trim("url"), F.lit("none")).alias("text"))


@query("p36_truncated_input", "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, length(text) > 2000 AS truncated FROM documents")
def truncated_input(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.substring("text", 1, 2000)).alias("digest"), (F.length("text") > 2000).alias("truncated"))


@query("a25_corpus_summary", "SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars >= 200) AS n_ok, round(avg(n_chars) FILTER (WHERE n_chars >= 200), 3) AS mean_chars, count(*) FILTER (WHERE strlen(text) > length(text)) AS n_warned FROM documents GROUP BY 1")
def corpus_summary(spark, sf):
    ok = F.col("n_chars") >= 200
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_ok"), F.round(F.avg(F.when(ok, F.col("n_chars"))), 3).alias("mean_chars"), F.count(F.when(F.octet_length("text") > F.length("text"), 1)).alias("n_warned"))
