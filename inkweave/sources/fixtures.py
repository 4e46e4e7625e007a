"""Model tables derived from the fixture tables, as DataFrames and as DuckDB common table expressions.

Graph G1: one paper per nation. Customers are research questions, orders claims, parts evidence, suppliers methods,
brands datasets; edges follow the foreign keys of lineitem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf: str, status: str | None) -> DataFrame:
    o = table(spark, sf, "orders")
    return o if status is None else o.where(F.col("o_orderstatus") == status)


def _owned(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    c, o = table(spark, sf, "customer"), _orders(spark, sf, status)
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("c_nationkey").cast("long").alias("paper_id"))


def _items(spark: SparkSession, sf: str, status: str | None = None, owned: DataFrame | None = None) -> DataFrame:
    li, owned = table(spark, sf, "lineitem"), _owned(spark, sf, status) if owned is None else owned
    return li.join(owned, li.l_orderkey == owned.o_orderkey).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("paper_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "o_orderstatus", "p_name", "p_brand")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """paper_id, id, label, type."""
    c, o, s = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "supplier")
    it = _items(spark, sf)
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("id")
    paper = F.col("c_nationkey").cast("long").alias("paper_id")
    # one pass over the items gives a row for each of its part, supplier and brand
    node = lambda key_, label, kind: F.struct("paper_id", key_, F.col(label).alias("label"), F.lit(kind).alias("type"))
    named = it.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    met = named.select(F.inline(F.array(node(key("p", "l_partkey"), "p_name", "Evidence"), node(key("s", "l_suppkey"), "s_name", "Method"), node(key("b", "p_brand"), "p_brand", "Dataset")))).distinct()
    customers = c.select(paper, key("c", "c_custkey"), F.col("c_name").alias("label"), F.lit("ResearchQuestion").alias("type"))
    claims = o.join(c, o.o_custkey == c.c_custkey).select(paper, key("o", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"), F.lit("Claim").alias("type"))
    return customers.unionByName(claims).unionByName(met)


def edges(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    """paper_id, id, source, target, type, rationale; with a status, of the orders of that status only (graph G1f for 'F')."""
    c, o = table(spark, sf, "customer"), _orders(spark, sf, status)
    it = _items(spark, sf, status)
    k = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    none = F.lit(None).cast("string").alias("rationale")
    edge = lambda name, target, kind: F.struct("paper_id", name.alias("id"), k("s", "l_suppkey").alias("source"), target.alias("target"), F.lit(kind).alias("type"), none)
    parts = [
        o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("long").alias("paper_id"), k("a", "o_orderkey").alias("id"), k("o", "o_orderkey").alias("source"), k("c", "o_custkey").alias("target"), F.lit("ADDRESSES").alias("type"), none),
        it.select("paper_id", F.concat(k("u", "l_orderkey"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("id"), k("p", "l_partkey").alias("source"), k("o", "l_orderkey").alias("target"), F.lit("SUPPORTS").alias("type"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("rationale")),
        it.select(F.inline(F.array(edge(F.concat(k("r", "l_suppkey"), F.lit("_"), F.col("l_partkey").cast("string")), k("p", "l_partkey"), "RELATES_TO"), edge(F.concat(k("v", "l_suppkey"), F.lit("_"), F.col("p_brand")), k("b", "p_brand"), "EVALUATED_ON")))).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph(spark: SparkSession, sf: str, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes() and edges(): the same rows, over tables that are joined once and written with keys as numbers. What reads them
    shuffles no items again, and a step's shuffle files go before the next, so disk stays near that of the largest step."""
    folder, s = shared_folder(spark), table(spark, sf, "supplier")
    owned = written(_owned(spark, sf), folder, "owned")
    it = written(_items(spark, sf, owned=owned), folder, "items")
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    node = lambda d, id_, label, kind: d.select("paper_id", id_.alias("id"), label.alias("label"), F.lit(kind).alias("type"))
    parts, brands = it.select("paper_id", "l_partkey", "p_name").distinct(), it.select("paper_id", "p_brand").distinct()
    suppliers = it.select("paper_id", "l_suppkey").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("paper_id", "l_suppkey", "s_name").distinct()
    n = node(table(spark, sf, "customer").withColumn("paper_id", F.col("c_nationkey").cast("long")), key("c", "c_custkey"), F.col("c_name"), "ResearchQuestion")
    for d in (
        node(owned, key("o", "o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "Claim"), node(written(parts, folder, "parts"), key("p", "l_partkey"), F.col("p_name"), "Evidence"),
        node(written(suppliers, folder, "suppliers"), key("s", "l_suppkey"), F.col("s_name"), "Method"), node(written(brands, folder, "brands"), key("b", "p_brand"), F.col("p_brand"), "Dataset"),
    ):
        n = n.unionByName(d)
    if status is not None:
        owned, it = owned.where(F.col("o_orderstatus") == status), it.where(F.col("o_orderstatus") == status)
    used = written(it.select("paper_id", "l_suppkey", "l_partkey").distinct(), folder, "used")
    tried = written(it.select("paper_id", "l_suppkey", "p_brand").distinct(), folder, "tried")
    none = F.lit(None).cast("string")
    edge = lambda d, id_, source, target, kind, why=none: d.select("paper_id", id_.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), why.alias("rationale"))
    e = edge(owned, key("a", "o_orderkey"), key("o", "o_orderkey"), key("c", "o_custkey"), "ADDRESSES")
    for d in (
        edge(it, F.concat(key("u", "l_orderkey"), F.lit("_"), F.col("l_linenumber").cast("string")), key("p", "l_partkey"), key("o", "l_orderkey"), "SUPPORTS", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))),
        edge(used, F.concat(key("r", "l_suppkey"), F.lit("_"), F.col("l_partkey").cast("string")), key("s", "l_suppkey"), key("p", "l_partkey"), "RELATES_TO"),
        edge(tried, F.concat(key("v", "l_suppkey"), F.lit("_"), F.col("p_brand")), key("s", "l_suppkey"), key("b", "p_brand"), "EVALUATED_ON"),
    ):
        e = e.unionByName(d)
    return n, e


GRAPH_SQL = """
it AS (
  SELECT CAST(c_nationkey AS BIGINT) AS paper_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, o_orderstatus, p_name, p_brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), nodes AS (
  SELECT CAST(c_nationkey AS BIGINT) AS paper_id, 'c' || c_custkey AS id, c_name AS label, 'ResearchQuestion' AS type FROM customer
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'o' || o_orderkey, 'order ' || o_orderkey, 'Claim' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT paper_id, 'p' || l_partkey, p_name, 'Evidence' FROM it
  UNION ALL SELECT DISTINCT paper_id, 's' || l_suppkey, s_name, 'Method' FROM it JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT DISTINCT paper_id, 'b' || p_brand, p_brand, 'Dataset' FROM it
), edges AS (
  SELECT CAST(c_nationkey AS BIGINT) AS paper_id, 'a' || o_orderkey AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, 'ADDRESSES' AS type, CAST(NULL AS VARCHAR) AS rationale FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT paper_id, 'u' || l_orderkey || '_' || l_linenumber, 'p' || l_partkey, 'o' || l_orderkey, 'SUPPORTS', CASE WHEN l_returnflag <> 'R' THEN l_returnflag END FROM it
  UNION ALL SELECT DISTINCT paper_id, 'r' || l_suppkey || '_' || l_partkey, 's' || l_suppkey, 'p' || l_partkey, 'RELATES_TO', CAST(NULL AS VARCHAR) FROM it
  UNION ALL SELECT DISTINCT paper_id, 'v' || l_suppkey || '_' || p_brand, 's' || l_suppkey, 'b' || p_brand, 'EVALUATED_ON', CAST(NULL AS VARCHAR) FROM it
)"""

#: G1f: the same nodes, edges of finished orders only.
_NODES, _EDGES = GRAPH_SQL.split("), edges AS (")
GRAPH_F_SQL = f"{_NODES}), fit AS (SELECT * FROM it WHERE o_orderstatus = 'F'), forders AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), edges AS ({_EDGES.replace('FROM it', 'FROM fit').replace('FROM orders', 'FROM forders')}"


#: Components of a vector that the node fixtures keep, so that some nodes are close to one another.
VECTOR_DIMS = 8


def vector_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """G1 nodes with description, source_span, confidence and v: customers, parts and suppliers have the vector of their key."""
    n = nodes(spark, sf).withColumn("key", F.substring("id", 2, 20).try_cast("long"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.slice(F.col("embedding").cast("array<double>"), 1, VECTOR_DIMS).alias("v"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("description"), F.col("p_type").alias("source_span"), (F.col("p_size") / 50).alias("confidence"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    out = n.join(e, (n.key == e.key) & n.type.isin("ResearchQuestion", "Evidence", "Method"), "left").drop(e.key)
    out = out.join(p, (out.key == p.key) & (out.type == "Evidence"), "left").drop(p.key).join(c, (out.key == c.key) & (out.type == "ResearchQuestion"), "left")
    return out.select("paper_id", "id", "label", "type", F.coalesce("description", "segment").alias("description"), "source_span", "confidence", "v")


VECTOR_NODES_SQL = f"""
vn AS (
  SELECT paper_id, id, k.label, type, CASE type WHEN 'Evidence' THEN p_brand WHEN 'ResearchQuestion' THEN c_mktsegment END AS description, CASE type WHEN 'Evidence' THEN p_type END AS source_span,
    CASE type WHEN 'Evidence' THEN p_size / 50 END AS confidence, CASE WHEN type IN ('ResearchQuestion', 'Evidence', 'Method') THEN list_transform(embedding[1:{VECTOR_DIMS}], lambda x: x::DOUBLE) END AS v
  FROM (SELECT *, TRY_CAST(substring(id, 2) AS BIGINT) AS key FROM nodes) k LEFT JOIN embeddings ON vec_id = key LEFT JOIN part ON p_partkey = key LEFT JOIN customer ON c_custkey = key
)"""


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, paper_id, status, ts, value: the event stream read as status changes of papers."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("paper_id"), status_of(F.col("event_type")).alias("status"), "ts", "value")


def status_of(kind: Column) -> Column:
    """The status that an event type stands for."""
    out = F.lit("failed")
    for name, status in (("signup", "pending"), ("view", "processing"), ("click", "indexing"), ("purchase", "ready")):
        out = F.when(kind == name, status).otherwise(out)
    return out


STATUS_SQL = """
st AS (
  SELECT event_id, user_id AS paper_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'indexing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS status, ts, value FROM events
)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, question, answer: each user turn with the turn after it."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("answer", F.lead("text").over(w)).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


TURNS_SQL = """
qa AS (
  SELECT conv_id, turn, text AS question, coalesce(nxt, '') AS answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user'
)"""
