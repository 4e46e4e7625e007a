"""Registered queries over documents, conversations, labels and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import text as t
from ..registry import query
from ..sources.fixtures import TURNS_SQL, table, turns

Q = f"WITH {TURNS_SQL}"
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(xs)) + "]"
FOLD = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("s01_page_offsets", "SELECT source, doc_id, CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS end_offset FROM documents")
def page_offsets(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return docs(spark, sf).select("source", "doc_id", F.sum(F.length("text") + 2).over(w).alias("end_offset"))


@query("s03_route", "SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN n_chars // 500 <= 25 THEN 'short' ELSE 'long' END AS route FROM documents")
def route(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(F.col("lang") == "es", None).when(F.floor(F.col("n_chars") / 500) <= 25, "short").otherwise("long").alias("route"))


@query("p07_truncate", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS label FROM documents")
def truncate(spark, sf):
    return docs(spark, sf).select("doc_id", t.truncated(F.col("text"), m.LABEL_MAX).alias("label"))


@query("p11_garbled", "SELECT doc_id, regexp_matches(x, chr(65533) || '{3,}') OR 2 * (length(x) - length(replace(x, chr(65533), ''))) > length(x) AS garbled FROM (SELECT doc_id, repeat(chr(65533), CAST(doc_id % 5 AS INT)) || lang AS x FROM documents)")
def garbled(spark, sf):
    return docs(spark, sf).select("doc_id", t.garbled(F.concat(F.repeat(F.lit("�"), (F.col("doc_id") % 5).cast("int")), F.col("lang"))).alias("garbled"))


@query("p27_background", "SELECT doc_id, length(text) > 20000 AS background, length(text) > 12000 AS truncated, length(substr(text, 1, 12000)) AS sent FROM documents")
def background(spark, sf):
    n = F.length("text")
    return docs(spark, sf).select("doc_id", (n > 20000).alias("background"), (n > 12000).alias("truncated"), F.length(F.substring("text", 1, 12000)).cast("long").alias("sent"))


@query("p28_failure_code", r"""SELECT doc_id, CASE WHEN contains(x, 'rate limit') OR contains(x, '429') THEN 'rate_limited' WHEN contains(x, 'timeout') OR contains(x, 'timed out') THEN 'timeout' WHEN contains(x, 'context window') OR contains(x, 'context length') OR contains(x, 'token') THEN 'context_window' WHEN contains(x, 'validation') OR contains(x, 'schema') THEN 'schema' WHEN contains(x, 'json') OR contains(x, 'parse') THEN 'json' ELSE 'fallback' END AS code
FROM (SELECT doc_id, lower(text) || (['', ' HTTP 429', ' timed out', ' too many tokens', ' schema', ' bad json'])[1 + doc_id % 6] AS x FROM (SELECT doc_id, lang AS text FROM documents))""")
def failure_code(spark, sf):
    x = F.lower(F.concat("lang", F.element_at(F.array(*[F.lit(v) for v in ("", " http 429", " timed out", " too many tokens", " schema", " bad json")]), (F.col("doc_id") % 6 + 1).cast("int"))))
    any_of = lambda *ks: F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(x, k))
    code = F.when(any_of("rate limit", "429"), "rate_limited").when(any_of("timeout", "timed out"), "timeout").when(any_of("context window", "context length", "token"), "context_window").when(any_of("validation", "schema"), "schema").when(any_of("json", "parse"), "json").otherwise("fallback")
    return docs(spark, sf).select("doc_id", code.alias("code"))


@query("p30_english_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')), 1), 6) AS ratio FROM documents")
def english_ratio(spark, sf):
    ascii_, alnum = F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return docs(spark, sf).select("doc_id", F.round(ascii_ / F.greatest(alnum, F.lit(1)), 6).alias("ratio"))


CLS = f"x AS (SELECT doc_id, {FOLD} AS f FROM documents), k AS (SELECT doc_id, list_filter({_list(m.STEM_KEYWORDS)}, lambda w: contains(f, w)) AS s, list_filter({_list(m.HSS_KEYWORDS)}, lambda w: contains(f, w)) AS h FROM x)"


@query("e01_classify", f"WITH {CLS} SELECT doc_id, CASE WHEN len(h) > len(s) THEN 'HSS' WHEN len(s) > len(h) THEN 'STEM' WHEN len(h) > 0 THEN 'HSS' ELSE 'STEM' END AS paradigm, CASE WHEN len(h) + len(s) = 0 THEN 0.55 ELSE round(least(0.95::DOUBLE, 0.62::DOUBLE + 0.07::DOUBLE * abs(len(h) - len(s)) + 0.02::DOUBLE * (len(h) + len(s))), 2) END AS confidence FROM k")
def classify(spark, sf):
    k = docs(spark, sf).select("doc_id", F.size(t.matched(F.col("text"), m.STEM_KEYWORDS)).alias("s"), F.size(t.matched(F.col("text"), m.HSS_KEYWORDS)).alias("h"))
    return k.select("doc_id", t.paradigm(F.col("s"), F.col("h")).alias("paradigm"), t.confidence(F.col("s"), F.col("h")).alias("confidence"))


@query("a29_keyword_evidence", f"WITH {CLS} SELECT doc_id, array_to_string(s, ',') AS stem, array_to_string(h, ',') AS hss FROM k")
def keyword_evidence(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(t.matched(F.col("text"), m.STEM_KEYWORDS), ",").alias("stem"), F.array_join(t.matched(F.col("text"), m.HSS_KEYWORDS), ",").alias("hss"))


@query("e02_mock_classify", f"WITH k AS (SELECT doc_id, len(list_filter({_list(m.MOCK_STEM_KEYWORDS)}, lambda w: contains(lower(text), w))) AS s, len(list_filter({_list(m.MOCK_HSS_KEYWORDS)}, lambda w: contains(lower(text), w))) AS h FROM documents) SELECT doc_id, CASE WHEN s > h THEN 'STEM' ELSE 'HSS' END AS paradigm, round(least(0.95::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * CASE WHEN s > h THEN s ELSE greatest(h, 1) END), 6) AS confidence FROM k")
def mock_classify(spark, sf):
    low = F.lower("text")
    count = lambda ks: F.size(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(low, k)))
    k = docs(spark, sf).select("doc_id", count(m.MOCK_STEM_KEYWORDS).alias("s"), count(m.MOCK_HSS_KEYWORDS).alias("h"))
    stem = F.col("s") > F.col("h")
    return k.select("doc_id", F.when(stem, "STEM").otherwise("HSS").alias("paradigm"), F.round(F.least(F.lit(0.95), F.lit(0.7) + F.lit(0.05) * F.when(stem, F.col("s")).otherwise(F.greatest("h", F.lit(1)))), 6).alias("confidence"))


@query("h03_section_names", "WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in m.SECTION_ALIASES.items()) + ") v(title, name)), x AS (SELECT doc_id, (['  Related   Work', 'METHODS', 'Works Cited', 'Nope', 'Evaluation '])[1 + doc_id % 5] AS raw FROM documents) SELECT doc_id, name AS section FROM x LEFT JOIN a ON title = trim(regexp_replace(lower(raw), '\\s+', ' ', 'g'))")
def section_names(spark, sf):
    raw = F.element_at(F.array(*[F.lit(v) for v in ("  Related   Work", "METHODS", "Works Cited", "Nope", "Evaluation ")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs(spark, sf).select("doc_id", t.section_name(raw).alias("section"))


@query("h04_clean_lines", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0B]+\\n', chr(10), 'g'), '^\\s+', ''), '\\s+$', '')) AS digest FROM documents")
def clean_lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.clean_lines(F.col("text"))).alias("digest"))


@query("h05_compact_lines", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \\t' || chr(160) || ']+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def compact_lines(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.compact_lines(F.col("text"))).alias("digest"))


@query("h11_keywords", Q + r""", c AS (SELECT conv_id, turn, translate(translate(question, '？，。；：、', '      '), '「」”“', '') AS c FROM qa), r AS (SELECT *, replace(c, ' ', '') AS raw FROM c),
k AS (SELECT conv_id, turn, list_concat(list_filter(regexp_split_to_array(c, '\s+'), lambda x: length(x) >= 2), list_concat(list_transform(range(1, greatest(length(raw) - 2, 1)), lambda i: substr(raw, i, 4)), list_concat(list_transform(range(1, greatest(length(raw) - 1, 1)), lambda i: substr(raw, i, 3)), list_transform(range(1, greatest(length(raw), 1)), lambda i: substr(raw, i, 2))))) AS l FROM r)
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda w: list_position(l, w)))[1:40], lambda i: l[i]), '|') AS keywords FROM k""")
def keywords(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.array_join(t.keywords(F.col("question")), "|").alias("keywords"))


@query("h12_label_norm", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(source || ' & ' || lang)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents")
def label_norm(spark, sf):
    return docs(spark, sf).select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.concat_ws(" & ", "source", "lang"))), r"[^\w\s]", ""), r"\s+", " ")).alias("norm"))


@query("h14_numbers")
def numbers(spark, sf):
    """No SQL: DuckDB adds the numbers of long texts up in another order, which shows in the last digit."""
    return _numbers(docs(spark, sf))


@query("h14_numbers_all")
def numbers_all(spark, sf):
    """h14 of every document, whatever its length; held against brute force."""
    return _numbers(docs(spark, sf))


def _numbers(d):
    x = d.select("doc_id", t.numbers(F.concat("text", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".5 % of "), F.col("n_chars").cast("string"))).alias("ns"))
    return x.select("doc_id", F.size("ns").cast("long").alias("n"), F.round(F.aggregate("ns", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("h15_tolerance", "SELECT event_id, abs(value - value * (1 + (event_id % 40) / 1000.0)) <= greatest(0.01 * greatest(abs(value), abs(value * (1 + (event_id % 40) / 1000.0))), 1e-9) AS close FROM events")
def tolerance(spark, sf):
    return tolerance_all(spark, sf)


@query("h15_tolerance_all")
def tolerance_all(spark, sf):
    """h15 of every event, the boundary of 1 % included; held against brute force."""
    b = F.col("value") * (1 + (F.col("event_id") % 40) / 1000.0)
    return table(spark, sf, "events").select("event_id", t.close(F.col("value"), b).alias("close"))


@query("h16_dataset_tokens", Q + r" SELECT conv_id, turn, array_to_string(regexp_extract_all(question, '[A-Z][A-Za-z0-9]{3,}'), ',') AS tokens FROM qa")
def dataset_tokens(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.array_join(F.regexp_extract_all("question", F.lit("([A-Z][A-Za-z0-9]{3,})"), F.lit(1)), ",").alias("tokens"))


@query("h18_sentences", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？.!?])\\s*', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def sentence_count(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(t.sentences(F.col("text"))).cast("long").alias("n"))


@query("h19_title", "SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '')[1], 1, 80), '未命名论文') AS title FROM documents")
def titles(spark, sf):
    return docs(spark, sf).select("doc_id", t.title(F.col("text")).alias("title"))


@query("h20_content_id", "SELECT doc_id, 'paper-' || substr(sha1(text), 1, 10) AS paper_id FROM documents")
def content_id(spark, sf):
    return docs(spark, sf).select("doc_id", t.content_id(F.col("text")).alias("paper_id"))


@query("h27_representative_label", "SELECT a.doc_id, CASE WHEN a.source = b.source OR length(a.source) <= length(b.source) THEN a.source ELSE b.source END AS label FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 7")
def representative_label(spark, sf):
    a = docs(spark, sf).select("doc_id", "source")
    b = docs(spark, sf).select((F.col("doc_id") - 7).alias("doc_id"), F.col("source").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.when((F.col("source") == F.col("other")) | (F.length("source") <= F.length("other")), F.col("source")).otherwise(F.col("other")).alias("label"))


@query("h28_config_hash", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS hash FROM documents")
def config_hash(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("hash"))


@query("h31_suffix_strip", "SELECT doc_id, regexp_replace(regexp_replace(source || ' dataset corpus', ' corpus$', ''), ' dataset$', '') AS label FROM documents")
def suffix_strip(spark, sf):
    return docs(spark, sf).select("doc_id", F.regexp_replace(F.regexp_replace(F.concat("source", F.lit(" dataset corpus")), " corpus$", ""), " dataset$", "").alias("label"))


@query("h37_mock_judge", Q + r""", s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '')) AS x FROM qa)
SELECT conv_id, turn, count(*) FILTER (WHERE contains(x, ' th')) AS hallucinated, count(*) FILTER (WHERE NOT contains(x, ' th') AND length(x) > 120) AS redundant, count(*) FILTER (WHERE NOT contains(x, ' th') AND length(x) <= 120) AS supported FROM s GROUP BY 1, 2""")
def mock_judge(spark, sf):
    parts = F.filter(F.transform(F.split("answer", "(?<=[。！？.!?])"), lambda x: F.btrim(x, F.lit("\n "))), lambda x: x != "")
    s = turns(spark, sf).select("conv_id", "turn", F.explode(parts).alias("x"))
    bad, long = F.contains("x", F.lit(" th")), F.length("x") > 120
    return s.groupBy("conv_id", "turn").agg(F.count(F.when(bad, 1)).alias("hallucinated"), F.count(F.when(~bad & long, 1)).alias("redundant"), F.count(F.when(~bad & ~long, 1)).alias("supported"))


@query("a17_verbosity", Q + " SELECT conv_id, turn, CASE WHEN length(answer) = 0 OR length(question) = 0 THEN 0.0 ELSE round(greatest(0, 1 - length(question)::DOUBLE / length(answer)), 6) END AS verbosity FROM qa")
def verbosity(spark, sf):
    q, a = F.length("question"), F.length("answer")
    return turns(spark, sf).select("conv_id", "turn", F.when((q == 0) | (a == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.try_divide(q, a)), 6)).alias("verbosity"))


@query("s22_vector_ids", "SELECT vec_id, label || ':chunk:' || (vec_id % 3) || ':' || vec_id AS id FROM embeddings")
def vector_ids(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.concat_ws(":", F.col("label").cast("string"), F.lit("chunk"), (F.col("vec_id") % 3).cast("string"), F.col("vec_id").cast("string")).alias("id"))


@query("s30_lock_key", "SELECT doc_id, substr(sha256('paper_ops:' || doc_id), 1, 16) AS hex FROM documents")
def lock_key(spark, sf):
    key = F.conv(F.substring(F.sha2(F.concat(F.lit("paper_ops:"), F.col("doc_id").cast("string")), 256), 1, 16), 16, -10).cast("long")
    return docs(spark, sf).select("doc_id", F.lower(F.lpad(F.hex(key), 16, "0")).alias("hex"))


@query("s33_sse", Q + " SELECT conv_id, turn, 'event: message' || chr(10) || 'data: {\"turn\":' || turn || '}' || chr(10) || chr(10) AS event FROM qa")
def sse(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.concat(F.lit("event: message\ndata: "), F.to_json(F.struct("turn")), F.lit("\n\n")).alias("event"))


@query("s35_upload_check", "SELECT page_id, CASE WHEN url NOT LIKE '%.pdf' AND page_id % 3 = 0 THEN 'extension' WHEN strlen(html) > 20000 THEN 'size' WHEN substr(html, 1, 9) <> '<!DOCTYPE' THEN 'magic' ELSE 'ok' END AS verdict FROM pages")
def upload_check(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.when(~F.col("url").like("%.pdf") & (F.col("page_id") % 3 == 0), "extension").when(F.octet_length("html") > 20000, "size").when(F.substring("html", 1, 9) != "<!DOCTYPE", "magic").otherwise("ok").alias("verdict"))


@query("s39_mock_embedding", "SELECT doc_id, CAST(i AS INT) AS at, 0.01::DOUBLE * (i % 10) AS value FROM documents, range(0, 16) r(i)")
def mock_embedding(spark, sf):
    v = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lit(0.01) * (i % 10))
    return docs(spark, sf).select("doc_id", F.posexplode(v).alias("at", "value"))


@query("s40_rerank_jaccard", Q + r" SELECT conv_id, turn, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS score FROM (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(question), '\s+')) AS x, list_distinct(regexp_split_to_array(lower(answer), '\s+')) AS y FROM qa)")
def rerank_jaccard(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.round(t.token_jaccard(F.col("question"), F.col("answer")), 6).alias("score"))


def _cos(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def _l2(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query("j08_cosine_matrix", f"WITH e AS ({VEC}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id")
def cosine_matrix(spark, sf):
    """Vectors are turned to doubles and their norms taken once, before they meet; a pair costs one scalar product."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    side = lambda d, id_, v, n: d.select(F.col("vec_id").alias(id_), "label", F.col("v").alias(v), F.col("norm").alias(n))
    pairs = side(e.where("vec_id % 50 = 0"), "a", "x", "nx").join(side(e, "b", "y", "ny"), "label").where("a <> b")
    norm = F.col("nx") * F.col("ny")
    return pairs.select("a", "b", F.round(F.when(norm == 0, F.lit(0.0)).otherwise(dot(F.col("x"), F.col("y")) / norm), 5).alias("cosine"))


@query("k01_vector_top_k", f"WITH e AS ({VEC}), q AS (SELECT * FROM e WHERE vec_id % 50 = 0) SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, e.v) ** 2, 4), e.vec_id) AS INT) AS rank FROM q JOIN e ON q.label = e.label QUALIFY rank <= 5")
def vector_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("x"))
    d = q.join(e, "label").withColumn("d", F.round(_l2(F.col("x"), F.col("embedding")), 4))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where("rank <= 5").select("query_id", "vec_id", "rank")


@query("p13_query_vectors", "SELECT vec_id, CASE WHEN len(v) = 0 THEN 'empty' WHEN len(v) <> 64 THEN 'dimension_mismatch:' || len(v) || '!=64' ELSE NULL END AS issue FROM (SELECT vec_id, embedding[1:CAST(CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 64 END AS INT)] AS v FROM embeddings)")
def query_vectors(spark, sf):
    v = F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 3 == 0, 0).when(F.col("vec_id") % 3 == 1, 60).otherwise(64))
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.size(v) == 0, "empty").when(F.size(v) != 64, F.concat(F.lit("dimension_mismatch:"), F.size(v).cast("string"), F.lit("!=64"))).when(odd, "non_finite").alias("issue"))


@query("a13_confusion", "WITH x AS (SELECT l.toxic = 1 AS gold, d.n_chars > 2000 AS said FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE gold AND said) AS tp, count(*) FILTER (WHERE said AND NOT gold) AS fp, count(*) FILTER (WHERE gold AND NOT said) AS fn, count(*) FILTER (WHERE NOT gold AND NOT said) AS tn FROM x) SELECT tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall FROM c")
def confusion(spark, sf):
    x = table(spark, sf, "labels").join(docs(spark, sf), "doc_id").select((F.col("toxic") == 1).alias("gold"), (F.col("n_chars") > 2000).alias("said"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    c = x.agg(n("gold and said").alias("tp"), n("said and not gold").alias("fp"), n("gold and not said").alias("fn"), n("not gold and not said").alias("tn"))
    return c.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4).alias("recall"))


@query("a22_routing_summary", Q + " SELECT count(*) FILTER (WHERE s = 'summary') AS n_summary, count(*) FILTER (WHERE s = 'detail') AS n_detail, round(avg(l) FILTER (WHERE s = 'summary'), 4) AS mean_summary, round(avg(l) FILTER (WHERE s = 'detail'), 4) AS mean_detail FROM (SELECT CASE WHEN length(question) > 200 THEN 'summary' ELSE 'detail' END AS s, length(answer) AS l FROM qa)")
def routing_summary(spark, sf):
    x = turns(spark, sf).select(F.when(F.length("question") > 200, "summary").otherwise("detail").alias("s"), F.length("answer").alias("l"))
    p = x.groupBy().pivot("s", ["summary", "detail"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 4).alias("mean"))
    return p.select(F.col("summary_n").alias("n_summary"), F.col("detail_n").alias("n_detail"), F.col("summary_mean").alias("mean_summary"), F.col("detail_mean").alias("mean_detail"))


@query("a23_paradigm_report", "SELECT lang, coalesce(source, 'all') AS source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source) HAVING lang IS NOT NULL")
def paradigm_report(spark, sf):
    return docs(spark, sf).rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")).where("lang is not null").select("lang", F.coalesce("source", F.lit("all")).alias("source"), "n", "mean_chars")


@query("a15_graph_element_recall", Q + r", r AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(answer), '[a-z]{4,}')) AS c, list_distinct(regexp_extract_all(lower(question), '[a-z]{4,}')) AS g FROM qa) SELECT conv_id, turn, CASE WHEN len(g) = 0 THEN 1.0 ELSE round(2.0 * len(list_intersect(c, g))::DOUBLE / len(g) / len(g), 6) END AS recall FROM r")
def graph_element_recall(spark, sf):
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    r = turns(spark, sf).select("conv_id", "turn", found("answer").alias("c"), found("question").alias("g"))
    # one gold list, no gold edges: twice the node recall over the number of gold elements, as defined
    return r.select("conv_id", "turn", F.when(F.size("g") == 0, F.lit(1.0)).otherwise(F.round(2 * F.try_divide(F.size(F.array_intersect("c", "g")), F.size("g")) / F.greatest(F.size("g"), F.lit(1)), 6)).alias("recall"))


@query("j22_head_merge", "SELECT coalesce(d.doc_id, p.page_id) AS id, coalesce(nullif(trim(p.url), ''), nullif(d.source, ''), '') AS title, CASE WHEN nullif(trim(p.url), '') IS NOT NULL THEN 'path_b' WHEN d.source IS NOT NULL THEN 'snippets' ELSE 'none' END AS provenance FROM documents d FULL JOIN pages p ON d.doc_id = p.page_id")
def head_merge(spark, sf):
    d, p = docs(spark, sf), table(spark, sf, "pages")
    b = F.nullif(F.trim("url"), F.lit(""))
    return d.join(p, d.doc_id == p.page_id, "full").select(F.coalesce("doc_id", "page_id").alias("id"), F.coalesce(b, F.nullif("source", F.lit("")), F.lit("")).alias("title"), F.when(b.isNotNull(), "path_b").when(F.col("source").isNotNull(), "snippets").otherwise("none").alias("provenance"))


@query("j18_baseline_compare", "WITH b AS (SELECT doc_id, n_chars % 5 AS score FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, n_chars % 4 AS score FROM documents WHERE doc_id % 3 <> 0) SELECT b.doc_id, b.score AS base, r.score AS now, r.score IS NOT NULL AND r.score >= b.score AS holds FROM b LEFT JOIN r USING (doc_id)")
def baseline_compare(spark, sf):
    d = docs(spark, sf)
    b = d.where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") % 5).alias("base"))
    r = d.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 4).alias("now"))
    return b.join(r, "doc_id", "left").withColumn("holds", F.coalesce(F.col("now") >= F.col("base"), F.lit(False)))


@query("w06_page_of_offset", "SELECT doc_id, CAST(len(list_filter([1000, 3000, 9000], lambda b: b <= n_chars)) + 1 AS INT) AS page FROM documents")
def page_of_offset(spark, sf):
    return docs(spark, sf).select("doc_id", (F.size(F.filter(F.array(*[F.lit(x) for x in (1000, 3000, 9000)]), lambda b: b <= F.col("n_chars"))) + 1).alias("page"))
