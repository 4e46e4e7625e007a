"""Registered queries of JSON answers, prompts, extraction chunks and word ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions import heads
from ..functions.jsontext import json_block, json_repaired
from ..functions.prompts import budgeted, section
from ..operators.extraction_chunks import chunked
from ..operators.lexical import ranked
from ..registry import query
from ..sources.fixtures import table


@query("h24_json_blocks")
def json_blocks(spark, sf):
    """The first balanced block of every page, conversation turn and event, and what repair makes of it."""
    raw = [("pages", "page_id", "html"), ("events", "event_id", "props")]
    rows = table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("raw"))
    for name, key, text in raw:
        rows = rows.unionByName(table(spark, sf, name).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("id"), F.col(text).alias("raw")))
    return rows.select("source", "id", F.length(json_block(F.col("raw"))).cast("long").alias("n_chars"), F.md5(json_block(F.col("raw"))).alias("digest"), json_repaired(F.col("raw")).alias("repaired"))


@query("h02_extraction_chunks")
def extraction_chunk_query(spark, sf):
    """Chunks of at most 2,000 characters, at least 500, a tenth of overlap, of every document."""
    out = chunked(table(spark, sf, "documents"), most=2000, overlap_ratio=0.1)
    return out.select("doc_id", "chunk_index", "title", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "start_char", "end_char")


_MOST = 1200
_FIT = "CASE WHEN length({x}) <= {a} THEN {x} WHEN contains(substr({x}, 1, greatest({a}, -1) + 1), chr(10)) THEN substr({x}, 1, length(regexp_extract(substr({x}, 1, greatest({a}, -1) + 1), '^((?s).*)\\n', 1))) ELSE substr({x}, 1, greatest({a}, 0)) END"
_ROOM = max(_MOST - len(m.CONTEXT_CUT), 0)
_MARK = "CASE WHEN {x} <> '' AND {after} = 0 THEN rtrim({x}, ' ' || chr(10)) || '" + m.CONTEXT_CUT + "' ELSE {x} END"


@query("k07_prompt_budget", f"""WITH t AS (SELECT conv_id, turn, role, text, string_agg('- [' || conv_id || '-' || turn || '] ' || split_part(text, '.', 1) || ' (' || role || ')', chr(10)) OVER w AS e,
string_agg('- [' || turn || '] ' || left(text, 200), chr(10)) OVER w AS r, string_agg('- [' || conv_id || '-' || turn || '] [page ' || turn || '] ' || left(text, 300), chr(10)) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT conv_id, turn, coalesce(e, '{m.EMPTY_ENTITIES}') AS e, coalesce(r, '{m.EMPTY_RELATIONS}') AS r, coalesce(c, '{m.EMPTY_CHUNKS}') AS c FROM t),
c1 AS (SELECT *, {_FIT.format(x='c', a=f'({_ROOM} - length(e) - length(r))')} AS cc FROM f), r1 AS (SELECT *, {_FIT.format(x='r', a=f'({_ROOM} - length(e) - length(cc))')} AS rr FROM c1), e1 AS (SELECT *, {_FIT.format(x='e', a=f'({_ROOM} - length(rr) - length(cc))')} AS ee FROM r1)
SELECT conv_id, turn, length(e) + length(r) + length(c) > {_MOST} AS cut, md5(CASE WHEN cut THEN {_MARK.format(x='ee', after='length(rr) + length(cc)')} ELSE e END) AS entities, md5(CASE WHEN cut THEN {_MARK.format(x='rr', after='length(cc)')} ELSE r END) AS relations, md5(CASE WHEN cut THEN {_MARK.format(x='cc', after='0')} ELSE c END) AS chunks FROM e1""")
def prompt_budget(spark, sf):
    """Before every turn: the turns so far as entities, relations and chunks, in 1,200 characters together."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t, lit = table(spark, sf, "conversations"), F.lit
    name = F.concat(lit("- ["), F.col("conv_id"), lit("-"), F.col("turn"), lit("] "))
    lines = {
        "e": F.concat(name, F.substring_index("text", ".", 1), lit(" ("), F.col("role"), lit(")")), "r": F.concat(lit("- ["), F.col("turn"), lit("] "), F.left("text", lit(200))),
        "c": F.concat(name, lit("[page "), F.col("turn"), lit("] "), F.left("text", lit(300))),
    }
    empty = {"e": m.EMPTY_ENTITIES, "r": m.EMPTY_RELATIONS, "c": m.EMPTY_CHUNKS}
    full = t.select("conv_id", "turn", *[section(F.collect_list(line).over(w), empty[k]).alias(k) for k, line in lines.items()])
    out = full.withColumn("b", budgeted(F.col("e"), F.col("r"), F.col("c"), _MOST))
    cut = F.length("e") + F.length("r") + F.length("c") > _MOST
    return out.select("conv_id", "turn", cut.alias("cut"), *[F.md5(f"b.{c}").alias(c) for c in ("entities", "relations", "chunks")])


@query("s27_static_ranking", f"""WITH ch AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents),
q AS (SELECT conv_id, turn, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z0-9][\\p{{L}}\\p{{N}}_.\\-]*'), lambda w: length(w) >= 2), lambda w: lower(w))) AS ts FROM conversations WHERE role = 'user')
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_filter(ts, lambda t: contains(lower(line), t))) DESC, chunk_index) AS rank, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(len(list_filter(ts, lambda t: contains(lower(line), t))) AS BIGINT) AS score
FROM q JOIN ch ON doc_id = conv_id QUALIFY rank <= 5""")
def static_ranking(spark, sf):
    """The five best lines of the document that has the conversation's number, for each user turn."""
    c = table(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), F.col("conv_id").alias("paper_id"), "text")
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return ranked(c, lines, 5).select("question_id.conv_id", "question_id.turn", F.col("rank").cast("long").alias("rank"), F.col("chunk_index").cast("long").alias("chunk_index"), "score")


def _papers(spark, sf):
    """Documents, and pages as plain text with their title as first line."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), r"(?is)</?(?:p|h\d|li|title|div|br|article|nav)\b[^>]*>", "\n")
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.regexp_replace(plain, "<[^>]*>", "").alias("text"))
    return table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text").unionByName(pages)


@query("h06_titles")
def titles(spark, sf):
    return _papers(spark, sf).select("source", "id", heads.paper_title(F.col("text")).alias("title"))


@query("h07_sections")
def section_query(spark, sf):
    """Title, abstract, keywords and introduction of every document and page."""
    return _papers(spark, sf).withColumn("s", heads.sections(F.col("text"))).select("source", "id", "s.title", F.md5("s.abstract").alias("abstract"), "s.keywords", F.md5("s.intro").alias("intro"))


@query("h08_conclusions")
def conclusions(spark, sf):
    return _papers(spark, sf).select("source", "id", heads.conclusion(F.col("text")).alias("conclusion"))


@query("h09_meta_lines")
def meta_lines(spark, sf):
    return _papers(spark, sf).select("source", "id", heads.meta(F.col("text")).alias("m")).select("source", "id", "m.*")
