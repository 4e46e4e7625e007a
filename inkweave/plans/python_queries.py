"""Registered queries whose operators keep state, and so run Python over Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunks import chunk_documents, register
from ..registry import query
from ..sources.fixtures import table
from ..streaming.stateful import admitted, breaker


@query("h01_chunks")
def chunk_query(spark, sf):
    """Pages end every 3,000 characters here."""
    d = table(spark, sf, "documents").withColumn("pages", F.sequence(F.lit(3000), F.greatest(F.length("text"), F.lit(3000)), F.lit(3000)))
    return chunk_documents(d, "pages").select("doc_id", "chunk_id", "chunk_index", "section", "char_start", "char_end", "page_start", "page_end", F.md5("text").alias("digest"))


@query("x05_chunk_function")
def chunk_function(spark, sf):
    register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("inkweave_documents")
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.section, c.char_start, c.char_end FROM inkweave_documents d, LATERAL chunk_text(d.text) c")


@query("t10_token_bucket")
def token_bucket(spark, sf):
    e = table(spark, sf, "events")
    return admitted(e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 20).alias("tokens")), 1.0, 10.0)


@query("t11_circuit_breaker")
def circuit_breaker(spark, sf):
    e = table(spark, sf, "events")
    return breaker(e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok")), 3600.0)
