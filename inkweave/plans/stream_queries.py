"""Registered queries that run as streams over the files of a table, to the end of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.fixtures import STATUS_SQL, status_of, table
from ..streaming.answers import answer_events, cleaned
from ..streaming.runs import drained, source
from ..streaming.watchdog import stuck_indexing

#: The events in order; what a paper's indexing knows after each of them; promotions between one event and the next.
_T04 = f"""WITH RECURSIVE {STATUS_SQL}, wm AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS wm FROM st),
o AS (SELECT paper_id, epoch_us(ts) // 1000 AS ms, status, row_number() OVER w AS rn, least(coalesce(lead(epoch_us(ts) // 1000) OVER w, wm), wm) AS nxt FROM st, wm WHERE epoch_us(ts) // 1000 <= wm WINDOW w AS (PARTITION BY paper_id ORDER BY epoch_us(ts) // 1000, event_id)),
r AS (SELECT paper_id, rn, nxt, CASE WHEN status = 'indexing' THEN ms END AS started, CASE WHEN status = 'indexing' THEN ms END AS heartbeat FROM o WHERE rn = 1
  UNION ALL SELECT o.paper_id, o.rn, o.nxt, CASE WHEN o.status <> 'indexing' THEN NULL WHEN greatest(r.started + 300000, r.heartbeat + 90000) < r.nxt THEN o.ms ELSE coalesce(r.started, o.ms) END, CASE WHEN o.status = 'indexing' THEN o.ms END FROM r JOIN o ON o.paper_id = r.paper_id AND o.rn = r.rn + 1)
SELECT paper_id, make_timestamp(started * 1000) AS started, make_timestamp(heartbeat * 1000) AS heartbeat, make_timestamp(due * 1000) AS due FROM (SELECT *, greatest(started + 300000, heartbeat + 90000) AS due FROM r) WHERE due < nxt"""


@query("t04_index_watchdog", _T04)
def index_watchdog(spark, sf):
    """Papers that are promoted because indexing is stuck, as the watermark passes each due time; a click is a sign of indexing."""
    e = source(spark, sf, "events")
    st = e.select("event_id", F.col("user_id").alias("paper_id"), status_of(F.col("event_type")).alias("status"), "ts")
    out = drained(spark, stuck_indexing(st))
    return out.select("paper_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "heartbeat", "due")])


def _thirds(text: Column) -> Column:
    """(n, part) of a text cut into three deltas, wherever that falls."""
    size = F.ceil(F.length(text) / 3).cast("int")
    return F.posexplode(F.array(*[F.substring(text, F.lit(1 + i) if i == 0 else size * i + 1, size) for i in range(3)]))


def _deltas(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Each conversation as one answer: every turn a passage that cites itself as chunk, in three deltas."""
    n = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    cited = F.concat(F.coalesce("text", F.lit("")), F.lit(" [CITE:chunk:"), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit("]\n"))
    rows = conversations.join(n, "conv_id").select("conv_id", "turn", "end", _thirds(cited).alias("nth", "part"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("turn"))
    return rows.select(F.col("conv_id").alias("answer_id"), (F.col("turn") * 3 + F.col("nth")).alias("seq"), F.col("part").alias("text"), ((F.col("turn") == F.col("end")) & (F.col("nth") == 2)).alias("last"), at.alias("at"))


@query("t09_citation_events")
def citation_events(spark, sf):
    """Citations of each answer stream and the clean text before each, put together from the stream's pieces."""
    out = drained(spark, answer_events(_deltas(source(spark, sf, "conversations"), table(spark, sf, "conversations"))))
    said = F.col("kind") == "message"
    pieces = F.array_sort(F.collect_list(F.when(said, F.struct("seq", "nth", "value"))))
    out = out.withColumn("nth", F.monotonically_increasing_id())
    per = out.groupBy("answer_id", "place").agg(F.concat_ws("", F.transform(pieces, lambda x: x["value"])).alias("text"), F.max(F.when(~said, F.col("kind"))).alias("kind"), F.max(F.when(~said, F.col("value"))).alias("value"))
    return per.select("answer_id", "place", F.md5("text").alias("digest"), "kind", "value")


@query("t08_clean_answers")
def clean_answers(spark, sf):
    """The clean text of each conversation as a stream of its turns' parts, and the final pass over it."""
    out = drained(spark, answer_events(_deltas(source(spark, sf, "conversations"), table(spark, sf, "conversations")))).withColumn("nth", F.monotonically_increasing_id())
    pieces = F.array_sort(F.collect_list(F.when(F.col("kind") == "message", F.struct("seq", "nth", "value"))))
    whole = out.groupBy("answer_id").agg(F.concat_ws("", F.transform(pieces, lambda x: x["value"])).alias("text"))
    final = F.pandas_udf(lambda s: s.map(cleaned), "string")
    return whole.select("answer_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), F.md5(final("text")).alias("final_digest"))
