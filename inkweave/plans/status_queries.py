"""Registered queries over the status stream, its tables and time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model as m
from ..operators import stores
from ..registry import query
from ..sources.fixtures import STATUS_SQL, status_events, table

S = f"WITH {STATUS_SQL}"
LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in m.TRANSITIONS)
NOW = "2024-02-01 00:00:00"


def _latest(df, key="paper_id"):
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


LATEST = ", cur AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ts DESC, event_id DESC) = 1)"


@query("p22_illegal_transitions", S + f""", t AS (SELECT paper_id, lag(status) OVER (PARTITION BY paper_id ORDER BY ts, event_id) AS from_status, status AS to_status FROM st)
SELECT from_status, to_status, count(*) AS n, (from_status, to_status) IN (VALUES {LEGAL}) AS legal FROM t WHERE from_status IS NOT NULL GROUP BY 1, 2""")
def illegal_transitions(spark, sf):
    w = Window.partitionBy("paper_id").orderBy("ts", "event_id")
    t = status_events(spark, sf).select(F.lag("status").over(w).alias("from_status"), F.col("status").alias("to_status")).where("from_status is not null")
    legal = F.concat_ws(">", "from_status", "to_status").isin(*[f"{a}>{b}" for a, b in m.TRANSITIONS])
    return t.groupBy("from_status", "to_status").agg(F.count("*").alias("n")).withColumn("legal", legal)


@query("w10_changes", S + ", t AS (SELECT *, lag(status) OVER (PARTITION BY paper_id ORDER BY ts, event_id) AS p FROM st) SELECT paper_id, count(*) FILTER (WHERE p IS DISTINCT FROM status AND p IS NOT NULL) AS n_changes FROM t GROUP BY 1")
def changes(spark, sf):
    w = Window.partitionBy("paper_id").orderBy("ts", "event_id")
    t = status_events(spark, sf).withColumn("p", F.lag("status").over(w))
    return t.groupBy("paper_id").agg(F.count(F.when(F.col("p").isNotNull() & (F.col("p") != F.col("status")), 1)).alias("n_changes"))


@query("s16_latest_status", S + LATEST + " SELECT paper_id, event_id, status FROM cur")
def latest_status(spark, sf):
    return _latest(status_events(spark, sf)).select("paper_id", "event_id", "status")


@query("p21_status_contract", S + """, x AS (SELECT event_id, status, CAST(event_id % 101 AS INT) AS percent, event_id % 7 = 0 AS has_error FROM st)
SELECT event_id, CASE WHEN status = 'pending' AND percent <> 0 THEN 'percent' WHEN status = 'processing' AND percent NOT IN (20, 35, 50, 80, 95) THEN 'percent' WHEN status = 'indexing' AND percent <> 98 THEN 'percent' WHEN status = 'ready' AND percent <> 100 THEN 'percent'
 WHEN status = 'failed' AND percent <> 0 THEN 'percent' WHEN status = 'failed' AND NOT has_error THEN 'error_missing' WHEN status <> 'failed' AND has_error THEN 'error_unexpected' ELSE 'ok' END AS verdict FROM x""")
def status_contract(spark, sf):
    x = status_events(spark, sf).select("event_id", "status", (F.col("event_id") % 101).cast("int").alias("percent"), (F.col("event_id") % 7 == 0).alias("has_error"))
    want = {"pending": (0,), "processing": tuple(m.STAGE_PERCENT[s] for s in ("ingesting", "head_refining", "classifying", "extracting", "storing")), "indexing": (98,), "ready": (100,), "failed": (0,)}
    wrong = F.lit(False)
    for status, values in want.items():
        wrong = wrong | ((F.col("status") == status) & ~F.col("percent").isin(*values))
    failed = F.col("status") == "failed"
    return x.select("event_id", F.when(wrong, "percent").when(failed & ~F.col("has_error"), "error_missing").when(~failed & F.col("has_error"), "error_unexpected").otherwise("ok").alias("verdict"))


@query("p23_status_drift", S + LATEST + ", fst AS (SELECT paper_id, arg_min(status, event_id) AS kept FROM st GROUP BY 1) SELECT paper_id, kept, status AS current, kept <> status AS drifted FROM fst JOIN cur USING (paper_id)")
def status_drift(spark, sf):
    s = status_events(spark, sf)
    first = s.groupBy("paper_id").agg(F.min_by("status", "event_id").alias("kept"))
    return first.join(_latest(s).select("paper_id", F.col("status").alias("current")), "paper_id").withColumn("drifted", F.col("kept") != F.col("current"))


@query("p24_generation_guard", S + ", g AS (SELECT *, nullif(event_id % 3, 0) AS token, nullif(event_id % 2, 0) AS expected FROM st) SELECT count(*) AS n, count(*) FILTER (WHERE token IS NOT DISTINCT FROM expected) AS n_writable FROM g")
def generation_guard(spark, sf):
    z = lambda k: F.nullif(F.col("event_id") % k, F.lit(0))
    return status_events(spark, sf).agg(F.count("*").alias("n"), F.count(F.when(z(3).eqNullSafe(z(2)), 1)).alias("n_writable"))


@query("s18_indexing_timestamps", S + ", x AS (SELECT *, lag(ts) OVER (PARTITION BY paper_id ORDER BY ts, event_id) AS prior FROM st) SELECT event_id, CASE WHEN status = 'indexing' THEN coalesce(prior, ts) END AS started_at FROM x")
def indexing_timestamps(spark, sf):
    prior = F.lag("ts").over(Window.partitionBy("paper_id").orderBy("ts", "event_id"))
    return status_events(spark, sf).withColumn("prior", prior).select("event_id", F.when(F.col("status") == "indexing", F.coalesce("prior", "ts")).alias("started_at"))


@query("s12_papers_page", S + LATEST + " SELECT paper_id, status, (SELECT count(*) FROM cur WHERE status = 'ready') AS total FROM cur WHERE status = 'ready' ORDER BY ts DESC, paper_id LIMIT 20 OFFSET 5")
def papers_page(spark, sf):
    ready = _latest(status_events(spark, sf)).where("status = 'ready'")
    total = ready.agg(F.count("*").alias("total"))
    return ready.orderBy(F.col("ts").desc(), "paper_id").offset(5).limit(20).select("paper_id", "status").join(F.broadcast(total))


@query("s13_point_updates", S + LATEST + ", u AS (SELECT paper_id, max(value) AS v, CASE WHEN paper_id % 2 = 0 THEN 'ready' END AS status FROM st WHERE value > 50 GROUP BY 1, 3) SELECT c.paper_id, coalesce(u.status, c.status) AS status, round(coalesce(u.v, c.value), 6) AS value FROM cur c LEFT JOIN u USING (paper_id)")
def point_updates(spark, sf):
    s = status_events(spark, sf)
    u = s.where("value > 50").groupBy("paper_id").agg(F.max("value").alias("v")).withColumn("u", F.when(F.col("paper_id") % 2 == 0, "ready"))
    return _latest(s).join(u, "paper_id", "left").select("paper_id", F.coalesce("u", "status").alias("status"), F.round(F.coalesce("v", "value"), 6).alias("value"))


@query("s14_version_bump", S + " SELECT event_id, CAST(coalesce(TRY_CAST(v AS BIGINT) + 1, 2) AS VARCHAR) AS version FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'v' || event_id ELSE CAST(event_id AS VARCHAR) END AS v FROM st)")
def version_bump(spark, sf):
    v = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return status_events(spark, sf).select("event_id", F.coalesce(v.try_cast("long") + 1, F.lit(2)).cast("string").alias("version"))


@query("s15_rank_bump", S + LATEST + f" SELECT paper_id, CAST(row_number() OVER (ORDER BY CASE WHEN paper_id IN (3, 5, 8) THEN TIMESTAMP '{NOW}' ELSE ts END DESC, paper_id) AS INT) AS rank FROM cur")
def rank_bump(spark, sf):
    when = F.when(F.col("paper_id").isin(3, 5, 8), F.lit(NOW).cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    ranked = stores.ranked(_latest(status_events(spark, sf)).withColumn("at", when), F.date_trunc("hour", "at"), [F.col("at").desc(), F.col("paper_id")])
    return ranked.select("paper_id", F.col("rank").cast("int").alias("rank"))


@query("s17_warning_union", S + " SELECT paper_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda w: list_position(l, w))), lambda i: l[i]), ',') AS warnings FROM (SELECT paper_id, list(status ORDER BY ts, event_id) AS l FROM st GROUP BY 1)")
def warning_union(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status"))), lambda x: x["status"])
    return status_events(spark, sf).groupBy("paper_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("warnings"))


@query("j12_stuck_scan", S + LATEST + f", o AS (SELECT * FROM cur WHERE status IN ('processing', 'indexing') ORDER BY ts, paper_id LIMIT 200) SELECT paper_id, status FROM o WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 2 DAY")
def stuck_scan(spark, sf):
    oldest = _latest(status_events(spark, sf)).where("status in ('processing', 'indexing')").orderBy("ts", "paper_id").limit(200)
    return oldest.where(F.col("ts") < F.expr(f"timestamp'{NOW}' - interval 2 days")).select("paper_id", "status")


@query("s28_cleanup_due", S + f" SELECT DISTINCT paper_id, CAST(event_id % 4 AS BIGINT) AS run_id FROM st WHERE status = 'failed' AND ts + INTERVAL 120 SECOND <= TIMESTAMP '2024-01-15 00:00:00'")
def cleanup_due(spark, sf):
    return status_events(spark, sf).where("status = 'failed' and ts + interval 120 seconds <= timestamp'2024-01-15 00:00:00'").select("paper_id", (F.col("event_id") % 4).alias("run_id")).distinct()


@query("s29_lease_held", S + " SELECT paper_id, max(ts) + INTERVAL 900 SECOND > TIMESTAMP '2024-01-29 12:00:00' AS held FROM st WHERE status = 'processing' GROUP BY 1")
def lease_held(spark, sf):
    return status_events(spark, sf).where("status = 'processing'").groupBy("paper_id").agg((F.max("ts").cast("timestamp") + F.expr("interval 900 seconds") > F.lit("2024-01-29 12:00:00").cast("timestamp")).alias("held"))


@query("t01_bus_counts", S + " SELECT status, count(*) AS n, round(sum(value), 4) AS total FROM st GROUP BY 1")
def bus_counts(spark, sf):
    return status_events(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t05_process_watchdog", S + LATEST + " SELECT paper_id, CASE WHEN status = 'processing' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 900 SECOND THEN 'PROCESS_TIMEOUT' WHEN status = 'pending' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 3600 SECOND THEN 'QUEUE_TIMEOUT' ELSE 'ok' END AS verdict FROM cur")
def process_watchdog(spark, sf):
    old = lambda s: F.col("ts") < F.expr(f"timestamp'2024-01-30 00:00:00' - interval {s} seconds")
    return _latest(status_events(spark, sf)).select("paper_id", F.when((F.col("status") == "processing") & old(900), "PROCESS_TIMEOUT").when((F.col("status") == "pending") & old(3600), "QUEUE_TIMEOUT").otherwise("ok").alias("verdict"))


@query("t06_late_writes", S + ", g AS (SELECT *, event_id - (event_id % 4) * 50 AS generation FROM st), x AS (SELECT *, max(generation) OVER (PARTITION BY paper_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g) SELECT event_id, seen IS NOT NULL AND generation < seen AS rejected FROM x")
def late_writes(spark, sf):
    w = Window.partitionBy("paper_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    g = status_events(spark, sf).withColumn("generation", F.col("event_id") - (F.col("event_id") % 4) * 50).withColumn("seen", F.max("generation").over(w))
    return g.select("event_id", F.coalesce(F.col("generation") < F.col("seen"), F.lit(False)).alias("rejected"))


@query("t12_head_refine_wait", S + " SELECT a.event_id, min(b.event_id) AS refined FROM st a LEFT JOIN st b ON a.paper_id = b.paper_id AND b.status = 'indexing' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.status = 'pending' GROUP BY 1")
def head_refine_wait(spark, sf):
    s = status_events(spark, sf)
    a, b = s.where("status = 'pending'").alias("a"), s.where("status = 'indexing'").alias("b")
    on = (F.col("a.paper_id") == F.col("b.paper_id")) & (F.col("b.ts") > F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("interval 6 hours"))
    return a.join(b, on, "left").groupBy(F.col("a.event_id").alias("event_id")).agg(F.min("b.event_id").alias("refined"))


@query("t17_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("t17_sliding_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, range(0, 3) r(k) GROUP BY 1")
def sliding_window(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("t17_session_window", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_window(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("w09_latest_revoked_run", S + " SELECT paper_id, coalesce(arg_max(event_id, ts) FILTER (WHERE status = 'indexing' AND value > 90), arg_max(event_id, ts) FILTER (WHERE status = 'failed')) AS run FROM st GROUP BY 1")
def latest_revoked_run(spark, sf):
    pick = lambda cond: F.max_by(F.when(F.expr(cond), F.col("event_id")), F.when(F.expr(cond), F.col("ts")))
    return status_events(spark, sf).groupBy("paper_id").agg(F.coalesce(pick("status = 'indexing' and value > 90"), pick("status = 'failed'")).alias("run"))


@query("u05_wipe_targets", S + LATEST + " SELECT paper_id, event_id AS run FROM cur UNION SELECT paper_id, min(event_id) FROM st WHERE status = 'indexing' GROUP BY 1 UNION SELECT paper_id, max(event_id) FROM st WHERE status = 'failed' GROUP BY 1")
def wipe_targets(spark, sf):
    s = status_events(spark, sf)
    a = _latest(s).select("paper_id", F.col("event_id").alias("run"))
    b = s.where("status = 'indexing'").groupBy("paper_id").agg(F.min("event_id").alias("run"))
    return a.unionByName(b).unionByName(s.where("status = 'failed'").groupBy("paper_id").agg(F.max("event_id").alias("run"))).distinct()


@query("u06_stuck_ids", S + LATEST + " SELECT paper_id, 1 AS list FROM cur WHERE status = 'processing' UNION ALL SELECT paper_id, 2 FROM cur WHERE status = 'pending'")
def stuck_ids(spark, sf):
    cur = _latest(status_events(spark, sf))
    return cur.where("status = 'processing'").select("paper_id", F.lit(1).alias("list")).unionByName(cur.where("status = 'pending'").select("paper_id", F.lit(2).alias("list")))


@query("j23_expected_minus_found", S + " SELECT DISTINCT paper_id FROM st WHERE status = 'pending' EXCEPT SELECT paper_id FROM st WHERE status = 'ready' AND value > 50")
def expected_minus_found(spark, sf):
    s = status_events(spark, sf)
    return s.where("status = 'pending'").select("paper_id").distinct().join(s.where("status = 'ready' and value > 50"), "paper_id", "left_anti")


@query("e11_terminal_promotion", S + LATEST + " SELECT paper_id, CASE WHEN status <> 'indexing' THEN status WHEN value > 50 THEN 'ready' ELSE 'ready_with_warnings' END AS status FROM cur")
def terminal_promotion(spark, sf):
    return _latest(status_events(spark, sf)).select("paper_id", F.when(F.col("status") != "indexing", F.col("status")).when(F.col("value") > 50, "ready").otherwise("ready_with_warnings").alias("status"))


@query("e22_result_cache_key", S + LATEST + " SELECT paper_id, sha256('lens_clash|' || paper_id || '|' || event_id) AS key, ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-30 12:00:00' AS live FROM cur")
def result_cache_key(spark, sf):
    return _latest(status_events(spark, sf)).select("paper_id", F.sha2(F.concat(F.lit("lens_clash|"), F.col("paper_id").cast("string"), F.lit("|"), F.col("event_id").cast("string")), 256).alias("key"), (F.col("ts").cast("timestamp") + F.expr("interval 24 hours") > F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("live"))
