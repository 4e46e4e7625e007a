"""Stores as tables: inserts, upserts, deletes, pointers, leases and scans as DataFrame-to-DataFrame rewrites.

Every function is one or two joins or aggregates on the store's key; nothing is collected. Blank and null keys or
pointers both mean "unset".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank(c: str | Column) -> Column:
    """Null where a text is null or blank, else the text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(col) != "", col)


def first_text(*cs: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[blank(c) for c in cs])


def insert_absent(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the store lacks are added, one for each key (the smallest row)."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c) for c in new.columns])
    once = new.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return store.unionByName(once.join(store.select(*key), key, "left_anti"))


def upsert(store: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of all rows with one key the one of the greatest `order` stays; new rows win ties."""
    every = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col(order).desc(), F.col("__new").desc())
    return every.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth", "__new")


def delete(store: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is in `gone` go (null keys stay); the same call on a child table cascades."""
    return store.join(gone.select(*key).distinct(), key, "left_anti")


def visible(vectors: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of each paper's active run; a paper without active run (null or blank) has none."""
    runs = active.select("paper_id", blank("run_id").alias("run_id")).where("run_id is not null")
    return vectors.join(runs, ["paper_id", "run_id"], "left_semi")


def usable(rows: DataFrame, row_id: str, document: str) -> DataFrame:
    """Rows with id, paper and document; 'None' is no document."""
    return rows.where(blank(F.col(row_id).cast("string")).isNotNull() & blank(F.col("paper_id").cast("string")).isNotNull() & (F.trim(document) != "None") & blank(document).isNotNull())


def foreign_evidence(evidence: DataFrame, owners: DataFrame) -> DataFrame:
    """Evidence whose paper_id isn't the one of its index run (owners: run_id, owner)."""
    return evidence.join(owners, "run_id").where(~F.col("paper_id").eqNullSafe(F.col("owner")))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset ... offset + limit of an order that is total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def success(data: Column, request_id: Column) -> Column:
    """JSON of {data, meta: {request_id}}; nulls in data are left out, a null request_id leaves meta empty."""
    return F.to_json(F.struct(data.alias("data"), F.struct(request_id.alias("request_id")).alias("meta")))


def envelope(rows: DataFrame, item: Column, total: DataFrame, offset: int, limit: int, request_id: str | None = None) -> DataFrame:
    """One row, JSON of {data: {items, total, offset, limit}}, with a request_id also {meta: {request_id}}; items are those of a page."""
    items = rows.agg(F.sort_array(F.collect_list(item)).alias("items"))
    counted = total.agg(F.count("*").alias("total"))
    body = F.struct("items", "total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"))
    whole = F.to_json(F.struct(body.alias("data"))) if request_id is None else success(body, F.lit(request_id))
    return items.withColumn("k", F.lit(1)).join(counted.withColumn("k", F.lit(1)), "k").select(whole.alias("body"))


def clean_metadata(fields: Column) -> Column:
    """A map without its null values, as JSON with sorted keys."""
    kept = F.map_filter(fields, lambda k, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(kept))))


def prefer(files: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of the files (path) of one stem the one whose ending comes first in `kinds`; other endings are no papers."""
    found = files.select("path", F.regexp_extract("path", r"([^/]+)\.(\w+)$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"))
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return found.where(rank > 0).groupBy("stem").agg(F.min_by("path", rank).alias("path"))


def wipe_times(failures: DataFrame, ts: str, delays: tuple[int, ...] = (0, 120, 125, 130), poll: int = 30) -> DataFrame:
    """Failures with wave, due (seconds since 1970) and polled: the first poll (each `poll` seconds) at or after due."""
    waves = F.posexplode(F.array(*[F.lit(d).cast("long") for d in delays])).alias("wave", "delay")
    due = F.unix_seconds(F.col(ts).cast("timestamp")) + F.col("delay")
    return failures.select("*", waves).withColumn("due", due).drop("delay").withColumn("polled", F.when(F.col("wave") == 0, F.col("due")).otherwise(F.ceil(F.col("due") / poll) * poll))


def drained(stuck: DataFrame, order: list[Column], size: int = 200, rounds: int = 50) -> DataFrame:
    """Stuck rows with the round (from 1) that drains them; null for what `rounds` rounds leave.

    One row for each stuck paper passes a window over all; the batch is bounded by size * rounds rows through the limit.
    """
    taken = stuck.orderBy(*order).limit(size * rounds)
    nth = F.row_number().over(Window.orderBy(*order))
    return taken.withColumn("round", (F.floor((nth - 1) / size) + 1).cast("int"))


def merged_degradation(profiles: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Profiles (report, seq, reason, papers) of one report become one: the reason of highest priority (the earliest of
    equals), papers in order of first sight, and whether there is any."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("reason")), F.lit(-1))
    seen = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "papers"))), lambda x: x["papers"])))
    return profiles.groupBy("report").agg(F.max_by("reason", F.struct(rank, -F.col("seq"))).alias("reason"), seen.alias("papers"))


def precision_recall(cases: DataFrame, by: list[str]) -> DataFrame:
    """Cases (expected, actual booleans) per group: tp, fp, fn, precision, recall and alarms among negatives; null over 0."""
    n = lambda c: F.count(F.when(c, 1))
    e, a = F.col("expected"), F.col("actual")
    out = cases.groupBy(*by).agg(n(e & a).alias("tp"), n(~e & a).alias("fp"), n(e & ~a).alias("fn"), n(~e).alias("negatives"))
    ratio = lambda x, y: F.round(F.try_divide(x, y), 4)
    return out.select(*by, "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("fp"), F.col("negatives")).alias("alarm_rate"))


def margins(cases: DataFrame, by: list[str]) -> DataFrame:
    """Cases (positive boolean, score, theta): least margins of either side and the threshold half way between the
    lowest positive and the highest negative score; null where a side is missing."""
    p = F.col("positive")
    out = cases.groupBy(*by).agg(F.min(F.when(p, F.col("score") - F.col("theta"))).alias("a"), F.min(F.when(~p, F.col("theta") - F.col("score"))).alias("b"), F.min(F.when(p, F.col("score"))).alias("low"), F.max(F.when(~p, F.col("score"))).alias("high"))
    return out.select(*by, F.round("a", 4).alias("min_margin"), F.round("b", 4).alias("min_safety"), F.round((F.col("low") + F.col("high")) / 2, 4).alias("suggested"))


def ranked(rows: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """Rows numbered from 1 by bucket (descending), then `order`. One task sees a row for each bucket only: take a key that many rows share, such as the hour."""
    keyed = rows.withColumn("__bucket", bucket)
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.col("__bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    out = keyed.join(offsets, F.col("__bucket").eqNullSafe(F.col("__of")))
    return out.withColumn("rank", F.col("__offset") + F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))).drop("__bucket", "__of", "__offset")
