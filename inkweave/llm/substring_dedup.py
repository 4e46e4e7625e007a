"""Operator 1, substring dedup: level-wise doubling over word windows.

A level has one window length. Windows that are found in two documents at one length are alone extended to the
next length, twice as long (the asked length at most), until no candidates survive or the asked length is reached.
The first level has half the asked length, rounded up (7 words for 13): of its windows only those are hashed that are
smallest in some window of the asked length (minimisers). Equal windows choose equal positions, so nothing that repeats
is lost, and about 2 of 8 positions are shuffled.

Cases: null or blank text has no words and no windows; a text shorter than the window keeps all its words; of equal
windows in one document none is removed for the other's sake; rows that repeat a doc_id count as one document for
the rule, keep their own texts' words and are returned as often as they come; a null doc_id is returned with its words unchanged; extra columns
are ignored. Memory follows one slice of texts (0.5 MB, or one longer text) and the marks of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import discard, materialise, release, workspace

WINDOW = 13


def _seed_rows(seed: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            t.find_words()
            grams = bk.windows(t.word_hashes(), seed)
            n = len(t.start) - window + 1
            if n <= 0:
                continue
            ok = bk.inside(t.wb, window, n)
            _, chosen = bk.minimisers(grams, ok, window - seed + 1)
            at = np.flatnonzero(chosen)
            doc = b.column(0).to_numpy(zero_copy_only=False)[bk.doc_of(t.wb, at)]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(doc, pa.int64())], ["h", "row_id"])

    return run


def _run_rows(seed: int, window: int):
    """Runs of windows that share the occurrence of a surviving seed: seed hash, hash of the words they span, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            t.find_words()
            n = len(t.start) - window + 1
            if n <= 0:
                continue
            words = t.word_hashes()
            ok = bk.inside(t.wb, window, n)
            low, chosen = bk.minimisers(bk.windows(words, seed), ok, window - seed + 1)
            # the seed of a window: its last position that holds the smallest hash (equal windows agree on it)
            grams = bk.windows(words, seed)
            place = bk.last_equal(grams, low, window - seed + 1)
            live = ok & np.isin(low.view(np.int64), np.unique(b.column(2).flatten().to_numpy()))
            first = live.copy()
            first[1:] &= ~live[:-1] | (place[1:] != place[:-1])
            at = np.flatnonzero(first)
            if not len(at):
                continue
            last = live.copy()
            last[:-1] &= ~live[1:] | (place[1:] != place[:-1])
            end = np.flatnonzero(last) + 1
            row = bk.doc_of(t.wb, at)
            span = bk.spans_hash(bk._prefix(words, 0), at, end + window - 1) ^ (place[at] - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            doc = b.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc, pa.int64()), pa.array((at - t.wb[row]).astype(np.int32)), pa.array((end - at).astype(np.int32))], ["h", "span", "row_id", "pos", "len"])

    return run


def _window_rows(length: int, width: int):
    """Windows of `length` words at the marked places (width 0), or whose two halves of `width` words are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            t.find_words()
            n = len(t.start) - length + 1
            if n <= 0:
                continue
            words, marks = t.word_hashes(), b.column(2)
            rows = np.repeat(np.arange(b.num_rows), [0 if x is None else x for x in marks.value_lengths().to_pylist()])
            flat = marks.flatten()
            step = np.zeros(len(words) + 1, np.int64)
            start = t.wb[rows] + flat.field("pos").to_numpy()
            np.add.at(step, start, 1)
            np.add.at(step, start + flat.field("len").to_numpy(), -1)
            live = np.cumsum(step)[:-1] > 0
            ok = bk.inside(t.wb, length, n)
            ok &= live[:n] & (live[length - width : length - width + n] if width else True)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            row = bk.doc_of(t.wb, at)
            doc = b.column(0).to_numpy(zero_copy_only=False)[row]
            a, c = bk.windows(words, length)[at], bk.windows(words, length, 1)[at]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc, pa.int64()), pa.array((at - t.wb[row]).astype(np.int32))], ["a", "b", "row_id", "pos"])

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (a, b, row_id, doc_id, pos), those whose hash two documents have: row_id, pos, len 1, later."""
    lows = rows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo")
    return rows.join(lows, ["a", "b"]).select("row_id", "pos", F.lit(1).alias("len"), (F.col("doc_id") > F.col("lo")).alias("later"))


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("row_id").agg(F.collect_list(F.struct("pos", "len", "later")).alias("marks"))


def numbered(docs: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """row_id, doc_id, text: row_id is doc_id (then True), or a number of the row's own where doc_ids repeat."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if slim.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return slim.select(F.col("doc_id").alias("row_id"), "doc_id", "text"), True
    return materialise(slim.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), folder, "numbered"), False


def repeated_windows(rows: DataFrame, folder: str, window: int = WINDOW, longest: int | None = None, plain: bool = True) -> list[tuple[int, DataFrame]]:
    """[(length, rows of row_id, marks)] for each level from `window` words on; marks: list of (pos, len, later).

    rows: those of numbered(); plain: row_id is doc_id. len windows from word pos on are each shared with another document; later tells that they
    start in a document with a smaller doc_id too. Levels go on to `longest` words (None: until no candidates survive).

    Windows around one occurrence of a window of the level before stand in one row, hashed as a whole. Where whole rows
    agree, that says it for all their windows; single windows are compared only between distinct rows, each taken once.
    """
    spark, seed = rows.sparkSession, (window + 1) // 2
    base = rows.where("doc_id is not null and text is not null").select(F.col("row_id"), "text")
    ids = rows.select("row_id", "doc_id")
    of = lambda found: found.withColumn("doc_id", F.col("row_id")) if plain else found.join(ids, "row_id")
    seeds = of(base.mapInArrow(_seed_rows(seed, window), "h long, row_id long"))
    both = seeds.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    alive = materialise(seeds.join(both, "h", "left_semi").groupBy("row_id").agg(F.collect_set("h").alias("marks")), folder, f"level-{seed}")
    del seeds, both
    release(spark)
    if alive.isEmpty():
        return []
    over = lambda marks, how, fields: of(base.join(marks, "row_id").select("row_id", "text", "marks").mapInArrow(how, fields))
    runs = materialise(over(alive, _run_rows(seed, window), "h long, span long, row_id long, pos int, len int"), folder, "runs")
    release(spark)
    spans = runs.groupBy("h", "span").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    placed = materialise(runs.join(spans, ["h", "span"]), folder, "placed")
    del runs, spans
    discard(spark, folder, "runs", f"level-{seed}")
    release(spark)
    whole = placed.where("lo < hi").select("row_id", "pos", "len", (F.col("doc_id") > F.col("lo")).alias("later"))
    reps = placed.where("doc_id = lo")
    mixed = reps.groupBy("h").agg(F.min("lo").alias("h_lo"), F.max("lo").alias("h_hi")).where("h_lo < h_hi").select("h")
    asked = reps.join(mixed, "h", "left_semi").groupBy("row_id").agg(F.collect_list(F.struct("pos", "len")).alias("marks"))
    single = _shared(over(asked, _window_rows(window, 0), "a long, b long, row_id long, pos int"))
    level = materialise(_by_document(whole.unionByName(single)), folder, f"level-{window}")
    del placed, whole, reps, mixed, asked, single
    discard(spark, folder, "placed")
    release(spark)
    levels, length = [(window, level)], window
    while (longest is None or length < longest) and not level.isEmpty():
        width, length = length, 2 * length if longest is None else min(2 * length, longest)
        found = over(level, _window_rows(length, width), "a long, b long, row_id long, pos int")
        level = materialise(_by_document(_shared(found)), folder, f"level-{length}")
        del found
        release(spark)
        levels.append((length, level))
    return levels


def _kept(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for text, marks in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = (text or b"").split()
                if marks:
                    gone = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(gone, [m["pos"] for m in marks], 1)
                    np.add.at(gone, [m["pos"] + m["len"] + window - 1 for m in marks], -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    left = [w for w, k in zip(ws, keep.tolist(), strict=True) if k]
                else:
                    left = ws
                kept = b" ".join(left)
                out["n_words"].append(len(ws))
                out["n_removed"].append(len(ws) - len(left))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["kept_text"].append(kept.decode())
            cols = [b.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out["kept_text"], pa.string())] * texts, ["doc_id", *list(out)[: 3 + texts]])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, longest: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (if texts): the words outside every window that starts in an earlier document too.

    longest: also follow the doubling beyond `window` to that length (0: as far as candidates survive) and add
    longest_repeat, the longest level at which a window of the document repeats in another one.
    """
    folder = workspace(docs.sparkSession)
    slim, plain = numbered(docs, folder)
    levels = repeated_windows(slim, folder, window, window if longest is None else longest or None, plain)
    if levels:
        marks = levels[0][1].select("row_id", F.filter("marks", lambda x: x["later"]).alias("marks")).where("size(marks) > 0")
        slim = slim.join(marks, "row_id", "left").select("doc_id", "text", "marks", "row_id")
    else:
        slim = slim.withColumn("marks", F.lit(None).cast("array<struct<pos:int,len:int,later:boolean>>")).select("doc_id", "text", "marks", "row_id")
    out = slim.mapInArrow(_kept(window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    if longest is not None:
        reach = None
        for length, level in levels:
            one = level.select("row_id", F.lit(length).alias("longest_repeat"))
            reach = one if reach is None else reach.unionByName(one)
        if reach is None:
            return out.withColumn("longest_repeat", F.lit(0))
        reach = reach.join(slim.select("row_id", "doc_id"), "row_id")
        out = out.join(reach.groupBy("doc_id").agg(F.max("longest_repeat").alias("longest_repeat")), "doc_id", "left").fillna(0, ["longest_repeat"])
    return out


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return substring_dedup(documents(spark, sf_dir), texts=False)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM pos
), lo AS (
  SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM win JOIN lo USING (s), range(0, 13) t(k) WHERE doc_id > first_doc
), one AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT o.doc_id, string_agg(o.ws[o.i], ' ' ORDER BY o.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n_removed
  FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
