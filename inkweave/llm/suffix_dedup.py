"""Operator 8, suffix-array dedup: shard Burrows-Wheeler orders merged by interleave refinement.

Texts are parsed into phrases at content-defined places (the smallest 16-byte hash of some stretch of `gap` bytes),
so equal strings are parsed alike and a string of 400 bytes holds whole phrases. Each shard (a slice of texts) sorts
the suffixes of its phrase sequence once, by as many phrases as cover the asked length. The shard orders are merged
without sorting suffixes again: suffixes that begin with one phrase meet, lie in shard order, and their interleave is
refined phrase by phrase; blocks that still hold two suffixes share one phrase more, which gives the common prefix of
every suffix with its neighbours and so the repeated intervals. Of equal suffixes of a shard only one takes part.

Phrase bounds far enough inside a string depend on its bytes alone, and `gap` is chosen so that two of them stand
there. A string can repeat only where the phrases between such bounds are a repeated interval. These places are then
checked exactly: strings around one anchor (the smallest hash inside the string) stand in one row, hashed as a whole;
where whole rows agree all their strings repeat. The distinct rows of an anchor, each taken once, are compared by
cells of 16 strings and these by single strings, only where the bytes that a cell's strings share repeat.

Cases: a null text is the empty text; texts shorter than the asked length keep all bytes; a rows' copies with one
doc_id count as different places; a null doc_id is kept apart from others and treated like any text; an empty table
gives an empty result; extra columns are ignored; lengths over 1,037 bytes are refused. Python memory follows one slice of texts and the distinct suffixes
of the commonest phrase.
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

LENGTH, GRAM, DEPTH, CELL = 400, 16, 4, 16
SHARD = 2 << 20
_U = np.uint64
_FULL = 1 << 20


def phrase_starts(t: bk.Texts, grams: np.ndarray, gap: int) -> np.ndarray:
    n = len(t.data) - gap - GRAM + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = bk.inside(t.bounds, gap + GRAM - 1, n)
    _, chosen = bk.minimisers(grams, ok, gap)
    return np.flatnonzero(chosen)


def _grams(t: bk.Texts) -> np.ndarray:
    return bk.windows(bk._TABLES[0][t.data], GRAM)


def _suffixes(length: int, gap: int):
    """Each shard's suffix order: first phrases, lengths (8 bits each), shard, rank, place.

    c0 holds 64 bits of the first phrase's hash, c12 and c3s 32 bits of the next three (what repeats is checked later).
    kind 1: answered in the shard (c12 has the reach); kind 2: takes part for its copies in the shard too.
    """
    names, zone = ["kind", "c0", "c12", "c3s", "shard", "rank", "row_id", "pos"], _zone(length, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text", SHARD):
            t = bk.Texts(b.column(1))
            start = phrase_starts(t, _grams(t), gap)
            if len(start) < 2:
                continue
            doc = bk.doc_of(t.bounds, start)
            whole = np.append(doc[1:] == doc[:-1], False)
            size = np.where(whole, np.diff(start, append=start[-1]), 0)
            symbol = np.where(whole, bk.spans_hash(t.byte_prefix(), start, start + size), _U(0))
            m = len(start)
            ctx, lens = np.zeros((DEPTH, m), _U), np.zeros((DEPTH, m), np.int64)
            covered, open_ = np.zeros(m, np.int64), np.ones(m, bool)
            for j in range(DEPTH):
                s = np.concatenate((symbol[j:], np.zeros(min(j, m), _U)))
                open_ &= (s != 0) & (covered < zone)
                ctx[j] = np.where(open_, s if j == 0 else (s >> _U(32)) | _U(1), _U(0))
                lens[j] = np.where(open_, np.concatenate((size[j:], np.zeros(min(j, m), np.int64))), 0)
                covered += lens[j]
            order = np.lexsort(ctx[::-1])
            order = order[ctx[0][order] != 0]
            if not len(order):
                continue
            c = ctx[:, order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (c[:, 1:] != c[:, :-1]).any(axis=0)
            group = np.cumsum(fresh) - 1
            many = np.bincount(group)[group] > 1
            full = covered[order]
            packed = c[3] << _U(32)
            for j in range(DEPTH):
                packed = packed | (lens[j][order].astype(_U) << _U(8 * j))
            pair = (c[1] << _U(32)) | c[2]
            ids = b.column(0).to_numpy(zero_copy_only=False)[doc[order]]
            pos = start[order] - t.bounds[doc[order]]
            shard = int(bk.mix(np.asarray([ids[0] ^ (pos[0] << 40)], np.int64).view(_U))[0] >> _U(33))
            # suffixes met once or first in the shard take part; those met again know their answer already
            first = np.flatnonzero(fresh)
            rank = np.arange(len(order), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(many[first], 2, 0).astype(np.int8)), pa.array(c[0][first].view(np.int64)), pa.array(pair[first].view(np.int64)), pa.array(packed[first].view(np.int64)), pa.array(np.full(len(first), shard, np.int32)), pa.array(rank[first]), pa.array(ids[first]), pa.array(pos[first].astype(np.int32))], names)
            told = np.flatnonzero(many & ~fresh)
            if len(told):
                key = bk.mix(ids[told].astype(np.int64).view(_U)).view(np.int64)
                zero = np.zeros(len(told), np.int64)
                reach = _reach(full[told], np.where(c[-1][told] != 0, DEPTH, 0), zone)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(told), np.int8)), pa.array(key), pa.array(reach), pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(zero.astype(np.int32)), pa.array(ids[told]), pa.array(pos[told].astype(np.int32))], names)

    return run


def _zone(length: int, gap: int) -> int:
    """Bytes between the outermost phrase bounds of a string that depend on the string alone, at most."""
    return length - 2 * gap - GRAM + 2


def _reach(covered: np.ndarray, depth: np.ndarray, zone: int) -> np.ndarray:
    """Bytes shared; a suffix that agrees as far as its context goes may agree further."""
    return np.where((depth >= DEPTH) | (covered >= zone), _FULL, covered).astype(np.int64)


def refine(symbols: np.ndarray) -> np.ndarray:
    """symbols: DEPTH x n, suffixes in shard order. Returns for each how many symbols it shares with some other one.

    The interleave starts as one block. Each round merges the shard orders inside the blocks by one more symbol
    (a stable partition) and cuts blocks where the symbols change; single suffixes leave.
    """
    n = symbols.shape[1]
    shared = np.zeros(n, np.int64)
    at, block = np.arange(n), np.zeros(n, np.int64)
    for j in range(symbols.shape[0]):
        if len(at) < 2:
            break
        x = symbols[j][at]
        order = np.lexsort((x, block))
        at, block, x = at[order], block[order], x[order]
        cut = np.ones(len(at), bool)
        cut[1:] = (block[1:] != block[:-1]) | (x[1:] != x[:-1]) | (x[1:] == 0)
        block = np.cumsum(cut) - 1
        live = (np.bincount(block)[block] > 1) & (x != 0)
        at, block = at[live], block[live]
        shared[at] = j + 1
    return shared


def _merge(zone: int):
    """Rows sorted by first phrase, shard and rank in; row_id, pos, reach of suffixes that share phrases out."""

    def answer(part: pa.Table) -> pa.RecordBatch | None:
        kind, c0, c12, c3s = (part[n].to_numpy() for n in ("kind", "c0", "c12", "c3s"))
        pair, last, half = c12.view(_U), c3s.view(_U), _U(0xFFFFFFFF)
        symbols = np.vstack((c0.view(_U), pair >> _U(32), pair & half, last >> _U(32)))
        shared, real = np.zeros(len(kind), np.int64), np.flatnonzero(kind != 1)
        shared[real] = refine(symbols[:, real])
        shared = np.where(kind == 2, (symbols != 0).sum(axis=0), shared)
        covered = np.zeros(len(kind), np.int64)
        for j in range(DEPTH):
            covered += np.where(shared > j, ((last >> _U(8 * j)) & _U(255)).astype(np.int64), 0)
        reach = np.where(kind == 1, c12, _reach(covered, shared, zone))
        keep = np.flatnonzero(reach > 0)
        if not len(keep):
            return None
        return pa.RecordBatch.from_arrays([pa.array(part["row_id"].to_numpy()[keep]), pa.array(part["pos"].to_numpy()[keep]), pa.array(reach[keep])], ["row_id", "pos", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(1).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last first phrase may go on in the next batch
            if cut or (held and held[-1].column(1)[-1].as_py() != key[0]):
                held.append(b.slice(0, cut))
                if out := answer(pa.Table.from_batches(held)):
                    yield out
                held = []
            held.append(b.slice(cut))
        if held and (out := answer(pa.Table.from_batches(held))):
            yield out

    return run


def _candidates(t: bk.Texts, marks: pa.Array, grams: np.ndarray, length: int, gap: int) -> np.ndarray:
    """Flags of string starts whose whole phrases are a repeated interval."""
    n = len(t.data) - length + 1
    start = phrase_starts(t, grams, gap)
    reach = np.zeros(len(start), np.int64)
    rows = np.repeat(np.arange(t.n), [0 if x is None else x for x in marks.value_lengths().to_pylist()])
    flat = marks.flatten()
    at = np.searchsorted(start, t.bounds[rows] + flat.field("pos").to_numpy())
    reach[at] = flat.field("reach").to_numpy()
    count = np.zeros(len(t.data) + 2, np.int32)
    count[start + 1] = 1
    np.cumsum(count, out=count)
    first = count[gap - 1 : gap - 1 + n]  # phrases that start before the zone of the string
    stop = length - gap - GRAM + 2
    last = count[stop : stop + n] - 1
    ok = bk.inside(t.bounds, length, n)
    if not len(start):
        return ok
    lone = last <= first
    first, last = np.minimum(first, len(start) - 1), np.maximum(last, 0)
    return ok & (lone | (start[first] + reach[first] >= start[last]))


def _runs(length: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            n = len(t.data) - length + 1
            if n <= 0:
                continue
            grams = _grams(t)
            live = _candidates(t, b.column(2), grams, length, gap)
            if not live.any():
                continue
            width = length - GRAM + 1
            low, chosen = bk.minimisers(grams, bk.inside(t.bounds, length, n), width)
            anchors = np.flatnonzero(chosen)
            w = np.flatnonzero(live)
            k = np.searchsorted(anchors, w + width, "left") - 1
            open_ = np.flatnonzero(grams[anchors[k]] != low[w])
            while len(open_):
                k[open_] -= 1
                open_ = open_[grams[anchors[k[open_]]] != low[w[open_]]]
            # one row for each anchor, also where candidates pause: a document never meets itself at one place
            cut = np.ones(len(w), bool)
            cut[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(cut)
            at, end = w[first], w[np.append(first[1:], len(w)) - 1] + 1
            row = bk.doc_of(t.bounds, at)
            span = bk.spans_hash(t.byte_prefix(), at, end + length - 1) ^ bk.mix((anchors[k[first]] - at).astype(_U))
            ids = b.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(low[at].view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids), pa.array((at - t.bounds[row]).astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array((anchors[k[first]] - at).astype(np.int32))], ["h", "span", "row_id", "pos", "len", "gap"])

    return run


def _cells(length: int):
    """Asked rows cut into cells of CELL neighbouring strings, aligned by their distance to the anchor.

    a, b: hash of the bytes that all strings of the cell share; none of them repeats where these don't. span: hash of
    all bytes they cover; where it repeats all of them do (cells that the document cuts off have a span of their own).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            marks = b.column(2)
            rows = np.repeat(np.arange(t.n), marks.value_lengths().to_numpy())
            flat = marks.flatten()
            pos, size, gap = (flat.field(f).to_numpy().astype(np.int64) for f in ("pos", "len", "gap"))
            # strings by falling distance to the anchor; cell c holds distances c * CELL ... c * CELL + CELL - 1
            high, low = gap // CELL, (gap - size + 1) // CELL
            many = high - low + 1
            of = np.repeat(np.arange(len(rows)), many)
            cell = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
            base, anchor = t.bounds[rows[of]], t.bounds[rows[of]] + pos[of] + gap[of]
            first = anchor - (cell * CELL + CELL - 1)  # the cell's own first string, maybe outside
            start, stop = np.maximum(first, base + pos[of]), np.minimum(first + CELL, base + pos[of] + size[of])
            last_start = t.bounds[rows[of] + 1] - length
            whole = (first >= base) & (first + CELL - 1 <= last_start)
            a, c = (bk.spans_hash(t.byte_prefix(i), first + CELL - 1, first + length, i) ^ bk.mix(cell.astype(_U)) for i in (0, 1))
            edge = np.clip(first, base, None), np.minimum(first + CELL - 1 + length, t.bounds[rows[of] + 1])
            span = bk.spans_hash(t.byte_prefix(), *edge)
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows[of]]
            span = np.where(whole, span, bk.mix(ids.astype(np.int64).view(_U) * _U(31) + start.astype(_U) - base.astype(_U)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array((c >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(span.view(np.int64)), pa.array(ids), pa.array((start - base).astype(np.int32)), pa.array((stop - start).astype(np.int32))], ["a", "b", "span", "row_id", "pos", "len"])

    return run


def _strings(length: int):
    """96 bits of hash of each single string of the asked rows; c: how many places its whole row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            t = bk.Texts(b.column(1))
            marks = b.column(2)
            rows = np.repeat(np.arange(t.n), marks.value_lengths().to_numpy())
            flat = marks.flatten()
            size = flat.field("len").to_numpy().astype(np.int64)
            start = np.repeat(t.bounds[rows] + flat.field("pos").to_numpy(), size)
            at = start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
            row, copies = np.repeat(rows, size), np.repeat(flat.field("c").to_numpy(), size)
            a, c = (bk.spans_hash(t.byte_prefix(i), at, at + length, i) for i in (0, 1))
            ids = b.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array((c >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(ids), pa.array((at - t.bounds[row]).astype(np.int32)), pa.array(copies)], ["a", "b", "row_id", "pos", "c"])

    return run


def repeated_strings(rows: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """rows: row_id (unique), text. Returns row_id, marks: list of (pos, len): strings starting at len bytes from pos on repeat."""
    spark, gap = rows.sparkSession, max(1, (length - GRAM + 2) // 4)
    if gap > 255:
        raise ValueError("length: at most 1,037 bytes")  # a phrase's length, gap at most, stands in 8 bits
    fields = "kind byte, c0 long, c12 long, c3s long, shard int, rank int, row_id long, pos int"
    long_enough = rows.where(F.octet_length("text") >= length)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = long_enough.mapInArrow(_suffixes(length, gap), fields).repartition(parts, "c0").sortWithinPartitions("c0", "shard", "rank")
    reach = order.mapInArrow(_merge(_zone(length, gap)), "row_id long, pos int, reach long").groupBy("row_id").agg(F.collect_list(F.struct("pos", "reach")).alias("marks"))
    reach = materialise(reach, folder, "intervals")
    del order
    release(spark)
    runs = materialise(long_enough.join(reach, "row_id").select("row_id", "text", "marks").mapInArrow(_runs(length, gap), "h long, span long, row_id long, pos int, len int, gap int"), folder, "runs")
    del reach
    discard(spark, folder, "intervals")
    release(spark)
    spans = runs.groupBy("h", "span").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "pos", "len", "gap")).alias("one"))
    mixed = spans.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    asked = materialise(spans.join(mixed, "h", "left_semi").select("one.row_id", "one.pos", "one.len", "one.gap", "n"), folder, "asked")
    whole = materialise(runs.join(spans.where("n > 1").select("h", "span"), ["h", "span"], "left_semi").select("row_id", "pos", "len"), folder, "whole")
    del runs, spans, mixed
    discard(spark, folder, "runs")
    release(spark)
    def over(rows_of: DataFrame, fields: list[str], how, schema: str) -> DataFrame:
        lists = rows_of.groupBy("row_id").agg(F.collect_list(F.struct(*fields)).alias("marks"))
        return long_enough.join(lists, "row_id").select("row_id", "text", "marks").mapInArrow(how, schema)

    cells = materialise(over(asked, ["pos", "len", "gap"], _cells(length), "a long, b int, span long, row_id long, pos int, len int"), folder, "cells")
    release(spark)
    cores = cells.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
    live = materialise(cells.join(cores, ["a", "b"], "left_semi"), folder, "live")
    kinds = live.groupBy("a", "b", "span").agg(F.count("*").alias("c"), F.min(F.struct("row_id", "pos", "len")).alias("one"))
    full = materialise(live.join(kinds.where("c > 1").select("a", "b", "span"), ["a", "b", "span"], "left_semi").select("row_id", "pos", "len"), folder, "full")
    mixed = kinds.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").select("a", "b")
    parts_of = materialise(kinds.join(mixed, ["a", "b"], "left_semi").select("one.row_id", "one.pos", "one.len", "c"), folder, "parts")
    del cores, live, kinds, mixed, cells
    discard(spark, folder, "asked", "cells", "live")
    release(spark)
    single = materialise(over(parts_of, ["pos", "len", "c"], _strings(length), "a long, b int, row_id long, pos int, c long"), folder, "single")
    release(spark)
    many = single.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    alone = single.where("c = 1").join(many, ["a", "b"], "left_semi").select("row_id", "pos", F.lit(1).alias("len"))
    out = materialise(whole.unionByName(full).unionByName(alone).groupBy("row_id").agg(F.collect_list(F.struct("pos", "len")).alias("marks")), folder, "marks")
    del asked, whole, full, parts_of, single, many, alone
    discard(spark, folder, "whole", "full", "parts", "single")
    release(spark)
    return out


def _kept(length: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text"):
            out: list[tuple] = []
            for doc, text, marks in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist(), strict=True):
                data = text.as_py() or b""
                left, gone, spans, end = [], 0, 0, 0
                for pos, size in sorted((m["pos"], m["len"]) for m in marks or ()):
                    if pos > end or not spans:
                        left.append(data[end:pos])
                        spans += 1
                        start = pos
                    else:
                        start = end
                    stop = max(end, pos + size + length - 1)
                    gone += stop - start
                    end = stop
                left.append(data[end:])
                kept = b"".join(left)
                out.append((doc, len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + texts])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (if texts: bytes outside strings that start elsewhere too)."""
    folder = workspace(docs.sparkSession)
    # a row's own number: doc_id where it is unique, so that rows repeating one stay apart
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = materialise(base.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), folder, "repeated-ids")
    if twice.isEmpty():
        rows = base.withColumn("row_id", F.col("doc_id"))
    else:
        rows = materialise(base.withColumn("row_id", F.monotonically_increasing_id()), folder, "numbered")
    marks = repeated_strings(rows.select("row_id", "text"), folder, length)
    joined = rows.join(marks, "row_id", "left").select("row_id", "doc_id", "text", "marks")
    return joined.mapInArrow(_kept(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return suffix_dedup(documents(spark, sf_dir), texts=False)
