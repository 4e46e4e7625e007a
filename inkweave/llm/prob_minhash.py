"""Operator 7, MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding, verification, components.

Every five-word shingle of a document is a Poisson process with the shingle's weight, 1 + ln(count), as rate; each
arrival goes to a random one of m components, which keeps its earliest. Arrivals later than the latest component stop
a process early, so a document costs about m ln m arrivals beside one per shingle. The chance that two documents
agree in a component is the probability Jaccard similarity of their weighted shingles. That may be far below the plain
Jaccard similarity where shingles repeat, so a document with repeated shingles is banded a second time with unit weights:
with these the chance is the plain Jaccard similarity. A document without has both signatures alike and is banded once.

Documents with equal shingle sets are one representative. Representatives that agree in a band of components are
candidates: in each bucket all are compared with its leader, the document that shares most buckets (in a group of
edited copies that is the one nearest to all). What doesn't reach the leader's class is compared with members of other
classes, but for pairs that the distances to the leader rule out (Jaccard distance is a metric, so these can't be
similar), or whose shingles that no other candidate has, or differing bits of a parity sketch of 512, are too many. A link is an exact Jaccard similarity of the shingle sets of `threshold` or more.
n_verified_links counts those that were compared: other members of a class may be similar, too.

Cases: a null text is the empty text; documents without words are one class; a text of one to four words is one
shingle; rows with equal doc_id count once, with the smallest of their texts, and each get a row; a null doc_id is a class of its own, with
class_id null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import components, discard, documents, materialise, release, workspace

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 26, 5, 0.8
PARITY = 512
_U = np.uint64


def shingles(t: bk.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each shingle of a slice of texts."""
    t.find_words()
    words, count = t.word_hashes(), np.diff(t.wb)
    h = bk.windows(words, size)
    ok = bk.inside(t.wb, size, len(h))
    doc = np.repeat(np.arange(t.n), count)[: len(h)]
    short = np.flatnonzero((count > 0) & (count < size))
    tail = bk.spans_hash(bk._prefix(words, 0), t.wb[short], t.wb[short + 1]) if len(words) else np.zeros(0, _U)
    return np.concatenate((h[ok], tail)), np.concatenate((doc[ok], short))


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) sorted by document and hash, with their counts."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m: for each document and component the shingle whose arrival is earliest (0: no shingle at all)."""
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, _U)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        r = bk.mix(h + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((r >> _U(11)).astype(float) + 0.5) / (1 << 53)) / weight
        slot = doc * m + (bk.mix(r ^ _U(0xA5A5A5A5)) % _U(m)).astype(np.int64)
        win = np.flatnonzero(time < best[slot])
        win = win[np.lexsort((h[win], -time[win]))]  # of several, the earliest is written last
        best[slot[win]], who[slot[win]] = time[win], h[win]
        # once components are all taken, processes beyond the latest of their document stop
        go = time < best.reshape(n, m).max(axis=1)[doc]
        h, doc, weight, time = h[go], doc[go], weight[go], time[go]
    return who.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands: a hash of each band of the signatures."""
    sig = sig.reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), _U) + np.arange(bands, dtype=_U) * _U(0xD1342543DE82EF95)
    for j in range(rows):
        out = bk.mix(out ^ sig[:, :, j]) + _U(j)
    return out


def _sketch(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bk.slices(batches, "text", 2 << 20):
            t = bk.Texts(b.column(1))
            h, doc, count = counted(*shingles(t))
            size = np.bincount(doc, minlength=t.n)
            at = np.append(0, np.cumsum(size))
            prefix = bk._prefix(h, 0), bk._prefix(bk.mix(h), 1)
            keys = [bk.spans_hash(p, at[:-1], at[1:], i).view(np.int64) for i, p in enumerate(prefix)]
            out = band_keys(signatures(h, doc, 1.0 + np.log(count), t.n, m), bands, rows)
            twice = np.zeros(t.n, bool)
            twice[doc[count > 1]] = True
            keep = twice[doc]
            plain = band_keys(signatures(h[keep], (np.cumsum(twice) - 1)[doc[keep]], np.ones(keep.sum()), int(twice.sum()), m), bands, rows)
            at = np.append(0, np.cumsum(np.where(twice, 2 * bands, bands)))
            flat = np.empty(at[-1], _U)
            flat[at[:-1, None] + np.arange(bands)] = out
            flat[at[:-1][twice][:, None] + np.arange(bands, 2 * bands)] = plain
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[0]), pa.array(keys[1]), pa.array(size), lists], ["doc_id", "k1", "k2", "n", "bands"])

    return run


def parity_bits(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x PARITY / 64 numbers: bit by bit the parity of a document's hashes that fall on it. Sets differ in as many hashes as bits at least."""
    odd = np.bincount(doc * PARITY + (h & _U(PARITY - 1)).astype(np.int64), minlength=n * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY), axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bk.slices(batches, "text", 2 << 20):
        t = bk.Texts(b.column(1))
        h, doc, _ = counted(*shingles(t))
        at = np.append(0, np.cumsum(np.bincount(doc, minlength=t.n))).astype(np.int32)
        wide = np.arange(0, t.n * PARITY // 64 + 1, PARITY // 64, dtype=np.int32)
        bits = pa.ListArray.from_arrays(pa.array(wide), pa.array(parity_bits(h, doc, t.n).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))), bits], ["id", "s", "p"])


def shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, s (distinct shingle hashes), p (their parity bits) of the documents whose doc_id (unique) is in ids (id)."""
    return docs.join(ids.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, s array<long>, p array<long>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) of doc_ids with sim, the exact Jaccard similarity of their shingle sets (id, s)."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("sim"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, folder: str | None = None) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), set_id (smallest doc_id of equal shingle sets), n_verified_links of set_id."""
    spark, folder = docs.sparkSession, folder or workspace(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = base.where("doc_id is not null")
    times = None
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        times = materialise(known.groupBy("doc_id").agg(F.min("text").alias("text"), F.count("*").alias("times")), folder, "unique")
        known = times.select("doc_id", "text")
    sketch = materialise(known.mapInArrow(_sketch(bands, rows), "doc_id long, k1 long, k2 long, n long, bands array<long>"), folder, "sketches")
    one = sketch.groupBy("k1", "k2").agg(F.min("doc_id").alias("set_id"))
    members = materialise(sketch.select("doc_id", "k1", "k2").join(one, ["k1", "k2"]).select("doc_id", "set_id"), folder, "members")
    firsts = sketch.where("n > 0").join(one.select(F.col("set_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands")
    buckets = materialise(firsts.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct("bands")).alias("band")), folder, "bands")
    shared = materialise(buckets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), folder, "shared")
    filled = buckets.join(shared, "band")
    fame = filled.groupBy("id").agg(F.sum("c").alias("fame"))
    filled = materialise(filled.join(fame, "id").select("band", "id", "fame"), folder, "filled")
    leaders = filled.groupBy("band").agg(F.max(F.struct("fame", (-F.col("id")).alias("neg"))).alias("m")).select("band", (-F.col("m.neg")).alias("lead"))
    led = filled.join(leaders, "band").select("band", "id", "lead")
    pairs = led.where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    sets = materialise(shingle_sets(fame.select("id"), known), folder, "sets")
    release(spark)
    stars = materialise(verify(pairs, sets), folder, "stars")
    del sketch, one, firsts, buckets, shared, fame, leaders, pairs
    release(spark)
    links = stars.where(F.col("sim") >= threshold).select("a", "b")
    classes = components(links, folder, "classes")
    placed = led.join(stars.withColumnRenamed("a", "x").withColumnRenamed("b", "y"), (F.least("id", "lead") == F.col("x")) & (F.greatest("id", "lead") == F.col("y")), "left").select("band", "id", F.coalesce("sim", F.lit(1.0)).alias("sim"))
    placed = placed.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = materialise(placed.join(split, "band", "left_semi"), folder, "rest")
    # leftovers (below the threshold to their leader) against members of other classes, but for pairs that can't be
    # similar: by the metric, or because shingles that no other document of these buckets has are too many
    sets = materialise(sets.join(rest.select("id").distinct().hint("merge"), "id", "left_semi"), folder, "rest-sets")
    own = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    sizes = sets.select("id", F.size("s").alias("n"), "p").join(own, "id", "left").select("id", "n", "p", (F.col("n") - F.coalesce("u", F.lit(0))).alias("shared"))
    rest = materialise(rest.join(sizes, "id"), folder, "rest-sizes")
    left = rest.where(F.col("sim") < threshold).where(F.col("shared") >= F.col("n") * threshold - 1e-9).select("band", F.col("id").alias("x"), F.col("sim").alias("sx"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("shared").alias("hx"), F.col("p").alias("px"))
    right = rest.where("sim < 1").where(F.col("shared") >= F.col("n") * threshold - 1e-9).select("band", F.col("id").alias("y"), F.col("sim").alias("sy"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("shared").alias("hy"), F.col("p").alias("py"))
    near = F.abs(F.col("sx") - F.col("sy")) <= (1 - threshold) + 1e-9
    most = F.least("hx", "hy")
    able = most >= threshold * (F.col("nx") + F.col("ny") - most) - 1e-9
    # a bit in which the parities differ stands for a shingle that only one side has
    differ = sum((F.bit_count(F.get("px", F.lit(i)).bitwiseXOR(F.get("py", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    both = F.col("nx") + F.col("ny")
    able = able & (differ <= both - 2 * F.ceil(both * (threshold / (1 + threshold)) - 1e-9))
    more = left.join(right, (left["band"] == right["band"]) & (F.col("rx") != F.col("ry")) & near & able & ((F.col("sy") >= threshold) | (F.col("x") < F.col("y"))))
    more = more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    extra = materialise(verify(more, sets).where(F.col("sim") >= threshold).select("a", "b"), folder, "extra")
    del placed, split, rest, left, right, more, led, sets, own, sizes
    discard(spark, folder, "sets", "rest-sets")
    release(spark)
    if not extra.isEmpty():
        links = links.unionByName(extra)
        classes = components(links, folder, "classes-2")
    count = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_verified_links"))
    by_set = classes.select(F.col("id").alias("set_id"), F.col("root").alias("class_id")).join(count, "set_id", "left")
    out = members.join(by_set, "set_id", "left").select("doc_id", F.coalesce("class_id", "set_id").alias("class_id"), "set_id", F.coalesce("n_verified_links", F.lit(0)).cast("long").alias("n_verified_links"))
    if times is not None:
        out = out.join(times.select("doc_id", "times"), "doc_id").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "nth")
    lost = base.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("set_id"), F.lit(0).cast("long").alias("n_verified_links"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id; of rows that repeat a doc_id the one with the smallest text
    stays, then the smallest other columns. Columns stay, whatever their names and types."""
    classes = near_duplicates(docs, **how).where("doc_id = class_id").select("doc_id").distinct()
    field = F.col("kept").getField
    plain = lambda f: not re.search(r"map<|variant", f.dataType.simpleString())
    others = [field(f.name) if plain(f) else F.to_json(F.struct(field(f.name))) for f in docs.schema if f.name not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(field("text").cast("string"), F.lit("")), *others)
    shut = docs.select("doc_id", F.struct("*").alias("kept"))
    kept = shut.join(classes, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return kept.select("kept.*").unionByName(docs.where("doc_id is null"))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
