"""Operator 6, document fingerprints (native): bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles (a shorter text with words is one
shingle; a text without words has an empty sketch). Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and, by the k-th smallest hash, the number of distinct shingles.

Cases: a null text is the empty text; two empty sketches are alike (1.0), an empty and a filled one aren't (0.0);
the next document of the last is the first, of a single document itself; rows with equal doc_id are neighbours in the
order of the hash of their texts; null doc_ids come first; an empty table gives an empty result; extra columns are
ignored. Words and hashes of one document at a time are in memory, never those of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, words

K, SHINGLE = 128, 5
_TOP = float(1 << 64)


def sketch_of_words(ws: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sorted array of the k smallest distinct shingle hashes of an array of words."""
    last = F.size(ws) - shingle + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*[F.get(ws, i + (j - 1)) for j in range(shingle)]))
    return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(each)), 1, k))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return _once(words(text), lambda ws: sketch_of_words(ws, k, shingle))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """Aggregate: sketch of all rows' parts. Folds an array of sketches; combine in stages where groups are large."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both have."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_once(merge(a, b, k), lambda u: _share(u, a, b)))


def _share(union: Column, a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double") / F.greatest(F.size(union), F.lit(1)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, k).cast("double") + F.lit(_TOP / 2)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) * F.lit(_TOP) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def encode(a: Column) -> Column:
    """The sketch as text: base64 of its hashes, 8 bytes each."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), r"\s", "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """docs (doc_id, text) with sketch and fingerprint."""
    return docs.withColumn("sketch", sketch(F.col("text"), k)).withColumn("fingerprint", encode(F.col("sketch")))


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs with part and mark, so that next_of() finds the next document by doc_id, the first following the last.

    Documents are cut into ranges of doc_id with about equal numbers; the first document of each range also goes
    to the range before as its end mark, so one shuffle brings every neighbour together and no range is large.
    """
    spark = docs.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.where("doc_id is not null").select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.col("doc_id"))))
    placed = docs.withColumn("part", place).withColumn("mark", F.lit(False))
    # the first doc_id of each range: at most `parts` rows, a bound that doesn't grow with the documents
    firsts = [(r["part"], r["doc_id"]) for r in placed.groupBy("part").agg(F.min("doc_id").alias("doc_id")).orderBy("part").collect()]
    if not firsts:
        return placed
    ends = spark.createDataFrame([(p, d, firsts[i - 1][0]) for i, (p, d) in enumerate(firsts)], "p int, first_id long, before int")
    marks = placed.join(F.broadcast(ends), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    marks = marks.withColumn("part", F.col("before")).withColumn("mark", F.lit(True)).select(placed.columns)
    return placed.unionByName(marks).repartition("part")


def next_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of in_order() with next_<column> of the next document."""
    order = Window.partitionBy("part").orderBy("mark", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not mark")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of texts and of their edited texts: the last half of the code points gives way to the start of the next text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = in_order(base).withColumn("sketch", sketch(F.col("text"), k))
    rows = next_of(rows, ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
