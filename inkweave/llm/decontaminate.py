"""Operator 5, benchmark decontamination (native): windows of canonical templates, hash join, slot consistency.

Texts are cut into tokens; numbers, names (capitalised words after a word, comma, colon or semicolon and one space) and
units after numbers become typed placeholders, the rest is lower-case. A capitalised word anywhere else (it opens a text,
sentence, line, bracket or quotation) may be a name or not: it agrees with any name, with any word that opens likewise and
with its own lower-case word; unless both sides hold the same word it is a slot. A name also agrees with its own
word in lower case and is no slot then, so that copies in capitals, title case or lower case match. So windows are hashed
in three ways, with all such words as names, with all as literals, and with names as literals, too; they join by any. Windows of `window` template tokens (a shorter
item: all of it) are joined with the benchmark's by hash and compared token by token. The values in the placeholders of a window must map
one to one between document and item, so that a re-parameterised question matches and a chance frame doesn't; at
least half of a window's tokens must be literal, unless every value is the item's own. A document leaks an item if
windows that start at a quarter or more of the item's window places match (a place counts half where it matches only with
a name of the item in lower case), or if matching windows follow one another in
both without a gap over `run` tokens or more, however long the item is.

Before windows leave their row they pass a bitmap of 2**22 bits of the benchmark's window hashes (a fixed size: with
a large benchmark it lets more through, and the join decides). The benchmark's windows are broadcast only if counted
at most 200,000 and 64 MB of tokens, and joined by shuffle beyond.

Cases: null texts have no tokens and leak nothing; items without tokens match nothing; of repeated doc_ids each row is
judged together with the others of its doc_id; rows with null doc_id are judged as one document; an empty table or
benchmark gives rows without leaks; extra columns are ignored by the query and kept by drop_leaks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise, workspace

WINDOW, COVER, RUN, BROADCAST_ROWS, BROADCAST_BYTES, LOG_BITS = 8, 0.25, 13, 200_000, 64 << 20, 22
#: Ways to hash a window: words that may be names as names; as literals; names as literals, too.
NAMED, OPENING, PLAIN = WAYS = range(3)
NUMBER, NAME, UNIT, FIRST = "\u0002", "\u0003", "\u0004", "\u0005"
#: Units of measure that may follow a number: fixed values.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "ms", "min", "h", "hour", "hours", "minutes", "seconds", "days", "weeks", "years", "inch", "inches", "feet", "ft", "miles", "mph", "lb", "lbs", "oz", "percent", "dollars", "euros", "usd", "eur", "w", "kw", "v", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb")


#: White space and punctuation of ASCII, Latin-1, general and CJK punctuation, but for the underscore and the marks.
GAPS = "[\u0000\u0001\u0006-/:-@\\[-\\^`{-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]+"


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-case tokens; a first character of NUMBER, NAME, UNIT or FIRST (perhaps a name) marks the value of a placeholder."""
    # each pattern opens with a cheap test, since it is tried at every character
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r" (?=\p{Lu})(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{L}+)", f" {NAME}$1")
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}_" + NAME + r"])(\p{Lu}\p{L}+)", f"{FIRST}$1")
    t = F.regexp_replace(F.lower(t), r"([0-9])[.,](?=[0-9])", "$1_")
    t = F.regexp_replace(t, r"(?=[0-9])(?<![\p{L}\p{N}_" + NAME + r"])([0-9][0-9_]*)(?:[ ]?" + NAME + r"?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}]))?", f"{NUMBER}$1 {UNIT}$2 ")
    return F.filter(F.split(t, GAPS), lambda w: ~w.isin("", UNIT))


def _mark(w: Column, way: int = NAMED) -> Column:
    """Template token: a placeholder's mark or the word; `way` says whether FIRST words and names are words."""
    word = F.substring(w, 2, 1 << 20)
    out = F.when(w >= F.lit("\u0006"), w).when(w.startswith(FIRST), F.lit(NAME) if way == NAMED else word)
    return (out.when(w.startswith(NAME), word) if way == PLAIN else out).otherwise(F.substring(w, 1, 1))


def _token_hashes(toks: Column, way: int) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(_mark(w, way)))


def _hashes(per: Column, size: int) -> Column:
    """Hash of each window of `size` of the token hashes `per`."""
    return F.when(F.size(per) >= size, F.transform(F.sequence(F.lit(1), F.size(per) - size + 1), lambda i: F.xxhash64(F.slice(per, i, size)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, at, hash (a row for each way to hash), item_tokens, places (windows of the item)."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("toks")).where("size(toks) > 0")
    items = items.withColumn("size", F.least(F.size("toks"), F.lit(window))).withColumn("places", F.size("toks") - F.col("size") + 1)
    cuts = F.transform(F.sequence(F.lit(1), F.col("places")), lambda i: F.slice("toks", i, F.col("size")))
    out = items.select("item_id", "size", "places", F.posexplode(cuts).alias("at", "item_tokens"))
    return out.withColumn("hash", F.explode(F.array_distinct(F.array(*[F.xxhash64(_token_hashes(F.col("item_tokens"), way)) for way in WAYS]))))


def consistent(doc: Column, item: Column) -> Column:
    """Whether two windows have one template, with values that map one to one, and literal tokens enough or equal values."""
    pairs = F.arrays_zip(doc.alias("d"), item.alias("i"))
    same = F.forall(pairs, lambda p: (_mark(p["d"]) == _mark(p["i"])) | (_mark(p["d"], PLAIN) == _mark(p["i"], PLAIN)))
    # places where both hold one word, and not both as a name, are no slots
    slots = F.filter(pairs, lambda p: (_mark(p["d"], PLAIN) != _mark(p["i"], PLAIN)) | (_mark(p["i"], PLAIN) < F.lit("\u0006")) | ((_mark(p["d"], OPENING) == NAME) & (_mark(p["i"], OPENING) != p["i"])) | ((_mark(p["i"], OPENING) == NAME) & (_mark(p["d"], OPENING) != p["d"])))
    slots = F.transform(slots, lambda p: F.struct(_value(p["d"]).alias("d"), _value(p["i"]).alias("i")))
    one = F.size(F.array_distinct(slots))
    to = (one == F.size(F.array_distinct(F.transform(slots, lambda p: p["d"])))) & (one == F.size(F.array_distinct(F.transform(slots, lambda p: p["i"]))))
    enough = (F.size(slots) * 2 <= F.size(doc)) | F.forall(slots, lambda p: p["d"] == p["i"])
    return same & to & enough


def kept_names(doc: Column, item: Column) -> Column:
    """Whether no name of the item's window stands in lower case in the document's."""
    return F.forall(F.arrays_zip(doc.alias("d"), item.alias("i")), lambda p: ~p["i"].startswith(NAME) | (p["d"] < F.lit("\u0006")))


def _value(w: Column) -> Column:
    return F.when(w.startswith(FIRST), F.concat(F.lit(NAME), F.substring(w, 2, 1 << 20))).otherwise(w)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, folder: str | None = None, run: int = RUN) -> DataFrame:
    """doc_id, item_id, n_places, coverage: the pairs where coverage reaches `cover` or windows in a row span `run` tokens."""
    spark, folder = docs.sparkSession, folder or workspace(docs.sparkSession)
    items = materialise(item_windows(benchmark, window), folder, "items")
    number, held = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("item_tokens", " "))), F.lit(0))).first()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` values
    if not sizes:
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_places"), F.lit(0.0).alias("coverage"))
    words = 1 << (LOG_BITS - 6)
    set_bits = items.select(F.pmod("hash", F.lit(1 << LOG_BITS)).cast("int").alias("b")).distinct().groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    have = {r["w"]: r["v"] for r in set_bits.collect()}  # at most 2**16 words
    bitmap = F.split(F.lit(",".join(str(have.get(i, 0)) for i in range(words))), ",").cast("array<bigint>")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), tokens(F.col("text").cast("string")).alias("toks"))
    of = lambda h: F.pmod(h, F.lit(1 << LOG_BITS)).cast("int")
    hit = lambda bits, h: F.getbit(F.get(bits, F.shiftright(of(h), 6)), of(h).bitwiseAND(63)) == 1

    def found_by(bits: Column, way: int) -> Column:
        """(hash, i, size) of the windows of each size that pass the bitmap."""
        here = lambda per, n: F.transform(_hashes(per, n), lambda h, i: F.when(hit(bits, h), F.struct(h.alias("hash"), i.alias("i"), F.lit(n).alias("size"))))
        out = _once(_token_hashes(F.col("toks"), way), lambda per: F.array_compact(F.concat(*[here(per, n) for n in sizes])))
        # a text without openers or names has the same hashes as in the way before
        mark = {OPENING: FIRST, PLAIN: NAME}.get(way)
        return out if mark is None else F.when(F.exists("toks", lambda w: w.startswith(mark)), out).otherwise(F.array().cast("array<struct<hash:bigint,i:int,size:int>>"))

    places = _once(bitmap, lambda bits: F.array_distinct(F.concat(*[found_by(bits, way) for way in WAYS])))
    found = base.withColumn("p", F.explode(places)).select("doc_id", "row", "p.*", F.slice("toks", F.col("p.i") + 1, F.col("p.size")).alias("doc_tokens"))
    small = F.broadcast(items) if number <= BROADCAST_ROWS and held <= BROADCAST_BYTES else items
    joined = found.join(small, ["hash", "size"]).where(consistent(F.col("doc_tokens"), F.col("item_tokens")))
    # runs: windows of one row of docs whose places in document and item are the same distance apart follow one another
    joined = joined.withColumn("kept", kept_names(F.col("doc_tokens"), F.col("item_tokens")))
    windows = joined.groupBy("doc_id", "item_id", "at", "row", (F.col("i") - F.col("at")).alias("shift")).agg(F.first("places").alias("places"), F.first("size").alias("size"), F.max("kept").alias("kept"))
    line = Window.partitionBy("doc_id", "item_id", "row", "shift").orderBy("at")
    runs = windows.withColumn("start", F.col("at") - F.row_number().over(line)).groupBy("doc_id", "item_id", "row", "shift", "start")
    runs = runs.agg((F.count("*") + F.first("size") - 1).alias("long"), F.collect_list("at").alias("ats"), F.collect_list(F.when(F.col("kept"), F.col("at"))).alias("kept"), F.first("places").alias("places"))
    several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    per = runs.groupBy("doc_id", "item_id").agg(several("ats").alias("n_places"), several("kept").alias("n_kept"), F.first("places").alias("places"), F.max("long").alias("long"))
    per = per.withColumn("coverage", (F.col("n_places") + F.col("n_kept")) / F.col("places") / 2)
    return per.where((F.col("coverage") >= cover) | (F.col("long") >= run)).select("doc_id", "item_id", "n_places", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_items, item_ids, coverage (the largest), contaminated (1 or 0) of every document."""
    per = leaks(docs, benchmark, **how).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")).select(F.col("doc_id").alias("_id"), "item_ids", "coverage")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.when(F.col("item_ids").isNull(), 0).otherwise(1).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that leak an item; columns stay, whatever their names."""
    bad = leaks(docs, benchmark, **how).select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(F.struct("*").alias("kept")).join(bad, F.col("kept.doc_id").cast("long").eqNullSafe(F.col("bad")), "left_anti").select("kept.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
