"""Operator 3, line dedup (native): exact set-similarity join of lines.

A line is a set of words. Words are ordered by rarity (counts of all words of the corpus in 262,144 hash bins, a bound
that doesn't grow, in steps of half a power of two; ties by hash), and lines that reach the similarity share a word
among their rarest ones: of n words the first n - ceil(t n) + 1, in the smaller of two lines the first
n - ceil(2 t n / (1 + t)) + 1. Lines meet on these words, the smaller by the fewer; pairs that sizes, the
word's positions or a parity sketch of 64 bits (128 in long lines) rule out are dropped, the others verified by the exact Jaccard
similarity of their words. A line goes if an earlier one (smaller doc_id, or the same and a smaller line number) is
similar, whether that one stays or goes.

Lines of one word set are one candidate, so copies of a line never meet in pairs. Words that more than HOT lines have
among their rarest are hot: there all lines are compared with the earliest first, and only those that stay are compared
with the others, behind a sketch of 512 bits and once a pair. Joins on words are sort-merge joins on shuffles that Spark
may split where they are skewed. The text of the lines to verify is fetched once.

Cases: null text has no lines and stays null; lines without words are never removed; of a line's repeats in one
document the first stays; equal rows (doc_id and text) count as one document, other rows with one doc_id follow one
another in the order of their texts' hashes; rows with null doc_id keep all lines; in lines of 65,535 different words or
more sizes and positions rule nothing out; an empty table gives an empty result; extra columns are kept by cut_lines()
and ignored by the query.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, discard, documents, materialise, release, workspace

THRESHOLD, BINS, LANES, HOT = 0.8, 1 << 18, 4, 512
#: Different words from which sizes are all the same, a pair's words from which 512 bits are compared, and a line's from which 128 are.
MOST, LONG, WIDE = 65_535, 400, 90


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _gap(text: Column) -> Column:
    """Pattern that splits the lines of text into words: a single space, which Java splits at without a pattern, unless the text has other blanks."""
    return F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\v")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r")), F.lit(GAP)).otherwise(F.lit(" "))


def _lines(docs: DataFrame) -> DataFrame:
    """l, line and gap of each line, after the other columns of docs."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.withColumn("gap", _gap(F.col("text"))).select(*rest, "gap", F.posexplode(F.split("text", "\n")).alias("l", "line"))


def rarity(docs: DataFrame, bins: int = BINS) -> Column:
    """Constant array: for each bin twice the logarithm (base 2) of the number of the corpus's words in it."""
    slots = bins // LANES  # a row counts LANES bins, so that a task's rows are few
    words = _lines(docs.select("text")).select(F.explode(F.split("line", F.col("gap"))).alias("w")).where("w <> ''").select(F.xxhash64("w").bitwiseAND(F.lit(bins - 1)).alias("bin"))
    rows = words.groupBy(F.col("bin").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(*[F.count_if(F.col("bin") >= i * slots).alias(f"from{i}") for i in range(LANES)])
    lane = lambda i: F.col(f"from{i}") - (F.col(f"from{i + 1}") if i + 1 < LANES else F.lit(0))
    counts = rows.select(F.inline(F.array(*[F.struct((F.col("slot") + i * slots).alias("bin"), lane(i).alias("c")) for i in range(LANES)]))).where("c > 0").select("bin", F.floor(F.log2("c") * 2).alias("level"))
    parts = counts.groupBy(F.expr("bin div 64").cast("int").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("bin") % 64).cast("int"), "level"))).alias("have"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("have", i), F.lit(0)).cast("string")), ",")
    rows = {r["part"]: r["text"] for r in parts.select("part", text.alias("text")).collect()}  # at most bins / 64 rows
    none = ",".join(["0"] * 64)
    return F.split(F.lit(",".join(rows.get(i, none) for i in range(bins // 64))), ",").cast("array<bigint>")


def word_set(line: Column) -> Column:
    """The different words of a line."""
    return F.array_except(F.split(line, _gap(line)), F.array(F.lit("")))


def word_keys(line: Column, gap: Column, ranks: Column, bins: int = BINS) -> Column:
    """Sorted keys of a line's different words (between the pattern gap), the rarest first: 7 bits of rank, the lower 56 of the word's hash."""
    hashes = F.array_except(F.transform(F.split(line, gap), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(bins - 1))), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(rank(h), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))))


def _bits(size: int = 64) -> Column:
    """Constant array: 1 << i at place i, 0 from place 64 to size."""
    return F.array(*[F.lit((i < 64) * (1 << i if i < 63 else -1 << 63)).cast("long") for i in range(size)])


def _parity(keys: Column, size: int = 64) -> Column:
    """64 bits, each the parity of the number of keys that fall on it, the first 64 of size: two sets differ in as many words as bits at least."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(_bits(size)[k.bitwiseAND(F.lit(size - 1))]))


def _wide(words: Column) -> Column:
    """512 such bits, as 8 numbers."""
    part = lambda hashes, i: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(7)) == i)
    return _once(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: _parity(part(hashes, i))))


def numbered(docs: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """docs with __row: doc_id, or where doc_ids repeat (then True) a number in the order of doc_id and the text's hash; null if doc_id is."""
    ids = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    twice = ids.where("d is not null").groupBy("d").agg(F.count("*").alias("c")).where("c > 1")
    if twice.isEmpty():
        return docs.withColumn("__row", F.col("doc_id").cast("long")), False
    order = ids.where("d is not null").select(F.col("d").alias("__d"), F.xxhash64("text").alias("__h")).distinct().orderBy("__d", "__h")
    order = materialise(order.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
    return docs.join(order, (F.col("doc_id").cast("long") == F.col("__d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h")), "left").drop("__d", "__h"), True


def _before(y: str, x: str) -> Column:
    return (F.col(f"{y}.d") < F.col(f"{x}.d")) | ((F.col(f"{y}.d") == F.col(f"{x}.d")) & (_line(F.col(f"{y}.q")) < _line(F.col(f"{x}.q"))))


def _smaller(x: str, y: str, threshold: float) -> Column:
    """Whether x is the smaller of two lines of like size, or the later one of two of equal size."""
    return (_size(x) >= _size(y) * threshold - 1e-9) & (_size(x) <= _size(y)) & ((_size(x) < _size(y)) | _before(y, x))


def _line(q: Column) -> Column:
    return F.shiftrightunsigned(q, 32)


def _size(t: str) -> Column:
    return F.shiftrightunsigned(F.col(f"{t}.q"), 16).bitwiseAND(F.lit(MOST))


def _far(x: str, y: str) -> Column:
    """In how many bits the sketches differ: 64, in long lines 128, since s is the sum of t and the other half."""
    s, t = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in "st")
    return F.when((_size(x) >= WIDE) & (_size(y) >= WIDE), F.bit_count(s.bitwiseXOR(t)) + F.bit_count(t)).otherwise(F.bit_count(s))


def _need(both: Column, threshold: float) -> Column:
    """Words that similar lines of `both` words together share at least."""
    return F.ceil(both * (threshold / (1 + threshold)) - 1e-9)


def _may(x: str, y: str, threshold: float) -> Column:
    """What sizes, positions and the sketch leave of pairs of postings."""
    left = lambda t: _size(t) - F.col(f"{t}.q").bitwiseAND(F.lit(MOST))
    both = _size(x) + _size(y)
    need = _need(both, threshold)
    fits = (F.least(_size(x), _size(y)) >= F.greatest(_size(x), _size(y)) * threshold - 1e-9) & (F.least(left(x), left(y)) >= need)
    fits = fits & (_far(x, y) <= both - 2 * need)
    return fits | (F.greatest(_size(x), _size(y)) >= MOST)


def early(posts: DataFrame, threshold: float) -> DataFrame:
    """Postings (q) that a line has to meet larger lines on: of two similar lines the smaller one, of n words, has the first word that both share among its first n - ceil(2 t n / (1 + t)) + 1."""
    n = F.shiftrightunsigned("q", 16).bitwiseAND(F.lit(MOST))
    return posts.where((F.col("q").bitwiseAND(F.lit(MOST)) <= n - _need(2 * n, threshold)) | (n >= MOST))


def _apart(a: Column, b: Column, both: Column, threshold: float) -> Column:
    """Whether the 512 bits of two lines (null: unknown) rule a pair out."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(8)), F.lit(0))
    return F.coalesce(differ > both - 2 * _need(both, threshold), F.lit(False)) & (both < MOST)


def _narrowed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs without those of long lines that 512 bits rule out."""
    side = lambda t: texts.where("b is not null").select(F.col("d").alias(f"{t}d"), F.col("l").alias(f"{t}l"), F.col("b").alias(f"{t}b")).hint("merge")
    long = pairs.where(F.col("n") > LONG).join(side("x"), ["xd", "xl"], "left").join(side("y"), ["yd", "yl"], "left")
    return pairs.where(F.col("n") <= LONG).unionByName(long.where(~_apart(F.col("xb"), F.col("yb"), F.col("n"), threshold)).select(pairs.columns))


def _pairs(joined: DataFrame) -> DataFrame:
    """(n, far, xd, xl, yd, yl) of joined postings x and y, the later line first; n: words of both; far: bits in which the sketches differ."""
    later = lambda a, b: F.when(_before("y", "x"), a).otherwise(b)
    xl, yl = (_line(F.col(f"{t}.q")).cast("int") for t in "xy")
    ends = later(F.col("x.d"), F.col("y.d")).alias("xd"), later(xl, yl).alias("xl"), later(F.col("y.d"), F.col("x.d")).alias("yd"), later(yl, xl).alias("yl")
    return joined.select((_size("x") + _size("y")).alias("n"), _far("x", "y").alias("far"), *ends).distinct()


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """d, l of the first of each pair whose lines (texts: d, l, line) reach the similarity."""
    side = lambda t: texts.select(F.col("d").alias(f"{t}d"), F.col("l").alias(f"{t}l"), F.col("line").alias(f"{t}line")).hint("merge")
    both = pairs.join(side("x"), ["xd", "xl"]).join(side("y"), ["yd", "yl"])
    sim = _once(F.struct(word_set(F.col("xline")).alias("x"), word_set(F.col("yline")).alias("y")), lambda p: _jaccard(p["x"], p["y"]))
    return both.where(sim >= threshold - 1e-12).select(F.col("xd").alias("d"), F.col("xl").alias("l")).distinct()


def _first_alike(pairs: DataFrame, texts: DataFrame, threshold: float, folder: str, name: str) -> DataFrame:
    """The same, but each line is compared with the one of the nearest sketch first and with the others only if that one isn't similar."""
    near = pairs.groupBy("xd", "xl").agg(F.min(F.struct("far", "yd", "yl")).alias("m")).select("xd", "xl", "m.yd", "m.yl")
    near = materialise(near, folder, f"{name}-nearest")
    one = materialise(_alike(near, texts, threshold), folder, f"{name}-near")
    release(pairs.sparkSession)
    open_ = pairs.join(one.select(F.col("d").alias("xd"), F.col("l").alias("xl")).hint("merge"), ["xd", "xl"], "left_anti")
    more = open_.join(near.hint("merge"), ["xd", "xl", "yd", "yl"], "left_anti").select("xd", "xl", "yd", "yl")
    return one.unionByName(_alike(more, texts, threshold))


def _jaccard(a: Column, b: Column) -> Column:
    return _once(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def _texts(base: DataFrame, ids: DataFrame) -> DataFrame:
    """d, l, line and b (512 bits of one that is in a pair of long lines) of the lines in ids (d, l, long)."""
    wanted = ids.groupBy("d", "l").agg(F.max("long").alias("long")).groupBy("d").agg(F.collect_list(F.struct("l", "long")).alias("ls"))
    lines = _once(F.split("text", "\n"), lambda parts: F.transform("ls", lambda i: F.struct(i["l"].alias("l"), F.get(parts, i["l"]).alias("line"), i["long"].alias("long"))))
    return base.join(wanted.hint("merge"), "d").select("d", F.inline(lines)).select("d", "l", "line", F.when(F.col("long"), _wide(word_set(F.col("line")))).alias("b"))


def similar_lines(base: DataFrame, folder: str, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """base: __row (unique, in the order of documents), text. Returns __row, lines: sorted numbers (from 0) of the lines that have a similar earlier one."""
    base = base.where("__row is not null and text is not null").select(F.col("__row").alias("d"), "text")
    least = F.lit(int(threshold / (1 - threshold) - 1e-9) + 1)  # smaller sets are similar to equal ones only
    ranks = rarity(base)
    made = _lines(base).withColumn("s", word_keys(F.col("line"), F.col("gap"), ranks)).withColumn("n", F.size("s"))
    width = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    rare = F.transform(F.slice("s", F.lit(1), width), lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    odd = F.when(F.col("n") >= WIDE, _parity(F.col("s"), 128)).otherwise(F.lit(0).cast("long"))
    made = made.select("d", "l", "n", F.xxhash64("s").alias("k"), _parity(F.col("s")).alias("s"), odd.alias("t"), F.when(F.col("n") >= least, rare).alias("rare"))
    lines = materialise(made, folder, "lines").where("n > 0")
    # the first line of each word set that more than one line has; a set is told by the hash, the sketch and the size
    place = F.col("d").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("l")  # a number, so that it is aggregated by hash
    first = materialise(lines.groupBy("k", "s", "n").agg(F.min(place).alias("f"), F.count("*").alias("copies")).where("copies > 1").select("k", "s", "n", "f"), folder, "first")
    sets = lines.join(first.hint("shuffle_hash"), ["k", "s", "n"], "left").withColumn("again", F.when(F.col("f").isNull(), False).otherwise(place != F.col("f")))
    sets = materialise(sets.select("d", "l", "again", F.least("n", F.lit(MOST)).alias("n"), F.when(~F.col("again"), F.col("s")).alias("s"), F.when(~F.col("again"), F.col("t")).alias("t"), F.when(~F.col("again"), F.col("rare")).alias("rare")), folder, "sets")
    del lines, first
    discard(spark := base.sparkSession, folder, "lines", "first")
    release(spark)
    q = lambda pos: F.shiftleft(F.col("l").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 16)).bitwiseOR(F.least(pos, F.lit(MOST)).cast("long"))
    posts = sets.where("not again and rare is not null").select("d", "l", "n", "s", "t", F.posexplode("rare").alias("pos", "w")).select("w", "d", q(F.col("pos")).alias("q"), "s", "t")
    often = F.get(ranks, F.col("w").bitwiseAND(F.lit(BINS - 1))) >= max(0, int(2 * log2(hot + 1)) - 1)  # only where the word's bin counts so many
    many = materialise(posts.where(often).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("w"), folder, "hot")  # few: joined by broadcast where they are
    cold = early(posts, threshold).join(many, "w", "left_anti")
    meet = cold.alias("x").join(posts.alias("y").hint("merge"), (F.col("x.w") == F.col("y.w")) & _smaller("x", "y", threshold) & _may("x", "y", threshold))
    none = lambda *kinds: [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds]
    cold_pairs = _pairs(meet).select("n", "far", "xd", "xl", "yd", "yl", *none("w int", "q long", "s long", "t long"))
    crowd = posts.join(many, "w").select(*none("n long", "far int"), F.col("d").alias("xd"), *none("xl int", "yd long", "yl int"), "w", "q", "s", "t")
    met = materialise(cold_pairs.unionByName(crowd), folder, "met")
    del posts, many, cold, meet, cold_pairs, crowd
    release(spark)
    pairs, crowd = met.where("w is null").select("n", "far", "xd", "xl", "yd", "yl"), met.where("w is not null").select("w", F.col("xd").alias("d"), "q", "s", "t")
    lead = crowd.groupBy("w").agg(F.min(F.struct("d", "q", "s", "t")).alias("m")).select("w", "m.*")
    star = _pairs(crowd.alias("x").join(lead.alias("y"), (F.col("x.w") == F.col("y.w")) & _before("y", "x") & _may("x", "y", threshold)))
    pairs = materialise(pairs.unionByName(star).distinct(), folder, "pairs")
    release(spark)
    ends = F.array(*[F.struct(F.col(f"{t}d").alias("d"), F.col(f"{t}l").alias("l"), (F.col("n") > LONG).alias("long")) for t in "xy"])
    ids = pairs.select(F.inline(ends)).unionByName(crowd.select("d", _line(F.col("q")).cast("int").alias("l"), F.lit(False).alias("long")))
    texts = materialise(_texts(base, ids), folder, "texts")
    release(spark)
    pairs = materialise(_narrowed(pairs, texts, threshold), folder, "narrowed")
    release(spark)
    gone = materialise(_first_alike(pairs, texts, threshold, folder, "gone"), folder, "gone")
    release(spark)
    found = sets.where("again").select("d", "l").unionByName(gone)
    if not crowd.isEmpty():
        # what the earliest lines leave: compared with the other earlier lines of the same hot word
        place = crowd.select("d", _line(F.col("q")).cast("int").alias("l"), F.struct(F.col("q").bitwiseAND(F.lit(MOST)).alias("pos"), "w").alias("p"))
        about = place.groupBy("d", "l").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"]).alias("ws"))
        wide = F.coalesce("b", _wide(word_set(F.col("line"))))
        about = materialise(about.join(texts.hint("merge"), ["d", "l"]).select("d", "l", "ws", wide.alias("b")), folder, "wide")
        full = crowd.withColumn("l", _line(F.col("q")).cast("int")).join(about.hint("merge"), ["d", "l"])
        left = full.join(gone.hint("merge"), ["d", "l"], "left_anti")
        close = ~_apart(F.col("x.b"), F.col("y.b"), _size("x") + _size("y"), threshold)
        once = F.get(F.array_intersect("x.ws", "y.ws"), F.lit(0)) == F.col("x.w")
        rest = left.alias("x").join(full.alias("y").hint("merge"), (F.col("x.w") == F.col("y.w")) & _before("y", "x") & _may("x", "y", threshold) & close & once)
        rest = materialise(_pairs(rest).join(pairs.hint("merge"), ["xd", "xl", "yd", "yl"], "left_anti"), folder, "rest")
        release(spark)
        found = found.unionByName(_first_alike(rest, texts, threshold, folder, "rest"))
    out = materialise(found.groupBy("d").agg(F.sort_array(F.collect_set("l")).alias("lines")).withColumnRenamed("d", "__row"), folder, "removed")
    discard(spark, folder, "sets", "hot", "met", "pairs", "narrowed", "texts", "wide", "rest")
    release(spark)
    return out


def _with_gone(docs: DataFrame, threshold: float, folder: str | None) -> DataFrame:
    folder = folder or workspace(docs.sparkSession)
    rows, repeats = numbered(docs, folder)
    base = rows.select("__row", F.col("text").cast("string").alias("text"))
    base = base.distinct() if repeats else base
    gone = similar_lines(base, folder, threshold).select(F.col("__row").alias("__gone_row"), F.col("lines").alias("__gone"))
    return rows.join(gone.hint("merge"), F.col("__row") == F.col("__gone_row"), "left").drop("__row", "__gone_row")


def _kept_text() -> Column:
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)


def cut_lines(docs: DataFrame, threshold: float = THRESHOLD, folder: str | None = None) -> DataFrame:
    """docs with removed lines cut out of text; all documents and columns stay, whatever their names."""
    shut = docs.select("doc_id", "text", F.struct("*").alias("kept"))
    return _with_gone(shut, threshold, folder).select(*[_kept_text().alias("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])


def drop_lines(docs: DataFrame, threshold: float = THRESHOLD, folder: str | None = None) -> DataFrame:
    """doc_id, text (without removed lines), n_lines and n_removed of every document."""
    joined = _with_gone(docs.select("doc_id", "text"), threshold, folder)
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return joined.select("doc_id", _kept_text().alias("text"), count.cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS l FROM documents WHERE text IS NOT NULL
), tok AS (
  SELECT doc_id, l, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM ln
), sets AS (
  SELECT s, len(s) AS n, min(doc_id * 100000 + l) AS first, row_number() OVER () AS sid FROM tok WHERE len(s) > 0 GROUP BY s
), freq AS (
  SELECT w, count(*) AS c FROM (SELECT unnest(s) AS w FROM sets) GROUP BY w
), post AS (
  SELECT sid, n, first, w, row_number() OVER (PARTITION BY sid ORDER BY c, w) AS r FROM (SELECT sid, n, first, unnest(s) AS w FROM sets) JOIN freq USING (w)
), pre AS (
  SELECT * FROM post WHERE r <= n - ceil(n * 0.8 - 1e-9) + 1
), cand AS (
  SELECT DISTINCT a.sid AS x, b.sid AS y FROM pre a JOIN pre b ON a.w = b.w AND b.first < a.first
), near AS (
  SELECT DISTINCT x FROM cand JOIN sets p ON p.sid = x JOIN sets q ON q.sid = y
  WHERE len(list_intersect(p.s, q.s)) >= 0.8 * (p.n + q.n - len(list_intersect(p.s, q.s))) - 1e-9
), flag AS (
  SELECT t.doc_id, t.l, t.line, len(t.s) > 0 AND (t.doc_id * 100000 + t.l > sets.first OR near.x IS NOT NULL) AS gone
  FROM tok t LEFT JOIN sets ON sets.s = t.s LEFT JOIN near ON near.x = sets.sid
), agg AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY l) FILTER (WHERE NOT gone) AS kept FROM flag GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""
