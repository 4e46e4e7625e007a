"""Each operator against brute force and DuckDB on small tables with nulls, ties, copies, long and empty texts."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkweave.llm import decontaminate as dc
from inkweave.llm import fingerprints as fp
from inkweave.llm import line_dedup as ld
from inkweave.llm import mixing, queries, toxicity, warc
from inkweave.llm import prob_minhash as pm
from inkweave.llm.common import components, workspace
from inkweave.llm.substring_dedup import numbered, repeated_windows, substring_dedup
from inkweave.llm.suffix_dedup import suffix_dedup
from tests.compare import check

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, marks string, _id int, h string"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(r.choices(vocabulary, k=70))
    long = " ".join(r.choices(vocabulary, k=9000))
    out = []
    for i in range(40):
        t = " ".join(r.choices(vocabulary, k=r.randrange(5, 120)))
        if i % 3 == 0:
            t = f"{t}\n{passage}\n" + " ".join(r.choices(vocabulary, k=20))
        out.append(t)
    out += [out[3], out[3], None, "", "   \t\n", "one", long, long + " end", "ha " * 600, "é" * 900, out[0][:-3] + " zz"]
    return [(i, t, None if i % 7 == 0 else f"s{i % 4}", "x", i, "y") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_duckdb(spark, name):
    check(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_substring_dedup(docs, rows, none):
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = {}
    for i, t, *_ in rows:
        w = split(t)
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substring_dedup(docs).collect()}
    assert got == want
    assert substring_dedup(none).count() == 0


def test_substring_dedup_of_repeated_and_null_doc_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    tail = " ".join(f"t{i}" for i in range(13))
    rows = [(0, long), (1, long), (1, "x y z"), (1, f"a {tail}"), (1, f"b {tail}"), (2, f"c {tail}"), (None, long), (3, None), (2, f"c {tail}")]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_id", F.lit("clash"))).collect())
    assert got == Counter([(0, 200, 0, long), (1, 200, 200, ""), (1, 3, 0, "x y z"), (1, 14, 0, f"a {tail}"), (1, 14, 0, f"b {tail}"), (2, 14, 13, "c"), (2, 14, 13, "c"), (None, 200, 0, long), (3, 0, 0, "")])
    reach = {r["doc_id"]: r["longest_repeat"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), longest=0).collect()}
    assert reach == {0: 104, 1: 104, 2: 13, 3: 0, None: 0}


def test_doubling_goes_on_until_nothing_survives(spark, docs):
    levels = repeated_windows(numbered(docs, workspace(spark))[0], workspace(spark))
    assert [n for n, _ in levels[:3]] == [13, 26, 52] and levels[-1][1].isEmpty() and levels[-1][0] > 9000


def test_suffix_dedup(docs, rows, none):
    size = 400
    count = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[p : p + size] for p in range(len(b) - size + 1))
    got = {r["doc_id"]: r for r in suffix_dedup(docs, size).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(gone), spans, kept), i
    assert suffix_dedup(none).count() == 0


def bytes_left(texts, size):
    data = [(t or "").encode() for t in texts]
    count, out = Counter(b[p : p + size] for b in data for p in range(len(b) - size + 1)), []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out.append((sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("size", [400, 800, 1000])
def test_suffix_dedup_of_overlapping_passages(spark, size):
    r = random.Random(size)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9)))
    texts = []
    for _ in range(120):
        p = " ".join(word() for _ in range(size // 3))[: size * 7 // 5]
        cut = [p[a : a + r.randrange(size * 8 // 10, size * 11 // 10)] for a in (0, size // 8, size // 4)]
        texts += [f"{word()} {c} {word()}" for c in cut] + [f"{word()} {p} {word()}"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size).collect()}
    assert got == dict(enumerate(bytes_left(texts, size)))


def test_suffix_dedup_refuses_what_its_fields_cannot_hold(spark):
    with pytest.raises(ValueError):
        suffix_dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 2000)


def test_suffix_dedup_of_repeated_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=900))
    got = suffix_dedup(spark.createDataFrame([(1, t), (1, t), (None, "x"), (2, "y")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 900), (1, 900), (2, 0)]


def test_lines(spark, none):
    docs = [(1, "a b c d e\nx"), (2, "a b c d e\nq r s t\nx y"), (3, "a b c d f\n\nq r s t u"), (4, None), (5, ""), (None, "a b c d e"), (6, "q r s t\nq r s t")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("l", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in ld.cut_lines(d).collect()}
    assert got == {1: "a b c d e\nx", 2: "q r s t\nx y", 3: "a b c d f\n", 4: None, 5: "", None: "a b c d e", 6: ""}
    assert ld.cut_lines(none).columns == none.columns and ld.cut_lines(none).count() == 0


@pytest.mark.parametrize("hot", [2, 512])
def test_lines_of_edited_copies(spark, hot):
    r = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(40)] = f"e{r.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    jac = lambda a, b: len(a & b) / len(a | b)
    sets = [set(t.split()) for _, t in docs]
    want = {i for i in range(120) if any(jac(sets[i], sets[j]) >= 0.8 for j in range(i))}
    got = {r["__row"] for r in ld.similar_lines(spark.createDataFrame(docs, "__row long, text string"), workspace(spark), hot=hot).collect()}
    assert got == want and len(want) < 120


def test_lines_are_split_at_every_blank(spark):
    blanks, docs, want = [" ", "  ", "\t", "\v", "\f", "\r", " \t "], [], {}
    gap = spark.createDataFrame([(f"{b}a b{b}\nb a",) for b in blanks], "text string").select("text", ld._gap(F.col("text")).alias("gap")).collect()
    assert all((r["gap"] == " ") == (r["text"].strip("\n ab") == "") for r in gap)
    for i, b in enumerate(blanks):
        w = [f"{c}{i}" for c in "abcde"]
        made = [" ".join(w), b.join(w), f"{b}{' '.join(w[::-1])}{b}\nx{i} y{i}", b, f"y{i}{b}x{i}{b}{b}"]
        docs += [(10 * i + k, t) for k, t in enumerate(made)]
        want |= {10 * i + k: t for k, t in enumerate([made[0], "", f"x{i} y{i}", b, ""])}
    got = {r["doc_id"]: r["text"] for r in ld.cut_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_smaller_line_meets_by_fewer_words(spark):
    """Postings of the smaller line are about half, and every similar pair still has its first shared word among them."""
    r, t = random.Random(2), 0.8
    sets = [sorted(r.sample(range(300), r.randrange(5, 60))) for _ in range(40)]
    for s in list(sets):
        for _ in range(6):
            sets.append(sorted((set(s) - set(r.sample(s, len(s) // r.choice((6, 9, 20))))) | set(r.sample(range(300), len(s) // r.choice((9, 20, 50))))))
    posts = [(i, len(s) << 16 | p, w) for i, s in enumerate(sets) for p, w in enumerate(s[: len(s) - -(-len(s) * 4 // 5) + 1])]
    kept = {(x["d"], x["w"]) for x in ld.early(spark.createDataFrame(posts, "d int, q long, w int"), t).collect()}
    assert len(kept) < 0.75 * len(posts)
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and len(sets[a]) <= len(sets[b]) and len(set(sets[a]) & set(sets[b])) * 5 >= 4 * len(set(sets[a]) | set(sets[b]))]
    assert len(pairs) > 200 and all((a, min(set(sets[a]) & set(sets[b]))) in kept for a, b in pairs)


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_lines_of_all_sizes(spark, hot):
    r = random.Random(11)
    docs, lines = [], []
    for i in range(60):
        text = []
        for _ in range(r.randrange(0, 7)):
            w = r.choice(lines).split() if lines and r.random() < 0.6 else [f"v{int(r.paretovariate(0.4)) % 400}" for _ in range(r.choice((1, 2, 4, 5, 9, 30, 90)))]
            for _ in range(r.choice((0, 0, 1, 2, len(w) // 8))):
                w[r.randrange(len(w))] = f"e{r.randrange(3000)}"
            lines.append(" ".join(w))
            text.append(lines[-1])
        docs.append((i, "\n".join(text)))
    seen, want = [], {}
    for i, text in docs:
        gone = []
        for n, line in enumerate(text.split("\n")):
            s = set(line.split())
            if s and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                gone.append(n)
            seen.append(s)
        if gone:
            want[i] = gone
    got = {r["__row"]: r["lines"] for r in ld.similar_lines(spark.createDataFrame(docs, "__row long, text string"), workspace(spark), hot=hot).collect()}
    assert got == want


def test_line_keys_name_the_bins_of_their_words(spark):
    """So postings of words that the corpus's bins rule out as hot need no counting; sketches: bit by bit the parity of the keys."""
    words = [f"v{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 50 :])) for i in range(80)], "d long, text string")
    ranks = ld.rarity(docs)
    line = ld._lines(docs).where("d = 0").withColumn("s", ld.word_keys(F.col("line"), F.col("gap"), ranks))
    got = line.select("s", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("h"), ld._parity(F.col("s")).alias("p"), ld._parity(F.col("s"), 128).alias("half")).first()
    low = (1 << 56) - 1
    assert len(got["h"]) == 200 and {k & low for k in got["s"]} == {h & low for h in got["h"]} and got["s"] == sorted(got["s"])
    at = spark.range(1).select(F.transform(F.lit([k & (ld.BINS - 1) for k in got["s"]]), lambda b: F.get(ranks, b)).alias("r")).first()["r"]
    assert at == [k >> 56 for k in got["s"]] and min(at) > 0
    for mask, mine in ((63, got["p"]), (127, got["half"])):
        bits = 0
        for k in got["s"]:
            bits ^= (1 << (k & mask)) & ((1 << 64) - 1)
        assert bits == mine & ((1 << 64) - 1)


def test_lines_of_extreme_doc_ids(spark):
    ids = [(1 << 63) - 1, 0, -1, -(1 << 63), 1 << 40]
    got = ld.cut_lines(spark.createDataFrame([(i, "a b\na b c d e f\na b") for i in ids], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: "a b\na b c d e f" if i == -(1 << 63) else "" for i in ids}


def test_lines_of_repeated_doc_ids(spark):
    long = " ".join(f"x{i}" for i in range(70_000))
    rows = [(1, "a b c d e\nz"), (1, "a b c d e\nz"), (1, "other one\na b c d e f"), (2, "a b c d e"), (2, None), (3, long), (4, long + " y"), (None, "a b c d e")]
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = [(1, 2, 0), (1, 2, 0), (1, 2, 1)], [(1, 2, 0), (1, 2, 1), (1, 2, 1)]  # whichever text comes first by its hash
    assert [x for x in got if x[0] == 1] in one
    assert [x for x in got if x[0] != 1] == [(0, 1, 0), (2, 0, 0), (2, 1, 1), (3, 1, 0), (4, 1, 1)]


def test_near_duplicates(spark, none):
    r = random.Random(9)
    rows = []
    for g in range(8):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice((8, 40, 300)))]
        for _ in range(r.choice((1, 2, 12))):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, " "), (len(rows) + 3, "one two"), (len(rows) + 4, "one  two")]
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    d = spark.createDataFrame([*rows, (None, "odd")], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(d).collect()}
    assert got.pop(None, 1) is None
    assert got == {i: find(i) for i, _ in rows}
    kept = pm.keep_one(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {None} | {find(i) for i, _ in rows}
    assert pm.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 105), (200, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), workspace(spark), "c").collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    h = pm.bk.mix(np.arange(1, 301, dtype=np.uint64))
    wa, wb = np.ones(200), np.ones(200)
    wa[150:], wb[:50] = 3.0, 2.0  # documents hold shingles 0..199 and 100..299
    sig = pm.signatures(np.concatenate((h[:200], h[100:])), np.repeat([0, 1], 200), np.concatenate((wa, wb)), 2, 4096)
    a = dict(zip(range(200), wa)) | {}
    b = dict(zip(range(100, 300), wb))
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in range(300)) for i in range(100, 200))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_decontamination(spark, none):
    item = "Tom bought 12 apples for 3 dollars each and then sold half of them to Anna"
    docs = [(1, f"Intro text here. {item} more words"), (2, item.replace("12", "40").replace("Tom", "Sue").replace("Anna", "Bob")), (3, "Nothing of that kind stands in this one at all"), (4, None), (5, ""), (None, item), (6, item), (6, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (10, "short item")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in dc.decontaminate(d, bench).collect()}
    assert {k for k, v in got.items() if v[0]} == {1, 2, 6, None} and got[1][1] == [7]
    assert {r["doc_id"] for r in dc.drop_leaks(d, bench).collect()} == {3, 4, 5}
    assert dc.decontaminate(none, bench).count() == 0 and dc.decontaminate(d, bench.limit(0)).where("contaminated = 1").count() == 0


def test_slot_consistency(spark):
    item = "if red has 5 coins and blue has 5 coins then both have 10 coins"
    docs = [(1, item.replace("5", "8").replace("10", "16")), (2, item.replace("has 5", "has 8", 1))]
    got = {r["doc_id"]: r["coverage"] for r in dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1] == 1.0 and got[2] < 1.0


def test_leaks_of_fixture_are_the_contained_items(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r["doc_id"] for r in dc.decontaminate(d, b).where("contaminated = 1").collect()}
    items = [r["text"] for r in b.collect()]
    assert got == {r["doc_id"] for r in d.collect() if any(t in r["text"] for t in items)}


def test_fingerprints(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    shingles = lambda t: {tuple(split(t)[i : i + 5]) for i in range(max(1, len(split(t)) - 4))} if split(t) else set()
    for n, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) < 3000:
            a, b = shingles(t), shingles(edited)
            assert abs(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert got[40]["fingerprint"] == got[41]["fingerprint"] == got[3]["fingerprint"] and got[42]["fingerprint"] == ""
    assert fp.edited_fingerprints(none).count() == 0
    one = fp.edited_fingerprints(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    d = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[1000:]))], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = d.select(fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_shingles(F.col("a")).alias("n"), (fp.distinct_shingles(fp.merge(F.col("a"), F.col("b")))).alias("u")).first()
    assert abs(r["j"] - 996 / 2996) < 0.15 and abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 1996) < 600 and abs(r["u"] - 2996) < 900


def test_toxicity_learns_words(spark, none):
    r = random.Random(2)
    rows = []
    for i in range(1500):
        w = r.choices([f"w{k}" for k in range(200)], k=r.randrange(20, 80))
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(("scumbag", "moron.", "Idiot")))
        rows.append((i, " ".join(w), int(bad)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "w1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.95
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and got[None]["held_out"] is False
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(d, labels.limit(0)).where("score <> 0").count() == 0


def test_mixing(spark, docs, rows, none):
    out = mixing.mix_sources(docs).collect()
    per = {}
    for r in out:
        p = per.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        p[2] += r["taken"]
        p[3] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(p[0] == p[3] and abs(p[1] - p[2]) <= 1 and p[1] <= 2 * p[0] for p in per.values())
    assert abs(sum(p[1] for p in per.values()) - 1.5 * sum(p[0] for p in per.values())) < 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_mixing_reshares_what_is_capped(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    rest = 1.5 * 2010 - 20
    assert got == {"a": 20.0, "b": pytest.approx(rest / 3), "c": pytest.approx(2 * rest / 3) if 2 * rest / 3 < 2000 else 2000.0, None: 0.0}


def test_warc_round_trip(spark, none):
    pages = [(1, "http://a.example/x?q=1", "<html>é</html>"), (2, "http://b.example", "<html>é</html>"), (3, None, None), (4, "http://c", ""), (5, "u", "x" * 300000), (6, "http://d/\r\nEvil: 1", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (5, "u", "x" * 300000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = workspace(spark) + "/w"
    warc.write_warc(d, folder, per_file=2)
    caps = warc.assemble(warc.read_warc(spark, folder)).collect()
    assert len(caps) == len(pages)
    for r in caps:
        html = next(h or "" for p, _, h in pages if p == r["capture"]["page_id"]).encode()
        assert r["capture"]["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r["request"]["record_type"] == "request" and r["metadata"]["record_type"] == "metadata"
        if r["capture"]["record_type"] == "response":
            assert bytes(r["capture"]["payload"]) == html and r["capture"]["block_digest_ok"]
        else:
            assert (r["capture"]["page_id"], r["origin"]["page_id"]) in {(2, 1), (4, 3)}
    assert Counter(r["capture"]["record_type"] for r in caps) == {"response": 5, "revisit": 2}
    empty = workspace(spark) + "/e"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.assemble(warc.read_warc(spark, empty)).count() == 0


def test_warc_archives_are_parsed_once(spark, monkeypatch):
    parsed, real = spark.sparkContext.accumulator(0), warc._parse

    def counted(payloads):
        def run(batches):
            for b in real(payloads)(batches):
                parsed.add(sum(k in ("response", "revisit") for k in b.column(1).to_pylist()))
                yield b

        return run

    monkeypatch.setattr(warc, "_parse", counted)
    assert len(queries.QUERIES["op10_warc_transactions"](spark, SF).collect()) == parsed.value > 0
