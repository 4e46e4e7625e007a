"""Operators 11 to 13 against brute force and DuckDB on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from inkweave.llm import centroid_clusters as cc
from inkweave.llm import collocations as co
from inkweave.llm import queries
from inkweave.llm import token_counts as tc
from tests.compare import check

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_collocations"])
def test_equals_duckdb(spark, name):
    check(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def lloyd(rows, k, rounds, scale=64, seed=1):
    """By the contract, with Python integers."""
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*own)] if (own := [v for (_, v), a in zip(kept, at) if a == i]) else m for i, m in enumerate(c)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, cl, d in got:
        own[cl] += d
    return sorted(((i, cl, d, own[cl], sum(own.values()), hashlib.sha256(",".join(map(str, c[cl])).encode()).hexdigest()) for i, cl, d in got), key=repr)


def test_clusters_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-2, 2) for _ in range(4)]) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # a hot vector
    rows += [(5, rows[6][1]), (5, rows[6][1]), (None, rows[7][1]), (200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [0.0] * 5), (206, [-0.0] * 4), (207, [1e5, -1e5, 0.1, -0.1])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v string, weight int, cluster int").repartition(3)
    got = [tuple(x)[:6] for x in cc.centroid_clusters(df, k=6, rounds=3, dims=4).collect()]
    assert sorted(got, key=repr) == lloyd(rows, 6, 3)


def test_clusters_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert cc.centroid_clusters(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], schema)
    assert [(r["cluster"], r["distance"], r["inertia"], r["weight"]) for r in cc.centroid_clusters(two).collect()] == [(0, 0, 0, 2)] * 2


def test_refuses_components_whose_squares_overflow(spark):
    with pytest.raises(Exception, match="quantised component"):
        cc.centroid_clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(pieces):
    count, r = tc.Counter(tc.read_vocabulary(MODEL)), random.Random(9)
    parts = ["a", "the", "ing", " ", "   ", "▁", "\n", "\t", "0", "42", "é", "日本", "😀", "́", "<s>", "</s>", "<unk>", "<0x41>", "\0", ".", "...", "==", "²", "　", "\xa0", "in", "er", "Привет", "ß", "-", "https://"]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randrange(0, 50)))
        assert count(text) == len(pieces.encode(text)), text
    for text in ("", " " * 5001, "a" * 20000, "".join(r.choices("etaoin", k=50000)), "\n" * 99, "日" * 5000):
        assert count(text) == len(pieces.encode(text))


def test_segments_change_no_count():
    v, r = tc.read_vocabulary(MODEL), random.Random(2)
    count = tc.Counter(v)
    for _ in range(500):
        text = "".join(r.choices(["er", "in ", "  ", ".", "x²", "λ", "\n", "7", "re-", "(a"], k=20))
        assert count(text) == tc.count_segment(tc.SPACE + text.replace(" ", tc.SPACE), v.ranks)


def test_token_query(spark, pieces):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in rows}


def test_token_counts_of_odd_rows(spark, pieces):
    texts = [None, "", " ", "a b", "a b", "é" * 3000]
    df = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tc.token_counts(df, MODEL).collect())
    assert got == [(i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in enumerate(texts)]
    assert tc.token_counts(df.limit(0), MODEL).count() == 0


def phrases(rows, least, top, longest=4, share=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if not any(lg == lang and len(q) > len(p) and 100 * b >= share * a and inside(q) for (lg, q), b in cand.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, v in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(v)[:top]))


def test_phrases_of_odd_rows(spark):
    r = random.Random(6)
    words = ["the", "The", "of", "é", "x-y", "日本", "q'", "\x0b", "\x1c", "\xa0", "a.b", "n"]
    rows = [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ", ", ".\n"]) for _ in range(r.randrange(0, 90)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", " \t "), ("de", "a b c d e " * 900), ("en", rows[4][1]), ("en", rows[4][1]), ("und", "of the of the " * 40), ("xx", "ha " * 500)]
    df = spark.createDataFrame([(i % 9, lang, t, 1, "z") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    for least, top, block, group in ((5, 2000, 6 << 20, 4_000_000), (3, 7, 700, 100)):
        got = sorted(tuple(x) for x in co.collocations(df, least=least, top=top, block_bytes=block, group_words=group).collect())
        assert got == phrases(rows, least, top)
    assert co.collocations(df.limit(0)).count() == 0
