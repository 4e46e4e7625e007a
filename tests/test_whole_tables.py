"""Queries without SQL over whole tables, against brute force."""

import re

import numpy as np
import pytest

from inkweave import plans

SF = "/root/testdata/sf0.001"


def test_numbers_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert any(d["n_chars"] >= 3000 for d in docs)
    want = {}
    for d in docs:
        text = f"{d['text']} {d['doc_id']}.5 % of {d['n_chars']}"
        shares = [float(x) / 100 for x in re.findall(r"(\d+(?:\.\d+)?)\s*%", text, re.ASCII)]
        plain = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", re.sub(r"\d+(?:\.\d+)?\s*%", " ", text, flags=re.ASCII), re.ASCII)]
        want[d["doc_id"]] = (len(shares + plain), sum(shares + plain))
    got = plans.QUERIES["h14_numbers"](spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(want)
    for r in got:
        n, total = want[r["doc_id"]]
        assert r["n"] == n and r["total"] == pytest.approx(total, rel=1e-12, abs=1e-4), r["doc_id"]


def test_tolerance_at_the_boundary(spark):
    want = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect():
        a, b = e["value"], e["value"] * (1 + (e["event_id"] % 40) / 1000.0)
        want[e["event_id"]] = abs(a - b) <= max(0.01 * max(abs(a), abs(b)), 1e-9)
    assert any(i % 40 == 10 for i in want)
    assert {r["event_id"]: r["close"] for r in plans.QUERIES["h15_tolerance_all"](spark, SF).collect()} == want


def test_every_question_is_retrieved_for(spark):
    asked = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()
    more = ("", " compared with another", " which dataset?", " 95.5% of it", " give a summary", " overview of x-101")
    vectors = {}
    for e in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        vectors.setdefault(e["label"], []).append((e["vec_id"], np.array(e["embedding"], dtype=float)))
    near = {label: [v for _, v in sorted((round(float(((x - vs[0][1]) ** 2).sum()), 4), v) for v, x in vs)[:3]] for label, vs in vectors.items()}
    want = set()
    for c in asked:
        short = len(c["text"] + more[(c["conv_id"] + c["turn"]) % 6]) <= 150
        found = near.get(c["conv_id"] % 10, []) if short else []
        want |= {(c["conv_id"], c["turn"], v, i + 1, "hybrid") for i, v in enumerate(found)} or {(c["conv_id"], c["turn"], None, None, "graph_only")}
    assert {w[4] for w in want} == {"hybrid", "graph_only"}
    for name in ("e12_hybrid_retrieval", "e12_hybrid_retrieval_all"):
        got = [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]
        assert len(got) == len(set(got)) and set(got) == want
