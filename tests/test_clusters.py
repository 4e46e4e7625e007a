"""Components, skeletons, vector joins and semantic merges against brute force."""

import random

import numpy as np
import pytest

from inkweave.operators import clusters as c
from inkweave.operators.components import components
from inkweave.operators.similar import cosine_join, similar_pairs

NODES, EDGES = "paper_id long, id string", "paper_id long, source string, target string"


def graph(spark, edges, nodes):
    n = spark.createDataFrame([(1, x, x.upper(), "Method") for x in nodes], NODES + ", label string, type string")
    e = spark.createDataFrame([(1, f"e{i}", s, t, "RELATES_TO") for i, (s, t) in enumerate(edges)], "paper_id long, id string, source string, target string, type string")
    return n, e


def test_ends_that_are_no_nodes_join_nothing(spark):
    n, e = graph(spark, [("a", "zz"), ("b", "zz"), ("c", "d"), ("d", "e")], "abcde")
    assert sorted((r["id"], r["root"]) for r in components(n, e).collect()) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "c"), ("e", "c")]


def test_skeleton_ignores_them_too(spark):
    n, e = graph(spark, [("a", "y1"), ("a", "y2"), ("a", "y3"), ("c", "d"), ("d", "e"), ("e", "e")], "acde")
    kept, inner = c.skeleton(n, e)
    assert sorted((r["id"], r["degree"]) for r in kept.collect()) == [("c", 1), ("d", 2), ("e", 3)] and inner.count() == 3


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components_equal_union_find(spark, shape):
    r = random.Random(5)
    ids = [f"n{i:03d}" for i in range(120)]
    shuffled = r.sample(ids, len(ids))
    pairs = {"path": list(zip(shuffled, shuffled[1:])), "star": [(ids[50], x) for x in ids], "random": [(r.choice(ids), r.choice(ids + ["?"])) for _ in range(70)], "none": []}[shape]
    edges = [(p, *pair) for p in (1, 2) for pair in pairs if p == 1 or r.random() < 0.6]
    root = {(p, i): i for p in (1, 2) for i in ids}

    def top(p, x):
        while root[p, x] != x:
            x = root[p, x]
        return x

    for p, a, b in edges:
        if (p, a) in root and (p, b) in root:
            x, y = sorted((top(p, a), top(p, b)))
            root[p, y] = x
    nodes = spark.createDataFrame([(p, i) for p in (1, 2) for i in ids] + [(1, ids[0]), (1, None)], NODES)
    got = {(x["paper_id"], x["id"]): x["root"] for x in components(nodes, spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {k: top(*k) for k in root}


def near(rows, t):
    v = {(k, i): np.array(x, float) for k, i, x in rows if x is not None and len(x) == 6 and np.all(np.isfinite(x)) and np.any(x)}
    return {(k, i, j) for (k, i), x in v.items() for (q, j), y in v.items() if k == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) > t}


@pytest.mark.parametrize("t", [0.95, 0.8, 0.2, -0.5])
def test_join_finds_every_pair(spark, t):
    """Recall and precision are 1: clustered and scattered vectors, odd rows, few and many pivots."""
    r = random.Random(7)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(r.choice("xy"), i, [a + r.gauss(0, 0.2) for a in r.choice(centre)] if i % 3 else [r.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [("x", 200, None), ("x", 201, [0.0] * 6), ("x", 202, [1.0] * 5), ("x", 203, [float("nan")] * 6), ("x", 204, [1e-200] * 6), ("x", 205, [1e150] * 6)]
    df = spark.createDataFrame([(k, i, v, t) for k, i, v in rows], "k string, id int, v array<double>, t double")
    want = {p for p in near([x for x in rows if x[1] < 204], t)}
    for pivots in (1, 64):
        got = cosine_join(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), ["k"], 6, pivots).select("k", "a", "b").collect()
        assert {tuple(x) for x in got if x["a"] < 204 and x["b"] < 204} == want and len(got) == len({tuple(x) for x in got})


def test_copies_are_linked_without_all_pairs(spark):
    rows = [("k", i, [1.0, 0.0], 0.9) for i in range(50)] + [("k", 50 + i, [1.0, 0.1], 0.9) for i in range(3)] + [("k", 60, [0.0, 1.0], 0.9)]
    got = similar_pairs(spark.createDataFrame(rows, "k string, id int, v array<double>, t double"), ["k"], 2).collect()
    assert len(got) == 49 + 2 + 1 and {x for r in got for x in (r["a"], r["b"])} == set(range(53))
    assert similar_pairs(spark.createDataFrame([], "k string, id int, v array<double>, t double"), ["k"], 2).count() == 0


def test_semantic_merge(spark):
    """Two methods merge into the one of higher degree; the lone node is bridged to its nearest in the largest component."""
    node = lambda i, kind, v, d=None, span=None, conf=0.5: (1, i, f"label {i}", kind, d, span, conf, v)
    nodes = spark.createDataFrame(
        [node("a", "Method", [1.0, 0.0], "one", "xy", 0.2), node("b", "Method", [1.0, 0.01], " two ", "xyz", 0.9), node("c", "Dataset", [1.0, 0.0], "one"), node("d", "Claim", [0.0, 1.0]), node("e", "Claim", [0.6, 0.8]), node("f", "Claim", None)],
        "paper_id long, id string, label string, type string, description string, source_span string, confidence double, v array<double>",
    )
    edge = lambda i, s, t, why=None, kind="SUPPORTS": (1, i, s, t, kind, "l", why, None)
    edges = spark.createDataFrame(
        [edge("e1", "b", "c", "short"), edge("e2", "a", "c", "longer one"), edge("e3", "b", "d"), edge("e4", "a", "b"), edge("e5", "d", "gone")],
        "paper_id long, id string, source string, target string, type string, label string, rationale string, source_span string",
    )
    n, e, ids = c.semantic_merge(nodes, edges, 2)
    assert {r["id"]: r["root"] for r in ids.collect()} == {"a": "b", "b": "b", "c": "c", "d": "d", "e": "e", "f": "f"}
    b = next(r for r in n.collect() if r["id"] == "b")
    assert (b["label"], b["description"], b["source_span"], b["confidence"], b["n_aliases"], b["v"]) == ("label b", "one | two", "xyz", 0.9, 1, [1.0, 0.0])
    got = sorted(((r["id"], r["source"], r["target"], r["rationale"], r["similarity"]) for r in e.collect()), key=lambda r: r[0])
    assert got == [("e1_supports", "b", "c", "longer one", None), ("e2_supports", "b", "d", None, None), ("e3_supports", "d", "gone", None, None), ("e4_semantically_related_to", "e", "d", None, 0.8)]
    assert [(r["root"], r["id"]) for r in c.aliases(nodes, ids).collect()] == [("b", "a")]


@pytest.mark.parametrize("tile", [7, 1000])
def test_join_that_keeps_the_best_only(spark, tile):
    """Of each left row, or of each two groups, the best is among what stays, and little else."""
    r = random.Random(11)
    rows = [(r.randrange(3), i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(0, 100, [1.0] * 6), (1, 101, [1.0] * 6), (1, 102, [2.0] * 6)]
    df = spark.createDataFrame([(0, g, i, v, 0.1) for g, i, v in rows], "k int, g int, id int, v array<double>, t double")
    cos = {(x[1], y[1]): np.dot(x[2], y[2]) / np.linalg.norm(x[2]) / np.linalg.norm(y[2]) for x in rows for y in rows}
    group, left, right = {i: g for g, i, _ in rows}, df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b")
    for best, at in (("row", lambda a, b: a), ("group", lambda a, b: (group[a], group[b]))):
        got, most = cosine_join(left, right, ["k"], 6, tile, best).collect(), {}
        for (a, b), c in cos.items():
            most[at(a, b)] = max(most.get(at(a, b), 0.1), c)
        want = {(a, b) for (a, b), c in cos.items() if c > most[at(a, b)] - 1e-9}
        assert want <= {(x["a"], x["b"]) for x in got} and len(got) < (len(cos) if tile == 7 else 4 * len(want)) / 2
        assert all(abs(x["cosine"] - cos[x["a"], x["b"]]) < 1e-12 for x in got)


def test_groups_of_the_join_are_tiles(spark):
    """A key of many rows is met in pieces of about a tile, and no pair twice."""
    df = spark.createDataFrame([("k", i, [1.0, i / 200], 0.0) for i in range(200)], "k string, id int, v array<double>, t double")
    got = similar_pairs(df, ["k"], 2, 16)
    assert sorted((x["a"], x["b"]) for x in got.select("a", "b").collect()) == [(i, j) for i in range(200) for j in range(i + 1, 200)]
