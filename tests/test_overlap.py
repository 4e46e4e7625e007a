"""What backs a pair of methods, and which pair is best."""

import random

from inkweave.operators.overlap import best_method_pairs, resonance


def graphs(spark):
    node = lambda p, i, kind, label, v=None: (p, i, label, kind, v)
    nodes = [
        node(1, "m1", "Method", "alpha", [1.0, 0.0]), node(1, "m2", "Method", "beta", [0.0, 1.0]), node(1, "d", "Dataset", " Set "), node(1, "q", "ResearchQuestion", "甲乙丙", [1.0, 1.0]),
        node(2, "n1", "Method", "gamma", [1.0, 0.05]), node(2, "n2", "Method", "delta", [0.05, 1.0]), node(2, "n3", "Method", "ALPHA", [1.0, 0.0]), node(2, "e", "Dataset", "set"), node(2, "r", "ResearchQuestion", "甲乙丁", [1.0, 0.9]),
        node(3, "o1", "Method", "eps", [1.0, 0.01]), node(3, "s", "ResearchQuestion", "one way", [1.0, -0.2]), node(4, "p1", "Method", "zeta", [1.0, 0.02]), node(4, "t", "ResearchQuestion", "甲乙丙", None),
    ]
    edges = [(1, "m2", "d"), (2, "e", "n2"), (1, "m1", "q"), (2, "r", "n1"), (3, "o1", "s"), (4, "p1", "t"), (2, "n3", "gone")]
    return spark.createDataFrame(nodes, "paper_id long, id string, label string, type string, v array<double>"), spark.createDataFrame(edges, "paper_id long, source string, target string")


def test_resonance(spark):
    n, e = graphs(spark)
    pairs = spark.createDataFrame([(1, "m2", 2, "n2"), (1, "m1", 2, "n1"), (1, "m1", 2, "n2"), (1, "m1", 3, "o1"), (1, "m1", 4, "p1"), (2, "n3", 3, "o1")], "paper_a long, a string, paper_b long, b string")
    got = {(r["a"], r["b"]): r["backed_by"] for r in resonance(pairs, n, e, 2).collect()}
    # the last but one has the same label; with the English question a cosine of 0.55 is enough
    assert got == {("m2", "n2"): "dataset", ("m1", "n1"): "similar_question", ("m1", "o1"): "similar_question", ("m1", "p1"): "question"}


def test_best_pair(spark):
    n, e = graphs(spark)
    got = {(r["paper_a"], r["paper_b"]): (r["a"], r["b"], r["backed_by"]) for r in best_method_pairs(n, e, 2).collect()}
    assert got[1, 2] == ("m1", "n1", "similar_question") and got[1, 4] == ("m1", "p1", "question") and (2, 4) not in got
    assert best_method_pairs(n.limit(0), e, 2).count() == 0


def test_best_pairs_by_rungs(spark):
    """Going down by rungs gives what all pairs give: backed and unbacked methods that stand in many papers."""
    r = random.Random(3)
    v = {m: [r.gauss(0, 1) for _ in range(3)] for m in range(12)}
    has = [(p, m) for p in range(6) for m in v if r.random() < 0.6]
    nodes = [(p, f"m{m}", f"label {m}", "Method", v[m]) for p, m in has] + [(p, f"d{k}", f"set {k}", "Dataset", None) for p in range(6) for k in range(4)]
    edges = [(p, f"m{m}", f"d{k}") for p, m in has for k in range(4) if r.random() < 0.2]
    n, e = spark.createDataFrame(nodes, "paper_id int, id string, label string, type string, v array<double>"), spark.createDataFrame(edges, "paper_id int, source string, target string")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    near = {(p, m): {k for q, s, k in edges if (q, s) == (p, f"m{m}")} for p, m in has}
    want = {}
    for p, x in has:
        for q, y in has:
            if p < q and x != y and near[p, x] & near[q, y] and cos(v[x], v[y]) >= 0.2:
                want[p, q] = min(want.get((p, q), (9, "", "")), (-round(cos(v[x], v[y]), 9), f"m{x}", f"m{y}"))
    for rungs in ((), (0.95, 0.8, 0.5)):
        got = {(x["paper_a"], x["paper_b"]): (-round(x["cosine"], 9), x["a"], x["b"]) for x in best_method_pairs(n, e, 3, 0.2, rungs).collect()}
        assert got == want
