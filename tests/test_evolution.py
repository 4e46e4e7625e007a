"""Every stage at which a pair of papers may end."""

from inkweave.operators.evolution import claim_evolution


def test_every_stage(spark):
    q = lambda p, i, v, label=None: (p, i, label or f"question {i}", "ResearchQuestion", None, v)
    claim = lambda p, i, label, d=None: (p, i, label, "Finding", d, None)
    nodes = [
        q(1, "q1", [1.0, 0.0]), q(1, "q2", [0.0, 1.0], "the same"), claim(1, "c1", "plain, long claim"), claim(1, "c2", "told", "why"),
        q(2, "q3", [0.1, 1.0], "the same"), claim(2, "c3", "short"), claim(2, "c4", "linked"),
        q(3, "q4", [-1.0, 0.0]), q(4, "q5", [0.0, 2.0]), q(6, "q6", [0.05, 1.0]), (5, "m", "no question", "Method", None, [0.0, 1.0]),
    ]
    n = spark.createDataFrame(nodes, "paper_id long, id string, label string, type string, description string, v array<double>")
    e = spark.createDataFrame([(2, "e", "c4", "q3", "SUPPORTS")], "paper_id long, id string, source string, target string, type string")
    chunks = spark.createDataFrame([(4, i, f"chunk {i}" if i != 2 else "  ", [0.0, float(i)]) for i in range(6)], "paper_id long, chunk_id int, text string, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (4, 6), (6, 6 + 1), (1, 5), (2, 6)], "paper_a long, paper_b long")
    got = {(r["paper_a"], r["paper_b"]): r for r in claim_evolution(pairs, n, e, chunks, 2).collect()}
    short = {k: (r["reason"], r["question_a"], r["question_b"], r["claim_a"], r["claim_b"]) for k, r in got.items()}
    assert short == {
        (1, 2): (None, "the same", "the same", "told", "linked"),
        (1, 3): ("RQ_GATE_FAILED", None, None, None, None),
        (1, 4): (None, "the same", "question q5", "told", "chunk 1\nchunk 3"),
        (4, 6): (None, "question q5", "question q6", "chunk 1\nchunk 3", None),
        (6, 7): ("MISSING_REQUIRED_NODES", None, None, None, None),
        (1, 5): ("MISSING_REQUIRED_NODES", None, None, None, None),
        (2, 6): (None, "the same", "question q6", "linked", None),
    }
    assert "同一问题「the same」" in got[1, 2]["summary"] and "论文 B 未检出" in got[2, 6]["evidence"] and got[1, 3]["phase"] == "RQ_ALIGNMENT"
    none = claim_evolution(pairs.where("paper_a = 4"), n, e, chunks.limit(0), 2).collect()[0]
    assert (none["reason"], none["phase"], none["status"]) == ("NO_RECALLABLE_CLAIMS", "CLAIM_RECALL", "insufficient_data")
