"""Rule operators on small tables: nulls, ties, repeated ids, absent sides."""

import pytest
from pyspark.sql import functions as F

from inkweave.operators import rules as r


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, id string, label string, type string")


def edges(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, id string, source string, target string, type string, rationale string")


def test_node_and_edge_lists(spark):
    n = nodes(spark, [(1, "a", "A", "Method"), (1, "a", "A", "Method"), (1, "b", "B", None), (2, "a", "A", "Claim")])
    assert got(r.node_list_check(n)) == [(1, 3, 1, 1, False), (2, 1, 0, 0, True)]
    e = edges(spark, [(1, "x", "a", "b", "SUPPORTS", "1"), (1, "x", "a", "zz", "odd", "2"), (2, "y", "a", "a", "odd", None), (3, "z", "a", "a", "SUPPORTED_BY", None)])
    kept, report = r.edge_list_check(e, n.unionByName(nodes(spark, [(3, "a", "A", "Claim")])), "rationale")
    assert got(kept.select("paper_id", "rationale")) == [(1, "1"), (2, None), (3, None)]
    assert got(report) == [(1, 1, "DUPLICATE_EDGE_IDS_DEDUPLICATED:x", True), (2, 1, None, False), (3, 1, None, False)]


def test_graphs_without_nodes_or_edges_are_refused(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id long")
    n = nodes(spark, [(1, "a", "A", "Method")])
    assert got(r.graph_check(papers, n, edges(spark, [(1, "e", "a", "a", "SUPPORTS", None)]))) == [(1, "", True), (2, "0", False)]
    assert got(r.graph_check(papers, n, edges(spark, []))) == [(1, "0", False), (2, "0", False)]


def test_masks_need_many_nodes_and_a_known_title(spark):
    n = nodes(spark, [(1, str(i), "x", "Claim" if i % 2 else "Method") for i in range(4)] + [(2, "0", "x", "Claim")])
    c = spark.createDataFrame([(1, 0, "3 Methods", "STEM"), (1, 1, None, "STEM"), (1, 2, "Methods", "HSS"), (2, 0, "Methods", "STEM")], "paper_id long, chunk_id int, title string, paradigm string")
    assert got(r.masked_nodes(n, c, 3).groupBy("paper_id", "chunk_id").count()) == [(1, 0, 2), (1, 1, 4), (1, 2, 4), (2, 0, 1)]


def test_citations_meet_one_chunk_only(spark):
    chunks = spark.createDataFrame([("k", "p:chunk:1"), ("k", "p:chunk:1"), ("k", "q:chunk:1"), ("k", "q:chunk:2"), ("k", "2"), ("k", "p:x:3")], "key string, chunk_id string")
    cited = spark.createDataFrame([("k", "p:chunk:1"), ("k", "chunk:1"), ("k", "chunk:2"), ("k", "r:9:3"), ("k", "r:2"), ("k", "2"), ("k", ""), ("k", None), ("j", "2")], "key string, cited string")
    out = {(x["key"], x["cited"]): x["chunk_id"] for x in r.resolved_chunks(cited, chunks).collect()}
    assert out == {("k", "p:chunk:1"): "p:chunk:1", ("k", "chunk:1"): None, ("k", "chunk:2"): "q:chunk:2", ("k", "r:9:3"): "p:x:3", ("k", "r:2"): None, ("k", "2"): "2", ("k", ""): None, ("k", None): None, ("j", "2"): None}


def test_alignment_takes_the_first_of_equal_scores(spark):
    c = spark.createDataFrame([(1, "a", "x", 0.5, 0.9), (1, "b", "x", 0.8, 0.9), (1, "c", "x", 0.41, 1.0), (2, "a", "x", 0.74, 0.59)], "pair int, left_id string, right_id string, coarse_score double, rerank_score double")
    assert got(r.aligned_questions(c, ["pair"]).select("pair", "left_id")) == [(1, "b")]
    assert got(r.aligned_questions(c, ["pair"], None).select("pair", "left_id")) == [(1, "b")]
    many = spark.createDataFrame([(1, f"{i:02}", "x", 0.9, 0.6 + i / 100) for i in range(12)], "pair int, left_id string, right_id string, coarse_score double, rerank_score double")
    assert got(r.aligned_questions(many, ["pair"]).select("left_id")) == [("07",)]


def test_contradictions_look_at_theses_first(spark):
    n = nodes(spark, [(1, "t", "Same", "Thesis"), (1, "s", "S", "SubArgument"), (2, "t", " same", "Thesis"), (2, "s", "S", "SubArgument"), (3, "t", "Other", "Thesis"), (4, "s", "S", "SubArgument")])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (5, 6)], "paper_a long, paper_b long")
    out = r.contradictions(pairs, n, edges(spark, [])).select("paper_a", "paper_b", "status", "missing_type", "affected_papers", "node_a", "conflict_type")
    assert got(out) == [
        (1, 2, "ready", None, None, "t", "none"), (1, 3, "insufficient_data", "SubArgument", "3", "t", None),
        (3, 4, "insufficient_data", "Thesis", "4", None, None), (5, 6, "insufficient_data", "Thesis", "5,6", None, None),
    ]
    assert r.exclusion(r.contradictions(pairs, n, edges(spark, []))).where("exclusion_logic is not null").count() == 3


def test_texts(spark):
    assert one(spark, r.handler_warning(F.lit("k"), F.col("e"), F.lit("E")), e=" \n") == "event_handler_failed: Handler k failed: E"
    assert one(spark, r.handler_warning(F.lit("k"), F.col("e"), F.lit("E")), e="x" * 201).endswith("x" * 197 + "...")
    p = "a\n### N\nb  b\n\na\n### E\nc"
    assert one(spark, r.prompt_section(F.col("p"), "N"), p=p) == "\nb  b\n\na" and one(spark, r.prompt_section(F.col("p"), "X"), p=p) == ""
    assert one(spark, r.prompt_section(F.col("p"), "N"), p="### N\nq\n## Z\n### Y") == "\nq\n## Z" and one(spark, r.prompt_section(F.col("p"), "N"), p="### N\nq\n## Z") == "\nq"
    assert one(spark, r.section_fingerprint(F.col("s")), s="\nb  b\n\na") == "abb"
    once = one(spark, r.with_notice(F.col("s"), F.lit("L"), F.lit("p")), s="t ")
    assert once == "t （提示：L；受影响论文：p）" and one(spark, r.with_notice(F.col("s"), F.lit("L"), F.lit("p")), s=once) == once
    assert [one(spark, r.chunk_chars(F.col("h"), F.lit(30_000)), h=h) for h in (None, 0, 18_500, 18_501)] == [19_500, 19_500, 1000, 19_500]
    assert one(spark, r.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))) == ["b", "a", "c"]


def test_unknown_status_is_an_error(spark):
    rows = spark.createDataFrame([("ready", "", None)], "status string, title string, warnings array<string>")
    assert got(r.paper_summary(rows)) == [("ready", None, [])]
    with pytest.raises(Exception, match="unknown status"):
        r.paper_summary(rows.withColumn("status", F.lit("gone"))).collect()


def test_citations_are_read_before_they_are_resolved(spark):
    chunks = spark.createDataFrame([("k", "p1:chunk:1"), ("k", "p1:chunk:2"), ("k", "p2:run:chunk:7")], "key string, chunk_id string")
    want = {"[p1 : chunk : 1]": "p1:chunk:1", "p1_chunk_2": "p1:chunk:2", " see [CITE: chunk : p1:chunk: 2 ] there": "p1:chunk:2", "chunk : 7": "p2:run:chunk:7", "[[ ]]": None, "[]": None, "": None, "p9:chunk:3": None}
    cited = spark.createDataFrame([("k", x) for x in want] + [("k", None)], "key string, cited string")
    assert {x["cited"]: x["chunk_id"] for x in r.resolved_chunks(cited, chunks).collect()} == want | {None: None}


def test_handler_warnings_of_blank_and_null_texts(spark, tmp_path):
    from inkweave import plans
    from tests.compare import check

    texts = [None, "", " \n", "boom", "x" * 300, None, "  y "]
    spark.createDataFrame([(i, t, s) for i, t in enumerate(texts * 3) for s in [None if i == 13 else "src"]], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).replace(tmp_path / "documents.parquet")
    check(plans.QUERIES["a31_handler_warning"](spark, str(tmp_path)), plans.ORACLES["a31_handler_warning"], str(tmp_path))
