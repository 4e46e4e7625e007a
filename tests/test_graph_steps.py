"""Graph tables that are written once, and operators that go step by step."""

import time

from pyspark.sql import functions as F

from inkweave.operators import graph as g
from inkweave.shared import shared_folder, written
from inkweave.sources.fixtures import edges, graph, nodes

SF = "/root/testdata/sf0.001"


def test_shuffle_files_of_a_written_step_go(spark):
    blocks = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",").split(",") if b.startswith("shuffle")}
    before, conf = blocks(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out, left = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), shared_folder(spark), "x"), 50
    while blocks() - before and left:
        time.sleep(0.1)
        left -= 1
    assert left and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf


def test_graph_is_nodes_and_edges(spark):
    for status in (None, "F"):
        n, e = graph(spark, SF, status)
        for new, old in ((n, nodes(spark, SF)), (e, edges(spark, SF, status))):
            assert new.columns == old.columns and new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()


def test_neighbour_types_count_neighbours(spark):
    """Loops, both directions, repeats, missing ends and nodes that stand twice."""
    n = spark.createDataFrame([(1, i, i, t) for i, t in [("a", "X"), ("b", "Y"), ("c", "Y"), ("c", "Y"), ("d", "X")]], "paper_id long, id string, label string, type string")
    e = spark.createDataFrame([(1, s, t) for s, t in [("a", "b"), ("b", "a"), ("a", "a"), ("c", "a"), ("c", "a"), (None, "d"), ("b", None), ("b", "zz"), ("zz", "d"), (None, None)]], "paper_id long, source string, target string")
    want = g.neighbours(n, e).groupBy("paper_id", "id", "other_type").agg(F.count("*").alias("n"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, g.neighbour_types(n, e).collect())) == sorted(map(key, want.collect()))


def test_edges_with_null_order_stay(spark):
    from inkweave.operators import rules as r

    n = spark.createDataFrame([(1, "a", "A", "Claim")], "paper_id long, id string, label string, type string")
    e = spark.createDataFrame([(1, "e", "a", "a", "SUPPORTS", None), (1, "f", "a", "gone", "SUPPORTS", None), (2, "e", "x", "y", "SUPPORTS", "w")], "paper_id long, id string, source string, target string, type string, rationale string")
    assert sorted(map(tuple, r.edge_list_check(e, n, "rationale")[1].collect())) == [(1, 2, None, False), (2, 1, None, False)]
    assert sorted(map(tuple, g.violations(n, e).collect())) == [(1, 3, 1), (2, 3, 2)]
