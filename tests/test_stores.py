"""Store and cluster operators on small tables: nulls, ties, repeated keys, loops."""

import json

from pyspark.sql import functions as F

from inkweave.operators import clusters as c
from inkweave.operators import stores as s


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_inserts_upserts_and_deletes(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    assert got(s.insert_absent(a, b, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert got(s.upsert(a.withColumn("t", F.lit(1)), b.withColumn("t", F.lit(1)).where("v <> 'y'"), ["k"], "t")) == [(1, "a", 1), (2, "x", 1), (3, "z", 1)]
    assert got(s.delete(a, b, ["k"])) == [(1, "a")] and s.delete(a.limit(0), b, ["k"]).count() == 0


def test_runs_are_visible_only_when_active(spark):
    v = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 2), ("q", "r1", 3), ("o", None, 4)], "paper_id string, run_id string, n int")
    a = spark.createDataFrame([("p", "r2"), ("q", " "), ("o", None)], "paper_id string, run_id string")
    assert got(s.visible(v, a).select("n")) == [(2,)]


def test_usable_and_foreign_rows(spark):
    d = spark.createDataFrame([("1", "p", "text"), ("2", "p", "None"), (" ", "p", "x"), ("3", None, "x"), ("4", "p", None)], "id string, paper_id string, document string")
    assert got(s.usable(d, "id", "document").select("id")) == [("1",)]
    e = spark.createDataFrame([("r", "p"), ("r", "q"), ("r", None)], "run_id string, paper_id string")
    assert s.foreign_evidence(e, spark.createDataFrame([("r", "p")], "run_id string, owner string")).count() == 2


def test_ratios_without_cases_are_null(spark):
    d = spark.createDataFrame([("a", False, False)], "g string, expected boolean, actual boolean")
    assert got(s.precision_recall(d, ["g"])) == [("a", 0, 0, 0, None, None, 0.0)]
    m = spark.createDataFrame([("a", True, 0.7, 0.5)], "g string, positive boolean, score double, theta double")
    assert got(s.margins(m, ["g"])) == [("a", 0.2, None, None)]


def test_skeleton_counts_loops_twice_and_keeps_the_giant(spark):
    n = spark.createDataFrame([(1, x, x, "T") for x in "abcde"], "paper_id long, id string, label string, type string")
    e = spark.createDataFrame([(1, "1", "a", "b", "X", None), (1, "2", "b", "c", "X", None), (1, "3", "c", "c", "X", None), (1, "4", "d", "e", "X", None)], "paper_id long, id string, source string, target string, type string, rationale string")
    kept, left = c.skeleton(n, e, 2)
    assert got(kept.select("id", "degree")) == [("b", 2), ("c", 3)] and got(left.select("id")) == [("2",), ("3",)]
    ids = spark.createDataFrame([(1, "c", "b")], "paper_id long, id string, root string")
    assert got(c.remapped(e, ids).select("id", "source", "target")) == [("1", "a", "b"), ("4", "d", "e")]


def test_ranks_cross_buckets(spark):
    d = spark.createDataFrame([(i, None if i == 7 else (i * 37 % 101)) for i in range(60)], "k int, v int")
    got_ = {x["k"]: x["rank"] for x in s.ranked(d, F.floor(F.col("v") / 10), [F.col("v").desc(), F.col("k")]).collect()}
    rows = sorted(((i * 37 % 101, i) for i in range(60) if i != 7), key=lambda t: (-t[0], t[1]))
    assert got_ == {k: n + 1 for n, (_, k) in enumerate(rows)} | {7: 60} and s.ranked(d.limit(0), F.col("v"), [F.col("k")]).count() == 0


def test_envelopes_carry_the_request_id(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, 'c"d')], "id long, name string")
    page = s.page(rows, [F.col("id")], 1, 2)
    body = json.loads(s.envelope(page, F.struct("id", "name"), rows, 1, 2, "r-1").first()["body"])
    assert body == {"data": {"items": [{"id": 2}, {"id": 3, "name": 'c"d'}], "total": 3, "offset": 1, "limit": 2}, "meta": {"request_id": "r-1"}}
    assert "meta" not in json.loads(s.envelope(page, F.struct("id"), rows, 1, 2).first()["body"])
    one = rows.select(s.success(F.struct("id"), F.concat(F.lit("r"), F.col("name"))).alias("body")).collect()
    assert [json.loads(r["body"]) for r in one] == [{"data": {"id": 1}, "meta": {"request_id": "ra"}}, {"data": {"id": 2}, "meta": {}}, {"data": {"id": 3}, "meta": {"request_id": 'rc"d'}}]


def test_deduped_edges_of_one_id(spark):
    """Two edges of one id and rationales of one length: the smaller one, however the rows lie."""
    e = [(1, "u1", "p", "o", "SUPPORTS", x) for x in ("N", "A", None)] + [(1, "u2", "p", "o", "SUPPORTS", "B")]
    for rows in (e, e[::-1]):
        df = spark.createDataFrame(rows, "paper_id long, id string, source string, target string, type string, rationale string").coalesce(1)
        assert got(c.deduped(df)) == [(1, "e0_SUPPORTS", "p", "o", "SUPPORTS", "A")]
