"""Question routing in English and Chinese."""

from pyspark.sql import functions as F

from inkweave.functions import routing

SCALES = (
    ("How does this compare to BERT", None, "cross_paper"), ("a vs", None, "cross_paper"), ("这与上一篇有何不同", None, "cross_paper"), ("两者差异在论文中", None, "cross_paper"),
    ("作者用什么证据", None, "verification"), ("实验是否成立", "STEM", "verification"), ("实验是否成立", "HSS", "summary"), ("史料如何选取", "HSS", "verification"),
    ("总体而言采用了什么方法", None, "summary"), ("整篇的模块", None, "summary"), ("which dataset?", None, "detail"), ("datasets", None, "summary"), ("intersections", None, "detail"), ("f1x", None, "detail"),
    ("它是 95.5% 吗", None, "detail"), ("第5th", None, "summary"), ("claim 与 metric 的关系", None, "detail"), ("全文与结论之间的关系", None, "summary"), ("架构", "STEM", "detail"), ("架构", None, "summary"), ("支撑", "HSS", "detail"),
    ("", None, "summary"), (None, None, "summary"), ("give a summary", None, "summary"),
)


def test_scales(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(SCALES)], "i int, q string, paradigm string, want string")
    got = rows.select("i", "q", "want", routing.question_scale(F.col("q"), F.col("paradigm")).alias("got")).where("got <> want or got is null").collect()
    assert got == []


def test_other_papers_are_told_by_their_ids(spark):
    rows = spark.createDataFrame([("see stem-001", "STEM-001", False), ("see stem-002", "stem-001", True), ("see stem-002", " ", False), ("see stem-002", None, False), ("see x-1", "stem-001", False)], "q string, paper string, want boolean")
    assert rows.where(routing.cross_paper(F.col("q"), F.col("paper")) != F.col("want")).count() == 0
