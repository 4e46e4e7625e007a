"""What the pipeline calls keeps columns whose names or types get in the way."""

from pyspark.sql import functions as F

from inkweave.llm.decontaminate import drop_leaks
from inkweave.llm.line_dedup import cut_lines
from inkweave.llm.prob_minhash import keep_one

CLASH = ("__row", "__gone", "__gone_row", "_id", "_nth", "nth", "kept", "bad", "rest", "lines", "a.b")


def table(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, {"m": 1}, words), (2, None, words + " end"), (3, {}, f"first line of its own\n{words}"), (4, None, None), (None, {"x": 2}, "alone"), (3, {"m": 1}, "another text that nobody else has, with some more words")]
    df = spark.createDataFrame(rows, "doc_id long, tags map<string,int>, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df


def test_columns_stay(spark):
    docs = table(spark)
    bench = spark.createDataFrame([(1, "nothing of the kind is said anywhere in any of these many texts here")], "item_id long, text string")
    for out in (cut_lines(docs), drop_leaks(docs, bench), keep_one(docs)):
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASH)


def test_keep_one_keeps_the_judged_text(spark):
    got = {(r["doc_id"], r["text"] and r["text"][:7]) for r in keep_one(table(spark)).collect()}
    assert got == {(1, "word0 w"), (3, "another"), (4, None), (None, "alone")}
