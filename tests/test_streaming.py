from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkweave.operators.chunks import _HEADING, SIZE, chunk_documents, normalised
from inkweave.streaming import stateful as st


def drained(spark, df, rows, schema, tmp_path, build, mode="append"):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = build(spark.readStream.schema(schema).parquet(path))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(df).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {df}").collect()


def test_windowed_counts_equal_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=7 * i), "view" if i % 3 else "click", i) for i in range(60)]
    got = drained(spark, "windowed", rows, "ts timestamp, event_type string, user_id long", tmp_path, st.windowed_counts)
    batch = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().collect()
    assert {(r["start"], r["event_type"], r["n"]) for r in got} <= {(r["w"]["start"], r["event_type"], r["count"]) for r in batch} and got


def test_generations(spark, tmp_path):
    rows = [(1, 1, 1.0), (1, 3, 2.0), (1, 2, 3.0), (1, 3, 4.0), (2, 1, 5.0)]
    got = drained(spark, "generations", rows, "key long, generation long, value double", tmp_path, st.newest_generation)
    assert sorted(r["value"] for r in got) == [1.0, 2.0, 4.0, 5.0]


def test_token_bucket_and_breaker(spark):
    at = datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, at + timedelta(seconds=s), 6.0) for s in (0, 1, 3, 10)], "key long, ts timestamp, tokens double")
    assert [r["admitted"] for r in st.admitted(req, 60, 10).orderBy("ts").collect()] == [True, False, True, True]
    calls = spark.createDataFrame([(1, at + timedelta(seconds=s), ok) for s, ok in ((0, True), (1, False), (5, True), (40, True), (41, True))], "key long, ts timestamp, ok boolean")
    assert [r["state"] for r in st.breaker(calls).orderBy("ts").collect()] == ["closed", "closed", "open", "half_open", "closed"]


def test_chunks_cover_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r["doc_id"]: normalised(r["text"]) for r in docs.collect()}
    by = {}
    for r in chunk_documents(docs).collect():
        assert r["text"] == texts[r["doc_id"]][r["char_start"] : r["char_end"]]
        by.setdefault(r["doc_id"], []).append(r)
    for doc, rows in by.items():
        rows.sort(key=lambda r: r["chunk_index"])
        assert rows[0]["char_start"] == 0 and rows[-1]["char_end"] == len(texts[doc])
        for a, b in zip(rows, rows[1:]):
            assert a["char_start"] < b["char_start"] and a["char_end"] < b["char_end"]
            # a chunk that ends early leaves what lies before the next step uncovered, but no more than that
            assert b["char_start"] <= max(a["char_end"], a["char_start"] + SIZE) or _HEADING.search(texts[doc][a["char_end"] : b["char_start"]])
