"""Operator 7: documents in which passages repeat."""

import numpy as np

from inkweave.llm import prob_minhash as pm


def test_repeated_passages_do_not_hide_links(spark):
    rows = []
    for k in range(30):
        a = [f"a{k}x{i}" for i in range(104)]  # 100 shingles
        p = [f"p{k}x{i}" for i in range(20)]  # 20 shingles when it repeats, and 4 where it starts
        rows += [(2 * k, " ".join(a + p * 50)), (2 * k + 1, " ".join(a))]
    got = {r["doc_id"]: r["class_id"] for r in pm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_unit_bands_only_where_shingles_repeat():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b c d e f g", "a b c d e a b c d e a b c d e", ""]})
    out = next(pm._sketch(26, 5)(iter([b])))
    bands = out.column(4).to_pylist()
    assert [len(x) for x in bands] == [26, 52, 26]
    h = pm.counted(*pm.shingles(pm.bk.Texts(b.column(1).slice(1, 1))))[0]
    plain = pm.band_keys(pm.signatures(h, np.zeros(len(h), int), np.ones(len(h)), 1, 130), 26, 5)
    assert bands[1][26:] == plain[0].view(np.int64).tolist()


def test_links_are_named_for_what_they_count(spark):
    out = pm.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (None, "x")], "doc_id long, text string"))
    assert out.columns == ["doc_id", "class_id", "set_id", "n_verified_links"] and out.count() == 2


def test_parity_bits_bound_what_differs():
    h = pm.bk.mix(np.arange(1, 400, dtype=np.uint64))
    a, b = h[:250], h[20:300]
    p = pm.parity_bits(np.concatenate((a, b)), np.repeat([0, 1], [250, 280]), 2)
    assert p.shape == (2, 8) and 40 <= np.bitwise_count((p[0] ^ p[1]).view(np.uint64)).sum() <= 70
    assert pm.parity_bits(a[:0], np.zeros(0, int), 1).tolist() == [[0] * 8]


def test_repeated_doc_ids_count_once(spark):
    rows = [(1, "b b b b b b c"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "long " * 3000)]
    out = pm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == [(1, 1)] * 3 + [(2, 1), (3, 3)]
