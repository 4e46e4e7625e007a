"""Operator 11, centroid clustering: Lloyd rounds over distinct quantised vectors with multiplicities.

Components become integers floor(scale * x). Identical integer vectors are grouped (counted before the shuffle) and
written once with their multiplicity; each round assigns the distinct vectors to the nearest centroid and adds up
weight and weighted components, so copies cost nothing and all arithmetic is on integers. A task hands on k * (dims + 1)
sums, Spark adds those up, and the driver sees k * (dims + 1) numbers a round. The last assignment is joined back to the
vec_ids: vectors that make up a thousandth of all rows or more (so at most a thousand of them) by a broadcast join, all
others by a shuffle in which no key has more than a thousandth of the rows.

Cases: a vector is kept if it has exactly `dims` components, none of them null, NaN or infinite; the others (null
vectors too) have no row in the result. Repeated rows and vec_ids are vectors each; rows with null vec_id are kept but
come last as starting centroids; equal hashes start in the order of their components. With fewer than k kept vectors
there are fewer centroids; an empty table gives an empty result. Equal starting centroids stay apart by number: the
smaller gets all, the larger stays as it is. Components over 2**27 in size after quantisation are refused, because
squared distances then pass 64 bits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, release, workspace

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest component: 64 squares of differences then fit into 63 bits.
MOST = 1 << 27
HOT_SHARE = 1000
_ROWS = 1 << 15


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of integers) of the rows whose vector has `dims` finite components."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    fits = F.forall(whole, lambda c: c.between(-MOST, MOST))
    v = F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a quantised component is over {MOST}")).cast("array<int>"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(good, F.lit(False))).select("vec_id", v.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def _matrix(col: pa.ListArray, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equals) and squared distance, exactly."""
    d = np.empty((len(v), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        diff = v - c
        d[:, i] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(1)
    return best, d[np.arange(len(v)), best]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _sums(centroids: np.ndarray, dims: int):
    """Rows (v, weight) in; one row (cluster, dim, total) for each sum of the task out, dim -1 being the weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), object)
        for b in _pieces(batches):
            v, w = _matrix(b.column(0), dims), b.column(1).to_numpy(zero_copy_only=False)
            best, _ = nearest(v, centroids)
            # sums over few enough rows to stay within 64 bits; task totals are Python integers
            some = np.zeros((len(centroids), dims + 1), object)
            for c in np.unique(best):
                at = best == c
                if int(w[at].max()) * int(at.sum()) * MOST < 1 << 62:
                    some[c, :dims] = w[at] @ v[at]
                else:
                    some[c, :dims] = w[at].astype(object) @ v[at].astype(object)
                some[c, dims] = int(w[at].sum())
            total += some
        c, d = np.nonzero(total)
        sums = pa.array([str(total[i, j]) for i, j in zip(c, d, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.where(d == dims, -1, d), pa.int32()), sums], ["cluster", "dim", "total"])

    return run


def _assigned(centroids: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            best, distance = nearest(_matrix(b.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array(distance)], ["v", "weight", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after `rounds` rounds over distinct vectors (v, weight)."""
    now = [list(map(int, c)) for c in centroids]
    for _ in range(rounds):
        if not now:
            break
        dims = len(now[0])
        sums = distinct.select("v", "weight").mapInArrow(_sums(np.array(now, np.int64), dims), "cluster int, dim int, total string")
        got = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        for c in range(len(now)):
            if n := got.get((c, -1), 0):
                now[c] = [got.get((c, d), 0) // n for d in range(dims)]
    return now


def centroid_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, and its multiplicity."""
    spark, folder = vectors.sparkSession, workspace(vectors.sparkSession)
    rows = materialise(quantised(vectors, dims, scale), folder, "rows")
    distinct = materialise(rows.groupBy("v").agg(F.count("*").alias("weight")), folder, "distinct")
    centroids = lloyd(distinct, first_centroids(rows, k, seed), rounds)
    fields = T.StructType([*distinct.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    fixed = np.array(centroids, np.int64).reshape(-1, dims)
    placed = materialise(distinct.mapInArrow(_assigned(fixed, dims), fields) if centroids else spark.createDataFrame([], fields), folder, "placed")
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("i"), F.sum("weight").alias("n")).collect()
    n, inertia = sum(r["n"] for r in per), sum(int(r["i"]) for r in per)
    own = {r["cluster"]: int(r["i"]) for r in per}
    digests = [(i, own.get(i, 0), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # k rows
    facts = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    hot = F.col("weight") * HOT_SHARE >= max(1, n)
    few = placed.where(hot)
    by_hot = rows.join(F.broadcast(few), "v")
    rest = rows.join(F.broadcast(few.select("v")), "v", "left_anti").join(placed.where(~hot).hint("merge"), "v")
    out = by_hot.unionByName(rest).join(F.broadcast(facts), "cluster")
    release(spark)
    discard(spark, folder, "distinct")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "weight")


def _sql() -> str:
    """The rounds as common table expressions: a(i) assigns, c(i) are the centroids after round i (one row a component)."""
    parts = [
        f"kept AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIMS})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INT) AS k, v FROM kept QUALIFY k < {CLUSTERS})",
    ]
    near = "SELECT r, vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, vec_id, kept.v, k, CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, {c} c) GROUP BY r, vec_id, v"
    for i in range(1, ROUNDS + 1):
        parts.append(f"a{i} AS ({near.format(c=f'c{i - 1}')})")
        # // cuts toward zero, so a negative sum that leaves a remainder goes one further down
        parts.append(f"s{i} AS (SELECT k, list(m ORDER BY j) AS v FROM (SELECT k, j, CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY k, j)) GROUP BY k)")
        parts.append(f"c{i} AS (SELECT k, coalesce(s.v, o.v) AS v FROM c{i - 1} o LEFT JOIN s{i} s USING (k))")
    parts.append(f"a AS ({near.format(c=f'c{ROUNDS}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY a.v) AS weight FROM a JOIN c{ROUNDS} c USING (k)"


OP11_SQL = _sql()


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
