"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into bands, and long bands into chunks. Each
query first gets a threshold, its k-th best product among the longest vectors.
A band whose greatest length times the query's cannot reach it is never joined
with the query. In a bucket the local cosine threshold picks the pruning: by
length (a prefix of the vectors in order of length) when it is low, by
coordinates (the feasible interval of the query's largest coordinates) when it
is high. What is left is verified by exact integer products.

Queries meet candidates block by block; a block of queries and a bucket have a
bounded number of rows.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows with a null vec_id, take no part; vectors of different dimension do not
meet; a repeated vec_id is a candidate for each of its rows, but never for a
query of the same vec_id; a query with fewer than k others gets them all; an
empty vector has product 0 with another; products beyond 64 bits are cut to the
limits of a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, table

#: Lengths within a band differ by at most this factor.
BAND = 1.1
#: Local cosine threshold from which coordinates prune better than lengths.
HIGH = 0.75
FOCUS = 4


def valid(x: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    d = x.cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)), F.lit(False))


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((t.num_rows, 0))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of integer-valued doubles."""
    if not (len(q) and len(c) and q.shape[1]):
        return np.zeros((len(q), len(c)), dtype=np.int64)
    if np.linalg.norm(q, axis=1).max() * np.linalg.norm(c, axis=1).max() * 2 < 2**53:
        return (q @ c.T).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    a, b = [[int(v) for v in r] for r in q], [[int(v) for v in r] for r in c]
    return np.array([[min(high, max(low, sum(x * y for x, y in zip(r, s)))) for s in b] for r in a], dtype=np.int64)


def _best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score.astype(np.float64), qi)) if len(score) and np.abs(score.astype(np.float64)).max() < 2**53 else np.array(sorted(range(len(qi)), key=lambda i: (qi[i], -int(score[i]), ids[i])), dtype=int)
    q = qi[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


def search_bucket(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, product) of the k best that reach each query's floor."""
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c, cid = c[order], cid[order]
    lc, lq = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((lq > 0) & (lc[0] > 0), floor / (lq * lc[0]), -1.0) if len(c) else np.full(len(q), 2.0)
        least = np.where((lq > 0) & (floor > 0), floor / lq, 0.0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def verify(rows: np.ndarray, some: np.ndarray | slice) -> None:
        p, ids = products(q[rows], c[some]), cid[some]
        i, j = np.nonzero((p >= floor[rows][:, None]) & (ids[None, :] != qid[rows][:, None]))
        best = _best(i, ids[j], p[i, j], k)
        out.append((rows[i[best]], ids[j[best]], p[i, j][best]))

    live = local <= 1 + 1e-9
    # Queries of like thresholds share a prefix of the lengths.
    by_length = np.flatnonzero(live & (local < HIGH))
    by_length = by_length[np.argsort(-least[by_length], kind="stable")]
    for at in range(0, len(by_length), 256):
        rows = by_length[at : at + 256]
        prefix = int(np.searchsorted(-lc, -(least[rows].min() * (1 - 1e-9)), side="right"))
        verify(rows, slice(0, prefix))
    by_coordinate = np.flatnonzero(live & (local >= HIGH))
    if len(by_coordinate):
        unit = c / lc[:, None].clip(1e-300)
        for r in by_coordinate:
            u, t = q[r] / lq[r], min(1.0, local[r])
            keep = np.flatnonzero(lc * lq[r] >= floor[r] * (1 - 1e-9))
            for f in np.argsort(-np.abs(u))[:FOCUS]:
                reach = math.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-9
                # With cosine of t at least, the candidate's coordinate lies in this interval.
                low = u[f] * t - reach if u[f] > -t else -1.0
                high = u[f] * t + reach if u[f] < t else 1.0
                keep = keep[(unit[keep, f] >= low) & (unit[keep, f] <= high)]
            verify(np.array([r]), keep)
    if not out:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_rows: int = 2048, bucket_rows: int = 4096) -> DataFrame:
    """vectors (vec_id, z: integer-valued array<double>) to query_id, rank, vec_id, score."""
    v = vectors.where("vec_id is not null").withColumn("dim", F.size("z")).withColumn("_big", F.coalesce(F.array_max(F.transform("z", lambda x: F.abs(x))), F.lit(0.0)))
    # Divided by the largest component first, so that no square overflows; the length itself may be infinite, its band is not.
    v = v.withColumn("_rest", F.when(F.col("_big") > 0, F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + (x / F.col("_big")) * (x / F.col("_big"))))).otherwise(0.0))
    v = v.withColumn("norm", F.col("_big") * F.col("_rest")).withColumn("band", F.when(F.col("_big") > 0, F.floor((F.log("_big") + F.log("_rest")) / math.log(BAND))).otherwise(-(10**6)).cast("int"))
    v = cut(v.withColumn("q", F.coalesce(is_query, F.lit(False))).drop("_big", "_rest"))
    # Bands times dimensions: a few hundred rows, since lengths are doubles.
    bands = v.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("dim", "band").collect()
    queries = v.where("q").select("vec_id", "z", "dim", "norm")
    nq = queries.count()
    blocks = max(1, math.ceil(nq / query_rows))
    queries = queries.withColumn("g", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("qk", F.monotonically_increasing_id())
    # Floors from the longest vectors, a fixed number of them.
    longest = v.select("vec_id", "z", "dim", "norm").orderBy(F.col("norm").desc(), "vec_id").limit(bucket_rows // 4).toArrow()
    by_dim = {d: (t := longest.filter(pa.compute.equal(longest["dim"], d)), _matrix(t, d), t["vec_id"].to_numpy()) for d in set(longest["dim"].to_pylist())}

    def floors(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            at = np.full(t.num_rows, -np.inf)
            dims, ids = t["dim"].to_numpy(), t["vec_id"].to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d in by_dim:
                    own = t.take(pa.array(rows))
                    p = products(_matrix(own, int(d)), by_dim[d][1]).astype(np.float64)
                    p[by_dim[d][2][None, :] == ids[rows][:, None]] = -np.inf
                    if p.shape[1] >= k:
                        at[rows] = np.partition(p, p.shape[1] - k, axis=1)[:, p.shape[1] - k]
            # A product past 2**53 is rounded as a double; step below it.
            at = np.where(np.abs(at) < 2**53, at, np.nextafter(at, -np.inf))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "floor"])

    queries = cut(queries.mapInArrow(floors, "vec_id long, z array<double>, dim int, norm double, g int, qk long, floor double"))
    table_of = F.array(*[F.struct(F.lit(r["dim"]).alias("dim"), F.lit(r["band"]).alias("band"), F.lit(float(r["longest"])).alias("longest"), F.lit(math.ceil(r["n"] / bucket_rows)).alias("chunks")) for r in bands]) if bands else None
    if table_of is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = F.filter(table_of, lambda r: (r["dim"] == F.col("dim")) & (r["longest"] * F.col("norm") * (1 + 1e-9) >= F.col("floor")))
    asked = queries.withColumn("r", F.explode(reach)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("r.chunks") - 1))).select("g", "dim", F.col("r.band").alias("band"), "chunk", "vec_id", "z", "qk", "floor")
    chunks = F.element_at(F.map_from_arrays(F.transform(table_of, lambda r: F.struct(r["dim"], r["band"])), F.transform(table_of, lambda r: r["chunks"])), F.struct(F.col("dim"), F.col("band")))
    asked = cut(asked)
    # A candidate goes only to the blocks of queries that can still reach its band.
    wanted = asked.groupBy("dim", "band", "chunk").agg(F.collect_set("g").alias("gs"))
    held = v.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "z"), chunks).cast("int")).join(wanted, ["dim", "band", "chunk"])
    held = held.select(F.explode("gs").alias("g"), "dim", "band", "chunk", "vec_id", "z", F.lit(None).cast("long").alias("qk"), F.lit(None).cast("double").alias("floor"))

    def bucket(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        asks = pa.compute.is_valid(t["qk"])
        q, c = t.filter(asks), t.filter(pa.compute.invert(asks))
        i, ids, p = search_bucket(_matrix(q, dim), q["vec_id"].to_numpy(), q["floor"].to_numpy(), _matrix(c, dim), c["vec_id"].to_numpy(), k)
        return pa.table({"qk": q["qk"].to_numpy()[i].astype(np.int64), "query_id": q["vec_id"].to_numpy()[i].astype(np.int64), "vec_id": ids.astype(np.int64), "score": p.astype(np.int64)})

    found = asked.unionByName(held).groupBy("g", "dim", "band", "chunk").applyInArrow(bucket, "qk long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("qk").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(valid(F.col("embedding")))
    # 256 times the largest doubles stays the largest double: finite components take part, whatever their size.
    most = F.lit(np.finfo(np.float64).max)
    z = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(F.greatest(F.least(x * 256.0, most), -most)))
    return top_k(e.select(F.col("vec_id").cast("long").alias("vec_id"), z.alias("z")), F.pmod("vec_id", F.lit(50)) == 0)


def _floor(x: Column) -> Column:
    """Floor as a double; values from 2**52 on are whole already (and may not fit a long)."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.z) = len(c.z)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
