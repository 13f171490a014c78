"""Embedding near-dedup with randomised-rotation binary codes.

Vectors of one label are compared. Equal vectors are one class before any pair
is looked at. A class's unit vector is rotated at random and kept as the signs
of its coordinates with a correction factor, its product with its own code. For
another vector, the code's product divided by that factor is an unbiased
estimate of the cosine; a confidence bound, and a certain bound by the angles,
limit the error. Only pairs whose upper limit reaches the threshold are computed
again, exactly, in doubles, so no pair at or above it is lost to the codes
beyond the bound's 1e-8 and none below it is linked.

A label's classes are dealt into blocks of bounded size; tasks compare two
blocks and return counts and local trees, never pairs.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have no label, link with nothing and are their own component; vectors of
different dimension do not link; repeated rows link with each other; a row with
a null vec_id takes part but is never a component's name or kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._base import cut, table
from weftgraph.llm._graph import components
from weftgraph.llm.topk import valid

#: Half-width of the estimate's confidence interval in standard deviations.
SIGMA = 6.0
_ROWS = 256


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes (+-1, divided by the root of the dimension), correction factors."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim).T
    bits = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(dim)
    return turned.astype(np.float32), bits.astype(np.float32), (turned * bits).sum(1)


def upper(product: np.ndarray, factor: np.ndarray, dim: int) -> np.ndarray:
    """Upper limit of the cosine from a code's product with a rotated vector: the smaller of both bounds."""
    f = np.clip(factor, 1e-6, 1.0)
    spread = np.sqrt((1 - f * f) / (f * f) / max(dim - 1, 1)) if dim > 1 else np.zeros_like(f)
    likely = product / f + SIGMA * spread
    s = np.clip(product, -1, 1)
    certain = np.where(s >= f, 1.0, f * s + np.sqrt((1 - f * f) * (1 - s * s)))
    return np.minimum(likely, certain) + 1e-4


def pairs(x: np.ndarray, y: np.ndarray, same: bool, least: float):
    """Index pairs with cosine >= least, in runs; x and y of the same block: each pair once."""
    dim = x.shape[1]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    turned = (x / nx[:, None] @ rotation(dim).T).astype(np.float32)
    _, bits, factor = codes(y / ny[:, None])
    factor = factor.astype(np.float32)[None, :]
    for at in range(0, len(x), _ROWS):
        likely = upper(turned[at : at + _ROWS] @ bits.T, factor, dim) >= least
        if same:
            likely &= np.arange(len(y))[None, :] > np.arange(at, min(at + _ROWS, len(x)))[:, None]
        i, j = np.nonzero(likely)
        if len(i) > 0.1 * likely.size:
            cos = ((x[at : at + _ROWS] @ y.T) / nx[at : at + _ROWS, None] / ny[None, :])[i, j]
        else:
            cos = np.concatenate([np.einsum("ij,ij->i", x[at + i[k : k + 20000]], y[j[k : k + 20000]]) for k in range(0, len(i), 20000)] or [np.zeros(0)]) / nx[at + i] / ny[j]
        hit = cos >= least
        yield (at + i[hit]).astype(np.int32), j[hit].astype(np.int32)


def trees(n: int, runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each index's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in runs:
            m = np.minimum(root[i], root[j])
            np.minimum.at(root, i, m)
            np.minimum.at(root, j, m)
        root = root[root]
        if (root == before).all():
            return root


def near_groups(vectors: DataFrame, least: float = 0.93, block_bytes: int = 4 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    # Divided by the largest component first, so that no square overflows.
    big = F.array_max(F.transform("x", lambda v: F.abs(v)))
    able = F.coalesce(valid(F.col("x")) & F.col("label").isNotNull() & (big > 0), F.lit(False))
    rows = cut(rows.withColumn("able", able))
    classes = cut(rows.where("able").groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("big", big).withColumn("c", F.monotonically_increasing_id()))
    # A block holds so many bytes of vectors, whatever their dimension: a class is copied once for each block of its label.
    sizes = classes.groupBy("label", F.size("x").alias("dim")).agg(F.ceil(F.count("*") * 8 * F.first(F.size("x")) / block_bytes).cast("int").alias("blocks"))
    # The scale is a written column: inside the lambda it would be found again for every component.
    scaled = classes.select("label", "c", "n", F.size("x").alias("dim"), F.transform("x", lambda v: v / F.col("big")).alias("x"))
    dealt = scaled.join(sizes, ["label", "dim"])
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("c"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "c", "n", "x")

    def compare(t: pa.Table) -> pa.Table:
        dim, i, j = (t[k][0].as_py() for k in ("dim", "i", "j"))
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        b, c, n = (t[k].to_numpy() for k in ("b", "c", "n"))
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        runs, links = [], np.zeros(len(c), dtype=np.int64)
        if len(left) and len(right):
            for p, q in pairs(x[left], x[right], i == j, least):
                p, q = left[p], right[q]
                links += np.bincount(p, n[q], len(c)).astype(np.int64) + np.bincount(q, n[p], len(c)).astype(np.int64)
                if len(p):
                    runs.append((p, q))
        root = trees(len(c), runs)
        own = np.flatnonzero(links)
        return pa.table({"c": c[own], "links": links[own], "root": c[root[own]]})

    met = cut(dealt.groupBy("label", "dim", "i", "j").applyInArrow(compare, "c long, links long, root long"))
    links = met.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = cut(classes.join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").select("label", "x", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "c").alias("root")))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(named.join(names, "root").select("label", "x", "n_links", "component_id"))
    known = rows.where("able").join(named, ["label", "x"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
