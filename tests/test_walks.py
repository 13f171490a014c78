"""Random walks: the same walks as a plain reckoning, and no copy of the graph's edges."""

import os

import pytest
from pyspark.sql import functions as F

from weftgraph import procedures
from weftgraph.procedures import random_walks

EDGES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "e"), ("b", "a"), ("d", "a"), ("c", None)]


def drawn(spark, around: dict, starts: list[str], length: int, back: float, far: float) -> dict:
    """Each walk step by step in Python, the same hashes drawn."""
    import math

    walks = {s: [s] for s in starts}
    for step in range(length):
        asked = [(s, t) for s, w in walks.items() if len(w) == step + 1 for t in sorted(around.get(w[-1], ()))]
        rows = spark.createDataFrame(asked, "id string, t string").select("id", "t", ((F.pmod(F.xxhash64(F.col("id"), F.lit(0), F.lit("0"), F.lit(step), F.col("t")), F.lit(2**52)) + 1) / float(2**52 + 1)).alias("u"))
        best = {}
        for s, t, u in rows.collect():
            w = walks[s]
            weight = 1.0 if step == 0 or t in around[w[-2]] and t != w[-2] else 1 / back if t == w[-2] else 1 / far
            best[s] = min(best.get(s, (math.inf, "")), (-math.log(u) / weight, t))
        for s, (_, t) in best.items():
            walks[s].append(t)
    return walks


@pytest.mark.parametrize("back, far", [(1.0, 1.0), (4.0, 0.25), (0.2, 5.0), (3.0, 1.0)])
def test_walks_equal_a_plain_reckoning(spark, back, far):
    edges = spark.createDataFrame(EDGES * 2, "from string, to string")
    around: dict = {}
    for x, y in EDGES:
        if y is not None:
            around.setdefault(x, set()).add(y)
            around.setdefault(y, set()).add(x)
    start = spark.createDataFrame([(x, 0) for x in "abcdez"], "id string, n int")
    got = {r.id: r.walk for r in random_walks(edges, start, 5, back, far).collect()}
    assert got == drawn(spark, around, list("abcdez"), 5, back, far)


def test_walks_store_only_their_own_rows(spark, monkeypatch):
    """A graph of 20,000 edges: what is written to the shared folder are rows of the two walks."""
    stored = []

    def settle(df):
        out = kept(df)
        stored.append(out.count())
        return out

    kept = procedures.settle
    monkeypatch.setattr(procedures, "settle", settle)
    edges = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("from"), F.concat(F.lit("y"), F.col("id") % 7).alias("to"))
    out = random_walks(edges, spark.createDataFrame([("x1", 0), ("x2", 0)], "id string, n int"), 3).collect()
    assert all(len(r.walk) == 4 for r in out) and len(out) == 2
    assert max(stored) <= 2, os.linesep.join(map(str, stored))
