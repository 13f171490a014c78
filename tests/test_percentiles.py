"""Percentiles by rank against lists, and the rows that one task gets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.values import Val
from weftgraph.operators import percentiles as P


@pytest.mark.parametrize("discrete", [True, False])
def test_percentiles_equal_lists(spark, discrete):
    rnd = random.Random(5)
    rows = [(g, rnd.choice([None, *range(40), rnd.random() * 40]) if g else None, [0.0, 0.3, 0.5, 1.0][g % 4]) for g in range(5) for _ in range(300)] + [(None, 3.0, 0.9)] * 50
    rows = [(g, None if v is None else float(v), p) for g, v, p in rows]
    df = spark.createDataFrame(rows, "g int, value double, share double")
    out = P.percentiles(df, Val(F.col("value"), df.schema["value"].dataType), "q", discrete, part=40)
    want = {}
    for g in {r[0] for r in rows}:
        xs, p = sorted(v for h, v, _ in rows if h == g and v is not None), next(p for h, _, p in rows if h == g)
        if xs:
            at = p * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[math.ceil(at)]
            want[g] = xs[math.floor(at + 0.5)] if discrete else pytest.approx(low + (at - math.floor(at)) * (high - low))
    assert {r.g: r.q for r in out.collect()} == want


def test_no_task_ranks_a_whole_group(spark, sf_dir, monkeypatch):
    """1,500 orders in parts of 200: the only window over rows has the part as a key."""
    from weftgraph.engine import Engine

    monkeypatch.setattr(P, "PART", 200)
    q = Engine.retail(spark, sf_dir).cypher("MATCH (o:Order) RETURN percentileDisc(o.o_totalprice, 0.9) AS q")
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(part#" in plan and "windowspecdefinition(o_totalprice" not in plan
    xs = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice").collect())
    assert q.collect()[0].q == xs[math.floor(0.9 * (len(xs) - 1) + 0.5)]


def test_many_percentiles_of_one_query(spark, sf_dir):
    from weftgraph.engine import Engine

    e = Engine.retail(spark, sf_dir)
    rows = e.cypher("MATCH (o:Order) RETURN percentileDisc(o.o_totalprice, 0.5) AS a, percentileCont(o.o_totalprice, 0.5) AS b").collect()
    xs = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice").collect())
    assert rows == [(xs[math.floor(0.5 * (len(xs) - 1) + 0.5)], pytest.approx((xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2))]
    assert e.cypher("MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN percentileDisc(o.o_totalprice, 0.5) AS a, count(*) AS n").collect() == [(None, 0)]
    assert e.cypher("MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN percentileDisc(o.o_totalprice, 0.5) AS a").collect() == [(None,)]
    with pytest.raises(Exception, match="(?i)percentage"):
        e.cypher("MATCH (o:Order) RETURN percentileCont(o.o_totalprice, 2.0) AS a").collect()
