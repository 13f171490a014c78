import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.operators import relational as R


@pytest.fixture(scope="module")
def g(spark, sf_dir):
    return Engine.retail(spark, sf_dir).catalog


def test_nulls_meet_in_a_value_hash_join(spark):
    a = spark.createDataFrame([(1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,), (2,)], "y int")
    assert R.value_hash_join(a, b, "x", "y").count() == 2


def test_entries_and_expansion(spark, g):
    one = R.anchored_entry(g, "n", "Nation", [3])
    assert one.count() == 1
    up = R.expand(one, g, "n", "IN_REGION", "r")
    assert [r.r_id for r in up.select("r_id").collect()] == [f"Region:{one.first().n_n_regionkey}"]
    got = R.argument_entry(spark.createDataFrame([("Nation:3",), ("nobody",), (None,)], "k string"), g, F.col("k"), "x").select("x_id", "x_labels").collect()
    assert sorted((r.x_id, r.x_labels) for r in got) == [("Nation:3", ["Nation"]), ("nobody", None)]
    deg = R.get_degree(one, g, "n", "d", ["IN_REGION"], "out").first().d
    assert deg == 1


def test_row_operators(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (None, [3])], "a int, xs array<int>")
    assert [r.x for r in R.unwind(df, F.col("xs"), "x").collect()] == [1, 2, 3]
    assert R.unwind(df, F.col("a"), "x").count() == 3
    assert R.keep(df, F.col("xs")).count() == 2
    assert [r.a for r in R.sort(df, ("a", True)).collect()] == [1, 2, 3, None]
    assert [r.a for r in R.give(df, [("a", False)], drop=1, take=2).collect()] == [3, 2]
    assert [tuple(r) for r in R.eager_aggregation(df.where("a > 9"), [], n=F.count("*")).collect()] == [(0,)]
    assert R.semi_apply(df, df.where("a = 1"), ["a"]).count() == 1 and R.semi_apply(df, df.where("a = 1"), ["a"], True).count() == 3
    assert R.union(df.select("a"), df.select("a"), False).count() == 4
    assert R.empty(spark, "a int").count() == 0 and R.unit(spark).count() == 1
