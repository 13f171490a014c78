import math

import duckdb
import pytest

from weftgraph import queries
from weftgraph.engine import Engine
from weftgraph.functions.scalar import FunctionProblem, murmur2
from weftgraph.plans.compiler import CompileProblem
from weftgraph.streaming.events import EventGraph

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sales(spark, sf_dir):
    return Engine.retail(spark, sf_dir)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(norm(x) for x in v) if isinstance(v, list) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def rows(e, text, **k):
    return [tuple(r) for r in e.cypher(text, **k).collect()]


@pytest.fixture(scope="module")
def family(spark, tmp_path_factory):
    e = Engine(spark, events=EventGraph(spark, str(tmp_path_factory.mktemp("g") / "log")))
    e.cypher("CREATE (a:Person {name: 'a', born: 1}), (b:Person {name: 'b', born: 2}), (c:Person {name: 'c'}), (a)-[:PARENT]->(b), (b)-[:PARENT]->(c), (c)-[:PARENT]->(a), (c)-[:KNOWS]->(a)")
    return e


def test_variable_length_stops_on_cycles(family):
    got = rows(family, "MATCH (x:Person {name: 'a'})-[:PARENT*]->(y) RETURN y.name AS n")
    assert sorted(got) == [("a",), ("b",), ("c",)]


def test_shortest_path(family):
    assert rows(family, "MATCH (x {name: 'a'}), (y {name: 'c'}) RETURN length(shortestPath((x)-[*]->(y))) AS d, length(shortestPath((x)-[*]-(y))) AS u") == [(2, 1)]


def test_missing_property_is_null(family):
    assert rows(family, "MATCH (p:Person) RETURN p.name, p.born, p.zzz ORDER BY p.born") == [("a", 1, None), ("b", 2, None), ("c", None, None)]


def test_nulls_sort_largest(family):
    assert [r[0] for r in rows(family, "MATCH (p:Person) RETURN p.born AS b ORDER BY b DESC")] == [None, 2, 1]


def test_history_set_merge_delete(spark, tmp_path):
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    e.cypher("CREATE (:K {v: 1, t: 'x'})-[:TO]->(:K {v: 2})")
    then = e.events.now()
    e.cypher("MATCH (k:K {v: 1}) SET k = {v: 10, w: [1, 2]}")
    assert rows(e, "MATCH (k:K) RETURN k.v AS v, k.t AS t, k.w AS w ORDER BY v") == [(2, None, None), (10, None, [1, 2])]
    assert rows(e, "MATCH (k:K) RETURN k.v AS v, k.t AS t ORDER BY v", at_time=then) == [(1, "x"), (2, None)]
    e.cypher("UNWIND [2, 3, 3] AS x MERGE (k:K {v: x}) ON CREATE SET k.made = true ON MATCH SET k.met = true")
    assert rows(e, "MATCH (k:K) RETURN k.v AS v, k.made AS a, k.met AS b ORDER BY v") == [(2, None, True), (3, True, None), (10, None, None)]
    with pytest.raises(CompileProblem):
        e.cypher("MATCH (k:K {v: 2}) DELETE k")
    with pytest.raises(CompileProblem):
        e.cypher("CREATE (:Z)", at_time=then)
    e.cypher("MATCH (k:K {v: 2}) DETACH DELETE k")
    assert rows(e, "MATCH (k:K) RETURN count(*) AS n") == [(2,)]
    h = e.events.state_hash()
    e.events.append(e.events.events())  # the same events again
    assert e.events.state_hash() == h
    e.cypher("MATCH (k:K) CALL incrementCounter(k, 'n', 3) YIELD count RETURN count")
    assert rows(e, "MATCH (k:K) RETURN sum(k.n) AS n") == [(6,)]
    e.cypher("MATCH (k:K) CALL set.insert(k, 'tags', 'q') YIELD result RETURN result")
    assert rows(e, "MATCH (k:K) RETURN DISTINCT k.tags AS t") == [(["q"],)]
    e.cypher("FOREACH (x IN [1, 2] | CREATE (:F {x: x}))")
    assert rows(e, "MATCH (f:F) RETURN sum(f.x) AS s") == [(3,)]
    e.cypher("MATCH (f:F {x: 1}) CALL purgeNode(f) RETURN 1")
    assert rows(e, "MATCH (f:F) RETURN f.x AS x") == [(2,)]


def test_unknown_id_is_an_empty_node(family):
    assert rows(family, "MATCH (n) WHERE id(n) = 'nobody' RETURN id(n) AS i, labels(n) AS l, n.name AS x") == [("nobody", [], None)]


def test_heterogeneous_list(sales):
    assert rows(sales, "UNWIND [1, 2, 'hello', 2, 1, null, true] AS n RETURN count(n) AS c, count(DISTINCT n) AS d") == [(6, 4)]


def test_sample_stdev_of_one_row(sales):
    assert rows(sales, "UNWIND [5] AS x RETURN stDev(x) AS a, stDevP(x) AS b") == [(0.0, 0.0)]


def test_overflow_and_division_raise(sales):
    for text in ("RETURN 9223372036854775807 + 1 AS x", "UNWIND [0] AS z RETURN 1 / z AS x"):
        with pytest.raises(Exception):
            rows(sales, text)


def test_compile_problems(sales):
    for text in ("RETURN x AS x", "RETURN 1 AS a, 2 AS a", "MATCH (n:Nation) RETURN n.n_name < 3 AS x", "CREATE (:X)", "CALL no.such() YIELD x RETURN x"):
        with pytest.raises(CompileProblem):
            sales.cypher(text)
    with pytest.raises(FunctionProblem):
        sales.cypher("RETURN nosuch(1) AS x")


def test_murmur2_known_values():
    assert murmur2(b"21") == (-973932308 & 0x7FFFFFFF) and murmur2(b"foobar") == (-790332482 & 0x7FFFFFFF) and murmur2(b"a-little-bit-long-string") == (-985981536 & 0x7FFFFFFF)


def test_columns_and_filters_reach_the_scan(sales):
    plan = sales.cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS s, count(*) AS n")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan.split("Physical Plan")[1]
    assert plan.split("Physical Plan")[1].count("FileScan") == 2


def test_explain(sales):
    r = sales.cypher("EXPLAIN MATCH (r:Region) RETURN r.r_name AS n").first()
    assert "Match" in r.logical and "Scan" in r.physical


def test_user_function(sales):
    from pyspark.sql import functions as F

    from weftgraph.functions.values import STRING, Val

    sales.register_function("my.shout", lambda a: Val(F.concat(F.upper(a.col), F.lit("!")), STRING), low=1, high=1)
    assert rows(sales, "RETURN my.shout('a') AS x, my.shout(null) AS y") == [("A!", None)]
