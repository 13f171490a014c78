"""Roots that a batch can change: only those the pattern's own steps lead back to."""

from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.session import shared_dir
from weftgraph.streaming.events import EventGraph
from weftgraph.streaming.standing import StandingQuery


def engine(spark, name: str) -> Engine:
    e = Engine(spark, events=EventGraph(spark, f"{shared_dir(spark)}/{name}"))
    e.cypher("UNWIND range(1, 2) AS u CREATE (n:User {k: u}), (n)-[:DID]->(:Event {kind: 'a'}), (n)-[:DID]->(:Event {kind: 'b'}), (n)-[:DID]->(:Event {kind: 'c'})")
    return e


def batch(e: Engine):
    """The event of kind c of user 1 becomes one of kind x."""
    one = e.cypher("MATCH (u:User {k: 1})-[:DID]->(v:Event {kind: 'c'}) RETURN id(v) AS id").first().id
    return e.events.events().where((F.col("node_id") == one) & (F.col("key") == "kind")).withColumn("ts_ms", F.lit(e.events.now())).withColumn("value", F.lit('"x"'))


def test_only_roots_on_the_way_back_are_evaluated(spark):
    e = engine(spark, "reach")
    q = StandingQuery(e, "both", "MATCH (u:User)-[:DID]->(a:Event), (u)-[:DID]->(b:Event) WHERE a.kind = 'x' AND b.kind = 'b' RETURN u.k AS k")
    calm = StandingQuery(e, "calm", "MATCH (u:User) WHERE NOT (u)-[:DID]->(:Event {kind: 'x'}) RETURN u.k AS k")
    b = batch(e)
    assert q.affected(b).count() == calm.affected(b).count() == 2  # the event and its user, not the user's other events
    got = q.process(b)
    assert [tuple(r) for r in got.select("data.k", "meta.isPositiveMatch").collect()] == [(1, True)]
    assert [tuple(r) for r in calm.process(b, append=False).select("data.k", "meta.isPositiveMatch").collect()] == [(1, False)]
