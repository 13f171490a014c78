import base64
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import recipes
from weftgraph.engine import Engine, parsed
from weftgraph.sources import outputs, readers
from weftgraph.streaming.events import SCHEMA, EventGraph
from weftgraph.streaming.ingest import Ingest
from weftgraph.streaming.standing import PatternProblem, StandingQuery, validate


def event(node, kind, ts, key=None, value=None, edge=None, other=None):
    return ("default", node, ts, 0, kind, key, json.dumps(value) if key else None, edge, "Outgoing" if edge else None, other)


def log():
    out = []
    for i in range(6):
        out += [event(f"u{i}", "PropertySet", 1, "__LABEL", ["U"]), event(f"e{i}", "PropertySet", 1, "kind", "a" if i % 2 else "b"), event(f"u{i % 3}", "EdgeAdded", 2, edge="DID", other=f"e{i}")]
    return out + [event("e0", "PropertySet", 3, "kind", "a"), event("u1", "EdgeRemoved", 3, edge="DID", other="e1")]


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_of_arrival_ends_in_the_same_matches(spark, tmp_path, seed):
    events = log()
    random.Random(seed).shuffle(events)
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    q = StandingQuery(e, "q", "MATCH (u:U)-[:DID]->(x) WHERE x.kind = 'a' RETURN id(u) AS u, id(x) AS x")
    net: dict = {}
    for part in (events[:7], events[7:13], events[13:]):
        for r in q.process(spark.createDataFrame(part, SCHEMA)).collect():
            k = tuple(r.data)
            net[k] = net.get(k, 0) + (1 if r.meta.isPositiveMatch else -1)
    want = {("u0", "e0"), ("u0", "e3"), ("u2", "e5")}
    assert {k for k, n in net.items() if n} == want and set(net.values()) <= {0, 1}
    assert {tuple(r) for r in q.matches().collect()} == want == {tuple(r)[:2] for r in q.evaluate().collect()}


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (u:U) WHERE NOT (u)-[:DID]->({kind: 'a'}) RETURN id(u) AS u",
        "MATCH (u:U)-[:DID]->(x) WHERE NOT (x)-[:DID]->({kind: 'b'}) AND x.kind = 'a' RETURN id(u) AS u, id(x) AS x",
        "MATCH (u:U) RETURN id(u) AS u, size([(u)-[:DID]->(x) WHERE x.kind = 'a' | x.kind]) AS n",
    ],
)
def test_patterns_in_where_and_return_do_not_go_stale(spark, tmp_path, text):
    """After every batch the stored matches are those of a whole evaluation."""
    events = log() + [event("u2", "EdgeAdded", 4, edge="DID", other="u0"), event("e2", "PropertySet", 5, "kind", "a"), event("e5", "PropertySet", 5, "kind", "c")]
    random.Random(3).shuffle(events)
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    q = StandingQuery(e, "q", text)
    for part in (events[:9], events[9:15], events[15:18], events[18:]):
        q.process(spark.createDataFrame(part, SCHEMA))
        assert sorted(tuple(r) for r in q.matches().collect()) == sorted(tuple(r)[:-1] for r in q.evaluate().collect())


def test_purge_and_history(spark, tmp_path):
    g = EventGraph(spark, str(tmp_path / "log"))
    g.append(spark.createDataFrame(log(), SCHEMA))
    before = g.events().count()
    g.purge(["u0"])
    left = g.events()
    assert 0 < left.count() < before and left.where("node_id = 'u0' or other = 'u0'").isEmpty()
    assert [p.name for p in tmp_path.iterdir()] == ["log"]


def test_slack_output_sends_every_result(spark, monkeypatch, tmp_path):
    sent = str(tmp_path / "sent")

    def post(req, timeout):
        with open(sent, "ab") as f:
            f.write(req.data + b"\n")
        return open(sent)

    monkeypatch.setattr(outputs.urllib.request, "urlopen", post)
    df = spark.range(45).select(F.struct("id").alias("data"), F.struct(F.lit(True).alias("isPositiveMatch")).alias("meta")).coalesce(1)
    rows = [r.value for r in outputs._lines(df, "WithMetadata").collect()]

    class Here:  # the partition function, in this process
        def foreachPartition(self, f):
            f(iter([type("R", (), {"value": x}) for x in rows]))

    monkeypatch.setattr(outputs, "_lines", lambda *_: Here())
    outputs.slack("http://localhost/x")(df)
    bodies = [json.loads(x) for x in open(sent, "rb")]
    assert [len(b["attachments"]) for b in bodies] == [20, 20, 5] and [a["text"] for b in bodies for a in b["attachments"]] == rows


def test_file_stream_into_graph_and_tap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        lines = [json.dumps({"user": i % 2, "thing": f"t{part}{i}"}) for i in range(4)] + ["broken {"]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    q = StandingQuery(e, "taps", "MATCH (u:User)-[:HAS]->(t) WHERE t.name = 't13' RETURN u.n AS n, t.name AS t", outputs=[outputs.memory("taps")])
    dead = []
    ingest = Ingest(e, "MATCH (u), (t) WHERE id(u) = idFrom($that.user) AND id(t) = idFrom($that.thing) SET u:User, u.n = $that.user, t.name = $that.thing CREATE (u)-[:HAS]->(t)", dead_letters=lambda df: dead.extend(r.value for r in df.collect()), standing=[q])
    assert ingest.warnings == [] and Ingest(e, "CREATE (n)").warnings == ["not idempotent: a replayed batch counts twice"]
    stream = readers.read_files(spark, str(tmp_path / "in"), "jsonl", stream=True, schema="user long, thing string", per_trigger=1)
    ingest.start(stream, str(tmp_path / "cp")).wait(120)
    assert ingest.status == "Completed" and len(dead) == 3
    assert [tuple(r) for r in e.cypher("MATCH (u:User)-[:HAS]->(t) RETURN u.n AS n, count(t) AS k ORDER BY n").collect()] == [(0, 6), (1, 6)]
    assert [tuple(r.data) for r in spark.table("global_temp.tap_taps").collect()] == [(1, "t13")]


@pytest.mark.parametrize(
    "text",
    ["MATCH (a)-[:X|Y]->(b) RETURN a.x AS x", "MATCH (a)-[:X]-(b) RETURN a.x AS x", "MATCH (a)-[:X*]->(b) RETURN a.x AS x", "MATCH (a)-[r:X]->(b) RETURN a.x AS x", "MATCH p = (a)-[:X]->(b) RETURN a.x AS x", "MATCH (a)-[:X]->(b), (b)-[:Y]->(a) RETURN a.x AS x", "MATCH (a), (b) RETURN a.x AS x", "MATCH (a) RETURN DISTINCT a.x AS x", "MATCH (a) RETURN a.x AS x LIMIT 1", "RETURN 1 AS x"],
)
def test_patterns_that_cannot_stand(text):
    with pytest.raises(PatternProblem):
        validate(parsed(text))


def test_distinct_id_form():
    assert validate(parsed("MATCH (a)-[:X]->(b) RETURN DISTINCT id(a) AS id"), "DistinctId") == "a"
    with pytest.raises(PatternProblem):
        validate(parsed("MATCH (a)-[:X]->(b) RETURN a.x AS x"), "DistinctId")


def test_decoders_and_formats(spark, tmp_path):
    (tmp_path / "b").write_text(base64.b64encode(gzip.compress(b'{"a": 1}')).decode())
    assert readers.read_files(spark, str(tmp_path / "b"), "jsonl", schema="a long", decoders=["Base64", "Gzip"]).select("a").collect()[0].a == 1
    (tmp_path / "c.csv").write_text('x;y\n1;"a""b"\n')
    assert [tuple(r) for r in readers.read_files(spark, str(tmp_path / "c.csv"), "csv", delimiter=";", escape='"').collect()] == [("1", 'a"b')]
    assert [r.value for r in readers.numbers(spark, 5, 3).collect()] == [5, 6, 7]
    e = Engine.retail(spark, "/root/testdata/sf0.001")
    assert [tuple(r) for r in e.cypher(f"LOAD CSV WITH HEADERS FROM '{tmp_path}/c.csv' AS r FIELDTERMINATOR ';' RETURN r.x AS x, r.y AS y").collect()] == [("1", 'a"b')]


def test_protobuf_round_trip(spark, tmp_path):
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="p.proto", package="t", syntax="proto3")
    m = f.message_type.add(name="P")
    for i, (name, kind) in enumerate((("name", 9), ("age", 3)), 1):
        m.field.add(name=name, number=i, type=kind, label=1)
    (tmp_path / "p.desc").write_bytes(files.SerializeToString())
    e = Engine.retail(spark, "/root/testdata/sf0.001")
    got = e.cypher(f"CALL toProtobuf({{name: 'Ann', age: 7}}, '{tmp_path}/p.desc', 't.P') YIELD protoBytes CALL parseProtobuf(protoBytes, '{tmp_path}/p.desc', 't.P') YIELD value RETURN castOrNull.string(value.name) AS n, toInteger(castOrNull.string(value.age)) AS a").collect()
    assert [tuple(r) for r in got] == [("Ann", 7)]


def test_subscribers(spark, tmp_path):
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    e.cypher("CREATE (:P {v: 1}), (:P {v: 2})")
    StandingQuery(e, "ones", "MATCH (p:P) WHERE p.v = 1 RETURN p.v AS v")
    assert [tuple(r) for r in e.cypher("MATCH (p:P) CALL subscribers(p) YIELD queryName RETURN p.v AS v, queryName AS q").collect()] == [(1, "ones")]


def test_outputs(spark, tmp_path):
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    df = spark.range(2).select(F.struct(F.col("id").alias("n")).alias("data"), F.struct((F.col("id") == 1).alias("isPositiveMatch")).alias("meta"))
    outputs.workflow([outputs.file(str(tmp_path / "out"), "Bare")], only_positive=True)(df)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"n":1}']
    outputs.cypher(e, "MATCH (x) WHERE id(x) = idFrom($that.data.n) SET x:Seen, x.n = $that.data.n")(df)
    assert [r.n for r in e.cypher("MATCH (x:Seen) RETURN count(*) AS n").collect()] == [2]
    with pytest.raises(ValueError):
        outputs.cypher(e, "MATCH (x) RETURN x")
    outputs.drop()(df)


def test_recipe(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(json.dumps({"a": i, "b": i % 2}) for i in range(5)))
    e = Engine(spark, events=EventGraph(spark, str(tmp_path / "log")))
    text = """
version: 1
ingestStreams:
  - type: FileIngest
    path: $file
    format: {type: CypherJson, query: "MATCH (n) WHERE id(n) = idFrom($that.a) SET n:N, n.a = $that.a, n.b = $that.b"}
standingQueries:
  - pattern: {type: Cypher, mode: DistinctId, query: "MATCH (n:N) WHERE n.b = 1 RETURN DISTINCT id(n) AS id"}
    outputs: {store: {type: CypherQuery, query: "MATCH (n) WHERE id(n) = $that.data.id SET n.hit = true"}}
statusQuery: {cypherQuery: "MATCH (n:N {hit: true}) RETURN n.a AS a ORDER BY a"}
"""
    _, status = recipes.run(e, text, {"file": str(tmp_path / "in.json")})
    assert [r.a for r in status.collect()] == [1, 3]
    with pytest.raises(ValueError):
        recipes.load(text)


def test_graph_after_batches_equals_the_whole_fold(spark, tmp_path, monkeypatch):
    """Late, repeated and removing batches; keys whose type stays, widens and is new; more batches than are kept apart."""
    from weftgraph.streaming import events as E

    monkeypatch.setattr(E, "BATCHES", 3)
    g = EventGraph(spark, str(tmp_path / "log"))
    e = Engine(spark, events=g)
    texts = ["CREATE (:A {k: 1, v: 1})-[:R]->(:B {k: 2})", "CREATE (:A {k: 3, v: 5})", "MATCH (a:A {k: 1}) SET a.v = 7", "MATCH (a:A {k: 1})-[r:R]->(b) DELETE r", "MATCH (a:A {k: 3}), (b:B {k: 2}) CREATE (b)-[:R]->(a)"]
    texts += ["MATCH (a:A {k: 3}) REMOVE a.v", "MATCH (a:A {k: 1}) SET a.v = 'text'", "MATCH (b:B) DETACH DELETE b", *[f"MATCH (a:A {{k: 3}}) SET a.v = {i}" for i in range(2)]]
    for text in texts:
        e.cypher(text)
        now, fresh = g.catalog(), E.State.whole(g.events()).graph()
        cols = ["node_id", "labels", "k", "v"]
        show = lambda df: sorted(map(str, df.selectExpr("node_id", "to_json(struct(labels, k, v)) AS j").collect()))
        assert set(cols) <= set(now.vertices[0].df.columns) and show(now.vertices[0].df) == show(fresh.vertices[0].df), text
        assert sorted(map(tuple, now.edges[0].df.collect())) == sorted(map(tuple, fresh.edges[0].df.collect())), text
    assert g.cache[None, g.namespace].age > 0
    late = g.events().where("key = 'v'").withColumn("ts_ms", F.lit(1)).withColumn("value", F.lit("99"))
    g.append(late)
    assert show(g.catalog().vertices[0].df) == show(E.State.whole(g.events()).graph().vertices[0].df)
