"""The event log: every change of a property or an edge, from which the graph at any time is folded.

One row per event: ns, node_id, ts_ms, seq, kind, key, value (JSON), edge_type,
direction, other. An edge is one row, at its start. Labels are the property
__LABEL. The latest event of a node and key, or of an edge, by (ts_ms, seq) wins.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.catalog import EdgeTable, GraphCatalog, VertexTable
from weftgraph.session import settle

SCHEMA = "ns string, node_id string, ts_ms long, seq long, kind string, key string, value string, edge_type string, direction string, other string"
LABEL = "__LABEL"
SET, REMOVED, ADDED, DROPPED = "PropertySet", "PropertyRemoved", "EdgeAdded", "EdgeRemoved"


#: Kinds of events, the keys that name what they are about, and what they say.
PROPERTY = ((SET, REMOVED), ["node_id", "key"], ["kind", "value"])
EDGE = ((ADDED, DROPPED), ["node_id", "edge_type", "other"], ["kind"])
#: Batches after which a state is written whole again, so that its plan stays short.
BATCHES = 8


class HistoryProblem(ValueError):
    """The past cannot be changed."""


class EventGraph:
    """A graph kept as an append-only log of Parquet files under `path`, partitioned by namespace."""

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default"):
        self.spark, self.path, self.namespace = spark, path, namespace
        self.last = 0
        self.cache: dict[tuple, State] = {}
        #: Batches added since the latest state of a namespace was folded.
        self.news: dict[str, list[DataFrame]] = {}

    def now(self) -> int:
        """A millisecond later than any given out before."""
        self.last = max(int(time.time() * 1000), self.last + 1)
        return self.last

    def exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def events(self, namespace: str | None = None, at_time: int | None = None) -> DataFrame:
        """The events; those that were added twice, as by a replayed batch, are one."""
        return self.log(namespace, at_time).dropDuplicates()

    def log(self, namespace: str | None = None, at_time: int | None = None) -> DataFrame:
        """The rows of the log as written. An event that is there twice changes no state."""
        if not self.exists():
            return self.spark.createDataFrame([], SCHEMA)
        out = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("ns") == (namespace or self.namespace))
        return out if at_time is None else out.where(F.col("ts_ms") <= at_time)

    def append(self, events: DataFrame) -> None:
        """Add events. The latest states read them from the log's new files, so they are written once."""
        cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        latest = [ns for at_time, ns in self.cache if at_time is None]
        had = self.files() if latest else set()
        events.select(*cols).write.partitionBy("ns").mode("append").option("compression", "zstd").parquet(self.path)
        self.cache = {(None, ns): self.cache[None, ns] for ns in latest}
        new = sorted(self.files() - had) if latest else []
        if new:
            batch = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*new)
            for ns in latest:
                self.news.setdefault(ns, []).append(batch.where(F.col("ns") == ns))

    def files(self) -> set[str]:
        return {unquote(f) for f in self.spark.read.schema(SCHEMA).parquet(self.path).inputFiles()} if self.exists() else set()

    def properties(self, namespace: str | None = None, at_time: int | None = None) -> DataFrame:
        """(node_id, key, value): the latest value of each property that is there."""
        return live_properties(latest(self.log(namespace, at_time), PROPERTY))

    def edges(self, namespace: str | None = None, at_time: int | None = None) -> DataFrame:
        """(src, type, dst): edges that are there."""
        return live_edges(latest(self.log(namespace, at_time), EDGE))

    def catalog(self, at_time: int | None = None, namespace: str | None = None) -> GraphCatalog:
        """The graph at a time as one vertex table with a typed column per property, and one edge table.

        The log is folded once; of the latest graph only the nodes that later batches touch are folded again.
        """
        ns = namespace or self.namespace
        k = (at_time, ns)
        if k in self.cache and at_time is None and self.news.get(ns):
            self.cache[k] = self.cache[k].after(reduce(DataFrame.unionByName, self.news[ns])) or State.whole(self.log(ns))
        elif k not in self.cache:
            self.cache[k] = State.whole(self.log(ns, at_time))
        if at_time is None:
            self.news.pop(ns, None)
        return self.cache[k].graph()

    def purge(self, node_ids: list[str], namespace: str | None = None) -> None:
        """Erase nodes and their history: a log without them is written beside this one and takes its place.

        The old log is deleted last, so that a failure at any moment leaves a whole log, here or under its `.old` name.
        """
        gone = self.spark.createDataFrame([(i, namespace or self.namespace) for i in node_ids], "id string, _ns string")
        keep = self.spark.read.schema(SCHEMA).parquet(self.path)
        for end in ("node_id", "other"):
            keep = keep.join(gone, (F.col("ns") == F.col("_ns")) & (F.col(end) == F.col("id")), "left_anti")
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        keep.write.partitionBy("ns").parquet(fresh)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        here, new, old = path(self.path), path(fresh), path(f"{self.path}.old")
        fs = here.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if not (fs.rename(here, old) and fs.rename(new, here)):
            raise OSError(f"the log {self.path} could not be replaced; {fresh} and {self.path}.old hold it")
        fs.delete(old, True)
        self.cache.clear()
        self.news.clear()

    def state_hash(self, namespace: str | None = None, at_time: int | None = None) -> int:
        """A digest of the state that does not depend on the order of rows."""
        p = self.properties(namespace, at_time).select(F.xxhash64("node_id", "key", "value").alias("h"))
        e = self.edges(namespace, at_time).select(F.xxhash64("src", "type", "dst").alias("h"))
        return int(p.unionByName(e).agg(F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()[0]) % 2**64


def _type_of(kinds: set[str]) -> T.DataType:
    kinds = {"BIGINT" if k in ("INT", "SMALLINT", "TINYINT") else "DOUBLE" if k.startswith(("DECIMAL", "FLOAT")) else k for k in kinds} - {"VOID"}
    simple = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<BIGINT>": T.ArrayType(T.LongType())}
    if kinds <= {"BIGINT", "DOUBLE"} and len(kinds) == 2:
        return T.DoubleType()
    return simple.get(next(iter(kinds)), T.VariantType()) if len(kinds) == 1 else T.VariantType()


def latest(events: DataFrame, by: tuple[tuple[str, ...], list[str], list[str]]) -> DataFrame:
    """The last event, removals too, of each property or edge: its keys, what it says, and its place."""
    kinds, keys, says = by
    at = F.struct("ts_ms", "seq")
    return events.where(F.col("kind").isin(*kinds)).groupBy(*keys).agg(F.max_by(F.struct(*says), at).alias("x"), F.max(at).alias("at")).select(*keys, "x.*", "at.*")


def live_properties(last: DataFrame) -> DataFrame:
    return last.where((F.col("kind") == SET) & F.col("value").isNotNull()).select("node_id", "key", "value")


def live_edges(last: DataFrame) -> DataFrame:
    return last.where(F.col("kind") == ADDED).select(F.col("node_id").alias("src"), F.col("edge_type").alias("type"), F.col("other").alias("dst"))


def _kinds(props: DataFrame) -> dict[str, set[str]]:
    """The types of each key's values: one row per property key reaches the driver, the schema."""
    rows = props.where(F.col("key") != LABEL).groupBy("key").agg(F.collect_set(F.schema_of_variant(F.parse_json("value"))).alias("kinds"))
    return {r.key: set(r.kinds) for r in rows.collect()}


def _nodes(ids: DataFrame, props: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """One row for each id with its labels and a typed column per key, from properties as JSON; mixed types are variants."""
    typed = []
    for k, t in types.items():
        v = F.parse_json(F.col(f"`k·{k}`"))
        typed.append((v if isinstance(t, T.VariantType) else F.variant_get(v, "$", t.simpleString())).alias(k))
    wide = props.groupBy("node_id").agg(F.max(F.when(F.col("key") == LABEL, F.col("value"))).alias("labels"), *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"k·{k}") for k in types])
    return ids.join(wide, "node_id", "left").select("node_id", F.coalesce(F.from_json("labels", "array<string>"), F.array().cast("array<string>")).alias("labels"), *typed)


def _ids(props: DataFrame, edges: DataFrame) -> DataFrame:
    ends = [edges.select(F.col(c).alias("node_id")) for c in ("src", "dst")]
    return reduce(DataFrame.unionByName, ends, props.select("node_id"))


@dataclass
class State:
    """A folded graph: the last event of each property and edge, the node rows, and the types seen of each key."""

    props: DataFrame
    links: DataFrame
    nodes: DataFrame
    kinds: dict[str, set[str]]
    age: int = 0

    @property
    def types(self) -> dict[str, T.DataType]:
        return {k: _type_of(self.kinds[k]) for k in sorted(self.kinds)}

    @classmethod
    def whole(cls, events: DataFrame) -> State:
        out = cls(settle(latest(events, PROPERTY)), settle(latest(events, EDGE)), events, {})
        props = live_properties(out.props)
        out.kinds = _kinds(props)
        out.nodes = settle(_nodes(_ids(props, live_edges(out.links)).distinct(), props, out.types))
        return out

    def after(self, batch: DataFrame) -> State | None:
        """The state with a batch added: rows of untouched nodes stay as they are. None if a property's type may change.

        Types only widen until the log is folded whole again.
        """
        seen = _kinds(batch.where(F.col("kind") == SET))
        kinds = {k: self.kinds.get(k, set()) | seen.get(k, set()) for k in {*self.kinds, *seen}}
        if any(k not in self.kinds or _type_of(v) != _type_of(self.kinds[k]) for k, v in kinds.items()):
            return None
        touched = settle(batch.select(F.explode(F.array("node_id", "other")).alias("node_id")).where("node_id is not null").distinct())
        mine = lambda df, how: df.join(touched, "node_id", how)
        cols = lambda by: [*by[1], *by[2], "ts_ms", "seq"]
        props = settle(latest(mine(self.props, "left_semi").unionByName(batch.select(cols(PROPERTY)).where(F.col("kind").isin(*PROPERTY[0]))), PROPERTY))
        links = settle(latest(mine(self.links, "left_semi").unionByName(batch.select(cols(EDGE)).where(F.col("kind").isin(*EDGE[0]))), EDGE))
        out = State(mine(self.props, "left_anti").unionByName(props), mine(self.links, "left_anti").unionByName(links), self.nodes, kinds, self.age + 1)
        ids = mine(_ids(live_properties(props), live_edges(out.links)), "left_semi").distinct()
        rows = settle(_nodes(ids, live_properties(props), self.types))
        out.nodes = mine(self.nodes, "left_anti").unionByName(rows)
        if out.age >= BATCHES:
            out = State(settle(out.props), settle(out.links), settle(out.nodes), out.kinds)
        return out

    def graph(self) -> GraphCatalog:
        g = GraphCatalog(self.nodes.sparkSession)
        g.vertices.append(VertexTable(None, self.nodes, "node_id", list(self.types)))
        g.edges.append(EdgeTable("*", None, None, live_edges(self.links), "src", "dst"))
        return g
