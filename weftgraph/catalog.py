"""Graphs as tables: one vertex table per label, one edge table per kind of edge.

An edge whose key is a column of one endpoint's table (a foreign key) is
declared inline: expanding it is one join with that table, not two. Labelled
patterns then read only the tables and columns they name; patterns without
labels read the union of what could match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Source:
    """A table, or a function that reads it when a query first needs it."""

    def __init__(self, source: DataFrame | Callable[[], DataFrame]):
        self.source = source

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source


class VertexTable(_Source):
    """Vertices of a label, or of any labels where `label` is None and the table has a `labels` column."""

    def __init__(self, label: str | None, source, key: str, props: list[str] | None = None):
        super().__init__(source)
        self.label, self.key, self.named = label, key, props

    @cached_property
    def props(self) -> list[str]:
        if self.named is not None:
            return self.named
        return [c for c in self.df.columns if not (self.label is None and c in (self.key, "labels"))]

    def gid(self, key: Column | None = None) -> Column:
        """The graph-wide id: label and key. A table of any labels has graph-wide keys already."""
        k = F.col(self.key) if key is None else key
        return k if self.label is None else F.concat(F.lit(self.label + ":"), k.cast("string"))

    def type_of(self, prop: str) -> T.DataType:
        return self.df.schema[prop].dataType


class EdgeTable(_Source):
    """Edges of a type from src_label to dst_label (None: ids are graph-wide).

    `inline` names the endpoint ("src" or "dst") whose vertex table is df itself.
    """

    def __init__(self, type: str, src_label: str | None, dst_label: str | None, source, src: str, dst: str, inline: str | None = None):
        super().__init__(source)
        self.type, self.src_label, self.dst_label, self.src, self.dst, self.inline = type, src_label, dst_label, src, dst, inline

    def generic(self) -> DataFrame:
        """(from, type, to) with graph-wide ids; an edge is a set member, so repeated rows are one."""
        gid = lambda label, c: F.col(c).cast("string") if label is None else F.concat(F.lit(label + ":"), F.col(c).cast("string"))
        kind = F.col("type") if self.type == "*" else F.lit(self.type)
        rows = self.df.where(F.col(self.src).isNotNull() & F.col(self.dst).isNotNull())
        out = rows.select(gid(self.src_label, self.src).alias("from"), kind.alias("type"), gid(self.dst_label, self.dst).alias("to"))
        return out if self.inline else out.distinct()  # a vertex row is one edge


@dataclass
class GraphCatalog:
    spark: SparkSession
    vertices: list[VertexTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)

    def add_vertices(self, label: str, df: DataFrame | Callable[[], DataFrame], key: str, props: list[str] | None = None) -> GraphCatalog:
        self.vertices.append(VertexTable(label, df, key, props))
        return self

    def add_edges(self, type: str, src_label: str, dst_label: str, df: DataFrame | Callable[[], DataFrame], src: str, dst: str, inline: str | None = None) -> GraphCatalog:
        self.edges.append(EdgeTable(type, src_label, dst_label, df, src, dst, inline))
        return self

    def tables(self, groups: list[list[str]]) -> list[VertexTable]:
        """Tables that can hold vertices with a label of every group."""
        return [v for v in self.vertices if v.label is None or all(v.label in g for g in groups)]

    def table(self, label: str) -> VertexTable | None:
        return next((v for v in self.vertices if v.label == label), None)

    def edge_tables(self, types: list[str]) -> list[EdgeTable]:
        return [e for e in self.edges if not types or e.type == "*" or e.type in types]

    def all_edges(self, types: list[str]) -> DataFrame:
        """(from, type, to) of these types, all if none is named."""
        out = None
        for e in self.edge_tables(types):
            part = e.generic()
            if e.type == "*" and types:
                part = part.where(F.col("type").isin(types))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "from string, type string, to string")

    def all_nodes(self) -> DataFrame:
        """(id, labels, properties as JSON) of every vertex table."""
        out = None
        for v in self.vertices:
            labels = F.col("labels") if v.label is None else F.array(F.lit(v.label))
            part = v.df.select(v.gid().cast("string").alias("id"), labels.alias("labels"), F.to_json(F.struct(*v.props)).alias("properties"))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "id string, labels array<string>, properties string")

    def relationship_types(self) -> DataFrame:
        """Types with an edge; of a table of one type a single edge is looked at."""
        out = self.spark.createDataFrame([], "relationshipType string")
        for e in self.edges:
            rows = e.df.where(F.col(e.src).isNotNull() & F.col(e.dst).isNotNull())
            out = out.unionByName(rows.select(F.col("type").alias("relationshipType")).distinct() if e.type == "*" else rows.limit(1).select(F.lit(e.type).alias("relationshipType")))
        return out.distinct()

    def property_keys(self) -> DataFrame:
        return self.spark.createDataFrame(sorted({(p,) for v in self.vertices for p in v.props}), "propertyKey string")

    def degrees(self, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """(id, degree) by half-edges."""
        e = self.all_edges(types or [])
        ends = [e.select(F.col(c).alias("id")) for c, ok in (("from", direction != "in"), ("to", direction != "out")) if ok]
        both = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
        return both.groupBy("id").agg(F.count("*").alias("degree"))


def retail_graph(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """The tables of a sales warehouse and an event stream as a property graph."""
    kept: dict[str, DataFrame] = {}

    def read(t: str) -> Callable[[], DataFrame]:
        def get() -> DataFrame:
            if t not in kept:
                kept[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            return kept[t]

        return get

    region, nation, customer, supplier, part, orders, events, documents, rows = map(read, "region nation customer supplier part orders events documents lineitem".split())

    def item() -> DataFrame:
        # Order and line number do not name a row; all its columns do, up to rows that are equal.
        df = rows()
        return df.withColumn("item_id", F.concat_ws(":", *[c for c in df.columns if c not in ("l_tax", "l_returnflag", "l_linestatus")]))

    user = lambda: events().select("user_id").distinct()
    source = lambda: documents().select("source").distinct()
    g = GraphCatalog(spark)
    g.add_vertices("Region", region, "r_regionkey").add_vertices("Nation", nation, "n_nationkey")
    g.add_vertices("Customer", customer, "c_custkey").add_vertices("Supplier", supplier, "s_suppkey")
    g.add_vertices("Part", part, "p_partkey").add_vertices("Order", orders, "o_orderkey").add_vertices("Item", item, "item_id")
    g.add_vertices("User", user, "user_id").add_vertices("Event", events, "event_id")
    g.add_vertices("Document", documents, "doc_id").add_vertices("Source", source, "source")
    g.add_edges("IN_REGION", "Nation", "Region", nation, "n_nationkey", "n_regionkey", "src")
    g.add_edges("IN_NATION", "Customer", "Nation", customer, "c_custkey", "c_nationkey", "src")
    g.add_edges("IN_NATION", "Supplier", "Nation", supplier, "s_suppkey", "s_nationkey", "src")
    g.add_edges("PLACED", "Customer", "Order", orders, "o_custkey", "o_orderkey", "dst")
    g.add_edges("CONTAINS", "Order", "Item", item, "l_orderkey", "item_id", "dst")
    g.add_edges("OF_PART", "Item", "Part", item, "item_id", "l_partkey", "src")
    g.add_edges("FROM_SUPPLIER", "Item", "Supplier", item, "item_id", "l_suppkey", "src")
    g.add_edges("DID", "User", "Event", events, "user_id", "event_id", "dst")
    g.add_edges("FROM_SOURCE", "Document", "Source", documents, "doc_id", "source", "src")
    return g
