"""The plan's operators as functions of DataFrames, for plans built by hand.

A node variable v is the columns v_id, v_key and v_<property>; an entry point makes them, other operators pass
them on. Queries as text are compiled by plans.compiler, which follows the same semantics with typed variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.catalog import GraphCatalog


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def unit(spark: SparkSession) -> DataFrame:
    """One row without columns."""
    return spark.range(1).select()


def anchored_entry(g: GraphCatalog, var: str, label: str, ids: list | None = None) -> DataFrame:
    """All nodes of a label, or those with these keys."""
    t = g.table(label)
    out = t.df if ids is None else t.df.where(F.col(t.key).isin(ids))
    return out.select(t.gid().alias(f"{var}_id"), F.col(t.key).alias(f"{var}_key"), *[F.col(p).alias(f"{var}_{p}") for p in t.props])


def argument_entry(rows: DataFrame, g: GraphCatalog, key: Column, var: str) -> DataFrame:
    """The node whose id an expression gives; null gives no row, an unknown id an empty node."""
    nodes = g.all_nodes().select(F.col("id").alias(f"{var}_found"), F.col("labels").alias(f"{var}_labels"), F.col("properties").alias(f"{var}_properties"))
    out = rows.withColumn(f"{var}_id", key.cast("string")).where(F.col(f"{var}_id").isNotNull())
    return out.join(nodes, F.col(f"{var}_id") == F.col(f"{var}_found"), "left").drop(f"{var}_found")


def get_degree(rows: DataFrame, g: GraphCatalog, var: str, name: str, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """The number of half-edges."""
    d = g.degrees(types, direction).select(F.col("id").alias("_deg_id"), F.col("degree").alias(name))
    return rows.join(d, F.col(f"{var}_id") == F.col("_deg_id"), "left").drop("_deg_id").withColumn(name, F.coalesce(name, F.lit(0)))


def expand(rows: DataFrame, g: GraphCatalog, var: str, types: str | list[str], to: str, direction: str = "out") -> DataFrame:
    """One hop along edges of these types, to the id of the node there."""
    e = g.all_edges([types] if isinstance(types, str) else types)
    ways = [e.select(F.col(a).alias("_near"), F.col(b).alias(f"{to}_id")) for a, b, d in (("from", "to", "out"), ("to", "from", "in")) if direction in (d, "both")]
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1].where(F.col("_near") != F.col(f"{to}_id")))
    return rows.join(steps, F.col(f"{var}_id") == F.col("_near")).drop("_near")


def local_node(rows: DataFrame, var: str, label: str | None = None, properties: dict | None = None) -> DataFrame:
    """Keep rows whose node has the label and these values."""
    out = rows if label is None else rows.where(F.col(f"{var}_id").startswith(label + ":"))
    for k, v in (properties or {}).items():
        out = out.where(F.col(f"{var}_{k}") == F.lit(v))
    return out


def load_csv(spark: SparkSession, path: str, headers: bool = True, separator: str = ",") -> DataFrame:
    """Rows of text columns."""
    return spark.read.option("header", headers).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)


def union(left: DataFrame, right: DataFrame, everything: bool = True) -> DataFrame:
    out = left.unionByName(right)
    return out if everything else out.dropDuplicates()


def or_else(rows: DataFrame, first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """first, and second for the rows that first has nothing for; `by` names a row."""
    return first.unionByName(second.join(first.select(*by).distinct(), by, "left_anti")).join(rows.select(*by).distinct(), by, "left_semi")


def value_hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equal values meet, and so do nulls."""
    return left.join(right, F.col(left_key).eqNullSafe(F.col(right_key)))


def semi_apply(rows: DataFrame, sub: DataFrame, by: list[str], inverted: bool = False) -> DataFrame:
    return rows.join(sub.select(*by).distinct(), by, "left_anti" if inverted else "left_semi")


def apply(rows: DataFrame, sub: DataFrame, by: list[str]) -> DataFrame:
    """Every row with each of its results; without shared columns, with all of them."""
    return rows.join(sub, by) if by else rows.crossJoin(sub)


def optional(rows: DataFrame, sub: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(sub, by, "left")


def keep(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true, or a list that is not empty."""
    t = rows.select(condition.alias("c")).schema[0].dataType
    return rows.where(F.size(condition) > 0 if isinstance(t, T.ArrayType) else condition)


def skip(rows: DataFrame, n: int) -> DataFrame:
    return rows.offset(max(0, n))


def limit(rows: DataFrame, n: int) -> DataFrame:
    return rows.limit(n)


def sort(rows: DataFrame, *by: tuple[str, bool]) -> DataFrame:
    """Nulls are largest: last when ascending, first when descending."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in by])


def give(rows: DataFrame, order: list[tuple[str, bool]] | None = None, distinct: list[str] | None = None, drop: int | None = None, take: int | None = None) -> DataFrame:
    """Sort, distinct, skip and limit in one; with an order and a limit a top-k."""
    out = rows.dropDuplicates(distinct) if distinct else rows
    out = sort(out, *order) if order else out
    out = skip(out, drop) if drop else out
    return out if take is None else out.limit(take)


def distinct(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.dropDuplicates(by) if by else rows.dropDuplicates()


def unwind(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """A row for each element; a null list gives none, a value that is no list one."""
    t = rows.select(values.alias("c")).schema[0].dataType
    return rows.withColumn(name, F.explode(values if isinstance(t, T.ArrayType) else F.when(values.isNotNull(), F.array(values)).otherwise(F.array().cast(T.ArrayType(t)))))


def adjust_context(rows: DataFrame, **columns: str | Column) -> DataFrame:
    """Project, rename and drop."""
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def eager_aggregation(rows: DataFrame, along: list[str], **aggregates: Column) -> DataFrame:
    """Grouped, null being a group; without groups always one row."""
    return rows.groupBy(*along).agg(*[c.alias(k) for k, c in aggregates.items()])
