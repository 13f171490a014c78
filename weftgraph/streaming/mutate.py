"""Writing clauses as events.

The rows that a clause writes for are settled first, so that a new node has one
id however often the plan runs. All events of a query are appended together when
it is done; a later clause of the same query sees its rows' new values, but its
MATCH sees the graph as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.functions.values import REL, Val
from weftgraph.plans import ast as A
from weftgraph.plans.compiler import CompileProblem, NodeVar, ValueVar, fresh
from weftgraph.session import settle
from weftgraph.streaming.events import ADDED, DROPPED, LABEL, REMOVED, SET, EventGraph


def as_json(v: Val) -> Column:
    if V.is_node(v.type) or v.type in (REL, V.PATH):
        raise CompileProblem("nodes, relationships and paths are no property values")
    if V.is_null(v.type):
        return F.lit(None).cast("string")
    if isinstance(v.type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(v.col)
    if isinstance(v.type, (T.StringType, T.BooleanType)) or V.is_num(v.type):
        return F.to_json(v.col.cast(T.VariantType()))
    return F.to_json(v.col.cast("string").cast(T.VariantType()))


class Writer:
    def __init__(self, graph: EventGraph, namespace: str | None = None):
        self.graph, self.ns = graph, namespace or graph.namespace
        self.ts, self.seq, self.batches = graph.now(), 0, []

    def commit(self) -> None:
        if self.batches:
            self.graph.append(reduce(DataFrame.unionByName, self.batches))
            self.batches = []

    def add(self, rows: DataFrame, node: Column, kind, key: Column | None = None, value: Column | None = None, edge: str | Column | None = None, other: Column | None = None) -> None:
        self.seq += 1
        s = lambda c: F.lit(None).cast("string") if c is None else (F.lit(c) if isinstance(c, str) else c)
        out = rows.select(
            F.lit(self.ns).alias("ns"), node.alias("node_id"), F.lit(self.ts).alias("ts_ms"), F.lit(self.seq).cast("long").alias("seq"), s(kind).alias("kind"), s(key).alias("key"), s(value).alias("value"),
            s(edge).alias("edge_type"), (F.lit("Outgoing") if edge is not None else F.lit(None).cast("string")).alias("direction"), s(other).alias("other"),
        )
        self.batches.append(out.where(F.col("node_id").isNotNull()))

    def property(self, rows: DataFrame, node: Column, key: str, v: Val) -> None:
        """A null value removes the property."""
        j = as_json(v)
        self.add(rows, node, F.when(j.isNull(), REMOVED).otherwise(SET), F.lit(key), j)

    # Clauses; `c` is the compiler with the rows so far
    def create(self, c, clause: A.Create) -> None:
        for p in clause.patterns:
            self._create(c, p, lambda node, props: F.expr("uuid()"))

    def _create(self, c, p: A.Pattern, new_id) -> None:
        nodes, rels = p.parts[::2], p.parts[1::2]
        made, cols = [], {}
        bound: list[NodeVar] = []
        for n in nodes:
            if n.var and n.var in c.scope:
                bound.append(c.node(n.var))
                continue
            props = n.props.items if isinstance(n.props, A.MapLit) else tuple((k, A.Lit(v)) for k, v in (c.params.get(n.props.name) or {}).items()) if n.props else ()
            vals = {k: c.ev(c.prepared(e)) for k, e in props}
            v = NodeVar(fresh(n.var or "anon"), None, {k: x.type if not V.is_null(x.type) else V.STRING for k, x in vals.items()})
            cols[v.name("id")] = new_id(n, vals)
            cols[v.name("labels")] = F.array(*[F.lit(x) for x in n.labels]).cast("array<string>")
            cols |= {v.name("p·" + k): x.col.cast(v.props[k]) for k, x in vals.items()}
            bound.append(v)
            made.append((n, v))
            if n.var:
                c.scope[n.var] = v
        if not c.df.columns:
            c.df = c.spark.range(1)
            c.one_row = False
        c.df = settle(c.df.withColumns(cols)) if cols else c.df
        for n, v in made:
            if n.labels:
                self.add(c.df, v.col("id"), SET, F.lit(LABEL), F.to_json(v.col("labels")))
            for k in v.props:
                self.property(c.df, v.col("id"), k, v.prop(k))
        for i, r in enumerate(rels):
            if len(r.types) != 1 or r.direction == "both" or r.variable or r.props is not None and r.props.items:
                raise CompileProblem("a new relationship has one type, a direction and no properties")
            a, b = (bound[i], bound[i + 1]) if r.direction == "out" else (bound[i + 1], bound[i])
            self.add(c.df.where(b.col("id").isNotNull()), a.col("id"), ADDED, edge=r.types[0], other=b.col("id"))
            if r.var:
                name = fresh(r.var)
                c.df = c.df.withColumn(name, F.struct(a.col("id").alias("start"), F.lit(r.types[0]).alias("type"), b.col("id").alias("end")))
                c.scope[r.var] = ValueVar(name, REL)

    def merge(self, c, clause: A.Merge) -> None:
        """Rows that match go on with their matches; for the others the pattern is made, once for equal values."""
        row = fresh("row")
        if not c.df.columns:
            c.df = c.spark.range(1)
        c.df = settle(c.df.withColumn(row, F.monotonically_increasing_id()))
        before = dict(c.scope)
        met, made = c.child(), c.child()
        met.one_row = made.one_row = False
        met.edges_seen = []
        met.pattern(clause.pattern)
        met.df = settle(met.df)
        made.df = made.df.join(met.df.select(F.col(f"`{row}`").alias(row + "'")).distinct(), F.col(f"`{row}`") == F.col(f"`{row}'`"), "left_anti")
        ts = self.ts
        self._create(made, clause.pattern, lambda n, vals: F.sha2(F.to_json(F.struct(F.lit(ts).alias("t"), F.lit(",".join(n.labels)).alias("l"), *[x.col.alias("v" + k) for k, x in sorted(vals.items())], *([] if vals else [F.expr("uuid()").alias("u")]))), 256))
        made.df = settle(made.df)
        if clause.on_match:
            self._set(met, clause.on_match)
        if clause.on_create:
            self._set(made, clause.on_create)
        parts, scope = [], dict(before)
        names = [v for v in made.scope if v not in before]
        for k in names:
            a, b = met.scope[k], made.scope[k]
            if isinstance(b, NodeVar):
                props = {p: V.common([t for t in (a.props.get(p), b.props.get(p)) if t is not None]) or V.STRING for p in {**a.props, **b.props}}
                scope[k] = NodeVar(fresh(k), None, props)
            else:
                scope[k] = ValueVar(fresh(k), b.type)
        old = [x for v in before.values() for x in v.columns()]
        for side in (met, made):
            cols = [F.col(f"`{x}`") for x in old]
            for k in names:
                v, u = side.scope[k], scope[k]
                if isinstance(u, NodeVar):
                    cols += [v.col("id").alias(u.name("id")), (v.col("labels") if v.loaded else F.array().cast("array<string>")).alias(u.name("labels"))]
                    cols += [(v.prop(p).col if v.prop(p) else F.lit(None)).cast(t).alias(u.name("p·" + p)) for p, t in u.props.items()]
                else:
                    cols.append(F.col(f"`{v.name}`").alias(u.name))
            parts.append(side.df.select(*cols))
        c.df, c.scope = parts[0].unionByName(parts[1]), scope

    def set(self, c, clause: A.SetItems) -> None:
        c.df = settle(c.df)
        self._set(c, clause.items)

    def _set(self, c, items: list) -> None:
        for kind, target, key, e, merge in items:
            if not isinstance(target, A.Var):
                raise CompileProblem("SET needs a variable")
            n = c.node(target.name)
            if kind == "prop":
                v = c.ev(c.prepared(e))
                self.property(c.df, n.col("id"), key, v)
                self._put(c, target.name, {key: v})
            elif kind == "labels":
                labels = F.array_union(n.col("labels") if n.loaded else F.array().cast("array<string>"), F.array(*[F.lit(x) for x in e]))
                self.add(c.df, n.col("id"), SET, F.lit(LABEL), F.to_json(labels))
                if n.loaded:
                    c.df = c.df.withColumn(n.name("labels"), labels)
            else:
                v = c.ev(c.prepared(e))
                if V.is_node(v.type):
                    v = Val(v.col["properties"], v.type["properties"].dataType)
                given = {f.name: Val(v.col[f.name], f.dataType) for f in v.type.fields} if isinstance(v.type, T.StructType) else {}
                if isinstance(v.type, (T.MapType, T.VariantType)):
                    m = v.col if isinstance(v.type, T.MapType) else v.col.cast("map<string,variant>")
                    pairs = c.df.select(n.col("id").alias("_n"), F.explode(m).alias("_k", "_v"))
                    t = v.type.valueType if isinstance(v.type, T.MapType) else T.VariantType()
                    self.add(pairs, F.col("_n"), SET, F.col("_k"), as_json(Val(F.col("_v"), t)))
                for k, x in given.items():
                    self.property(c.df, n.col("id"), k, x)
                gone = {} if merge else {k: V.null() for k in n.props if k not in given}
                for k in gone:
                    self.property(c.df, n.col("id"), k, V.null())
                self._put(c, target.name, {**given, **gone})

    def _put(self, c, name: str, vals: dict[str, Val]) -> None:
        """The rows' own copy of a node gets the new values."""
        n = c.scope[name]
        props = {**n.props, **{k: (v.type if not V.is_null(v.type) else V.STRING) for k, v in vals.items()}}
        c.df = c.df.withColumns({n.name("p·" + k): v.col.cast(props[k]) for k, v in vals.items()})
        if not n.loaded:
            c.df = c.df.withColumn(n.name("labels"), F.array().cast("array<string>"))
        c.scope[name] = NodeVar(n.prefix, n.label, props, n.native, True)

    def remove(self, c, clause: A.Remove) -> None:
        c.df = settle(c.df)
        for kind, target, key, labels in [(*i, None)[:4] for i in clause.items]:
            n = c.node(target.name)
            if kind == "prop":
                self.property(c.df, n.col("id"), key, V.null())
                self._put(c, target.name, {key: V.null()})
            else:
                left = F.array_except(n.col("labels"), F.array(*[F.lit(x) for x in labels]))
                self.add(c.df, n.col("id"), SET, F.lit(LABEL), F.to_json(left))
                c.df = c.df.withColumn(n.name("labels"), left)

    def delete(self, c, clause: A.Delete) -> None:
        for e in clause.items:
            v = c.scope.get(e.name) if isinstance(e, A.Var) else None
            if not isinstance(v, NodeVar):
                x = c.ev(e)
                if V.is_node(x.type):
                    v = c.node(e.name)
                elif x.type == REL:
                    self.add(c.df.where(x.col.isNotNull()), x.col["start"], DROPPED, edge=x.col["type"], other=x.col["end"])
                    continue
                else:
                    raise CompileProblem("only nodes and relationships can be deleted")
            ids = settle(c.df.select(v.col("id").alias("id")).where("id is not null").distinct())
            every = self.graph.edges(self.ns)
            # By equal keys, one end at a time: edges that start here, then those that only end here.
            edges = every.join(ids, F.col("src") == F.col("id"), "left_semi")
            edges = edges.unionByName(every.join(ids, F.col("src") == F.col("id"), "left_anti").join(ids, F.col("dst") == F.col("id"), "left_semi"))
            if not clause.detach and not edges.isEmpty():
                raise CompileProblem("a node with relationships needs DETACH DELETE")
            self.add(settle(edges), F.col("src"), DROPPED, edge=F.col("type"), other=F.col("dst"))
            have = settle(self.graph.properties(self.ns).join(ids, F.col("node_id") == F.col("id"), "left_semi"))
            self.add(have, F.col("node_id"), REMOVED, F.col("key"))

    def foreach(self, c, clause: A.Foreach) -> None:
        if not c.df.columns:
            c.df = c.spark.range(1)
            c.one_row = False
        inner = c.child()
        inner.one_row = False
        inner.do_unwind(A.Unwind(clause.source, clause.var))
        for x in clause.body:
            getattr(inner, "do_" + type(x).__name__.lower())(x)
