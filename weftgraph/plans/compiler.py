"""Queries to DataFrames: patterns become joins of vertex and edge tables, clauses become relational operators.

A node variable is a set of flat columns, so that a property nobody reads is
never scanned; it becomes a struct only where it is returned or collected.
"""

from __future__ import annotations

import dataclasses
import itertools
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.catalog import EdgeTable, GraphCatalog, VertexTable
from weftgraph.functions import aggregates, scalar, temporal
from weftgraph.functions import values as V
from weftgraph.functions.values import BOOL, DOUBLE, LONG, PATH, REL, STRING, Val
from weftgraph.operators.percentiles import percentiles
from weftgraph.plans import ast as A
from weftgraph.session import settle

#: Longest variable-length traversal.
MOST_HOPS = 1000
#: Longest shortest path that is looked for without a bound.
MOST_SHORTEST = 10
_ids = itertools.count()


class CompileProblem(ValueError):
    """The query has no meaning here."""


@dataclass
class NodeVar:
    prefix: str
    label: str | None  # of the one table it comes from
    props: dict[str, T.DataType]
    native: bool = False  # has a key column of its table's own type
    loaded: bool = True  # has its labels and properties

    def name(self, part: str) -> str:
        return f"{self.prefix}·{part}"

    def col(self, part: str) -> Column:
        return F.col(f"`{self.prefix}·{part}`")

    def prop(self, key: str) -> Val | None:
        return Val(self.col("p·" + key), self.props[key]) if key in self.props else None

    def columns(self) -> list[str]:
        return [self.name("id")] + ([self.name("key")] if self.native else []) + ([self.name("labels"), *(self.name("p·" + k) for k in self.props)] if self.loaded else [])

    def value(self) -> Val:
        t = T.StructType([T.StructField("id", STRING), T.StructField("labels", T.ArrayType(STRING)), T.StructField("properties", T.StructType([T.StructField(k, v) for k, v in self.props.items()]) if self.props else T.MapType(STRING, STRING))])
        props = F.struct(*[self.col("p·" + k).alias(k) for k in self.props]) if self.props else V.struct([]).col
        s = F.struct(self.col("id").alias("id"), (self.col("labels") if self.loaded else F.array().cast("array<string>")).alias("labels"), props.alias("properties"))
        return Val(F.when(self.col("id").isNotNull(), s), t)


@dataclass
class ValueVar:
    name: str
    type: T.DataType
    ends: tuple[set, set] | None = None  # of a relationship: labels of the tables that its start and end may be in

    def columns(self) -> list[str]:
        return [self.name]

    def value(self) -> Val:
        return Val(F.col(f"`{self.name}`"), self.type)


@dataclass
class Lambda:
    val: Val

    def columns(self) -> list[str]:
        return []

    def value(self) -> Val:
        return self.val


def fresh(stem: str) -> str:
    return f"{stem}#{next(_ids)}"


def conjuncts(e) -> list:
    if e is None:
        return []
    return [*conjuncts(e.args[0]), *conjuncts(e.args[1])] if isinstance(e, A.Op) and e.op == "AND" else [e]


def label_groups(labels: tuple) -> list[list[str]]:
    """Labels that a node must all have, each as its alternatives: (:A|B:C) is [[A, B], [C]]."""
    out: list[list[str]] = []
    for x in labels:
        if x.startswith("|"):
            out[-1].append(x[1:])
        else:
            out.append([x])
    return out


def children(e) -> list:
    """Sub-expressions of a dataclass node, through tuples."""
    out = []
    if dataclasses.is_dataclass(e):
        for f in dataclasses.fields(e):
            out += children_of(getattr(e, f.name))
    return out


def children_of(v) -> list:
    if dataclasses.is_dataclass(v):
        return [v]
    if isinstance(v, (tuple, list)):
        return [x for y in v for x in children_of(y)]
    return []


def has_aggregate(e) -> bool:
    if isinstance(e, A.Call) and e.name.lower() in aggregates.NAMES:
        return True
    return any(has_aggregate(c) for c in children(e))


def replace(e, f):
    """e with every node that f maps to something replaced, from the top."""
    got = f(e)
    if got is not None:
        return got
    if isinstance(e, tuple):
        return tuple(replace(x, f) for x in e)
    if dataclasses.is_dataclass(e):
        return dataclasses.replace(e, **{x.name: replace(getattr(e, x.name), f) for x in dataclasses.fields(e)})
    return e


class Compiler:
    def __init__(self, graph: GraphCatalog, params: dict | None = None, df: DataFrame | None = None, scope: dict | None = None, writer=None, procedures=None, unique: bool = True):
        self.graph, self.spark, self.params = graph, graph.spark, params or {}
        self.df = df if df is not None else self.spark.range(1).select()
        self.scope: dict = dict(scope or {})
        self.writer, self.procedures, self.unique = writer, procedures, unique
        self.row: str | None = None  # a column that correlates a subquery's rows with outer ones
        self.row_ids: DataFrame | None = None  # all its values
        self.edges_seen: list = []
        self.one_row = df is None  # nothing but the unit row so far
        self.lazy: set[str] = set()  # node variables of which only the key is asked for

    # Queries
    def query(self, q: A.Query) -> DataFrame:
        outs = []
        for clauses in q.branches:
            c = self.child()
            c.run(clauses)
            outs.append(c)
        out = outs[0]
        for nxt, every in zip(outs[1:], q.everything):
            out = out.union(nxt, every)
        self.df, self.scope = out.df, out.scope
        return self.df

    def child(self) -> Compiler:
        c = Compiler(self.graph, self.params, self.df, self.scope, self.writer, self.procedures, self.unique)
        c.row, c.row_ids, c.one_row = self.row, self.row_ids, self.one_row
        return c

    def union(self, other: Compiler, every: bool) -> Compiler:
        if list(self.scope) != list(other.scope):
            raise CompileProblem("branches of a union return different columns")
        left, right = self.flat(), other.flat()
        for k in left.scope:
            t = V.common([left.scope[k].type, right.scope[k].type])
            if t is None:
                t = STRING
            for c in (left, right):
                if c.scope[k].type != t:
                    c.df = c.df.withColumn(c.scope[k].name, F.col(f"`{c.scope[k].name}`").cast(t))
                    c.scope[k].type = t
        keep = [left.row] if left.row else []
        names = {k: fresh(k) for k in left.scope}
        rows = lambda c: c.df.select(*keep, *[F.col(f"`{c.scope[k].name}`").alias(n) for k, n in names.items()])
        out = self.child()
        out.df = rows(left).unionByName(rows(right))
        out.scope = {k: ValueVar(n, left.scope[k].type) for k, n in names.items()}
        if not every:
            out.df = out.distinct_rows(out.df, list(out.scope.values()))
        return out

    def flat(self) -> Compiler:
        """The same with every variable a plain value."""
        c = self.child()
        new = {k: fresh(k) for k in self.scope}
        c.df = self.df.select(*([self.row] if self.row else []), *[self.scope[k].value().col.alias(n) for k, n in new.items()])
        c.scope = {k: ValueVar(n, self.scope[k].value().type) for k, n in new.items()}
        return c

    def result(self) -> DataFrame:
        return self.df.select(*[v.value().col.alias(k) for k, v in self.scope.items()])

    def run(self, clauses: list) -> None:
        for i, c in enumerate(clauses):
            self.edges_seen = []
            getattr(self, "do_" + type(c).__name__.lower())(c)
        if clauses and not isinstance(clauses[-1], A.Projection) and not (isinstance(clauses[-1], A.CallProc) and clauses[-1].yields is None and len(clauses) == 1 and self.scope):
            self.df, self.scope = self.df.limit(0).select(*([self.row] if self.row else [])), {}

    # Clauses
    def do_match(self, c: A.Match) -> None:
        if c.optional:
            return self.optional(c)
        rest = self.anchors(c.patterns, c.where)
        for p in c.patterns:
            self.pattern(p)
        for e in rest:
            self.filter(e)

    def anchors(self, patterns: list, where) -> list:
        """Bind nodes whose id a condition gives: a join on the id, in which an unknown id is an empty node."""
        free = {n.var: n for p in patterns for n in p.parts if isinstance(n, A.NodePattern) and n.var and n.var not in self.scope}
        rest = []
        for e in conjuncts(where):
            for a, b in (e.args, e.args[::-1]) if isinstance(e, A.Op) and e.op == "=" else ():
                if isinstance(a, A.Call) and a.name.lower() in ("id", "strid") and isinstance(a.args[0], A.Var) and a.args[0].name in free and self.names(b) <= set(self.scope):
                    n = free.pop(a.args[0].name)
                    key = fresh("key")
                    if not self.df.columns and self.one_row:
                        self.df = self.spark.range(1)
                    v = self.ev(self.prepared(b))
                    self.df = self.df.withColumn(key, (v.col["id"] if V.is_node(v.type) else v.col).cast("string")).where(F.col(f"`{key}`").isNotNull())
                    self.one_row = False
                    self.scope[n.var] = self.arrive(F.col(f"`{key}`"), A.NodePattern(n.var, (), None), None, set())
                    break
            else:
                rest.append(e)
        return rest

    def optional(self, c: A.Match) -> None:
        """Left outer join with the whole optional pattern, its condition included."""
        inner, shared, rest = self.standalone(c.patterns, c.where)
        on = self.same_nodes(shared, inner)
        both = self.child()
        both.scope = {**inner.scope, **self.scope}
        left, right = self.df, inner.df
        for e in rest:
            on = on & both.ev(e).col.cast("boolean")
        self.df = left.join(right, on, "left")
        self.scope = {**{k: v for k, v in inner.scope.items() if k not in self.scope}, **self.scope}
        self.one_row = False

    def standalone(self, patterns: list, where, value=None) -> tuple[Compiler, list[str], list]:
        """Patterns matched on their own, the names they share with this scope, conditions that need this scope."""
        inner = Compiler(self.graph, self.params, writer=self.writer, procedures=self.procedures, unique=self.unique)
        inner.outer = self
        # A shared node has the label it has here; one that is only matched by its key is not scanned again.
        used = {n for e in [*conjuncts(where), value] if e is not None for n in self.names(e)}
        labels = {k: v.label for k, v in self.scope.items() if isinstance(v, NodeVar) and v.label}
        know = lambda n: dataclasses.replace(n, labels=(labels[n.var],)) if isinstance(n, A.NodePattern) and n.var in labels and not n.labels else n
        patterns = [dataclasses.replace(p, parts=tuple(know(n) for n in p.parts)) for p in patterns]
        inner.lazy = {k for k in labels if k not in used}
        for p in patterns:
            inner.pattern(p)
        deferred = inner.deferred if hasattr(inner, "deferred") else []
        rest = list(deferred)
        for e in conjuncts(where):
            if self.names(e) <= set(inner.scope):
                inner.filter(e)
            else:
                rest.append(e)
        shared = [k for k, v in inner.scope.items() if isinstance(v, NodeVar) and k in self.scope]
        return inner, shared, rest

    def same_nodes(self, shared: list[str], inner: Compiler) -> Column:
        on = F.lit(True)
        for k in shared:
            mine, theirs = self.node(k), inner.scope[k]
            on = on & ((mine.col("key") == theirs.col("key")) if mine.native and theirs.native and mine.label == theirs.label else (mine.col("id") == theirs.col("id")))
        return on

    def names(self, e) -> set[str]:
        """Variables that an expression needs from outside itself."""
        if isinstance(e, A.Var):
            return {e.name}
        if isinstance(e, A.MapProjection):
            return {e.of} | {n for c in children(e) for n in self.names(c)}
        inner = {n for c in children(e) for n in self.names(c)}
        if isinstance(e, (A.Comprehension, A.Quantifier)):
            return inner - {e.var}
        if isinstance(e, A.Reduce):
            return inner - {e.var, e.acc}
        if isinstance(e, A.PatternExpr):
            return inner | {p.var for p in e.pattern.parts if isinstance(p, A.NodePattern) and p.var}
        return inner

    def filter(self, where) -> None:
        for e in conjuncts(where):
            inverted = isinstance(e, A.Op) and e.op == "NOT"
            p = e.args[0] if inverted else e
            if isinstance(p, A.PatternExpr) and p.value is None:
                inner, shared, rest = self.standalone([p.pattern], p.where)
                both = self.child()
                both.scope = {**inner.scope, **self.scope}
                on = self.same_nodes(shared, inner)
                for r in rest:
                    on = on & both.ev(r).col
                self.df = self.df.join(inner.df, on, "left_anti" if inverted else "left_semi")
            else:
                v = self.ev(self.prepared(e))
                if isinstance(v.type, T.ArrayType):
                    self.df = self.df.where(F.size(v.col) > 0)
                elif isinstance(v.type, T.VariantType):
                    self.df = self.df.where(F.try_variant_get(v.col, "$", "boolean"))
                else:
                    self.df = self.df.where(v.col if isinstance(v.type, T.BooleanType) else F.lit(False))

    def prepared(self, e):
        """e with patterns inside it replaced by columns joined to the rows."""

        def swap(x):
            if isinstance(x, A.Call) and x.name.lower() == "size" and len(x.args) == 1 and isinstance(x.args[0], A.PatternExpr) and x.args[0].value is None:
                return self.attach(x.args[0], "count")
            if isinstance(x, A.PatternExpr):
                return self.attach(x, "exists" if x.value is None else "list")
            if isinstance(x, A.Call) and x.name.lower() in ("id", "strid") and len(x.args) == 1 and self.is_end(x.args[0]):
                return A.Call("endpointId", (A.Lit(x.args[0].name.lower()), *x.args[0].args), False, False)
            if self.is_end(x):
                return self.end_node(x)
            if isinstance(x, A.ShortestPath):
                return self.shortest(x.pattern)
            return None

        return replace(e, swap)

    def is_end(self, e) -> bool:
        """Whether e is startNode or endNode of a relationship of the rows (not of an element of a list)."""
        return isinstance(e, A.Call) and e.name.lower() in ("startnode", "endnode") and len(e.args) == 1 and all(n in self.scope for n in self.names(e.args[0]))

    def end_node(self, e: A.Call) -> A.Var:
        """A hidden variable of the node at an end of a relationship, fetched by its id."""
        name = fresh("#end")
        at = self.ev(e).col
        ends = getattr(self.scope.get(e.args[0].name), "ends", None) if isinstance(e.args[0], A.Var) else None
        labels = ends[e.name.lower() == "endnode"] if ends else {None}
        right, node = self.scan(name, self.graph.vertices if None in labels else [t for t in self.graph.vertices if t.label in labels])
        self.df = self.df.join(right, at == node.col("id"), "left")
        self.scope[name] = node
        return A.Var(name)

    def attach(self, p: A.PatternExpr, what: str):
        inner, shared, rest = self.standalone([p.pattern], p.where, p.value)
        if rest:
            raise CompileProblem("a pattern inside an expression may use outer nodes only")
        keys = [(self.node(k), inner.scope[k], fresh(k)) for k in shared]
        out = fresh(what)
        value = inner.ev(p.value) if what == "list" else None
        by = lambda a, b: "key" if a.native and b.native and a.label == b.label else "id"
        rows = inner.df.select(*[theirs.col(by(mine, theirs)).alias(n) for mine, theirs, n in keys], *([value.col.alias(out)] if value else []))
        agg = F.collect_list(out) if value else F.count(F.lit(1))
        rows = rows.groupBy(*[n for *_, n in keys]).agg(agg.alias(out))
        on = F.lit(True)
        for mine, theirs, n in keys:
            on = on & (mine.col(by(mine, theirs)) == F.col(f"`{n}`"))
        self.df = self.df.join(rows, on, "left").drop(*[n for *_, n in keys])
        c = F.col(f"`{out}`")
        t = T.ArrayType(value.type) if value else LONG if what == "count" else BOOL
        c = F.coalesce(c, F.array().cast(t)) if value else F.coalesce(c, F.lit(0)) if what == "count" else c.isNotNull()
        self.df = self.df.withColumn(out, c)
        self.scope_hidden(out, t)
        return A.Var(out)

    def scope_hidden(self, name: str, t: T.DataType) -> None:
        self.hidden = {**getattr(self, "hidden", {}), name: ValueVar(name, t)}

    # Patterns
    def node(self, name: str) -> NodeVar:
        v = self.scope.get(name)
        if isinstance(v, NodeVar):
            return v
        if isinstance(v, ValueVar) and V.is_node(v.type):
            s, t = F.col(f"`{v.name}`"), v.type["properties"].dataType
            n = NodeVar(fresh(name), None, {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else {})
            self.df = self.df.withColumns({n.name("id"): s["id"], n.name("labels"): s["labels"], **{n.name("p·" + k): s["properties"][k] for k in n.props}})
        elif isinstance(v, ValueVar) and isinstance(v.type, T.StringType):
            n = NodeVar(fresh(name), None, {}, loaded=False)
            self.df = self.df.withColumns({n.name("id"): F.col(f"`{v.name}`")})
        else:
            raise CompileProblem(f"{name} is no node")
        self.scope[name] = n
        return n

    def scan(self, name: str, tables: list[VertexTable]) -> tuple[DataFrame, NodeVar]:
        """Rows of these tables as columns of a node variable."""
        prefix = fresh(name)
        if len(tables) == 1:
            t = tables[0]
            n = NodeVar(prefix, t.label, {p: t.type_of(p) for p in t.props}, native=t.label is not None)
            labels = F.col("labels") if t.label is None else F.array(F.lit(t.label))
            return t.df.select(t.gid().cast("string").alias(n.name("id")), *([F.col(t.key).alias(n.name("key"))] if n.native else []), labels.alias(n.name("labels")), *[F.col(p).alias(n.name("p·" + p)) for p in t.props]), n
        types: dict[str, T.DataType] = {}
        for t in tables:
            for p in t.props:
                types[p] = t.type_of(p) if p not in types else V.common([types[p], t.type_of(p)]) or STRING
        n = NodeVar(prefix, None, types)
        out = None
        for t in tables:
            labels = F.col("labels") if t.label is None else F.array(F.lit(t.label))
            part = t.df.select(t.gid().cast("string").alias(n.name("id")), labels.alias(n.name("labels")), *[(F.col(p) if p in t.props else F.lit(None)).cast(x).alias(n.name("p·" + p)) for p, x in types.items()])
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([T.StructField(n.name("id"), STRING), T.StructField(n.name("labels"), T.ArrayType(STRING))]))
        return out, n

    def label_tests(self, n: NodeVar, labels: tuple) -> Column | None:
        out = None
        for group in label_groups(labels):
            test = F.lit(True) if n.label in group else F.arrays_overlap(n.col("labels"), F.array(*[F.lit(x) for x in group])) if len(group) > 1 else F.array_contains(n.col("labels"), group[0])
            out = test if out is None else out & test
        return out

    def constrain(self, n: NodeVar, p: A.NodePattern) -> None:
        test = self.label_tests(n, p.labels)
        if test is not None and not all(n.label in g for g in label_groups(p.labels)):
            self.df = self.df.where(F.coalesce(test, F.lit(False)))
        if isinstance(p.props, A.MapLit):
            for k, e in p.props.items:
                outer = getattr(self, "outer", None)
                if outer is not None and not self.names(e) <= set(self.scope):
                    self.deferred = [*getattr(self, "deferred", []), A.Op("=", (A.Prop(A.Var(p.var), k), e))]
                    continue
                have = n.prop(k)
                self.df = self.df.where(V.equals(have, self.ev(e)) if have else F.lit(False))
        elif isinstance(p.props, A.Param):
            for k, x in (self.params.get(p.props.name) or {}).items():
                have = n.prop(k)
                self.df = self.df.where(V.equals(have, V.lit(x)) if have else F.lit(False))

    def cross(self, right: DataFrame) -> None:
        """Rows beside rows; a later equality makes Catalyst join on it."""
        self.df = right if self.one_row and not self.df.columns else self.df.crossJoin(right)
        self.one_row = False

    def start(self, p: A.NodePattern, ends: set | None = None) -> NodeVar:
        """The first node of a pattern; `ends` are the labels that its relationships allow."""
        if p.var and p.var in self.scope:
            n = self.node(p.var)
        else:
            tables = self.graph.tables(label_groups(p.labels))
            if ends and None not in ends:
                tables = [t for t in tables if t.label is None or t.label in ends]
            right, n = self.scan(p.var or "anon", tables)
            self.cross(right)
            self.scope[p.var or n.prefix] = n
        self.constrain(n, p)
        return n

    def pattern(self, p: A.Pattern) -> None:
        if isinstance(p.parts[0], A.ShortestPath):
            v = self.shortest(p.parts[0].pattern)
            if p.var:
                self.scope[p.var] = self.hidden[v.name]
            self.df = self.df.where(F.col(f"`{v.name}`").isNotNull())
            return
        nodes, rels = p.parts[::2], p.parts[1::2]
        at = next((i for i, n in enumerate(nodes) if n.var and n.var in self.scope), None)
        if at is None:
            free = [i for i, n in enumerate(nodes) if n.var not in self.lazy or n.props is not None] or [0]
            at = min(free, key=lambda i: (self.growth(nodes, rels, i), i))
        ends = None
        if rels and not nodes[at].labels:
            r, right = (rels[at], True) if at < len(rels) else (rels[at - 1], False)
            if not (r.variable and r.low == 0):
                ways = self.graph.edge_tables(list(r.types))
                out = (r.direction == "out") == right
                ends = {e.src_label for e in ways if out or r.direction == "both"} | {e.dst_label for e in ways if not out or r.direction == "both"}
        bound: dict[int, NodeVar] = {at: self.start(nodes[at], ends)}
        steps: dict[int, Column] = {}
        for i in range(at, len(rels)):
            bound[i + 1], steps[i] = self.expand(bound[i], rels[i], nodes[i + 1], False)
        for i in range(at - 1, -1, -1):
            bound[i], steps[i] = self.expand(bound[i + 1], rels[i], nodes[i], True)
        if p.var:
            name = fresh(p.var)
            ids = F.array(*[bound[i].col("id") for i in range(len(nodes))])
            parts = F.concat(*[steps[i] for i in range(len(rels))]) if rels else F.array().cast(T.ArrayType(REL))
            if any(r.variable for r in rels):
                ids = F.concat(F.array(bound[0].col("id")), F.transform(parts, lambda r: r["end"]))
            self.df = self.df.withColumn(name, F.struct(ids.alias("nodes"), parts.alias("relationships")))
            self.scope[p.var] = ValueVar(name, PATH)

    def growth(self, nodes: tuple, rels: tuple, at: int) -> float:
        """How many steps from this node on can lead to many nodes: those against a foreign key, and those not known."""
        seen, cost = {nodes[at].var}, -0.5 if nodes[at].props is not None else 0.0
        for i in [*range(at, len(rels)), *range(at - 1, -1, -1)]:
            r, (a, b) = rels[i], (nodes[i], nodes[i + 1]) if i >= at else (nodes[i + 1], nodes[i])
            if b.var is None or b.var not in seen:
                one = [g[0] for g in label_groups(a.labels) if len(g) == 1 and self.graph.table(g[0])]
                ways = self.oriented(NodeVar("", one[0] if one else None, {}), r, [g[0] for g in label_groups(b.labels) if len(g) == 1], i < at)
                e, flipped = ways[0] if len(ways) == 1 and not r.variable else (None, False)
                cost += 0 if e is not None and e.inline and (e.inline == "dst") == flipped else 1
            seen.add(b.var)
        return cost

    def oriented(self, a: NodeVar, rel: A.RelPattern, b_labels: list[str], back: bool) -> list[tuple[EdgeTable, bool]]:
        """Edge tables that can lead from a, and whether against their direction."""
        d = rel.direction if not back or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]
        fits = lambda want, have: have is None or want is None or want == have
        goal = next((x for x in b_labels if self.graph.table(x)), None)
        out = []
        for e in self.graph.edge_tables(list(rel.types)):
            if d in ("out", "both") and fits(a.label, e.src_label) and fits(goal, e.dst_label):
                out.append((e, False))
            if d in ("in", "both") and fits(a.label, e.dst_label) and fits(goal, e.src_label):
                out.append((e, True))
        return out

    def expand(self, a: NodeVar, rel: A.RelPattern, p: A.NodePattern, back: bool) -> tuple[NodeVar, Column]:
        """One relationship further: the node there, and the relationships taken as an array."""
        known = self.node(p.var) if p.var and p.var in self.scope else None
        labels = [g[0] for g in label_groups(p.labels) if len(g) == 1] + ([known.label] if known is not None and known.label else [])
        if rel.props is not None and rel.props.items:
            self.df = self.df.where(F.lit(False))  # relationships have no properties
        ways = self.oriented(NodeVar("", None, {}) if rel.variable else a, rel, [] if rel.variable else labels, back)
        if rel.variable:
            return self.walk(a, rel, p, ways, known, back)
        if len(ways) == 1 and ways[0][0].src_label and ways[0][0].dst_label and a.native:
            b, start, end, kind = self.native_step(a, p, *ways[0], known)
        else:
            b, start, end, kind = self.generic_step(a, rel, p, ways, known)
        if p.var and p.var not in self.scope:
            self.scope[p.var] = b
        elif p.var is None:
            self.scope[b.prefix] = b
        self.constrain(b, p)
        if self.unique:
            tables = {id(e) for e, _ in ways}
            for other, s, t in self.edges_seen:
                if other & tables:
                    self.df = self.df.where(~(s.eqNullSafe(start) & t.eqNullSafe(end)))
            self.edges_seen.append((tables, start, end))
        step = F.struct(start.alias("start"), kind.alias("type"), end.alias("end"))
        if rel.var:
            name = fresh(rel.var)
            self.df = self.df.withColumn(name, step)
            self.scope[rel.var] = ValueVar(name, REL, tuple({getattr(e, x) for e, _ in ways} for x in ("src_label", "dst_label")))
        return b, F.array(step)

    def native_step(self, a: NodeVar, p: A.NodePattern, e: EdgeTable, flipped: bool, known: NodeVar | None):
        """Along one edge table between two known vertex tables, by their own keys."""
        near, far, far_label = (e.dst, e.src, e.src_label) if flipped else (e.src, e.dst, e.dst_label)
        table = self.graph.table(far_label)
        inline = e.inline and (e.inline == "src") == flipped  # the far vertex's row holds the near key
        at_near = e.inline and not inline
        if at_near and a.loaded and far in a.props:
            key = a.col("p·" + far)
        elif inline and known is not None and known.loaded and known.label == far_label and near in known.props:
            self.df = self.df.where(known.col("p·" + near) == a.col("key"))
            return self.ends(a, known, e, flipped) + (F.lit(e.type),)
        elif inline and known is None:
            right, b = self.scan(p.var or "anon", [table])
            if near not in b.props:
                raise CompileProblem(f"{near} is no column of {far_label}")
            self.df = self.df.join(right, a.col("key") == b.col("p·" + near))
            return self.ends(a, b, e, flipped) + (F.lit(e.type),)
        else:
            k, f = fresh("near"), fresh("far")
            links = e.df.select(F.col(near).alias(k), F.col(far).alias(f)).where(F.col(f"`{k}`").isNotNull() & F.col(f"`{f}`").isNotNull())
            if not e.inline:
                links = links.distinct()
            self.df = self.df.join(links, a.col("key") == F.col(f"`{k}`"))
            key = F.col(f"`{f}`")
        if known is not None:
            self.df = self.df.where(known.col("key") == key if known.native and known.label == far_label else known.col("id") == table.gid(key))
            return self.ends(a, known, e, flipped) + (F.lit(e.type),)
        if (p.var is None or p.var in self.lazy) and p.props is None:  # nobody looks at this vertex: its key will do
            b = NodeVar(fresh(p.var or "anon"), far_label, {}, native=True, loaded=False)
            self.df = self.df.where(key.isNotNull()).withColumns({b.name("key"): key, b.name("id"): table.gid(key)})
        else:
            right, b = self.scan(p.var or "anon", [table])
            self.df = self.df.join(right, key == b.col("key"))
        return self.ends(a, b, e, flipped) + (F.lit(e.type),)

    @staticmethod
    def ends(a: NodeVar, b: NodeVar, e: EdgeTable, flipped: bool):
        return (b, b.col("id"), a.col("id")) if flipped else (b, a.col("id"), b.col("id"))

    def steps_table(self, ways: list[tuple[EdgeTable, bool]], types: tuple) -> DataFrame:
        """(from, to, start, type, end) along these edge tables."""
        out = None
        for e, flipped in ways:
            g = e.generic()
            if e.type == "*" and types:
                g = g.where(F.col("type").isin(list(types)))
            one = g.select(F.col("to" if flipped else "from").alias("from"), F.col("from" if flipped else "to").alias("to"), F.col("from").alias("start"), "type", F.col("to").alias("end"))
            if flipped and any(x is e and not y for x, y in ways):
                one = one.where("`start` <> `end`")  # a loop is met once
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "`from` string, `to` string, `start` string, `type` string, `end` string")

    def generic_step(self, a: NodeVar, rel: A.RelPattern, p: A.NodePattern, ways, known: NodeVar | None):
        k = fresh("e")
        names = {c: f"{k}·{c}" for c in ("from", "to", "start", "type", "end")}
        steps = self.steps_table(ways, rel.types).select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        at = {c: F.col(f"`{n}`") for c, n in names.items()}
        self.df = self.df.join(steps, a.col("id") == at["from"])
        b = self.arrive(at["to"], p, known, {(e.src_label if f else e.dst_label) for e, f in ways})
        return b, at["start"], at["end"], at["type"]

    def arrive(self, to: Column, p: A.NodePattern, known: NodeVar | None, far: set) -> NodeVar:
        """The node with the id `to`; an id without a row is an empty node."""
        if known is not None:
            self.df = self.df.where(known.col("id") == to)
            return known
        tables = self.graph.tables(label_groups(p.labels))
        if far and None not in far:
            tables = [t for t in tables if t.label is None or t.label in far]
        if p.var is None and p.props is None and not p.labels:
            b = NodeVar(fresh("anon"), None, {}, loaded=False)
            self.df = self.df.withColumn(b.name("id"), to)
            return b
        right, b = self.scan(p.var or "anon", tables)
        bare = not p.labels and p.props is None
        self.df = self.df.join(right, to == b.col("id"), "left" if bare else "inner")
        if bare:
            self.df = self.df.withColumn(b.name("id"), F.coalesce(b.col("id"), to)).withColumn(b.name("labels"), F.coalesce(b.col("labels"), F.array().cast("array<string>")))
        return b

    def walk(self, a: NodeVar, rel: A.RelPattern, p: A.NodePattern, ways, known, back: bool) -> tuple[NodeVar, Column]:
        """Variable length: hop by hop, no relationship twice on a path. Long or open ranges stop when no path goes on."""
        low, high = rel.low, MOST_HOPS if rel.high is None else min(rel.high, MOST_HOPS)
        steps = self.steps_table(ways, rel.types).select(F.col("from").alias("w·from"), F.col("to").alias("w·to"), F.struct("start", "type", "end").alias("w·step"))
        at, taken = fresh("at"), fresh("path")
        base = self.df.columns
        now = self.df.withColumn(at, a.col("id")).withColumn(taken, F.array().cast(T.ArrayType(REL)))
        levels = [now] if low == 0 else []
        lazy = high <= 4
        if not lazy:
            steps = settle(steps)
        for hop in range(1, high + 1):
            j = now.join(steps, F.col(f"`{at}`") == F.col("`w·from`")).where(~F.array_contains(F.col(f"`{taken}`"), F.col("`w·step`")))
            add = F.array(F.col("`w·step`"))
            grown = F.concat(add, F.col(f"`{taken}`")) if back else F.concat(F.col(f"`{taken}`"), add)
            now = j.select(*[F.col(f"`{c}`") for c in base], F.col("`w·to`").alias(at), grown.alias(taken))
            if not lazy:
                now = settle(now)
                if now.isEmpty():
                    break
            if hop >= low:
                levels.append(now)
        out = levels[0] if levels else now.limit(0)
        for x in levels[1:]:
            out = out.unionByName(x)
        self.df = out
        b = self.arrive(F.col(f"`{at}`"), p, known, {(e.src_label if f else e.dst_label) for e, f in ways} | ({a.label} if low == 0 else set()))
        if p.var and p.var not in self.scope:
            self.scope[p.var] = b
        elif p.var is None:
            self.scope[b.prefix] = b
        self.constrain(b, p)
        if rel.var:
            self.scope[rel.var] = ValueVar(taken, T.ArrayType(REL))
        return b, F.col(f"`{taken}`")

    def shortest(self, p: A.Pattern):
        """One shortest path for each row's pair of bound nodes, by frontiers that keep one path to each node."""
        first, rel, last = p.parts
        a, b = self.node(first.var), self.node(last.var)
        high = MOST_SHORTEST if rel.high is None else rel.high
        steps = settle(self.steps_table(self.oriented(NodeVar("x", None, {}), rel, [], False), rel.types))
        pairs = settle(self.df.select(a.col("id").alias("s"), b.col("id").alias("t")).distinct())
        now = pairs.select("s", "t", F.col("s").alias("at"), F.array(F.col("s")).alias("nodes"), F.array().cast(T.ArrayType(REL)).alias("rels"))
        found = now.where("s = t").limit(0)
        seen = now.select("s", "t", "at")
        for hop in range(1, high + 1):
            j = now.join(steps, F.col("at") == F.col("from")).select("s", "t", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("rels", F.array(F.struct("start", "type", "end"))).alias("rels"))
            now = settle(j.join(seen, ["s", "t", "at"], "left_anti").groupBy("s", "t", "at").agg(F.min(F.struct("nodes", "rels")).alias("x")).select("s", "t", "at", "x.nodes", "x.rels"))
            if now.isEmpty():
                break
            if hop >= (rel.low or 1):
                found = found.unionByName(now.where("at = t"))
            arrived = now.where("at = t").select("s", "t")
            seen = seen.unionByName(now.select("s", "t", "at"))
            now = now.join(arrived, ["s", "t"], "left_anti")
        out, s, t = fresh("path"), fresh("s"), fresh("t")
        found = found.select(F.col("s").alias(s), F.col("t").alias(t), F.struct("nodes", F.col("rels").alias("relationships")).alias(out))
        self.df = self.df.join(found, (a.col("id") == F.col(f"`{s}`")) & (b.col("id") == F.col(f"`{t}`")), "left").drop(s, t)
        self.scope_hidden(out, PATH)
        return A.Var(out)

    # Other reading clauses
    def do_unwind(self, c: A.Unwind) -> None:
        v = self.ev(self.prepared(c.source))
        name = fresh(c.var)
        if isinstance(v.type, T.VariantType):
            v = Val(F.coalesce(v.col.try_cast("array<variant>"), F.when(v.col.isNotNull(), F.array(v.col))), T.ArrayType(v.type))
        if v.type == PATH:
            v = Val(v.col["relationships"], T.ArrayType(REL))
        if V.is_null(v.type):
            self.df, t = self.df.withColumn(name, F.lit(None)).limit(0), T.NullType()
        elif isinstance(v.type, T.ArrayType):
            self.df, t = self.df.withColumn(name, F.explode(v.col)), v.type.elementType
        else:
            self.df, t = self.df.withColumn(name, F.explode(F.when(v.col.isNotNull(), F.array(v.col)).otherwise(F.array().cast(T.ArrayType(v.type))))), v.type
        self.scope[c.var] = ValueVar(name, t)
        self.one_row = False

    def do_loadcsv(self, c: A.LoadCsv) -> None:
        rows = self.spark.read.option("header", c.headers).option("sep", c.separator).option("quote", '"').option("escape", '"').csv(self.constant(c.url))
        name = fresh(c.var)
        cols = [F.col(f"`{x}`") for x in rows.columns]
        value = F.struct(*cols) if c.headers else F.array(*cols)
        t = T.StructType([T.StructField(x, STRING) for x in rows.columns]) if c.headers else T.ArrayType(STRING)
        self.cross(rows.select(value.alias(name)))
        self.scope[c.var] = ValueVar(name, t)

    def do_callproc(self, c: A.CallProc) -> None:
        from weftgraph import procedures

        procedures.run(self, c)
        if c.where is not None:
            self.filter(c.where)

    def do_subquery(self, c: A.SubQuery) -> None:
        if c.recursive is not None:
            return self.recursive(c)
        row = fresh("row")
        self.df = settle(self.df.withColumn(row, F.monotonically_increasing_id()))
        outs = []
        for clauses in c.query.branches:
            inner = self.child()
            inner.row, inner.row_ids, inner.one_row = row, self.df.select(row), False
            first, rest = clauses[0], clauses
            plain = isinstance(first, A.Projection) and not first.final and all(isinstance(e, A.Var) and e.name == n for e, n in first.items) and not first.where and first.limit is None
            if plain and not first.star:
                inner.scope, rest = {n: self.scope[n] for _, n in first.items}, clauses[1:]
            elif not (plain and first.star):
                inner.scope = {}
            else:
                rest = clauses[1:]
            inner.run(rest)
            outs.append(inner)
        out = outs[0].flat()
        for nxt, every in zip(outs[1:], c.query.everything):
            out = out.union(nxt, every)
        got = out.df.withColumnRenamed(row, row + "'")
        self.df = self.df.join(got, F.col(f"`{row}`") == F.col(f"`{row}'`"), "inner").drop(row, row + "'")
        self.scope |= out.scope

    def recursive(self, c: A.SubQuery) -> None:
        """Run the body on its own results: rows that are done come out, the others' variables go in again."""
        row = fresh("row")
        self.df = settle((self.df if self.df.columns else self.spark.range(1)).withColumn(row, F.monotonically_increasing_id()))
        self.one_row = False
        now = self.child()
        now.row = row
        now.project(A.Projection(c.recursive, False, False, [], None, None, None, False))
        now = now.flat()
        types = {k: v.type for k, v in now.scope.items()}
        names, done = None, None
        for _ in range(MOST_HOPS):
            step = Compiler(self.graph, self.params, now.df, now.scope, self.writer, self.procedures, self.unique)
            step.row, step.one_row = row, False
            step.query(c.query)
            step = step.flat()
            step.df = settle(step.df)
            missing = [k for k in types if k not in step.scope]
            if missing:
                raise CompileProblem(f"the recursive part does not return {', '.join(missing)}")
            names = names or {k: (fresh(k), v.type) for k, v in step.scope.items()}
            end = F.coalesce(step.ev(c.until).col, F.lit(False))
            part = step.df.where(end).select(row, *[F.col(f"`{step.scope[k].name}`").cast(t).alias(n) for k, (n, t) in names.items()])
            done = part if done is None else done.unionByName(part)
            rest = step.df.where(~end)
            if rest.isEmpty():
                break
            again = {k: fresh(k) for k in types}
            now = self.child()
            now.df = rest.select(row, *[F.col(f"`{step.scope[k].name}`").cast(t).alias(again[k]) for k, t in types.items()])
            now.scope = {k: ValueVar(again[k], t) for k, t in types.items()}
        else:
            raise CompileProblem(f"CALL RECURSIVELY has rows that are not done after {MOST_HOPS} rounds")
        self.df = self.df.join(done.withColumnRenamed(row, row + "'"), F.col(f"`{row}`") == F.col(f"`{row}'`")).drop(row, row + "'")
        self.scope |= {k: ValueVar(n, t) for k, (n, t) in names.items()}

    # Projections
    def do_projection(self, c: A.Projection) -> None:
        self.project(c)

    def project(self, c: A.Projection) -> None:
        items = [(A.Var(k), k) for k in self.scope if c.star and "#" not in k] + list(c.items)
        items = [(self.prepared(e), n) for e, n in items]
        order = [(self.prepared(e), up) for e, up in c.order]
        if any(has_aggregate(e) for e, _ in items) or any(has_aggregate(e) for e, _ in order):
            items, order = self.group(items, order)
        new: dict = {}
        add = {}
        for e, n in items:
            if n in new:
                raise CompileProblem(f"column {n} twice")
            v = self.scope.get(e.name) if isinstance(e, A.Var) else None
            if isinstance(v, NodeVar):
                new[n] = v
            else:
                x = self.ev(e)
                name = fresh(n)
                add[name] = x.col.cast("string") if V.is_null(x.type) else x.col
                new[n] = ValueVar(name, x.type)
        self.df = self.df.withColumns(add)
        if c.distinct:
            self.df = self.distinct_rows(self.df, list(new.values()))
        if order:
            both = self.child()
            both.hidden = getattr(self, "hidden", {})
            same = {repr(e): n for e, n in items}
            both.scope = {**({} if c.distinct else self.scope), **new}
            keys = []
            for e, up in order:
                e = A.Var(same[repr(e)]) if repr(e) in same else e
                keys += V.sort_keys(both.ev(e), up)
            if self.row and (c.limit is not None or c.skip is not None):
                self.per_row(c, keys)
            else:
                self.df = self.df.orderBy(*keys)
        elif self.row and (c.limit is not None or c.skip is not None):
            self.per_row(c, [F.lit(0)])
        if not self.row:
            if c.skip is not None:
                self.df = self.df.offset(max(0, int(self.constant(c.skip))))
            if c.limit is not None:
                self.df = self.df.limit(int(self.constant(c.limit)))
        keep = list(dict.fromkeys(x for v in new.values() for x in v.columns()))
        self.df = self.df.select(*([self.row] if self.row else []), *[F.col(f"`{x}`") for x in keep])
        self.scope = new
        if c.where is not None:
            self.filter(c.where)

    def per_row(self, c: A.Projection, keys: list[Column]) -> None:
        """Skip and limit within each outer row of a subquery."""
        rn, skip = fresh("rn"), int(self.constant(c.skip)) if c.skip is not None else 0
        self.df = self.df.withColumn(rn, F.row_number().over(W.partitionBy(self.row).orderBy(*keys)))
        test = F.col(f"`{rn}`") > skip
        if c.limit is not None:
            test = test & (F.col(f"`{rn}`") <= skip + int(self.constant(c.limit)))
        self.df = self.df.where(test).drop(rn)

    def distinct_rows(self, df: DataFrame, vars_: list) -> DataFrame:
        keys, extra = [self.row] if self.row else [], {}
        for v in vars_:
            if isinstance(v, NodeVar):
                keys.append(v.name("id"))
            elif isinstance(v.type, (T.MapType, T.VariantType)):
                extra[fresh("key")] = F.to_json(F.col(f"`{v.name}`"))
            else:
                keys.append(v.name)
        df = df.withColumns(extra) if extra else df
        return df.dropDuplicates([*keys, *extra]).drop(*extra)

    def group(self, items: list, order: list) -> tuple[list, list]:
        """groupBy on the items without aggregates; gives back items and order over the grouped rows."""
        keys, aggs, found, none, ranked = {}, {}, {}, {}, {}
        new_scope: dict = {}
        first = {}
        for e, n in items:
            if has_aggregate(e):
                continue
            v = self.scope.get(e.name) if isinstance(e, A.Var) else None
            if isinstance(v, NodeVar):
                keys[v.name("id")] = v.col("id")
                first |= {x: F.first(F.col(f"`{x}`")).alias(x) for x in v.columns() if x != v.name("id")}
                new_scope[n] = v
            else:
                x = self.ev(e)
                if V.is_null(x.type):
                    x = Val(x.col.cast("string"), STRING)
                name = fresh(n)
                if isinstance(x.type, (T.VariantType, T.MapType)):
                    keys[fresh("key")] = F.to_json(x.col)
                    first[name] = F.first(x.col).alias(name)
                else:
                    keys[name] = x.col
                new_scope[n] = ValueVar(name, x.type)

        def by_rank(x) -> bool:
            """Percentiles but percentileCont of a constant that is no fraction, which Spark's own refuses."""
            if not x.name.lower().startswith("percentile"):
                return False
            p = self.constant(x.args[1]) if isinstance(x.args[1], (A.Lit, A.Param)) and not (isinstance(x.args[1], A.Param) and x.args[1].name in self.scope) else 0
            return x.name.lower() == "percentiledisc" or isinstance(p, (int, float)) and 0 <= p <= 1

        def swap(x):
            if isinstance(x, A.Call) and x.name.lower() in aggregates.NAMES:
                if repr(x) not in found:
                    name = fresh(x.name)
                    node = self.scope.get(x.args[0].name) if x.args and isinstance(x.args[0], A.Var) and x.name.lower() == "count" else None
                    # A node counts by its id; its properties are not read for that.
                    args = [Val(node.col("id"), STRING)] if isinstance(node, NodeVar) else [self.ev(self.prepared(y)) for y in x.args]
                    if by_rank(x):
                        discrete = x.name.lower() == "percentiledisc"
                        ranked[name] = (*args[:2], discrete)
                        v = Val(F.col(f"`{name}`"), args[0].type if discrete else DOUBLE)
                    else:
                        v = aggregates.aggregate(x.name, args, x.distinct, x.star)
                        aggs[name] = v.col.alias(name)
                    none[name] = F.lit(0) if x.name.lower() in ("count", "sum", "stdev", "stdevp") and not isinstance(v.type, T.DayTimeIntervalType) else F.array().cast(v.type) if x.name.lower() == "collect" else None
                    found[repr(x)] = name
                    new_scope[name] = ValueVar(name, v.type)
                return A.Var(found[repr(x)])
            same = next((n for e, n in items if n in new_scope and e == x), None)
            return A.Var(same) if same is not None and not isinstance(x, A.Lit) else None

        out = [(A.Var(n) if not has_aggregate(e) else replace(e, swap), n) for e, n in items]
        aliases = {n for _, n in items}
        sorts = [(e if isinstance(e, A.Var) and e.name in aliases else replace(e, swap), up) for e, up in order]
        by = ([F.col(self.row)] if self.row else []) + [c.alias(k) for k, c in keys.items()]
        if ranked and not self.df._jdf.queryExecution().analyzed().deterministic():
            self.df = settle(self.df)  # it is read for each percentile
        placed = [percentiles(self.df.select(*by, value.col.alias("value"), share.col.alias("share")), value, name, discrete) for name, (value, share, discrete) in ranked.items()]
        on = ([self.row] if self.row else []) + list(keys)
        self.df = self.df.groupBy(*by).agg(*aggs.values(), *first.values()) if aggs or first else self.df.select(*by).distinct() if by or not ranked else self.df.groupBy().agg(F.count(F.lit(1)).alias(fresh("n")))
        for p in placed:
            other = [fresh("by") for _ in on]
            p = p.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(on, other)], *[c for c in p.columns if c not in on])
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{o}`")) for k, o in zip(on, other)]
            self.df = self.df.join(p, reduce(and_, same) if same else F.lit(True), "left").drop(*other)
        if self.row and self.row_ids is not None and not keys:  # an outer row without inner rows still has its aggregates
            self.df = self.row_ids.join(self.df, self.row, "left").withColumns({k: F.coalesce(F.col(f"`{k}`"), c.cast(new_scope[k].type)) for k, c in none.items() if c is not None})
        self.scope = new_scope
        self.one_row = False
        return out, sorts

    # Writing clauses go to the writer
    def _write(self, what: str, c) -> None:
        if self.writer is None:
            raise CompileProblem("this graph is read-only")
        getattr(self.writer, what)(self, c)

    def do_create(self, c):
        self._write("create", c)

    def do_merge(self, c):
        self._write("merge", c)

    def do_setitems(self, c):
        self._write("set", c)

    def do_remove(self, c):
        self._write("remove", c)

    def do_delete(self, c):
        self._write("delete", c)

    def do_foreach(self, c):
        self._write("foreach", c)

    # Expressions
    def constant(self, e):
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Param):
            return self.params[e.name]
        if isinstance(e, A.ListLit):
            return [self.constant(x) for x in e.items]
        if isinstance(e, A.MapLit):
            return {k: self.constant(x) for k, x in e.items}
        return self.spark.range(1).select(self.ev(e).col.alias("x")).first()[0]

    def ev(self, e) -> Val:
        return getattr(self, "ev_" + type(e).__name__.lower())(e)

    def ev_lit(self, e: A.Lit) -> Val:
        return V.lit(e.value)

    def ev_param(self, e: A.Param) -> Val:
        if e.name in self.scope:
            return self.scope[e.name].value()
        if e.name not in self.params:
            raise CompileProblem(f"no parameter {e.name}")
        return V.lit(self.params[e.name])

    def ev_var(self, e: A.Var) -> Val:
        v = self.scope.get(e.name) or getattr(self, "hidden", {}).get(e.name)
        if v is None:
            raise CompileProblem(f"no variable {e.name}")
        return v.value()

    def ev_prop(self, e: A.Prop) -> Val:
        if isinstance(e.of, A.Var) and isinstance(self.scope.get(e.of.name), NodeVar):
            return self.scope[e.of.name].prop(e.key) or V.null()
        return self.get(self.ev(e.of), e.key)

    def get(self, v: Val, key: str) -> Val:
        t = v.type
        if V.is_node(t):
            p = t["properties"].dataType
            return Val(v.col["properties"][key], p[key].dataType) if isinstance(p, T.StructType) and key in p.names else V.null()
        if isinstance(t, T.StructType):
            return Val(v.col[key], t[key].dataType) if key in t.names and t != REL else V.null()
        if isinstance(t, T.MapType):
            return Val(F.try_element_at(v.col, F.lit(key)), t.valueType)
        if isinstance(t, T.VariantType):
            return Val(F.try_variant_get(v.col, f"$['{key}']", "variant"), t)
        return temporal.field(v, key) or V.null()

    def ev_index(self, e: A.Index) -> Val:
        v = self.ev(e.of)
        if isinstance(e.at, A.Lit) and isinstance(e.at.value, str):
            return self.get(v, e.at.value)
        i = self.ev(e.at)
        if V.is_null(v.type) or V.is_null(i.type):
            return V.null()
        if isinstance(v.type, T.ArrayType):
            at = i.col.cast("int")
            return Val(F.when(at >= 0, F.try_element_at(v.col, at + 1)).otherwise(F.try_element_at(v.col, F.when(at < 0, at))), v.type.elementType)
        if isinstance(v.type, T.VariantType):
            return Val(F.try_variant_get(v.col, F.concat(F.lit("$['"), i.col.cast("string"), F.lit("']")) if isinstance(i.type, T.StringType) else F.concat(F.lit("$["), i.col.cast("string"), F.lit("]")), "variant"), v.type)
        m = scalar._as_map(v)
        return Val(F.try_element_at(m.col, i.col), m.type.valueType)

    def ev_slice(self, e: A.Slice) -> Val:
        v = self.ev(e.of)
        n = F.size(v.col)
        fix = lambda c: F.when(c < 0, F.greatest(n + c, F.lit(0))).otherwise(F.least(c, n))
        a = fix(self.ev(e.start).col.cast("int")) if e.start is not None else F.lit(0)
        b = fix(self.ev(e.end).col.cast("int")) if e.end is not None else n
        return Val(F.slice(v.col, a + 1, F.greatest(b - a, F.lit(0))), v.type)

    def ev_listlit(self, e: A.ListLit) -> Val:
        return V.array([self.ev(x) for x in e.items])

    def ev_maplit(self, e: A.MapLit) -> Val:
        return V.struct([(k, self.ev(x)) for k, x in e.items])

    def ev_mapprojection(self, e: A.MapProjection) -> Val:
        of = self.ev(A.Var(e.of))
        items: dict[str, Val] = {}
        if e.every:
            p = scalar._properties(of) if V.is_node(of.type) else of
            items = {f.name: Val(p.col[f.name], f.dataType) for f in p.type.fields}
        items |= {k: self.ev(x) for k, x in e.items}
        out = V.struct(list(items.items()))
        return Val(F.when(of.col.isNotNull(), out.col), out.type)

    def ev_haslabels(self, e: A.HasLabels) -> Val:
        v = self.scope.get(e.of.name) if isinstance(e.of, A.Var) else None
        if isinstance(v, NodeVar):
            return Val(self.label_tests(v, e.labels), BOOL)
        x = self.ev(e.of)
        out = F.lit(True)
        for label in e.labels:
            out = out & F.array_contains(x.col["labels"], label)
        return Val(out, BOOL)

    def ev_case(self, e: A.Case) -> Val:
        subject = self.ev(e.subject) if e.subject is not None else None
        tests = [V.equals(subject, self.ev(c)) if subject else self.ev(c).col.cast("boolean") for c, _ in e.whens]
        outs = [self.ev(v) for _, v in e.whens] + [self.ev(e.default)]
        t = V.common([o.type for o in outs])
        if t is None:
            t = T.VariantType()
        col = V.cast(outs[-1], t)
        for test, o in zip(reversed(tests), reversed(outs[:-1])):
            col = F.when(test, V.cast(o, t)).otherwise(col)
        return Val(col, t)

    def within(self, name: str, v: Val) -> Compiler:
        c = self.child()
        c.hidden = getattr(self, "hidden", {})
        c.scope = {**self.scope, name: Lambda(v)}
        return c

    def listed(self, e) -> Val:
        v = self.ev(e)
        return Val(F.lit(None).cast("array<string>"), T.ArrayType(STRING)) if V.is_null(v.type) else v

    def lambda_type(self, v: Val, var: str, e) -> T.DataType:
        return self.within(var, Val(F.lit(None).cast(v.type.elementType), v.type.elementType)).ev(e).type

    def ev_comprehension(self, e: A.Comprehension) -> Val:
        v = self.listed(e.source)
        el = v.type.elementType
        col, t = v.col, el
        if e.where is not None:
            col = F.filter(col, lambda x: self.within(e.var, Val(x, el)).ev(e.where).col)
        if e.value is not None:
            t = self.lambda_type(v, e.var, e.value)
            col = F.transform(col, lambda x: self.within(e.var, Val(x, el)).ev(e.value).col)
        return Val(col, T.ArrayType(t))

    def ev_quantifier(self, e: A.Quantifier) -> Val:
        v = self.listed(e.source)
        el = v.type.elementType
        test = lambda x: self.within(e.var, Val(x, el)).ev(e.where).col
        if e.kind == "all":
            return Val(F.forall(v.col, test), BOOL)
        if e.kind == "any":
            return Val(F.exists(v.col, test), BOOL)
        if e.kind == "none":
            return Val(~F.exists(v.col, test), BOOL)
        return Val(F.size(F.filter(v.col, test)) == 1, BOOL)

    def ev_reduce(self, e: A.Reduce) -> Val:
        v, start = self.listed(e.source), self.ev(e.start)
        el = v.type.elementType

        def step(t):
            c = self.within(e.var, Val(F.lit(None).cast(el), el)).within(e.acc, Val(F.lit(None).cast(t), t))
            return c.ev(e.value).type

        t = V.common([start.type, step(start.type)]) or step(start.type)
        fold = lambda acc, x: self.within(e.var, Val(x, el)).within(e.acc, Val(acc, t)).ev(e.value).col.cast(t)
        return Val(F.aggregate(v.col, start.col.cast(t), fold), t)

    def ev_call(self, e: A.Call) -> Val:
        name = e.name.lower()
        if name in aggregates.NAMES:
            raise CompileProblem(f"{e.name} outside of WITH or RETURN")
        one = self.scope.get(e.args[0].name) if len(e.args) == 1 and isinstance(e.args[0], A.Var) else None
        if isinstance(one, NodeVar):  # without building the whole node
            if name in ("id", "strid"):
                return Val(one.col("id"), STRING)
            if name == "labels" and one.loaded:
                return Val(one.col("labels"), T.ArrayType(STRING))
        if name in ("exists",):
            return Val(self.ev(e.args[0]).col.isNotNull(), BOOL)
        if name == "endpointid":
            return self.ev_call(A.Call(e.args[0].value, e.args[1:], False, False))
        if name in ("startnode", "endnode"):
            return Val(self.ev(e.args[0]).col["start" if name == "startnode" else "end"], STRING)
        return scalar.call(e.name, [self.ev(a) for a in e.args])

    def ev_op(self, e: A.Op) -> Val:
        op = e.op
        if op in ("IS NULL", "IS NOT NULL"):
            x = e.args[0]
            v = self.scope.get(x.name) if isinstance(x, A.Var) else None
            c = v.col("id") if isinstance(v, NodeVar) else self.ev(x).col
            return Val(c.isNull() if op == "IS NULL" else c.isNotNull(), BOOL)
        if op in ("=", "<>") and all(isinstance(a, A.Var) and isinstance(self.scope.get(a.name), NodeVar) for a in e.args):
            a, b = (self.scope[x.name].col("id") for x in e.args)
            return Val(a == b if op == "=" else a != b, BOOL)
        args = [self.ev(a) for a in e.args]
        truth = lambda v: v.col.cast("boolean") if V.is_null(v.type) else v.col if isinstance(v.type, T.BooleanType) else F.size(v.col) > 0 if isinstance(v.type, T.ArrayType) else F.try_variant_get(v.col, "$", "boolean")
        if op == "AND":
            return Val(truth(args[0]) & truth(args[1]), BOOL)
        if op == "OR":
            return Val(truth(args[0]) | truth(args[1]), BOOL)
        if op == "XOR":
            return Val(truth(args[0]) != truth(args[1]), BOOL)
        if op == "NOT":
            return Val(~truth(args[0]), BOOL)
        if op == "=":
            return Val(V.equals(*args), BOOL)
        if op == "<>":
            return Val(~V.equals(*args), BOOL)
        if op == "IN":
            x, xs = args
            if V.is_null(xs.type):
                return V.null()
            el = xs.type.elementType
            if V.is_null(el):
                return Val(F.when(F.size(xs.col) > 0, F.lit(None)).otherwise(F.lit(False)), BOOL)
            return Val(F.exists(xs.col, lambda y: V.equals(Val(y, el), x)), BOOL)
        if op in ("<", ">", "<=", ">="):
            return self.ordered(op, *args)
        if any(V.is_null(a.type) for a in args):
            return V.null()
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            if not all(isinstance(a.type, T.StringType) for a in args):
                args = [Val(F.try_variant_get(a.col, "$", "string"), STRING) if isinstance(a.type, T.VariantType) else a for a in args]
                if not all(isinstance(a.type, T.StringType) for a in args):
                    return V.null()
            a, b = args[0].col, args[1].col
            if op == "=~":
                return Val(F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), BOOL)
            return Val({"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a, b), BOOL)
        return self.arithmetic(op, args)

    def ordered(self, op: str, a: Val, b: Val) -> Val:
        if V.is_null(a.type) or V.is_null(b.type):
            return V.null()
        number = lambda v: Val(F.try_variant_get(v.col, "$", "double"), DOUBLE) if isinstance(v.type, T.VariantType) else v
        a, b = number(a), number(b)
        x, y, t = V.unite(a, b)
        if t is None:
            ok = (T.TimestampType, T.TimestampNTZType, T.DateType)
            if not (isinstance(a.type, ok) and isinstance(b.type, ok)):
                raise CompileProblem(f"{op} between {scalar.type_name(a.type)} and {scalar.type_name(b.type)}")
        out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if isinstance(t, T.DoubleType):  # NaN is not larger than anything
            out = out & ~F.isnan(x) & ~F.isnan(y)
        return Val(out, BOOL)

    def arithmetic(self, op: str, args: list[Val]) -> Val:
        args = [Val(F.try_variant_get(a.col, "$", "double"), DOUBLE) if isinstance(a.type, T.VariantType) else a for a in args]
        if op == "neg":
            return Val(-args[0].col, args[0].type)
        if op == "pos":
            return args[0]
        a, b = args
        x, y, s, t = a.col, b.col, a.type, b.type
        if op == "+":
            if isinstance(s, T.ArrayType) or isinstance(t, T.ArrayType):
                one = a if isinstance(s, T.ArrayType) else V.array([a])
                two = b if isinstance(t, T.ArrayType) else V.array([b])
                p, q, both = V.unite(one, two)
                return Val(F.concat(p, q), both)
            if isinstance(s, T.StringType) or isinstance(t, T.StringType):
                return Val(F.concat(x.cast("string"), y.cast("string")), STRING)
        moment = (T.TimestampType, T.TimestampNTZType, T.DateType)
        if isinstance(s, moment) or isinstance(t, moment) or isinstance(s, T.DayTimeIntervalType):
            out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y
            return Val(out, s if not (op == "-" and isinstance(t, moment)) else T.DayTimeIntervalType())
        if op == "^":
            return Val(F.pow(x.cast("double"), y.cast("double")), DOUBLE)
        if not (V.is_num(s) and V.is_num(t)):
            raise CompileProblem(f"{op} between {scalar.type_name(s)} and {scalar.type_name(t)}")
        whole = V.is_int(s) and V.is_int(t)
        x, y = x.cast("long" if whole else "double"), y.cast("long" if whole else "double")
        if op in ("+", "-", "*"):
            return Val({"+": x + y, "-": x - y, "*": x * y}[op], LONG if whole else DOUBLE)
        if whole:
            return Val(F.call_function("div", x, y) if op == "/" else x % y, LONG)
        if op == "%":
            return Val(F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y)), DOUBLE)
        at_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return Val(F.when(y == 0, at_zero).otherwise(x / F.when(y != 0, y)), DOUBLE)

