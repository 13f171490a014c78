"""Standing queries: patterns whose matches are reported, and taken back, as the graph changes.

A batch of events touches some nodes. Only the roots within the pattern's reach
of them can have new or lost matches: the pattern is evaluated for those roots
alone, by the same compiled plan as a whole evaluation, and the difference to
their stored rows is reported with signs. Matches depend on the final graph only,
so any order of arrival ends in the same set.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.engine import Engine, parsed
from weftgraph.plans import ast as A
from weftgraph.plans.compiler import Compiler, children
from weftgraph.session import settle
from weftgraph.streaming.events import BATCHES

ROOT = "·root"


class PatternProblem(ValueError):
    """Not a pattern that can stand."""


def validate(q: A.Query, mode: str = "MultipleValues") -> str:
    """Check the restrictions on standing patterns and give the root's variable."""
    if len(q.branches) != 1 or len(q.branches[0]) != 2 or not isinstance(q.branches[0][0], A.Match) or not isinstance(q.branches[0][1], A.Projection):
        raise PatternProblem("a standing query is MATCH ... WHERE ... RETURN ...")
    m, r = q.branches[0]
    if m.optional or r.order or r.skip is not None or r.limit is not None:
        raise PatternProblem("a standing query has no OPTIONAL, ORDER BY, SKIP or LIMIT")
    joined: dict[str, str] = {}

    def find(x):
        while joined.setdefault(x, x) != x:
            x = joined[x]
        return x

    names = []
    for p in m.patterns:
        if p.var:
            raise PatternProblem("no named paths")
        last = None
        for i, x in enumerate(p.parts):
            if isinstance(x, A.RelPattern):
                if len(x.types) != 1 or x.direction == "both" or x.variable or x.var:
                    raise PatternProblem("a relationship has one type, a direction, no variable and a fixed length")
                continue
            if not isinstance(x, A.NodePattern):
                raise PatternProblem("no shortest paths")
            name = x.var or f"anon{id(x)}"
            names.append(name)
            find(name)
            if last is not None:
                a, b = find(last), find(name)
                if a == b:
                    raise PatternProblem("the pattern has a cycle")
                joined[a] = b
            last = name
    if len({find(n) for n in names}) != 1:
        raise PatternProblem("the pattern is not connected")
    scanned = [v for kind, v in m.hints if kind == "SCAN"]
    ids = [e.args[0].name for e, _ in r.items if isinstance(e, A.Call) and e.name.lower() in ("id", "strid") and isinstance(e.args[0], A.Var)]
    if mode == "DistinctId" and not (r.distinct and len(r.items) == 1 and ids):
        raise PatternProblem("DistinctId returns DISTINCT id(n) alone")
    if mode == "MultipleValues" and r.distinct:
        raise PatternProblem("MultipleValues has no DISTINCT")
    first = next((n for n in names if not n.startswith("anon")), None)
    root = scanned[0] if scanned else ids[0] if len(ids) == 1 else first
    if root is None:
        raise PatternProblem("the pattern has no named node")
    return root


def patterns_in(e) -> list[A.PatternExpr]:
    """The patterns that stand anywhere in an expression."""
    return ([e] if isinstance(e, A.PatternExpr) else []) + [p for x in children(e) for p in patterns_in(x)]


def steps(e: A.PatternExpr) -> int:
    """The most steps from a pattern's start to its end."""
    out = 0
    for x in e.pattern.parts:
        if isinstance(x, A.RelPattern):
            if x.variable and x.high is None:
                raise PatternProblem("a pattern in WHERE or RETURN has a greatest length")
            out += x.high if x.variable else 1
    return out


def ways_from(root: str, m: A.Match, items: list) -> dict[str, list[tuple]] | None:
    """For each node of the pattern, seen from its root, the steps to its children: (types, direction, child).

    A pattern in WHERE or RETURN hangs on the node it starts at. None if it starts at no node of MATCH, or has a
    variable length: then the way back to the root is not known.
    """
    near: dict[str, list[tuple]] = {}
    flip = {"out": "in", "in": "out", "both": "both"}
    for p in m.patterns:
        names = [x.var or f"anon{id(x)}" for x in p.parts[::2]]
        for a, rel, b in zip(names, p.parts[1::2], names[1:]):
            near.setdefault(a, []).append((tuple(rel.types), rel.direction, b))
            near.setdefault(b, []).append((tuple(rel.types), flip[rel.direction], a))
        near.setdefault(names[0], [])
    tree: dict[str, list[tuple]] = {}
    todo = [(root, None)]
    while todo:
        v, parent = todo.pop()
        tree[v] = [(types, d, c) for types, d, c in near[v] if c != parent]
        todo += [(c, v) for _, _, c in tree[v]]
    inside = [p for x in (m.where, *(e for e, _ in items)) for p in patterns_in(x)]
    if sum(len(patterns_in(p)) for p in inside) != len(inside):
        return None  # one within another
    for e in inside:
        parts = e.pattern.parts
        if not isinstance(parts[0], A.NodePattern) or parts[0].var not in tree or any(isinstance(x, A.RelPattern) and x.variable for x in parts):
            return None
        at = parts[0].var
        for i, rel in enumerate(parts[1::2]):
            child = f"{id(e)}·{i}"
            tree[at].append((tuple(rel.types), rel.direction, child))
            tree[child] = []
            at = child
    return tree


class StandingQuery:
    def __init__(self, engine: Engine, name: str, text: str, mode: str = "MultipleValues", cancellations: bool = True, outputs: list | None = None, propagate: bool = True):
        self.engine, self.name, self.cancellations, self.outputs = engine, name, cancellations, outputs or []
        q = copy.deepcopy(parsed(text))
        self.root = validate(q, mode)
        m, r = q.branches[0]
        # A pattern in WHERE or RETURN can change a match as well: its steps reach beyond the nodes of MATCH.
        beyond = max((steps(p) for x in (m.where, *(e for e, _ in r.items)) for p in patterns_in(x)), default=0)
        self.reach = sum(isinstance(x, A.RelPattern) for p in m.patterns for x in p.parts) + beyond
        self.ways = ways_from(self.root, m, r.items)
        r.items = [*r.items, (A.Call("id", (A.Var(self.root),)), ROOT)]
        self.query = q
        self.results = settle(self.evaluate()) if propagate else None
        self.batches = 0
        engine.standing[name] = self

    def evaluate(self, roots: DataFrame | None = None) -> DataFrame:
        """All matches, or those of the roots (id)."""
        c = Compiler(self.engine.graph(), procedures=self.engine, unique=False)
        if roots is not None:
            c = Compiler(self.engine.graph(), df=roots.select(F.col("id").alias("root·id")), procedures=self.engine, unique=False)
            c.scope[self.root] = c.arrive(F.col("`root·id`"), A.NodePattern(self.root, (), None), None, set())
        c.query(self.query)
        return c.result()

    def affected(self, batch: DataFrame) -> DataFrame:
        """Roots within the pattern's reach of what the events touch, over edges there are and edges just dropped."""
        touched = batch.select(F.explode(F.array("node_id", "other")).alias("id")).where("id is not null").distinct()
        dropped = batch.where("other is not null").select(F.col("node_id").alias("src"), F.col("edge_type").alias("type"), F.col("other").alias("dst"))
        out = settle(touched)
        edges = self.engine.graph().edges[0].df.select("src", "type", "dst").unionByName(dropped)
        if self.ways is not None:
            return self.back(self.root, out, edges, {})[1]
        for _ in range(self.reach):
            ways = [edges.join(out, F.col("id") == F.col(a)).select(F.col(b).alias("id")) for a, b in (("src", "dst"), ("dst", "src"))]
            out = settle(out.unionByName(ways[0]).unionByName(ways[1]).distinct())
        return out

    def back(self, node: str, touched: DataFrame, edges: DataFrame, seen: dict) -> tuple[tuple, DataFrame]:
        """Nodes that can stand for a node of the pattern and have a touched one at or below it; equal branches are walked once."""
        steps = {}
        for types, direction, child in self.ways[node]:
            shape, below = self.back(child, touched, edges, seen)
            steps[types, direction, shape] = below
        key = tuple(sorted(steps, key=repr))
        if key not in seen:
            out = touched
            for (types, direction, _), below in steps.items():
                e = edges.where(F.col("type").isin(*types)) if types else edges
                for a, b, d in (("src", "dst", "out"), ("dst", "src", "in")):
                    if direction in (d, "both"):
                        out = out.unionByName(e.join(below, F.col("id") == F.col(b)).select(F.col(a).alias("id")))
            seen[key] = settle(out.distinct()) if steps else touched
        return key, seen[key]

    def process(self, batch: DataFrame, append: bool = True) -> DataFrame:
        """Add events to the graph; the changed matches as (data, meta.isPositiveMatch)."""
        batch = settle(batch)
        if append:
            self.engine.events.append(batch)
        roots = self.affected(batch)
        new = settle(self.evaluate(roots))
        near = roots.select(F.col("id").alias("root·id"))
        mine = F.col(f"`{ROOT}`") == F.col("`root·id`")
        if self.results is None:
            self.results = new.limit(0)
        for f in new.schema:  # a property's type can appear or widen as the graph grows
            if f.name in self.results.columns and self.results.schema[f.name].dataType != f.dataType:
                self.results = self.results.withColumn(f.name, F.col(f"`{f.name}`").cast(f.dataType))
        hit = self.results.join(near, mine, "left_semi")
        plus, minus = new.exceptAll(hit), hit.exceptAll(new)
        signed = plus.withColumn("_sign", F.lit(True))
        if self.cancellations:
            signed = signed.unionByName(minus.withColumn("_sign", F.lit(False)))
        data = [c for c in new.columns if c != ROOT]
        out = settle(signed.select(F.struct(*[F.col(f"`{c}`") for c in data]).alias("data"), F.struct(F.col("_sign").alias("isPositiveMatch")).alias("meta")))
        self.results, self.batches = self.results.join(near, mine, "left_anti").unionByName(new), self.batches + 1
        if self.batches % BATCHES == 0:  # its plan stays short
            self.results = settle(self.results)
        for o in self.outputs:
            o(out)
        return out

    def matches(self) -> DataFrame:
        """The rows that hold now."""
        return self.results.drop(ROOT)

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Follow a stream of events; at least once, and events that come again change nothing."""
        return events.writeStream.foreachBatch(lambda df, _: self.process(df) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
