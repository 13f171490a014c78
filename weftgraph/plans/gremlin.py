"""A subset of Gremlin traversals, step by step over the generic node and edge views."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.catalog import GraphCatalog
from weftgraph.functions.scalar import call
from weftgraph.functions.values import lit


class GremlinProblem(ValueError):
    """No traversal of this subset."""


@dataclass
class Step:
    name: str
    args: list


@dataclass
class Name:
    name: str


_TOKEN = re.compile(r"\s*(?:(?P<num>-?\d+\.\d+|-?\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>[().,\[\]=;:]))", re.S)


class _Parser:
    def __init__(self, text: str):
        self.t, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise GremlinProblem(f"unexpected {text[at]!r} at {at}")
            self.t.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.t.append(("end", ""))
        self.i = 0

    def peek(self, k=0):
        return self.t[min(self.i + k, len(self.t) - 1)][1]

    def next(self):
        self.i += 1
        return self.t[self.i - 1]

    def need(self, s):
        if self.next()[1] != s:
            raise GremlinProblem(f"expected {s!r}")

    def query(self):
        """Bindings `x = literal;` and then the traversal."""
        bind = {}
        while self.t[self.i][0] == "name" and self.peek(1) == "=":
            name = self.next()[1]
            self.need("=")
            bind[name] = self.arg(bind)
            self.need(";")
        if self.peek() != "g":
            raise GremlinProblem("a traversal begins with g")
        self.next()
        steps = self.steps(bind)
        if self.t[self.i][0] != "end":
            raise GremlinProblem(f"unexpected {self.peek()!r}")
        return steps

    def steps(self, bind):
        out = []
        while self.peek() == ".":
            self.next()
            name = self.next()[1]
            out.append(Step(name, self.args(bind) if self.peek() == "(" else []))
        return out

    def args(self, bind):
        self.need("(")
        out = []
        while self.peek() != ")":
            out.append(self.arg(bind))
            if self.peek() == ",":
                self.next()
        self.need(")")
        return out

    def arg(self, bind):
        kind, s = self.next()
        if kind == "num":
            return float(s) if "." in s else int(s)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", s[1:-1])
        if s == "[":
            out = []
            while self.peek() != "]":
                out.append(self.arg(bind))
                if self.peek() == ",":
                    self.next()
            self.need("]")
            return out
        if s in ("true", "false"):
            return s == "true"
        if s in ("_", "__"):
            if self.peek() == "(":
                self.args(bind)
            return self.steps(bind)
        if self.peek() == "(":
            first = Step(s, self.args(bind))
            if s in ("eq", "neq", "within", "regex"):
                return first
            if s == "idFrom":
                return first
            return [first, *self.steps(bind)]
        return bind.get(s, Name(s))


class Traversal:
    """Rows of the current element: `kind` vertex (id in `at`), edge (struct in `at`) or value."""

    def __init__(self, g: GraphCatalog):
        self.g, self.df, self.kind = g, None, "vertex"
        self.nodes = g.all_nodes()

    def copy(self):
        t = Traversal.__new__(Traversal)
        t.g, t.df, t.kind, t.nodes = self.g, self.df, self.kind, self.nodes
        return t

    def run(self, steps: list[Step]) -> Traversal:
        for s in steps:
            f = getattr(self, "do_" + s.name.lower(), None)
            if f is None:
                raise GremlinProblem(f"unknown step {s.name}")
            f(*s.args)
        return self

    def _others(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("at", "path")]

    def _ids(self, args: list):
        ids = [x for a in args for x in (a if isinstance(a, list) else [a])]
        return [self.g.spark.range(1).select(call("idFrom", [lit(x) for x in i.args]).col).first()[0] if isinstance(i, Step) and i.name == "idFrom" else str(i) for i in ids]

    def do_v(self, *ids):
        self.df = self.nodes.select(F.col("id").alias("at"))
        if len(ids) == 1 and isinstance(ids[0], Name) and ids[0].name == "recent_nodes":
            return self.do_recentv()
        if ids:  # an id nobody wrote to is an empty vertex
            self.df = self.g.spark.createDataFrame([(i,) for i in self._ids(list(ids))], "at string")
        self.df = self.df.withColumn("path", F.array("at"))

    def do_recentv(self, n=10):
        self.df = self.nodes.select(F.col("id").alias("at")).orderBy("at").limit(n).withColumn("path", F.array("at"))

    def _with_node(self) -> DataFrame:
        n = self.nodes.select(F.col("id").alias("_id"), F.col("labels").alias("_labels"), F.col("properties").alias("_props"))
        return self.df.join(n, F.col("at") == F.col("_id"), "left")

    def _keep(self, df: DataFrame) -> None:
        self.df = df.drop("_id", "_labels", "_props")

    @staticmethod
    def _test(c, p):
        """A predicate on a text column."""
        show = lambda x: str(x).lower() if isinstance(x, bool) else str(x)
        if not isinstance(p, Step):
            return c == show(p)
        if p.name == "eq":
            return c == show(p.args[0])
        if p.name == "neq":
            return c != show(p.args[0])
        if p.name == "within":
            return c.isin([show(x) for a in p.args for x in (a if isinstance(a, list) else [a])])
        return c.rlike("^(?:" + str(p.args[0]) + ")$")

    def do_has(self, key, p=None):
        v = F.get_json_object("_props", f"$['{key}']")
        self._keep(self._with_node().where(v.isNotNull() if p is None else self._test(v, p)))

    def do_hasnot(self, key):
        self._keep(self._with_node().where(F.get_json_object("_props", f"$['{key}']").isNull()))

    def do_haslabel(self, p):
        if isinstance(p, Step):
            self._keep(self._with_node().where(F.exists("_labels", lambda x: self._test(x, p))))
        else:
            self._keep(self._with_node().where(F.array_contains("_labels", p)))

    def do_hasid(self, *ids):
        self.df = self.df.where(F.col("at").isin(self._ids(list(ids))))

    def _hop(self, args, directions: str, edge: bool):
        limit = next((a for a in args if isinstance(a, int) and not isinstance(a, bool)), None)
        types = [x for a in args if not isinstance(a, int) for x in (a if isinstance(a, list) else [a])]
        e = self.g.all_edges(types)
        e = e.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.struct(F.col("from").alias("start"), "type", F.col("to").alias("end")).alias("_e"))
        ways = {"out": e, "in": e.select(F.col("_t").alias("_f"), F.col("_f").alias("_t"), "_e")}
        steps = ways[directions] if directions != "both" else ways["out"].unionByName(ways["in"].where("_f <> _t"))
        if limit is not None:
            steps = steps.withColumn("_r", F.row_number().over(W.partitionBy("_f").orderBy("_e"))).where(F.col("_r") <= limit).drop("_r")
        j = self.df.join(steps, F.col("at") == F.col("_f"))
        now = F.col("_e") if edge else F.col("_t")
        mark = F.to_json("_e") if edge else F.col("_t")
        self.df = j.select(now.alias("at"), F.concat("path", F.array(mark)).alias("path"), *self._others())
        self.kind = "edge" if edge else "vertex"

    def do_out(self, *a):
        self._hop(a, "out", False)

    def do_in(self, *a):
        self._hop(a, "in", False)

    def do_both(self, *a):
        self._hop(a, "both", False)

    def do_oute(self, *a):
        self._hop(a, "out", True)

    def do_ine(self, *a):
        self._hop(a, "in", True)

    def do_bothe(self, *a):
        self._hop(a, "both", True)

    def _end(self, c):
        self.df = self.df.select(c.alias("at"), *[x for x in self.df.columns if x != "at"])
        self.kind = "vertex"

    def do_outv(self):
        self._end(F.col("at.start"))

    def do_inv(self):
        self._end(F.col("at.end"))

    def do_bothv(self):
        self._end(F.explode(F.array("at.start", "at.end")))

    def _where(self, t, negate: bool):
        row = self.df.select("at").distinct().withColumn("_from", F.col("at"))
        inner = self.copy()
        inner.df = row.withColumn("path", F.array(F.col("at").cast("string") if self.kind != "edge" else F.to_json("at")))
        inner.run(t)
        hits = inner.df.select("_from").distinct()
        self.df = self.df.join(hits, F.col("at").eqNullSafe(F.col("_from")), "left_anti" if negate else "left_semi")

    def do_where(self, t):
        if len(t) == 1 and t[0].name == "not":
            self._where(t[0].args[0], True)
        elif len(t) == 1 and t[0].name in ("and", "or"):
            getattr(self, "do_" + t[0].name)(*t[0].args)
        else:
            self._where(t, False)

    def do_not(self, t):
        self._where(t, True)

    def do_and(self, *ts):
        for t in ts:
            self._where(t, False)

    def do_or(self, *ts):
        parts = [self.copy() for _ in ts]
        for p, t in zip(parts, ts):
            p._where(t, False)
        keys = parts[0].df.select("at")
        for p in parts[1:]:
            keys = keys.union(p.df.select("at"))
        self.df = self.df.join(keys.distinct().withColumnRenamed("at", "_k"), F.col("at").eqNullSafe(F.col("_k")), "left_semi")

    def do_union(self, *ts):
        parts = []
        for t in ts:
            p = self.copy()
            p.run(t)
            parts.append(p)
        self.df, self.kind = parts[0].df, parts[0].kind
        for p in parts[1:]:
            self.df = self.df.unionByName(p.df)

    def do_eqtovar(self, x):
        self.df = self.df.where(F.col("at").cast("string") == (F.col(f"as·{x.name}") if isinstance(x, Name) else F.lit(str(x))))

    def do_values(self, *keys):
        j = self._with_node()
        vals = F.array(*[F.get_json_object("_props", f"$['{k}']") for k in keys]) if keys else F.map_values(F.from_json("_props", "map<string,string>"))
        self._keep(j.withColumn("at", F.explode(F.filter(vals, lambda v: v.isNotNull()))))
        self.kind = "value"

    def do_valuemap(self, *keys):
        m = F.from_json("_props", "map<string,string>")
        if keys:
            m = F.map_filter(m, lambda k, _: k.isin(list(keys)))
        self._keep(self._with_node().withColumn("at", m))
        self.kind = "value"

    def do_is(self, p):
        self.df = self.df.where(self._test(F.col("at").cast("string"), p))

    def do_dedup(self):
        self.df = self.df.dropDuplicates(["at"])

    def do_as(self, k):
        self.df = self.df.withColumn(f"as·{k}", F.col("at"))

    def do_select(self, *ks):
        c = F.col(f"as·{ks[0]}") if len(ks) == 1 else F.struct(*[F.col(f"as·{k}").alias(k) for k in ks])
        self.df = self.df.withColumn("at", c)

    def do_limit(self, n):
        self.df = self.df.limit(n)

    def do_id(self):
        self.kind = "value"

    def do_strid(self):
        self.df = self.df.withColumn("at", F.col("at").cast("string"))
        self.kind = "value"

    def do_unrollpath(self):
        self.df = self.df.withColumn("at", F.explode("path"))
        self.kind = "vertex"

    def do_count(self):
        self.df = self.df.agg(F.count("*").alias("at")).withColumn("path", F.array().cast("array<string>"))
        self.kind = "value"

    def do_groupcount(self):
        key = F.to_json("at") if self.kind == "edge" else F.col("at").cast("string")
        counted = self.df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
        self.df = counted.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("at")).withColumn("path", F.array().cast("array<string>"))
        self.kind = "value"


def run(graph: GraphCatalog, text: str) -> DataFrame:
    """The traversal's elements as one column, `result`."""
    t = Traversal(graph).run(_Parser(text).query())
    return t.df.select(F.col("at").alias("result"))
