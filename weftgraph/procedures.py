"""Procedures: calls that give rows, or change the graph, for each row of a query."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import scalar
from weftgraph.functions import values as V
from weftgraph.functions.aggregates import NAMES as AGGREGATES
from weftgraph.functions.values import LONG, REL, STRING, Val
from weftgraph.plans import ast as A
from weftgraph.plans.compiler import CompileProblem, ValueVar, fresh
from weftgraph.session import settle

log = logging.getLogger("weftgraph")
REGISTRY: dict[str, tuple[Callable, list[str], str]] = {}


def procedure(name: str, outputs: list[str], signature: str):
    def add(f):
        REGISTRY[name.lower()] = (f, outputs, signature)
        return f

    return add


def register_procedure(name: str, outputs: list[str], signature: str, f: Callable) -> None:
    """f(compiler, argument expressions) adds rows to the compiler and returns a Val for each output."""
    procedure(name, outputs, signature)(f)


def run(c, call: A.CallProc) -> None:
    if call.name.lower() not in REGISTRY:
        raise CompileProblem(f"unknown procedure {call.name}")
    f, outputs, _ = REGISTRY[call.name.lower()]
    if not c.df.columns and c.one_row:
        c.df = c.spark.range(1)
    c.one_row = False
    vals = f(c, call.args)
    names = call.yields if call.yields is not None else [(o, o) for o in vals]
    cols = {}
    for out, alias in names:
        if out not in vals:
            raise CompileProblem(f"{call.name} does not yield {out}")
        n = fresh(alias)
        cols[n] = vals[out].col
        c.scope[alias] = ValueVar(n, vals[out].type)
    c.df = c.df.withColumns(cols)


def table(c, df: DataFrame) -> dict[str, Val]:
    """Every row of the query beside every row of a table."""
    names = {k: fresh(k) for k in df.columns}
    c.df = c.df.crossJoin(df.select(*[F.col(k).alias(n) for k, n in names.items()]))
    return {k: Val(F.col(f"`{n}`"), df.schema[k].dataType) for k, n in names.items()}


def node_of(c, e):
    """The node variable that an argument names."""
    if not isinstance(e, A.Var):
        n = fresh("node")
        v = c.ev(e)
        c.df = c.df.withColumn(n, v.col)
        c.scope[n] = ValueVar(n, v.type)
        e = A.Var(n)
    return c.node(e.name)


# The graph's own tables
@procedure("db.relationshipTypes", ["relationshipType"], "() :: (relationshipType)")
def _types(c, args):
    return table(c, c.graph.relationship_types())


@procedure("db.propertyKeys", ["propertyKey"], "() :: (propertyKey)")
def _keys(c, args):
    return table(c, c.graph.property_keys())


@procedure("dbms.labels", ["label"], "() :: (label)")
def _labels(c, args):
    return table(c, c.graph.all_nodes().select(F.explode("labels").alias("label")).distinct())


@procedure("db.indexes", ["name"], "() :: (name)")
def _indexes(c, args):
    return table(c, c.spark.createDataFrame([(v.label or "*",) for v in c.graph.vertices], "name string"))


@procedure("recentNodeIds", ["nodeId"], "(count?) :: (nodeId)")
def _recent_ids(c, args):
    n = int(c.constant(args[0])) if args else 10
    return table(c, _recent(c, n).select(F.col("id").alias("nodeId")))


@procedure("recentNodes", ["node"], "(count?) :: (node)")
def _recent_nodes(c, args):
    n = int(c.constant(args[0])) if args else 10
    right, v = c.scan("node", c.graph.vertices)
    recent = _recent(c, n)
    name = fresh("node")
    out = right.join(F.broadcast(recent) if n <= 10000 else recent, v.col("id") == F.col("id"), "left_semi").select(v.value().col.alias(name))
    c.df = c.df.crossJoin(out)
    return {"node": Val(F.col(f"`{name}`"), v.value().type)}


def _recent(c, n: int) -> DataFrame:
    """Ids of the latest touched nodes; of a catalog of tables, any nodes in order of id."""
    events = getattr(c.procedures, "events", None)
    if events is None:
        return c.graph.all_nodes().select("id").orderBy("id").limit(n)
    return events.events().groupBy(F.col("node_id").alias("id")).agg(F.max(F.struct("ts_ms", "seq")).alias("t")).orderBy(F.col("t").desc(), "id").limit(n).select("id")


@procedure("help.builtins", ["name", "signature", "description"], "() :: (name, signature, description)")
@procedure("help.functions", ["name", "signature", "description"], "() :: (name, signature, description)")
def _functions(c, args):
    rows = sorted((f.name, f.signature, f.description) for f in scalar.REGISTRY.values()) + sorted((a, "(ANY?) :: ANY?", "aggregate") for a in AGGREGATES)
    return table(c, c.spark.createDataFrame(rows, "name string, signature string, description string"))


@procedure("help.procedures", ["name", "signature"], "() :: (name, signature)")
def _procedures(c, args):
    return table(c, c.spark.createDataFrame(sorted((k, s) for k, (_, _, s) in REGISTRY.items()), "name string, signature string"))


@procedure("loadJsonLines", ["value"], "(url) :: (value)")
def _load_json(c, args):
    return table(c, c.spark.read.text(c.constant(args[0])).where("trim(value) <> ''").select(F.parse_json("value").alias("value")))


@procedure("log", ["log"], "(level?, value) :: (log)")
def _log(c, args):
    v = scalar.call("toString", [c.ev(args[-1])])
    log.log(getattr(logging, str(c.constant(args[0])).upper(), logging.INFO) if len(args) > 1 else logging.INFO, "query log of %s", args[-1])
    return {"log": v}


@procedure("util.sleep", [], "(ms) :: ()")
@procedure("debug.sleep", [], "(node) :: ()")
def _sleep(c, args):
    """Nodes do not sleep here, and rows do not wait."""
    return {}


# Edges and paths
@procedure("getFilteredEdges", ["edge"], "(node, types, directions, allowed) :: (edge)")
def _filtered_edges(c, args):
    n = node_of(c, args[0])
    types, directions = (c.constant(a) for a in args[1:3])
    allowed = c.ev(args[3]) if len(args) > 3 else None
    e = c.graph.all_edges([])
    d = {x.lower() for x in directions} or {"outgoing", "incoming"}
    parts = [e.select(F.col(a).alias("near"), F.col(b).alias("far"), F.struct(F.col("from").alias("start"), "type", F.col("to").alias("end")).alias("edge")) for a, b, k in (("from", "to", "outgoing"), ("to", "from", "incoming")) if k in d]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if types:
        both = both.where(F.col("edge.type").isin(list(types)))
    k = fresh("edge")
    both = both.select(F.col("near").alias(k + "n"), F.col("far").alias(k + "f"), F.col("edge").alias(k))
    c.df = c.df.join(both, n.col("id") == F.col(f"`{k}n`"))
    if allowed is not None and isinstance(allowed.type.elementType, T.StringType):
        c.df = c.df.where((F.size(allowed.col) == 0) | F.array_contains(allowed.col, F.col(f"`{k}f`")))
    elif allowed is not None and V.is_node(allowed.type.elementType):
        c.df = c.df.where((F.size(allowed.col) == 0) | F.exists(allowed.col, lambda x: x["id"] == F.col(f"`{k}f`")))
    return {"edge": Val(F.col(f"`{k}`"), REL)}


@procedure("algorithms.shortestPath", ["path"], "(from, to, options?) :: (path)")
def _shortest(c, args):
    o = c.constant(args[2]) if len(args) > 2 else {}
    for i in (0, 1):
        node_of(c, args[i])
    direction = {"outgoing": "out", "incoming": "in"}.get(str(o.get("direction", "both")).lower(), "both")
    rel = A.RelPattern(None, tuple(o.get("types", ())), None, direction, int(o.get("minLength", 1)), int(o.get("maxLength", 10)), True)
    v = c.shortest(A.Pattern(None, (A.NodePattern(args[0].name, (), None), rel, A.NodePattern(args[1].name, (), None))))
    c.df = c.df.where(F.col(f"`{v.name}`").isNotNull())
    return {"path": Val(F.col(f"`{v.name}`"), V.PATH)}


def random_walks(edges: DataFrame, start: DataFrame, length: int = 10, back: float = 1.0, far: float = 1.0, seed: str = "0") -> DataFrame:
    """(id, n, walk) for start (id, n): second-order walks along edges (from, to), in either direction.

    Each step draws among the neighbours with weight 1/back for the node before, 1 for its neighbours, 1/far for
    others: the neighbour with the least -ln(u) / weight, u from a hash of start, seed, step and neighbour. An edge
    met twice draws the same u, so edges need no distinct; only those at the walks' own ends are joined, none is stored.
    """
    ends = F.array(F.struct(F.col("from").alias("b"), F.col("to").alias("t")), F.struct(F.col("to").alias("b"), F.col("from").alias("t")))
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    now = start.select("id", "n").distinct().select("id", "n", F.col("id").alias("at"), F.lit(None).cast("string").alias("before"), F.array("id").alias("walk"))
    done = None
    for step in range(length):
        now = settle(now)
        j = now.select("id", "n", "at", "before").join(both, F.col("at") == F.col("b")).select("id", "n", "before", "t")
        weight = F.when(F.col("t") == F.col("before"), 1.0 / back).otherwise(1.0 / far)
        if step and far != 1.0:  # only then do neighbours of the node before count otherwise than others
            near = now.select("before").distinct().join(both, F.col("before") == F.col("b")).select("b", F.col("t").alias("near")).distinct()
            j = j.join(near, (F.col("before") == F.col("b")) & (F.col("t") == F.col("near")), "left")
            weight = F.when(F.col("t") == F.col("before"), 1.0 / back).when(F.col("near").isNotNull(), 1.0).otherwise(1.0 / far)
        u = (F.pmod(F.xxhash64(F.col("id"), F.col("n"), F.lit(seed), F.lit(step), F.col("t")), F.lit(2**52)) + 1) / float(2**52 + 1)
        key = F.struct((-F.ln(u) / (weight if step else F.lit(1.0))).alias("w"), F.col("t"))
        drawn = j.where("t is not null").groupBy("id", "n").agg(F.min(key)["t"].alias("next"))
        now = settle(now.join(drawn, ["id", "n"], "left"))
        stuck = now.where("next is null").select("id", "n", "walk")
        done = stuck if done is None else done.unionByName(stuck)
        now = now.where("next is not null").select("id", "n", F.col("next").alias("at"), F.col("at").alias("before"), F.concat("walk", F.array("next")).alias("walk"))
    rest = now.select("id", "n", "walk")
    return rest if done is None else rest.unionByName(done)


@procedure("random.walk", ["walk"], "(start, depth, return?, inOut?, seed?) :: (walk)")
def _random_walk(c, args):
    n = node_of(c, args[0])
    depth, *rest = (c.constant(a) for a in args[1:])
    rest += [1.0, 1.0, "0"][len(rest) :]
    start = c.df.select(n.col("id").alias("id"), F.lit(0).alias("n")).distinct()
    w, k = fresh("walk"), fresh("id")
    walks = random_walks(c.graph.all_edges([]), start, int(depth), float(rest[0]), float(rest[1]), str(rest[2]))
    c.df = c.df.join(walks.select(F.col("id").alias(k), F.col("walk").alias(w)), n.col("id") == F.col(f"`{k}`"))
    return {"walk": Val(F.col(f"`{w}`"), T.ArrayType(STRING))}


def save_random_walks(graph, path: str, length: int = 10, count: int = 5, back: float = 1.0, far: float = 1.0, seed: str = "0") -> None:
    """`count` walks from every node as lines of node ids."""
    start = graph.all_nodes().select("id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("n"))
    random_walks(graph.all_edges([]), start, length, back, far, seed).select(F.array_join("walk", ",")).write.text(path)


# Sub-queries as text
def _per_row(c, df: DataFrame, row: str, text: str, params) -> DataFrame:
    """(row, value): the results of a query text for each row of df, whose parameters are values of that row."""
    from weftgraph.engine import parsed

    inner = c.child()
    inner.df, inner.row, inner.row_ids, inner.one_row = df, row, df.select(row), False
    items = params.items if isinstance(params, A.MapLit) else [(k, A.Lit(v)) for k, v in (c.constant(params) if params is not None else {}).items()]
    vals = {k: inner.ev(e) for k, e in items}
    names = {k: fresh(k) for k in vals}
    inner.df = df.select(row, *[v.col.alias(names[k]) for k, v in vals.items()])
    inner.scope = {k: ValueVar(names[k], v.type) for k, v in vals.items()}
    inner.query(parsed(text))
    out = inner.flat()
    fields = [F.col(f"`{v.name}`").alias(k) for k, v in out.scope.items()]
    return out.df.select(row, (F.to_variant_object(F.struct(*fields)) if fields else F.parse_json(F.lit("{}"))).alias("value"))


def _numbered(c) -> str:
    row = fresh("row")
    c.df = settle((c.df if c.df.columns else c.spark.range(1)).withColumn(row, F.monotonically_increasing_id()))
    return row


def _joined(c, row: str, rows: DataFrame) -> dict[str, Val]:
    out = fresh("value")
    rows = rows.select(F.col(row).alias(row + "'"), F.col("value").alias(out))
    c.df = c.df.join(rows, F.col(f"`{row}`") == F.col(f"`{row}'`")).drop(row, row + "'")
    return {"value": Val(F.col(f"`{out}`"), T.VariantType())}


@procedure("cypher.doIt", ["value"], "(query, params?) :: (value)")
def _do_it(c, args):
    row = _numbered(c)
    return _joined(c, row, _per_row(c, c.df, row, c.constant(args[0]), args[1] if len(args) > 1 else None))


@procedure("cypher.runTimeboxed", ["value"], "(query, params, timeout) :: (value)")
def _timeboxed(c, args):
    """As doIt; its jobs are cancelled, and the query fails, when they take more than so many milliseconds."""
    sc, tag = c.spark.sparkContext, fresh("timebox").replace("·", "-")
    row, over = _numbered(c), threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(float(c.constant(args[2])) / 1000, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = settle(_per_row(c, c.df, row, c.constant(args[0]), args[1]))
    except Exception as e:
        if over.is_set():
            raise TimeoutError("the query took longer than its time box") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return _joined(c, row, rows)


@procedure("do.when", ["value"], "(condition, if, else, params?) :: (value)")
def _do_when(c, args):
    return _branches(c, [(args[0], args[1])], args[2], args[3] if len(args) > 3 else None)


@procedure("cypher.do.case", ["value"], "(conditionals, else, params?) :: (value)")
def _do_case(c, args):
    flat = args[0].items
    return _branches(c, list(zip(flat[::2], flat[1::2])), args[1], args[2] if len(args) > 2 else None)


def _branches(c, pairs: list, default, params) -> dict[str, Val]:
    """For each row the query of its first true condition."""
    test = F.lit(len(pairs))
    for i in range(len(pairs) - 1, -1, -1):
        test = F.when(c.ev(pairs[i][0]).col, F.lit(i)).otherwise(test)
    which = fresh("which")
    c.df = c.df.withColumn(which, test)
    row, parts = _numbered(c), None
    for i, q in enumerate([q for _, q in pairs] + [default]):
        text = c.constant(q)
        if text:
            rows = _per_row(c, c.df.where(F.col(f"`{which}`") == i), row, text, params)
            parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        parts = c.df.select(row, F.parse_json(F.lit("{}")).alias("value")).limit(0)
    return _joined(c, row, parts)


# Changes of nodes
def _writer(c):
    if c.writer is None:
        raise CompileProblem("this graph is read-only")
    c.df = settle(c.df)
    return c.writer


def _counter(kind: T.DataType):
    def f(c, args):
        """Rows of one query that count on the same node add up; each row gets the total after all of them."""
        n = node_of(c, args[0])
        key = c.constant(args[1])
        amount = c.ev(args[2]) if len(args) > 2 else V.lit(1)
        w = _writer(c)
        old = n.prop(key)
        step, k = fresh("step"), fresh("id")
        sums = c.df.select(n.col("id").alias(k), (old.col if old else F.lit(0)).alias("old"), amount.col.alias("a")).groupBy(k).agg((F.coalesce(F.first("old"), F.lit(0)) + F.sum("a")).cast(kind).alias(step))
        sums = settle(sums)
        w.property(sums, F.col(f"`{k}`"), key, Val(F.col(f"`{step}`"), kind))
        c.df = c.df.join(sums, n.col("id") == F.col(f"`{k}`"))
        v = Val(F.col(f"`{step}`"), kind)
        return {"count": v, "result": v}

    return f


procedure("incrementCounter", ["count"], "(node, key, amount?) :: (count)")(_counter(LONG))
procedure("int.add", ["result"], "(node, key, add?) :: (result)")(_counter(LONG))
procedure("float.add", ["result"], "(node, key, add?) :: (result)")(_counter(T.DoubleType()))


def _set_add(many: bool):
    def f(c, args):
        n, key, v = node_of(c, args[0]), c.constant(args[1]), c.ev(args[2])
        w = _writer(c)
        items = v.col if many else F.array(v.col)
        t = v.type if many else T.ArrayType(v.type)
        old = n.prop(key)
        k, out = fresh("id"), fresh("set")
        rows = c.df.select(n.col("id").alias(k), (old.col.cast(t) if old else F.array().cast(t)).alias("old"), items.alias("new"))
        sums = settle(rows.groupBy(k).agg(F.array_distinct(F.concat(F.coalesce(F.first("old"), F.array().cast(t)), F.flatten(F.collect_list("new")))).alias(out)))
        w.property(sums, F.col(f"`{k}`"), key, Val(F.col(f"`{out}`"), t))
        c.df = c.df.join(sums, n.col("id") == F.col(f"`{k}`"))
        return {"result": Val(F.col(f"`{out}`"), t)}

    return f


procedure("set.insert", ["result"], "(node, key, value) :: (result)")(_set_add(False))
procedure("set.union", ["result"], "(node, key, values) :: (result)")(_set_add(True))


@procedure("create.relationship", ["rel"], "(from, type, props, to) :: (rel)")
def _create_relationship(c, args):
    a, b = node_of(c, args[0]), node_of(c, args[3])
    kind = c.ev(args[1])
    w = _writer(c)
    w.add(c.df, a.col("id"), "EdgeAdded", edge=kind.col, other=b.col("id"))
    return {"rel": Val(F.struct(a.col("id").alias("start"), kind.col.alias("type"), b.col("id").alias("end")), REL)}


@procedure("create.setProperty", [], "(node, key, value) :: ()")
def _set_property(c, args):
    n = node_of(c, args[0])
    v = c.ev(args[2])
    _writer(c).property(c.df, n.col("id"), c.constant(args[1]), v)
    return {}


@procedure("create.setLabels", [], "(node, labels) :: ()")
def _set_labels(c, args):
    n = node_of(c, args[0])
    v = c.ev(args[1])
    _writer(c).add(c.df, n.col("id"), "PropertySet", F.lit("__LABEL"), F.to_json(v.col))
    return {}


@procedure("purgeNode", [], "(node) :: ()")
def _purge(c, args):
    n = node_of(c, args[0])
    ids = [r[0] for r in c.df.select(n.col("id")).distinct().limit(10001).collect()]
    if len(ids) > 10000:
        raise CompileProblem("over 10000 nodes are not purged in one call")
    c.writer.graph.purge(ids, c.writer.ns)
    return {}


@procedure("debug.node", ["id", "properties", "edges", "journal"], "(node) :: (id, properties, edges, journal)")
def _debug_node(c, args):
    n = node_of(c, args[0])
    events = c.procedures.events
    state = events.properties().groupBy(F.col("node_id").alias("_p")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("_props"))
    e = c.graph.all_edges([])
    ends = e.select(F.col("from").alias("_e"), F.struct(F.col("from").alias("start"), "type", F.col("to").alias("end")).alias("x")).unionByName(e.select(F.col("to").alias("_e"), F.struct(F.col("from").alias("start"), "type", F.col("to").alias("end")).alias("x")))
    ends = ends.groupBy("_e").agg(F.collect_set("x").alias("_edges"))
    journal = events.events().groupBy(F.col("node_id").alias("_j")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("ts_ms", "seq", "kind", "key", "value", "edge_type", "other")))).alias("_journal"))
    c.df = c.df.join(state, n.col("id") == F.col("_p"), "left").join(ends, n.col("id") == F.col("_e"), "left").join(journal, n.col("id") == F.col("_j"), "left")
    return {"id": Val(n.col("id"), STRING), "properties": Val(F.col("_props"), STRING), "edges": Val(F.col("_edges"), T.ArrayType(REL)), "journal": Val(F.col("_journal"), STRING)}


#: Periods of reified time and how a moment is cut to them.
PERIODS = ["year", "month", "day", "hour", "minute", "second"]


@procedure("reify.time", ["node"], "(datetime?, periods?) :: (node)")
def _reify(c, args):
    """Time nodes of each period with their neighbours before and after, linked; yields the finest one's id."""
    when = c.ev(args[0]) if args else Val(F.current_timestamp(), T.TimestampType())
    periods = [p for p in PERIODS if p in (c.constant(args[1]) if len(args) > 1 else PERIODS)]
    w = _writer(c)
    c.df = settle(c.df.withColumn(m := fresh("moment"), when.col.cast("timestamp")))
    col = F.col(f"`{m}`")
    node = lambda p, t: F.sha2(F.concat_ws("|", F.lit("time"), F.lit(p), F.unix_seconds(t).cast("string")), 256)
    start = lambda p, t: F.date_trunc(p, t)
    shift = lambda p, t, k: t + F.expr(f"interval {k} {p}")
    for i, p in enumerate(periods):
        rows = c.df.select(start(p, col).alias("t")).where("t is not null").distinct()
        rows = settle(rows.select(F.explode(F.array(*[shift(p, F.col("t"), k) for k in (-1, 0, 1)])).alias("t")).distinct())
        id_ = node(p, F.col("t"))
        w.add(rows, id_, "PropertySet", F.lit("__LABEL"), F.to_json(F.array(F.lit(p))))
        w.property(rows, id_, "period", V.lit(p))
        w.property(rows, id_, "start", Val(F.col("t").cast("string"), STRING))
        own = settle(c.df.select(start(p, col).alias("t")).where("t is not null").distinct())
        w.add(own, node(p, shift(p, F.col("t"), -1)), "EdgeAdded", edge="NEXT", other=node(p, F.col("t")))
        w.add(own, node(p, F.col("t")), "EdgeAdded", edge="NEXT", other=node(p, shift(p, F.col("t"), 1)))
        if i:
            up = periods[i - 1]
            w.add(rows, node(up, start(up, F.col("t"))), "EdgeAdded", edge=p.upper(), other=id_)
    return {"node": Val(node(periods[-1], start(periods[-1], col)), STRING)}


@procedure("standing.wiretap", ["data", "meta"], "(options) :: (data, meta)")
def _wiretap(c, args):
    """Rows of a standing query's memory table, as far as it has come."""
    name = c.constant(args[0]).get("name")
    rows = c.spark.table(f"global_temp.tap_{name}")
    return table(c, rows.select(F.col("data"), F.col("meta")))


@procedure("subscribers", ["queryName"], "(node) :: (queryName)")
@procedure("subscriptions", ["queryName"], "(node) :: (queryName)")
def _subscribers(c, args):
    """Standing queries with a match rooted at the node."""
    n = node_of(c, args[0])
    k, q = fresh("id"), fresh("query")
    rows = c.spark.createDataFrame([], "id string, q string")
    for name, sq in getattr(c.procedures, "standing", {}).items():
        rows = rows.unionByName(sq.results.select(F.col("`·root`").alias("id"), F.lit(name).alias("q")).distinct())
    rows = rows.select(F.col("id").alias(k), F.col("q").alias(q))
    c.df = c.df.join(rows, n.col("id") == F.col(f"`{k}`"))
    return {"queryName": Val(F.col(f"`{q}`"), STRING)}


@procedure("parseProtobuf", ["value"], "(bytes, schemaFile, typeName) :: (value)")
def _parse_protobuf(c, args):
    from weftgraph.sources.protobuf import parser

    f = parser(c.constant(args[1]), c.constant(args[2]))
    return {"value": Val(F.parse_json(f(c.ev(args[0]).col)), T.VariantType())}


@procedure("toProtobuf", ["protoBytes"], "(map, schemaFile, typeName) :: (protoBytes)")
def _to_protobuf(c, args):
    from weftgraph.sources.protobuf import writer

    f = writer(c.constant(args[1]), c.constant(args[2]))
    return {"protoBytes": Val(f(F.to_json(c.ev(args[0]).col)), T.BinaryType())}
