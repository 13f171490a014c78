"""Outputs of standing queries: functions of a DataFrame with the columns data and meta."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Output = Callable[[DataFrame], None]


def drop() -> Output:
    return lambda df: df.write.format("noop").mode("overwrite").save()


def _lines(df: DataFrame, structure: str) -> DataFrame:
    return df.select(F.to_json("data" if structure == "Bare" else F.struct("meta", "data")).alias("value"))


def file(path: str, structure: str = "WithMetadata") -> Output:
    """JSON lines, appended to a folder."""
    return lambda df: _lines(df, structure).write.mode("append").text(path)


def console(rows: int = 20) -> Output:
    return lambda df: df.show(rows, truncate=False)


def memory(name: str) -> Output:
    """A global temporary view with all results so far, `tap_<name>`; live taps read it."""
    kept: list[DataFrame] = []

    def out(df: DataFrame) -> None:
        kept.append(df)
        whole = kept[0]
        for x in kept[1:]:
            whole = whole.unionByName(x, allowMissingColumns=True)
        whole.createOrReplaceGlobalTempView(f"tap_{name}")

    return out


def http(url: str, headers: dict | None = None, structure: str = "WithMetadata", batch: bool = False) -> Output:
    """POST every result, or (batch) one list for each partition, from the executors."""

    def send(rows) -> None:
        texts = [r.value for r in rows]
        for body in ["[" + ",".join(texts) + "]"] if batch and texts else texts:
            req = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
            urllib.request.urlopen(req, timeout=30).close()

    return lambda df: _lines(df, structure).foreachPartition(send)


def slack(url: str, each: int = 20) -> Output:
    """All results, at most `each` of them in a message, from the executors."""

    def post(texts: list[str]) -> None:
        body = json.dumps({"text": f"{len(texts)} results", "attachments": [{"text": x} for x in texts]}).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=30).close()

    def send(rows) -> None:
        now: list[str] = []
        for r in rows:
            now.append(r.value)
            if len(now) == each:
                post(now)
                now = []
        if now:
            post(now)

    return lambda df: _lines(df, "WithMetadata").foreachPartition(send)


def kafka(servers: str, topic: str, structure: str = "WithMetadata") -> Output:
    """Needs the spark-sql-kafka package."""
    return lambda df: _lines(df, structure).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def cypher(engine, query: str, parameter: str = "that", then: list[Output] | None = None, allow_all_node_scan: bool = False) -> Output:
    """Run a query for every result, bound to $that; its rows go on to `then`."""
    from weftgraph.engine import analyse, parsed
    from weftgraph.streaming.ingest import bound

    if analyse(parsed(query))["can_scan_all_nodes"] and not allow_all_node_scan:
        raise ValueError("the query may scan all nodes for each batch")

    def out(df: DataFrame) -> None:
        from weftgraph.streaming.mutate import Writer

        writer = Writer(engine.events) if engine.events is not None else None
        c = bound(engine, query, df.select("data", "meta"), parameter, writer)
        rows = c.result()
        if writer is not None:
            writer.commit()
        if then and rows.columns:
            result = rows.select(F.struct(*[F.col(f"`{x}`") for x in rows.columns]).alias("data"), F.struct(F.lit(True).alias("isPositiveMatch")).alias("meta"))
            for o in then:
                o(result)

    return out


def workflow(outputs: list[Output], only_positive: bool = False, inline: bool = False, enrich: Callable[[DataFrame], DataFrame] | None = None, taps: dict[str, Output] | None = None) -> Output:
    """Filter, transform, enrich, then fan out; taps see the rows raw, before and after enrichment."""
    taps = taps or {}

    def out(df: DataFrame) -> None:
        if "raw" in taps:
            taps["raw"](df)
        if only_positive:
            df = df.where("meta.isPositiveMatch")
        if inline:
            df = df.select(F.struct("data.*").alias("data"), "meta")
        if "before" in taps:
            taps["before"](df)
        if enrich is not None:
            df = enrich(df)
        if "after" in taps:
            taps["after"](df)
        for o in outputs:
            o(df)

    return out
