"""Recipes: ingest streams, standing queries and a status query in one YAML text."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame

from weftgraph.engine import Engine
from weftgraph.sources import outputs, readers
from weftgraph.streaming.ingest import Ingest
from weftgraph.streaming.standing import StandingQuery


def load(text: str, values: dict[str, str] | None = None) -> dict:
    """The recipe with $names of its template filled in; `$$` stands for a dollar sign."""

    def fill(x):
        if isinstance(x, str) and x.startswith("$$"):
            return x[1:]
        if isinstance(x, str) and re.fullmatch(r"\$\w+", x):
            if x[1:] not in (values or {}):
                raise ValueError(f"recipe needs a value for {x[1:]}")
            return values[x[1:]]
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        return [fill(v) for v in x] if isinstance(x, list) else x

    return fill(yaml.safe_load(text))


def source(engine: Engine, spec: dict) -> tuple[DataFrame, str, str]:
    """Records, query and parameter of an ingest stream."""
    f = spec.get("format", {})
    kind = f.get("type", "CypherJson")
    if spec["type"] == "NumberIteratorIngest":
        rows = readers.numbers(engine.spark, spec.get("startAtOffset", 0), spec.get("ingestLimit", 1000))
    elif spec["type"] == "FileIngest":
        shape = {"CypherLine": "line", "CypherJson": "jsonl", "CypherCsv": "csv"}[kind]
        rows = readers.read_files(engine.spark, spec["path"], shape, headers=f.get("headers", True), delimiter=f.get("delimiter", ","), offset=spec.get("startAtOffset", 0), limit=spec.get("ingestLimit"))
    elif spec["type"] == "KafkaIngest":
        rows = readers.kafka(engine.spark, spec["bootstrapServers"], ",".join(spec["topics"]))
    else:
        rows = readers.connector(engine.spark, spec["type"].removesuffix("Ingest"), {k: v for k, v in spec.items() if k not in ("type", "format")})
    return rows, f["query"], f.get("parameter", "that")


def sink(engine: Engine, name: str, spec: dict):
    then = [sink(engine, name, spec["andThen"])] if "andThen" in spec else []
    return {
        "Drop": lambda: outputs.drop(),
        "PrintToStandardOut": lambda: outputs.console(),
        "WriteToFile": lambda: outputs.file(spec["path"]),
        "PostToEndpoint": lambda: outputs.http(spec["url"]),
        "PostToSlack": lambda: outputs.slack(spec["hookUrl"]),
        "WriteToKafka": lambda: outputs.kafka(spec["bootstrapServers"], spec["topic"]),
        "CypherQuery": lambda: outputs.cypher(engine, spec["query"], spec.get("parameter", "that"), then, spec.get("allowAllNodeScan", False)),
        "Memory": lambda: outputs.memory(name),
    }[spec["type"]]()


def run(engine: Engine, text: str, values: dict[str, str] | None = None) -> tuple[dict[str, StandingQuery], DataFrame | None]:
    """Run all ingest streams of a recipe through its standing queries; the queries, and the status query's rows."""
    recipe = load(text, values)
    standing = {}
    for i, s in enumerate(recipe.get("standingQueries", [])):
        p = s["pattern"]
        outs = [sink(engine, k, o) for k, o in s.get("outputs", {}).items()]
        name = s.get("name", f"STANDING-{i + 1}")
        standing[name] = StandingQuery(engine, name, p["query"], p.get("mode", "DistinctId"), s.get("includeCancellations", False), outs)
    for spec in recipe.get("ingestStreams", []):
        rows, query, parameter = source(engine, spec)
        Ingest(engine, query, parameter, standing=list(standing.values())).run(rows)
    status = recipe.get("statusQuery")
    return standing, engine.cypher(status["cypherQuery"]) if status else None
