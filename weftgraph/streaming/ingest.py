"""Ingest: records of a source, each bound to $that, through a query into the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.engine import Engine, analyse, parsed
from weftgraph.plans.compiler import Compiler, ValueVar


def bound(engine: Engine, text: str, records: DataFrame, name: str = "that", writer=None, params: dict | None = None) -> Compiler:
    """The query compiled with every record as one row; a single column `value` is the record itself."""
    that = F.col("value") if records.columns == ["value"] else F.struct(*[F.col(f"`{c}`") for c in records.columns])
    rows = records.select(that.alias("that·rec"))
    c = Compiler(engine.graph(), params, df=rows, scope={name: ValueVar("that·rec", rows.schema[0].dataType)}, writer=writer, procedures=engine, unique=engine.unique)
    c.query(parsed(text))
    return c


class Ingest:
    """An ingest query over batches or a stream.

    Delivery is at least once: a batch is replayed from the checkpoint after a failure. Queries that are not
    idempotent, or read all nodes for each batch, are reported in `warnings`.
    """

    def __init__(self, engine: Engine, query: str, parameter: str = "that", transform: Callable[[DataFrame], DataFrame] | None = None, dead_letters: Callable[[DataFrame], None] | None = None, standing: list | None = None):
        self.engine, self.text, self.parameter, self.transform, self.dead = engine, query, parameter, transform, dead_letters
        self.standing = standing or []
        self.status = "Running"
        self.stream = None
        facts = analyse(parsed(query))
        self.warnings = (["not idempotent: a replayed batch counts twice"] if not facts["idempotent"] else []) + (["may scan all nodes for every batch"] if facts["can_scan_all_nodes"] else [])

    def run(self, records: DataFrame) -> None:
        """One batch. Records that could not be decoded (`_corrupt`) go to the dead letters."""
        from weftgraph.streaming.mutate import Writer

        if self.transform is not None:
            records = self.transform(records)
        if "_corrupt" in records.columns:
            if self.dead is not None:
                self.dead(records.where("_corrupt is not null").select(F.col("_corrupt").alias("value")))
            records = records.where("_corrupt is null").drop("_corrupt")
        writer = Writer(self.engine.events)
        bound(self.engine, self.text, records, self.parameter, writer)
        if writer.batches:
            from functools import reduce

            from weftgraph.session import settle

            batch = reduce(DataFrame.unionByName, writer.batches)
            if self.standing:
                batch = settle(batch)
            self.engine.events.append(batch)
            for q in self.standing:
                q.process(batch, append=False)

    def start(self, records: DataFrame, checkpoint: str, trigger: dict | None = None):
        self.stream = records.writeStream.foreachBatch(lambda df, _: self.run(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        self.again = (records, checkpoint, trigger)
        return self

    def pause(self) -> None:
        self.stream.stop()
        self.status = "Paused"

    def resume(self) -> None:
        self.start(*self.again)
        self.status = "Running"

    def wait(self, seconds: float | None = None) -> None:
        self.stream.awaitTermination(seconds)
        self.status = "Failed" if self.stream.exception() else "Completed"
