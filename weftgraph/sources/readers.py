"""Sources and formats of ingest, for batches and streams. Every reader gives columns of a record, or one column `value`."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


class SourceProblem(ValueError):
    """A source that this session cannot read."""


def _reader(spark: SparkSession, stream: bool, per_trigger: int | None = None):
    r = spark.readStream if stream else spark.read
    return r.option("maxFilesPerTrigger", per_trigger) if stream and per_trigger else r


def read_files(spark: SparkSession, path: str, format: str = "jsonl", stream: bool = False, schema: str | None = None, headers: bool | list[str] = True, delimiter: str = ",", quote: str = '"', escape: str = "\\", charset: str = "UTF-8", offset: int = 0, limit: int | None = None, max_line: int | None = None, decoders: list[str] | None = None, per_trigger: int | None = None) -> DataFrame:
    """Files or a watched folder of files: line, jsonl, json (documents over many lines), csv, parquet, avro."""
    r = _reader(spark, stream, per_trigger)
    if format == "line" or format == "jsonl":
        out = r.option("encoding", charset).text(path)
        if decoders:
            out = decode(out, decoders)
        if max_line:
            out = out.where(F.length("value") <= max_line)
        if format == "jsonl":
            out = out.where("trim(value) <> ''")
            if schema:
                out = out.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("x.*")
            else:
                v = F.try_parse_json("value")
                out = out.select(v.alias("value"), F.when(v.isNull(), F.col("value")).alias("_corrupt"))
    elif format == "json":
        out = (r.schema(schema) if schema else r).option("multiLine", True).json(path)
    elif format == "csv":
        r = r.option("sep", delimiter).option("quote", quote).option("escape", escape).option("encoding", charset).option("header", headers is True)
        if isinstance(headers, list):
            r = r.schema(", ".join(f"`{h}` string" for h in headers))
        elif schema:
            r = r.schema(schema)
        out = r.csv(path)
        if headers is False:
            out = out.select(F.array(*out.columns).alias("value"))
    elif format == "parquet":
        out = (r.schema(schema) if schema else r).parquet(path)
    elif format == "avro":
        out = r.format("avro").load(path)  # needs the spark-avro package
    else:
        raise SourceProblem(f"unknown format {format}")
    if not stream:
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
    return out


@F.pandas_udf(BinaryType())
def _gunzip(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else gzip.decompress(bytes(b)))


@F.pandas_udf(BinaryType())
def _inflate(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else zlib.decompress(bytes(b)))


def decode(df: DataFrame, decoders: list[str], column: str = "value") -> DataFrame:
    """Record decoders in order: Base64, Gzip, Zlib; the result is text."""
    c = F.col(column)
    for d in decoders:
        c = {"base64": F.unbase64, "gzip": _gunzip, "zlib": _inflate}[d.lower()](c if d.lower() == "base64" else c.cast("binary"))
    return df.withColumn(column, c.cast("string"))


def numbers(spark: SparkSession, start: int = 0, limit: int | None = None, per_second: int = 1000, stream: bool = False) -> DataFrame:
    """The number iterator: whole numbers from a start."""
    if stream:
        return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select((F.col("value") + start).alias("value"))
    if limit is None:
        raise SourceProblem("a batch of numbers needs a limit")
    return spark.range(start, start + limit).select(F.col("id").alias("value"))


def kafka(spark: SparkSession, servers: str, topics: str | dict, group: str | None = None, start: str = "latest", end: str | None = None, options: dict | None = None, per_trigger: int | None = None, stream: bool = True) -> DataFrame:
    """Topics by name, or partitions by topic (needs the spark-sql-kafka package)."""
    import json

    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", start)
    r = r.option("assign", json.dumps(topics)) if isinstance(topics, dict) else r.option("subscribe", topics)
    for k, v in {"kafka.group.id": group, "endingOffsets": None if stream else end, "maxOffsetsPerTrigger": per_trigger, **{f"kafka.{k}": v for k, v in (options or {}).items()}}.items():
        if v is not None:
            r = r.option(k, v)
    return r.load().select(F.col("value").cast("string").alias("value"))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket; standard input and reactive streams are fed through one."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


#: Sources that need a connector package: the format's name and the option each setting maps to.
CONNECTORS = {
    "Kinesis": ("aws-kinesis", {"streamName": "kinesis.streamName", "shardIds": "kinesis.shardIds", "iteratorType": "kinesis.startingposition"}),
    "KinesisKCL": ("aws-kinesis", {"kinesisStreamName": "kinesis.streamName", "applicationName": "kinesis.consumerName", "initialPosition": "kinesis.startingposition"}),
    "SQS": ("sqs", {"queueUrl": "queueUrl", "readParallelism": "numWorkers", "deleteReadMessages": "deleteMessages"}),
    "ServerSentEvent": ("sse", {"url": "url"}),
    "WebsocketClient": ("websocket", {"wsUrl": "url", "initMessages": "initMessages", "keepAlive": "keepAlive"}),
    "DeltaSharingCdf": ("deltaSharing", {"table": "path", "startingVersion": "startingVersion", "snapshotOnFirstRun": "responseFormat"}),
}


def connector(spark: SparkSession, kind: str, settings: dict) -> DataFrame:
    """A stream of a source whose package is on the cluster."""
    if kind not in CONNECTORS:
        raise SourceProblem(f"unknown source {kind}")
    name, options = CONNECTORS[kind]
    r = spark.readStream.format(name)
    for k, v in settings.items():
        r = r.option(options.get(k, k), str(v))
    if kind == "DeltaSharingCdf":
        r = r.option("readChangeFeed", "true")
    return r.load()
