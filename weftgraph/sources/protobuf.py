"""Protobuf messages by a descriptor set file, with the google.protobuf library in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


@lru_cache(maxsize=16)
def message(descriptors: bytes, name: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def _read(path: str) -> bytes:
    """A descriptor set through Spark, so that any file system will do."""
    from pyspark.sql import SparkSession

    return bytes(SparkSession.active().read.format("binaryFile").load(path).first().content)


def parser(path: str, name: str):
    """bytes to JSON text; null where the bytes are no such message."""
    data = _read(path)

    @F.pandas_udf(StringType())
    def parse(s: pd.Series) -> pd.Series:
        from google.protobuf.json_format import MessageToJson
        from google.protobuf.message import DecodeError

        def one(b):
            try:
                return None if b is None else MessageToJson(message(data, name).FromString(bytes(b)), preserving_proto_field_name=True, indent=None)
            except DecodeError:
                return None

        return s.map(one)

    return parse


def writer(path: str, name: str):
    """JSON text to bytes."""
    data = _read(path)

    @F.pandas_udf(BinaryType())
    def write(s: pd.Series) -> pd.Series:
        from google.protobuf.json_format import Parse

        return s.map(lambda t: None if t is None else Parse(t, message(data, name)()).SerializeToString())

    return write
