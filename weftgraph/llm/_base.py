"""Shared helpers: reading tables, cutting lineage, folds, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The result has no lineage to recompute after an executor is lost, and its
    size on disk is known to the planner. Every read gives the same rows. The
    codec is zstd: it compresses in heap memory, where the default's direct
    buffers pile up outside the heap over many small tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a cut() result that nothing reads any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def held_out(doc_id: str, n: int, rest: int) -> Column:
    """True for the held-out fold. A row without an id is never learned from, so it counts as held out."""
    return F.coalesce(fold(doc_id, n) == rest, F.lit(True))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label for each id: ids that are null, unlabelled or labelled both ways are left out."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("_y"))
    return (
        lab.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
        .where("_y = _z")
        .select("_id", "_y")
    )


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, fn: Callable[[list], list[pa.Array]], as_bytes: bool = False, rows: int = 1024) -> DataFrame:
    """Run fn over whole texts, at most `rows` of them at a time.

    `keep` columns pass through; fn maps a list of texts (str, or UTF-8 bytes)
    with None for null to Arrow arrays in the order of `schema`.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    full = ", ".join([f"`{k}` {types[k]}" for k in keep] + [schema])
    src = df.select(*keep, (F.col(text).cast("binary") if as_bytes else F.col(text).cast("string")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = [part.column(i) for i in range(len(keep))] + fn(part.column(len(keep)).to_pylist())
                if names is None:
                    names = list(keep) + out_names
                yield pa.RecordBatch.from_arrays(out, names)

    out_names = [x.strip().split(" ")[0].strip("`") for x in split_schema(schema)]
    return src.mapInArrow(run, full)


def split_schema(schema: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += ch
    return parts + [now]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def platt(d: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit to counts of both labels at scores d (Newton, light ridge)."""
    a, b = 1.0, 0.0
    n = pos + neg
    if not (pos.sum() and neg.sum()):
        return 0.0, float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
    for _ in range(60):
        p = sigmoid(a * d + b)
        r, w = pos - n * p, n * p * (1 - p) + 1e-9
        g = np.array([(r * d).sum() - 1e-3 * (a - 1.0), r.sum()])
        h = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step = np.clip(step, -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
