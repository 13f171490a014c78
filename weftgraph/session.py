"""Making the package importable for the workers of a running session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each SparkContext.

    Python workers of a cluster cannot rely on the driver's path; a zip handed to
    the context reaches every executor, those started later as well.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="weft-src-")) / "weftgraph.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._weft_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: no lineage, one value for random ids, a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
