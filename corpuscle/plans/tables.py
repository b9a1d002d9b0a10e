"""Tables between the steps of a plan, in the folder that the executors share, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the executors of a cluster this package, once for each application, and bounds Arrow batches by bytes where the session has Spark's own bound."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":  # a worker holds a batch several times over
        spark.conf.set(size, "6m")
    sc = spark.sparkContext
    if getattr(sc, "_corpuscle_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "corpuscle_package.zip")  # on the driver, which serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "corpuscle").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(target)
    sc._corpuscle_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in spark.checkpoint.dir; a local one only where none is named and the master is local."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_corpuscle_dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = sc._corpuscle_dir = f"file://{os.path.realpath(tempfile.mkdtemp(prefix='corpuscle-'))}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, so that later plans start from it. Whoever owns the folder clears it: a result may still read the table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
