"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that this process has written.
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallyflow-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared root."""
    return f"{shared_root(spark)}/tallyflow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once, survives lost executors."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    _made.append(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of `written` that no plan reads any more."""
    if (at := getattr(df, "_written_at", None)) in _made:
        _made.remove(at)
        _delete(df.sparkSession, at)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this process has written so far: results that still read one must be saved before."""
    while _made:
        _delete(spark, _made.pop())


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from (where they see the same folder)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
