"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes when the application ends. One is chosen only where that is
    unset and the executor is the driver's own process, as in tests."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(at)
    top = f"{at}/tessella-engine-{sc.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(_drop, sc, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: plans do not grow, and a lost executor costs a task."""
    at = shared_folder(df.sparkSession, "step")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _drop(sc, top: str) -> None:
    if sc._jsc is not None:  # else the session has ended before
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except OSError:  # the gateway has gone
            pass
