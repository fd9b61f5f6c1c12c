"""Tables written between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Used only where a local session names no folder, as in tests.
LOCAL_ROOT = "/tmp/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a local folder only if that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = LOCAL_ROOT
    path = f"{root.rstrip('/')}/quirelake-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: what follows recomputes nothing that came before, even if executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to as many tasks as a shuffle has.

    For small rows that cost much: adaptive execution goes by their bytes and would
    leave a few tasks, but doesn't join partitions of a stated number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@atexit.register
def _clean() -> None:
    """What was written goes when the driver ends, through Hadoop's file system, whatever its scheme."""
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has already gone; its owner clears the folder
            return
