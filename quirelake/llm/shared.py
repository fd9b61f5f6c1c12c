"""Written tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder, as in tests.
LOCAL_ROOT = "/tmp/checkpoints"
#: Rows of a batch that become Python objects at once.
TOGETHER = 64

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only if that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = LOCAL_ROOT
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one written table; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/quirelake-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs a read of the written files,
    never a recomputation of what came before them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point from which written tables can be forgotten."""
    return len(_made)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` written, and all tables written since ``since`` removed: no plan but ``df``'s may need them."""
    out = written(df, name)
    for spark, path in _made[since:-1]:
        remove(spark, path)
    del _made[since:-1]
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a task holds few of its texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has already gone; its owner clears the folder
            return
