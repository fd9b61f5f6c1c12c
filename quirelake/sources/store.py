"""Keyed tables that take changes: buckets of Parquet, a manifest, and an atomic switch.

A row's bucket is a hash of its key.  A change rewrites the buckets that it touches
into a new folder and then publishes a manifest that names a folder for each
bucket; all other buckets keep their files.  Readers follow the last published
manifest, so a change that fails, or loses its executors, leaves the table as it
was.  Several rows of a key are one after ``merge`` (the last by ``order``) and
stay several after ``append``.  A lookup reads its keys' buckets only.

One writer at a time publishes a version: the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table.
BUCKETS = 64


class Store:
    """A table at ``path`` (a folder that the whole cluster shares) with rows of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, schema: str):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path.rstrip("/"), key, buckets, schema

    # Files and versions ---------------------------------------------------------

    def _file(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last published version, or -1."""
        fs = self._system()
        if not fs.exists(self._file("manifest")):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(self._file("manifest")) if s.getPath().getName().isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict[int, list[str]]:
        """Each bucket's folders."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        [row] = self.spark.read.text(f"{self.path}/manifest/{version}").collect()  # one line, a name a bucket
        return {int(k): v for k, v in json.loads(row["value"]).items()}

    def _publish(self, folders: dict[int, list[str]], after: int) -> None:
        made = f"making-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(folders),)], "value string").coalesce(1).write.text(f"{self.path}/{made}")
        fs = self._system()
        fs.mkdirs(self._file("manifest"))
        target = self._file(f"manifest/{after + 1}")
        if fs.exists(target) or not fs.rename(self._file(made), target):
            raise RuntimeError(f"version {after + 1} was published by another writer")

    # Rows -------------------------------------------------------------------------

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket(F.col(self.key))).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/{f}/__bucket={k}" for k, own in sorted(folders.items()) for f in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(F.col(self.key))).distinct().collect()}  # at most one row a bucket

    def merge(self, changes: DataFrame, order: str) -> set[int]:
        """Insert or replace by key: of old and new rows of a key the last by ``order`` stays.  Returns the rewritten buckets."""
        before = self.version()
        folders = self.manifest(before)
        own = changes.select(*self.read().columns)
        touched = self._touched(own)
        old = self._read({k: v for k, v in folders.items() if k in touched})
        columns = F.struct(*own.columns)
        latest = old.unionByName(own).groupBy(self.key).agg(F.max_by(columns, F.struct(order, columns)).alias("r")).select("r.*")
        folder = self._write(latest)
        self._publish(folders | {k: [folder] for k in touched}, before)
        return touched

    def append(self, rows: DataFrame) -> set[int]:
        """Rows beside all that are there, with no uniqueness; only new files are written."""
        before = self.version()
        folders = self.manifest(before)
        own = rows.select(*self.read().columns)
        touched = self._touched(own)
        folder = self._write(own)
        self._publish(folders | {k: [*folders.get(k, []), folder] for k in touched}, before)
        return touched

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (a column of the key's name): only their buckets are read."""
        folders = self.manifest()
        touched = self._touched(keys)
        return self._read({k: v for k, v in folders.items() if k in touched}).join(keys.select(self.key).distinct(), self.key, "left_semi")


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Store:
    """A new table of ``rows``, as its version 0."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    store = Store(rows.sparkSession, path, key, buckets, schema)
    store.append(rows)
    return store
