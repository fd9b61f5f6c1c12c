"""Token-id files: fixed-size id blocks, shuffled into byte planes, with a chunk index.

Format ("chunks" and "index", both Parquet, so that Spark's commit protocol and
any Hadoop store hold them):

* ``chunks``: one row per chunk of whole documents, in ascending document order:
  ``part, seq`` (order), ``doc_ids``, ``doc_tokens`` (ids of each document),
  ``n_ids``, ``payload`` and ``plane_bytes``.  The chunk's ids are cut into blocks
  of ``BLOCK_IDS`` (the last may be shorter).  Each block of little-endian
  unsigned 32-bit ids is transposed into four byte planes; each plane is a
  zstandard frame; ``payload`` holds the frames one after another and
  ``plane_bytes`` their lengths, four for each block.
* ``index``: one row per chunk: ``part, seq, n_docs, n_ids, start`` (ids before it).

A chunk is closed at ``CHUNK_IDS`` ids; only a single longer document makes a
larger one.  Rows are ordered by document id (nulls first), then text; repeated
ids stay separate rows.  A null text is an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import BYTE_LEVEL, encoder, vocabulary
from .shared import new_path, slices

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20

CHUNKS = "part long, seq int, doc_ids array<long>, doc_tokens array<long>, n_ids long, payload binary, plane_bytes array<int>"
_CHUNKS = pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("plane_bytes", pa.list_(pa.int32()))])
_DOCS = pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def shuffle_planes(ids: bytes, block_ids: int = BLOCK_IDS, level: int = 1) -> tuple[bytes, list[int]]:
    """The compressed byte planes of little-endian 32-bit ids, and their lengths."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    frames = []
    values = np.frombuffer(ids, np.uint8)
    for at in range(0, len(values), 4 * block_ids):
        planes = values[at : at + 4 * block_ids].reshape(-1, 4).T
        frames += [press.compress(np.ascontiguousarray(p).data) for p in planes]
    return b"".join(frames), [len(f) for f in frames]


def restore_planes(payload: bytes, plane_bytes: list[int]) -> bytes:
    """The ids that ``shuffle_planes`` was given."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    ends = np.cumsum(plane_bytes)
    planes = [press.decompress(payload[e - n : e]) for e, n in zip(ends, plane_bytes, strict=True)]
    blocks = []
    for k in range(0, len(planes), 4):
        blocks.append(np.stack([np.frombuffer(p, np.uint8) for p in planes[k : k + 4]], axis=1).tobytes())
    return b"".join(blocks)


def _chunker(path: str, end_id: int | None, chunk_ids: int):
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, True)
        seq, part = 0, None
        docs: list = []
        counts: list[int] = []
        held: list[bytes] = []
        n = 0

        def chunk() -> pa.RecordBatch:
            payload, sizes = shuffle_planes(b"".join(held))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "doc_ids": docs, "doc_tokens": counts, "n_ids": n, "payload": payload, "plane_bytes": sizes}], _CHUNKS)

        for batch in slices(batches):
            for doc, text, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # noqa: B020
                ids = own.encode(text or "") + end
                docs.append(doc)
                counts.append(len(ids) // 4)
                held.append(ids)
                n += len(ids) // 4
                if n >= chunk_ids:
                    yield chunk()
                    seq, docs, counts, held, n = seq + 1, [], [], [], 0
        if docs:
            yield chunk()

    return run


def write_token_files(documents: DataFrame, path: str, *, vocab: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text and write ``{path}/chunks`` and ``{path}/index``.

    Documents are dealt by ranges of their id, so that each task writes one run of
    consecutive documents; an empty table gives empty files.
    """
    spark = documents.sparkSession
    rows = (
        documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    rows.mapInArrow(_chunker(vocab or vocabulary(BYTE_LEVEL), end_id, chunk_ids), CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("part", "seq", F.size("doc_ids").alias("n_docs"), "n_ids")
    # One row per task that wrote: their number is the number of partitions.
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks.join(parts.select("part", "before"), "part").select("part", "seq", "n_docs", "n_ids", (F.col("before") + within).alias("start")).write.parquet(f"{path}/index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for row in batch.to_pylist():
            ids = memoryview(restore_planes(row["payload"], row["plane_bytes"]))
            ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
            starts = ends - np.asarray(row["doc_tokens"], np.int64)
            n = len(ends)
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int64()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())], schema=_DOCS)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    docs = chunks.mapInArrow(_reader, "part long, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    index = spark.read.parquet(f"{path}/index").select("part", "seq", F.col("start").alias("before"))
    return docs.join(index, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _ids_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for batch in slices(batches, 1):
        for row in batch.to_pylist():
            ids = np.frombuffer(restore_planes(row["payload"], row["plane_bytes"]), "<u4").astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(row["doc_tokens"], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], schema=schema)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, ids``."""
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(_ids_reader, "doc_id long, ids array<long>")


def token_file_digests(documents: DataFrame) -> DataFrame:
    """Write the token files of ``documents`` in the shared folder and read them back."""
    spark = documents.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(documents, path)
    return read_token_digests(spark, path)
