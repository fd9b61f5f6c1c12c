"""Exact top-k inner products over a bit-sliced index.

Each component x becomes floor(1024 * x).  Rows are dealt into blocks; a block
holds, for each attribute (component), one bitmap for each bit of its value above
the block's least value.  For a query the slices are added, weighted by the
query's components, with carry-save bitmap arithmetic; a negative weight takes
the complemented slices.  The sums stay in slices too: going down from the most
significant one splits the rows at the k-th largest sum.  The rows above it and
the boundary (the rows that share that sum) are resolved exactly: their scores
are read from the slices, and ties go to the smaller id, then the smaller row.

Queries are the rows whose id is divisible by ``every``; each block of queries
meets each block of rows in one task, and each meeting returns k rows a query at
most.  A query never meets its own row.  Repeated rows and ids are rows of their
own: each is a query and a candidate.

Vectors that are null or hold null or non-finite components take no part; a
shorter vector counts as padded with zeros.  Components beyond 64 bits and scores
beyond them are held at the largest 64-bit values.  An empty table gives an empty
result; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, written

SCALE = 1024
K = 10
#: Rows of the index and queries that meet at once.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 256

BLOCK = "block long, dim int, width int, bits int, ids binary, keys binary, floor binary, slices binary"


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _slice_block(rows: pd.DataFrame) -> pd.DataFrame:
    dim = max((len(v) for v in rows["vector"]), default=0)
    values = _matrix(rows["vector"], dim)
    floor = values.min(axis=0) if dim else np.zeros(0, np.int64)
    above = values.view(np.uint64) - floor.view(np.uint64)  # modulo 2**64, so no difference is too large
    bits = int(above.max(initial=0)).bit_length()
    slices = np.stack([np.packbits((above >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0).T for b in range(bits)], axis=1) if dim and bits else np.zeros((dim, 0, 0), np.uint8)
    own = {name: [rows[c].to_numpy(np.int64).tobytes()] for name, c in (("ids", "vec_id"), ("keys", "key"))}
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "dim": [dim], "width": [len(rows)], "bits": [bits], **own, "floor": [floor.tobytes()], "slices": [np.ascontiguousarray(slices).tobytes()]})


def _add_slices(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The sum of weighted bitmaps (``columns[w]``: stacks of those of weight 2**w) as slices, lowest first."""
    out, carried = [], []
    w = 0
    while w < len(columns) or carried:
        own = np.concatenate([*(columns[w] if w < len(columns) else []), *carried, np.zeros((0, words), np.uint64)])
        carried = []
        # Three bitmaps of a weight become one, and one of twice the weight; all triples at once.
        while len(own) >= 2:
            n = len(own) // 3
            if not n:
                own = np.concatenate([own, np.zeros((1, words), np.uint64)])
                n = 1
            a, b, c = own[:n], own[n : 2 * n], own[2 * n : 3 * n]
            half = a ^ b
            carried.append((a & b) | (half & c))
            own = np.concatenate([half ^ c, own[3 * n :]])
        out.append(own[0] if len(own) else np.zeros(words, np.uint64))
        w += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: list[np.ndarray], k: int, present: np.ndarray) -> np.ndarray:
    """The rows above the k-th largest sum and the boundary, which has that sum: from the top slice down."""
    above, equal = np.zeros_like(present), present
    for bit in reversed(slices):
        more = equal & bit
        if _count(above) + _count(more) >= k:
            equal = more
        else:
            above = above | more
            equal = equal & ~bit
    return above | equal


def search_block(block: dict, query_keys: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """The k best rows of one block for each query: ``query's key, vec_id, key, score``."""
    n, dim, bits = block["width"], block["dim"], block["bits"]
    ids, keys = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["keys"], np.int64)
    floor = np.frombuffer(block["floor"], np.int64).tolist()
    pad = -(-n // 64) * 8
    padded = np.zeros((dim, bits, pad), np.uint8)
    if bits:
        padded[:, :, : -(-n // 8)] = np.frombuffer(block["slices"], np.uint8).reshape(dim, bits, -(-n // 8))
    plain = padded.view(np.uint64)
    everyone = np.zeros(pad, np.uint8)
    everyone[: -(-n // 8)] = np.packbits(np.ones(n, bool))
    place = {int(key): at for at, key in enumerate(keys)}
    out = []
    for q, vector in zip(query_keys.tolist(), queries, strict=True):
        weights = vector[:dim].tolist()
        size = [abs(w) for w in weights]
        turned = plain ^ np.array([0 if w >= 0 else (1 << 64) - 1 for w in weights], np.uint64).reshape(-1, 1, 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(max(size, default=0).bit_length() + bits)]
        for w in range(max(size, default=0).bit_length()):
            some = [j for j in range(dim) if size[j] >> w & 1]
            for b in range(bits if some else 0):
                columns[w + b].append(turned[some, b])
        mask = everyone.copy()
        if q in place:
            mask[place[q] >> 3] &= 255 ^ (128 >> (place[q] & 7))
        seen = mask.view(np.uint64)
        sums = _add_slices(columns, pad // 8)
        if _count(seen) > k:
            seen = top_rows(sums, k, seen)
        rows = np.flatnonzero(np.unpackbits(seen.view(np.uint8))[:n])
        if not len(rows):
            continue
        # The exact scores: a row's sum, and a constant that the floors and the complements leave.
        constant = sum(w * f for w, f in zip(weights, floor, strict=True)) - sum(-w for w in weights if w < 0) * ((1 << bits) - 1)
        total = [constant] * len(rows)
        for w, bit in enumerate(sums):
            for i in np.flatnonzero(np.unpackbits(bit.view(np.uint8))[rows]).tolist():
                total[i] += 1 << w
        best = sorted(zip((-t for t in total), ids[rows].tolist(), keys[rows].tolist(), strict=True))[:k]
        out += [(q, i, key, max(-(1 << 63), min((1 << 63) - 1, -t))) for t, i, key in best]
    return out


def _searcher(k: int):
    names = ["query_key", "vec_id", "key", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                queries = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["q_dim"])
                if row["q_dim"] < row["dim"]:
                    queries = np.pad(queries, ((0, 0), (0, row["dim"] - row["q_dim"])))
                found = search_block(row, np.frombuffer(row["q_keys"], np.int64), queries, k)
                columns = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _query_block(rows: pd.DataFrame) -> pd.DataFrame:
    dim = max(len(v) for v in rows["vector"])
    return pd.DataFrame({"q_block": [rows["q_block"].iloc[0]], "q_dim": [dim], "q_keys": [rows["key"].to_numpy(np.int64).tobytes()], "q_vectors": [_matrix(rows["vector"], dim).tobytes()]})


def quantised(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, as whole numbers."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return embeddings.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vector"))


def bit_sliced_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written index over ``key, vec_id, vector``: one row a block of about ``block_rows`` vectors."""
    blocks = 1 + vectors.count() // block_rows
    return written(vectors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").applyInPandas(_slice_block, BLOCK), "bit-slices")


def top_k(embeddings: DataFrame, *, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k rows of the largest inner product."""
    # A row's key is fixed once it is written.
    vectors = written(quantised(embeddings, id_col=id_col, vector_col=vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    index = bit_sliced_index(vectors)
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks = 1 + asked.count() // BLOCK_QUERIES
    queries = written(asked.withColumn("q_block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("q_block").applyInPandas(_query_block, "q_block long, q_dim int, q_keys binary, q_vectors binary"), "queries")
    # A stated query set against all rows: the pairs of blocks are dealt to tasks, and each side is joined by its number.
    pairs = index.select("block").join(F.broadcast(asked.sparkSession.range(blocks).withColumnRenamed("id", "q_block")))
    met = pairs.join(queries.hint("merge"), "q_block").join(index.hint("merge"), "block")
    tasks = max(1, min(index.count() * blocks, 4 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = met.repartition(tasks, "block", "q_block").mapInArrow(_searcher(k), "query_key long, vec_id long, key long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "key"))).where(F.col("rank") <= k)
    names = asked.select(F.col("key").alias("query_key"), F.col("vec_id").alias("query_id"))
    return best.join(names, "query_key").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB's SQL, over the table ``embeddings``.
ORACLE_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.key, q.vec_id AS query_id, c.vec_id, c.key AS other, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.key <> c.key WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id, other) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
