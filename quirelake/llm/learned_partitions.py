"""Approximate nearest neighbours by learned partitions.

The index is fitted on at most ``SAMPLE`` distinct vectors, those of the smallest
digests: their neighbour graph is cut into balanced parts (medians along principal
directions, then rounds in which vertices move to the part of most of their
neighbours while it has room).  A softmax classifier learns the part of a vector
and places every row of the table; a second one learns in which parts a query's
neighbours lie and routes queries: parts are probed, most probable first, until
their probabilities add up to a threshold.  The threshold is the least one that
finds ``TARGET`` of the true neighbours of sampled queries that neither classifier
has seen.  How much that prunes depends on the data: vectors of random directions
need most parts, clustered ones few.

All rows are indexed.  Equal vectors are one entry of the index with the ``k`` + 1
rows of the smallest ids, which is all that a query can return of them, and are
searched for once.  Parts are dealt into blocks of bounded size, queries of a part
too; blocks meet in tasks, and each meeting returns ``k`` + 1 rows a query at most,
reranked by inner products summed in the order of the components, in double
precision, over the original vectors.

Vectors that are null, zero or empty, or hold null or non-finite components, take
no part, nor do null ids; a shorter vector counts as padded with zeros.  Repeated
ids are rows of their own, each a query and a candidate of the others; ties go to
the smaller id.  An empty table gives an empty result; other columns of the input,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mark, settled, slices, written

K, EVERY = 20, 20
#: Distinct vectors on which the index is fitted, at most, and its parts (one for each ``LEAST`` vectors of a smaller sample).
SAMPLE, PARTS, LEAST = 8192, 32, 16
#: Neighbours of a vertex of the graph, and the share of the sample that is held out to set the threshold.
NEIGHBOURS, HELD_OUT = 20, 8
#: The share of true neighbours that the threshold must find among held-out queries.
TARGET = 0.96
#: Entries of the index and queries that meet at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Groups into which an entry's rows are dealt before its smallest ids are taken.
SALTS = 16
#: Query rows of one entry that are joined in one group.
TOGETHER = 256
SEED = 11


class Model(NamedTuple):
    """Two softmax classifiers (weights with a last row of intercepts), the vectors' scale, and the threshold."""

    place: np.ndarray
    route: np.ndarray
    scale: float
    threshold: float


def _features(x: np.ndarray, dim: int, scale: float) -> np.ndarray:
    """Scaled vectors of ``dim`` components, and a one."""
    own = np.zeros((len(x), dim + 1))
    width = min(dim, x.shape[1])
    own[:, :width] = x[:, :width] / scale
    own[:, dim] = 1
    return own


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def neighbours(queries: np.ndarray, x: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """The ``k`` rows of ``x`` with the largest inner products, without row ``own`` of each query."""
    out = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ x.T
        s[np.arange(len(s)), own[at : at + 512]] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex: medians along principal directions, then moves towards neighbours within a cap."""
    n = len(x)
    part = np.zeros(n, np.int64)
    open_parts = [(np.arange(n), 0, parts)]
    while open_parts:
        rows, first, count = open_parts.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        ranked = rows[np.argsort(centred @ direction, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        open_parts += [(ranked[:cut], first, left), (ranked[cut:], first + left, count - left)]
    a = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    cap = int(np.ceil(slack * n / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        best = votes.argmax(axis=1)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < cap:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def softmax_regression(features: np.ndarray, wanted: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Weights whose softmax is close to the ``wanted`` distributions: full gradients with momentum of both orders."""
    w = np.zeros((features.shape[1], wanted.shape[1]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope = features.T @ (_softmax(features @ w) - wanted) / len(features) + decay * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w


def probes(model: Model, x: np.ndarray) -> np.ndarray:
    """For each query which parts it searches: the most probable ones until the threshold is reached."""
    p = _softmax(_features(x, len(model.route) - 1, model.scale) @ model.route)
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, axis=1)
    chosen = np.cumsum(ranked, axis=1) - ranked < model.threshold
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, chosen, axis=1)
    return out


def placed(model: Model, x: np.ndarray) -> np.ndarray:
    """The part of each vector."""
    return np.argmax(_features(x, len(model.place) - 1, model.scale) @ model.place, axis=1)


def fit(sample: np.ndarray, *, parts: int = PARTS, k: int = K, target: float = TARGET) -> Model:
    """The model of a sample of distinct vectors; a sample too small to part has one part."""
    n, dim = sample.shape
    parts = max(1, min(parts, n // LEAST))
    scale = float(np.sqrt((sample**2).mean()) or 1.0) if n else 1.0
    if parts == 1:
        empty = np.zeros((dim + 1, 1))
        return Model(empty, empty, scale, 1.0)
    degree = min(NEIGHBOURS, n - 1)
    graph = neighbours(sample, sample, degree, np.arange(n))
    features = _features(sample, dim, scale)
    held = np.random.default_rng(SEED).permutation(n) % HELD_OUT == 0
    part = balanced_parts(sample, graph, parts)
    place = softmax_regression(features[~held], np.eye(parts)[part[~held]])
    own = np.argmax(features @ place, axis=1)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.repeat(np.arange(n), degree), own[graph].ravel()), 1 / degree)
    route = softmax_regression(features[~held], wanted[~held])
    # The threshold: how much probability stands before the part of each true neighbour of the held-out queries.
    p = _softmax(features[held] @ route)
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, axis=1)
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
    near = neighbours(sample[held], sample, min(k, n - 1), np.flatnonzero(held))
    needed = np.sort(np.take_along_axis(before, own[near], axis=1).ravel())
    return Model(place, route, scale, float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))], 2)))


def _matrix(rows: list, dim: int | None = None) -> np.ndarray:
    own = [np.frombuffer(r, np.float64) for r in rows]
    dim = max(map(len, own), default=0) if dim is None else dim
    out = np.zeros((len(own), dim))
    for k, v in enumerate(own):
        out[k, : len(v)] = v[:dim]
    return out


def valid(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles, no negative zeros) of the rows that take part."""
    x = F.col(vector_col)
    value = lambda v: v.cast("double")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(value(v)) & (F.abs(value(v)) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return embeddings.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: value(v) + 0.0).alias("vector"))


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes without zeros at their ends, and the digests that name them."""
    import hashlib

    for batch in slices(batches, 1024):
        own = [np.trim_zeros(np.array(v, np.float64), "b").tobytes() for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(v).hexdigest()[:32] for v in own]), pa.array(own, pa.binary())], names=["key", "vec_id", "entry", "vector"])


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``entry, vector, members``: distinct vectors with the rows (``vec_id, key``) of the k + 1 smallest ids."""
    w = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id", "key"))
    dealt = rows.select("entry", "vec_id", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    few = dealt.withColumn("r", w("entry", "salt")).where(F.col("r") <= k + 1).drop("r", "salt")
    least = few.withColumn("r", w("entry")).where(F.col("r") <= k + 1)
    members = least.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("vec_id", "key"))).alias("members"))
    return rows.groupBy("entry").agg(F.first("vector").alias("vector")).join(members, "entry").select("entry", "vector", "members")


def sample_vectors(rows: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """The distinct vectors of the smallest digests, ``size`` at most."""
    some = rows.select("entry", "vector").orderBy("entry").limit(size).toArrow()
    return _matrix(some.column("vector").to_pylist())


def _placer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            part = placed(model, _matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(part, pa.int32())], names=["entry", "vector", "members", "part"])

    return run


def _router(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            some, part = np.nonzero(probes(model, _matrix(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array(part, pa.int32())], names=["entry", "vector", "part"])

    return run


def _row_block(rows: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(rows["vector"].tolist())
    counts = rows["members"].map(len).to_numpy(np.int64)
    ids, keys = (np.array([m[c] for own in rows["members"] for m in own], np.int64) for c in ("vec_id", "key"))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "block": [rows["block"].iloc[0]], "dim": [x.shape[1]], "vectors": [x.tobytes()], "counts": [counts.tobytes()], "ids": [ids.tobytes()], "keys": [keys.tobytes()]})


def _query_block(rows: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(rows["vector"].tolist())
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "q_block": [rows["q_block"].iloc[0]], "q_dim": [x.shape[1]], "q_vectors": [x.tobytes()], "q_entries": [rows["entry"].tolist()]})


def _blocks(df: DataFrame, name: str, size: int, shape, schema: str) -> DataFrame:
    """Each part's rows dealt into blocks of about ``size``."""
    n = df.groupBy("part").agg(F.ceil(F.count("*") / size).alias("__n"))
    return df.join(F.broadcast(n), "part").withColumn(name, F.pmod(F.xxhash64("entry"), F.col("__n"))).drop("__n").groupBy("part", name).applyInPandas(shape, schema)


def best_rows(queries: np.ndarray, x: np.ndarray, counts: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
    """``query, vec_id, key, score``: the k rows of the largest inner products for each query; ``counts`` rows share a vector."""
    ends = np.cumsum(counts)
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ x.T
        for q in range(len(rough)):
            own = rough[q]
            least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
            # Matrix products round as they like: all that may be among the best are summed again, in order.
            some = np.flatnonzero(own >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else np.ones(len(own), bool))
            products = x[some] * queries[at + q]
            score = np.zeros(len(some))
            for j in range(products.shape[1]):
                score += products[:, j]
            found = []
            for s, row in sorted(zip(score.tolist(), some.tolist(), strict=True), key=lambda p: -p[0]):
                if len(found) >= k and s < found[k - 1][0]:
                    break
                found += [(s, int(ids[m]), int(keys[m])) for m in range(ends[row] - counts[row], ends[row])]
            for s, i, key in sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:k]:
                yield at + q, i, key, s


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                dim = max(row["dim"], row["q_dim"])
                x, q = (np.pad(v, ((0, 0), (0, dim - v.shape[1]))) for v in (np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]), np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["q_dim"])))
                found = list(best_rows(q, x, *(np.frombuffer(row[c], np.int64) for c in ("counts", "ids", "keys")), k))
                names = row["q_entries"]
                columns = [[names[f[0]] for f in found], *([f[c] for f in found] for c in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["entry", "vec_id", "key", "score"])

    return run


def search(embeddings: DataFrame, *, every: int = EVERY, k: int = K, parts: int = PARTS, sample: int = SAMPLE, target: float = TARGET, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k`` nearest found."""
    since = mark()
    spark = embeddings.sparkSession
    packed = valid(embeddings, id_col=id_col, vector_col=vector_col).select(F.monotonically_increasing_id().alias("key"), "vec_id", "vector")
    rows = written(packed.mapInArrow(_packer, "key long, vec_id long, entry string, vector binary"), "vectors")
    distinct = written(entries(rows, k), "entries")
    model = fit(sample_vectors(distinct, sample), parts=parts, k=k, target=target)
    index = written(_blocks(distinct.mapInArrow(_placer(model), "entry string, vector binary, members array<struct<vec_id:long,key:long>>, part int"), "block", block_rows, _row_block, "part int, block long, dim int, vectors binary, counts binary, ids binary, keys binary"), "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    wanted = written(asked.groupBy("entry").agg(F.first("vector").alias("vector"), F.ceil(F.count("*") / TOGETHER).alias("copies")), "wanted")
    queries = written(_blocks(wanted.select("entry", "vector").mapInArrow(_router(model), "entry string, vector binary, part int"), "q_block", block_queries, _query_block, "part int, q_block long, q_dim int, q_vectors binary, q_entries array<string>"), "queries")
    # A stated query set against the parts it is routed to: pairs of blocks of a part.
    pairs = queries.select("part", "q_block").join(index.select("part", "block"), "part")
    met = pairs.join(queries.hint("merge"), ["part", "q_block"]).join(index.hint("merge"), ["part", "block"])
    tasks = max(1, min(pairs.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = met.repartition(tasks, "part", "block", "q_block").mapInArrow(_searcher(k + 1), "entry string, vec_id long, key long, score double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id", "key"))).where(F.col("r") <= k + 1)
    best = ranked.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "key", "score"))).alias("best"))
    # Query rows of one vector share what was found; many of them are joined in groups.
    shared = best.join(wanted.select("entry", "copies"), "entry").select("entry", "best", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    names = asked.join(wanted.select("entry", "copies"), "entry").select("entry", F.col("vec_id").alias("query_id"), F.col("key").alias("own"), F.pmod(F.xxhash64("key"), F.col("copies")).alias("salt"))
    others = names.join(shared, ["entry", "salt"]).select("query_id", F.slice(F.filter("best", lambda b: b["key"] != F.col("own")), 1, k).alias("best"))
    out = others.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
    return settled(out, "neighbours", since)
