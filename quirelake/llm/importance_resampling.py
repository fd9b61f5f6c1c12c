"""Resampling of documents towards a target distribution, by hashed n-gram weights.

Features are all runs of 1 to ``RUN`` consecutive words, hashed to ``BUCKETS``
buckets.  A bucket's gain is the logarithm of its share in the target over its
share in the documents; a document's weight is the mean gain of its features, and
the draw adds Gumbel noise from the id's digest, so that taking the highest scores
is a weighted draw without replacement.

Long texts are skewed, so they are cut into overlapping chunks that are dealt to
tasks by text and chunk: cuts fall on word boundaries, each chunk carries the
``RUN`` - 1 words that follow it, and owns the features that start at its own
words.  Every feature is thus counted in exactly one chunk.  A chunk's buckets are
written once; the corpus' counts and then the chunks' gains are read from there,
and chunk counts and gains are summed by document.

A null text has no words; a null id is drawn as the empty string and sorts last.
Rows that share an id are documents of their own.  Texts and words of any length
are read whole (a word is never cut, so a longer one makes a longer chunk).  Empty
documents give an empty result, an empty target counts no features; other columns
of the inputs, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, written

#: Words of the longest feature, and buckets (65,536 at most).
RUN, BUCKETS = 2, 10_000
#: Bytes of the words that a chunk owns, about.
CHUNK_BYTES = 1 << 16
#: The share that is drawn, in percent, of the documents with so many words.
PERCENT, LEAST_WORDS = 25, 20
SEED = 7

#: Lower-cased words over UTF-8 bytes, and what parts them.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]+")
_SPACED = re.compile(rb" [^ ]+")

_CHUNKS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("own", pa.binary()), ("carry", pa.binary())])
_BUCKETS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])


def chunks(text: bytes, run: int = RUN, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """A lower-cased text cut before words: what each chunk owns, and the words it carries from the next ones."""
    at = 0
    while True:
        gap = _GAP.search(text, at + size)
        if not gap:
            yield text[at:], b""
            return
        carried, end = [], gap.end()
        for _ in range(run - 1):
            word = _WORD.search(text, end)
            if not word:
                break
            carried.append(word[0])
            end = word.end()
        yield text[at : gap.end()], b" ".join(carried)
        at = gap.end()


def feature_buckets(own: bytes, carry: bytes, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The words that a chunk owns, and the buckets of the features that start at them."""
    words = _SPACED.findall(b" " + _GAP.sub(b" ", own))
    n = len(words)
    words += [b" " + w for w in carry.split()]
    hashes = list(map(crc32, [w[1:] for w in words[:n]]))
    found = [hashes]
    for k in range(1, run):  # the checksum of a run goes on where that of the shorter one ends
        following = words[k : n + k]
        hashes = list(map(crc32, following, hashes))
        found.append(hashes)
    flat = np.fromiter((h for part in found for h in part), np.uint32, sum(map(len, found)))
    return n, (flat % np.uint32(buckets)).astype("<u2")


def _cutter(run: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                lower = text.as_buffer().to_pybytes().lower() if text.is_valid else b""  # bytes: only A to Z fold
                rows += [(key, doc, k, *parts) for k, parts in enumerate(chunks(lower, run, size))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNKS.types, strict=True)], schema=_CHUNKS)

    return cut


def _bucketer(run: int, buckets: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [feature_buckets(own, carry, run, buckets) for own, carry in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())], schema=_BUCKETS)

    return hashed


def bucket_table(texts: DataFrame, *, run: int = RUN, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written ``key`` (one for each row), ``doc_id, n_words, buckets`` (little-endian, two bytes each), one row a chunk."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 65,536 at most")
    rows = texts.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInArrow(_cutter(run, chunk_bytes), "key long, doc_id long, chunk int, own binary, carry binary")
    return written(cut.repartition("key", "chunk").mapInArrow(_bucketer(run, buckets), "key long, doc_id long, n_words long, buckets binary"), "buckets")


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of a bucket table: each task sends one row for each bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for held in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(held, "<u2"), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` in thousandths, from the counts of both sides; one row for each bucket."""
    spark = documents.sparkSession
    sides = documents.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionAll(target.select("bucket", F.lit(0), "n")).unionAll(spark.range(buckets).select(F.col("id"), F.lit(0), F.lit(0)))
    both = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    share = ((x["t"] + 1) * (x["all_s"] + buckets)) / ((x["s"] + 1) * (x["all_t"] + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def _summer(gains: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.frombuffer(b, "<u2") for b in batch.column(3).to_pylist()]
            sums = [pa.array([len(b) for b in held], pa.int64()), pa.array([int(gains[b].sum()) for b in held], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *sums], names=["key", "doc_id", "n_words", "n_features", "gain"])

    return add


def document_weights(table: DataFrame, gains: DataFrame) -> DataFrame:
    """``key, doc_id, n_words, n_features, weight``: chunk sums by document.  The gains, one number a bucket, go to every task."""
    known = gains.orderBy("bucket").toArrow().column("gain").to_numpy().astype(np.int64)
    parts = table.mapInArrow(_summer(known), "key long, doc_id long, n_words long, n_features long, gain long")
    sums = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    mean = F.expr("coalesce((gain - pmod(gain, n_features)) div nullif(n_features, 0), 0L)")  # a floor, in whole numbers
    return sums.select("key", "doc_id", "n_words", "n_features", mean.alias("weight"))


def with_scores(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Weights and their Gumbel noise, a function of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def with_ranks(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rank`` of the drawn documents (null for others): a range partition sorts, and the counts of the parts before it are added.

    ``scored`` must be a written table.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    enough = F.col("n_words") >= least_words
    chosen = scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts a partition's rows in their order, in its lower 33 bits.
    placed = written(chosen.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranked")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    total = counts.agg(F.floor(F.coalesce(F.sum("__n"), F.lit(0)) * percent / 100).alias("__drawn"))
    rank = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(total)).select(*scored.columns, F.when(rank <= F.col("__drawn"), rank).alias("rank"))
    return ranked.unionAll(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(
    documents: DataFrame, target: DataFrame, *, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight, score, rank`` (null if not drawn)."""
    own = bucket_table(documents, run=run, buckets=buckets, chunk_bytes=chunk_bytes, id_col=id_col, text_col=text_col)
    wanted = bucket_table(target, run=run, buckets=buckets, chunk_bytes=chunk_bytes, id_col=target_id, text_col=target_text)
    gains = bucket_gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets), buckets)
    scored = written(with_scores(document_weights(own, gains), seed), "scored")
    return with_ranks(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def drawn(documents: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of ``documents``, whole; rows that share an id, null included, are drawn together."""
    chosen = scores.where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(chosen, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")


_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The registered query for DuckDB, which has no CRC-32: a table by its polynomial, and a fold over each distinct feature's bytes.
ORACLE_SQL = rf"""
WITH crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (
    SELECT 0 AS side, row_number() OVER () AS key, doc_id, {_LOWER} AS w FROM documents
    UNION ALL SELECT 1, row_number() OVER (), item_id, {_LOWER} FROM benchmark),
lists AS MATERIALIZED (SELECT side, key, doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM texts),
held AS MATERIALIZED (SELECT side, key, f, count(*) AS n FROM (SELECT side, key, unnest(f) AS f FROM lists) GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM held)),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM bytes, crc),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM held JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS MATERIALIZED (
    SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + {BUCKETS})))) AS BIGINT) AS gain FROM counts, totals),
sums AS (SELECT key, sum(gain * n) AS total, sum(n) AS n FROM held JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY key),
weighed AS (
    SELECT key, doc_id, n_words, len(f) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM lists LEFT JOIN sums USING (key) WHERE side = 0),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (
    SELECT key, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, key) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (key)
"""
