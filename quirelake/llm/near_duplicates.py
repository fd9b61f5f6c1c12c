"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

Shingles are five words; a document with fewer words is one shingle, one without
words is empty and linked with nothing.  Each distinct shingle is hashed to 64
bits.  A first permutation takes it to a place on a circle of ``CIRCLE`` places; a
second one, a table, is read from that place on: its next ``COORDINATES`` entries
are the shingle's values for all coordinates, so that coordinate k uses the
second permutation shifted by k.  Minima over a document's shingles are its
signature, and ``ROWS`` coordinates make a band.

Documents with equal shingle sets form a class; the smallest id stands for it.
Classes that share a band are candidates.  First, each bucket's smallest member
meets the others, exact Jaccard similarities on the full sets confirm links, and
linked classes become components.  Buckets of one component are done.  The
members of the others are dealt into blocks of bounded size; two blocks at a time
are compared at once, by counting shared shingles with matrix products, and what
leaves a task is one link for each member that joins a component, never all
pairs.  Every pair in a bucket is thus either compared or already connected.

Null ids: never linked, kept.  Rows that share an id are one vertex of the graph.
Whole texts are read, however long; an empty table gives an empty result; other
columns of the input, whatever their names, play no part.  The first permutation
is a bijection of 64 bits of which the place is the upper part, so that shingles
may share a place; that only makes candidates, which are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mark, settled, slices, written

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of 64 bands of 6 coordinates, a pair of similarity 0.75 shares none with probability 4e-6; one of 0.33 shares any with 0.08.
COORDINATES = 384
ROWS = 6
CIRCLE = 1 << 22
SEED = 20240229
#: What a bucket's blocks hold on average, at most: shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 1024
#: Members that meet a leader in one group of the verification.
GROUP = 256
#: A task forgets its words beyond this number; results don't depend on it.
REMEMBERED = 150_000

_tables: dict[int, np.ndarray] = {}


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    own = (text or "").encode().lower().split()  # bytes: only A to Z fold, only \x20 and \x09-\x0D part words
    if not own:
        return np.zeros(0, np.uint64)
    if len(words) > REMEMBERED:
        words.clear()
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    width = min(size, len(own))
    n = len(own) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _second_permutation(coordinates: int) -> np.ndarray:
    """The table of the second permutation, its beginning repeated at its end."""
    if coordinates not in _tables:
        table = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
        _tables[coordinates] = np.concatenate([table, table[:coordinates]])
    return _tables[coordinates]


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty shingle set."""
    rows = np.lib.stride_tricks.sliding_window_view(_second_permutation(coordinates), coordinates)
    with np.errstate(over="ignore"):
        places = (_mixed(shingles + np.uint64(SEED)) >> np.uint64(64 - CIRCLE.bit_length() + 1)).astype(np.int64)
    out = np.full(coordinates, CIRCLE, np.uint32)
    for at in range(0, len(places), 4096):
        np.minimum(out, rows[places[at : at + 4096]].min(axis=0), out=out)
    return out


def bands(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band."""
    with np.errstate(over="ignore"):
        parts = sign.reshape(-1, rows).astype(np.uint64)
        key = np.arange(len(parts), dtype=np.uint64)
        for k in range(rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.astype(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    words = _Words()
    for batch in slices(batches):
        sizes, hashes, keys = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, words)
            sizes.append(len(own))
            hashes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            keys.append(bands(signature(own)) if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leader, group and role: each leader's texts, then its members'."""
    words = _Words()
    group, leaders = None, []
    for batch in slices(batches):
        links: list[tuple[int, int]] = []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leader", "salt", "role", "doc_id", "text"))
        for leader, salt, role, doc, text in zip(*columns, strict=True):
            if (leader, salt) != group:
                group, leaders = (leader, salt), []
            own = shingle_set(text, words)
            if role == 0:
                leaders.append(own)
                continue
            for other in leaders:
                small, large = sorted((own, other), key=len)
                if not len(small) or 100 * len(small) < PERCENT * len(large):
                    continue
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                if 100 * both >= PERCENT * (len(small) + len(large) - both):
                    links.append((leader, doc))
                    break
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], names=["a", "b"])


def _joined(ids: list[int], component: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that tie together what similar sets of different components tie together: one a member at most."""
    n = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(df > 1)
    place = np.full(len(df), -1, np.int64)
    place[shared] = np.arange(len(shared))
    held = place[column]
    common = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):
        width = min(4096, len(shared) - at)
        some = (held >= at) & (held < at + width)
        has = np.zeros((n, width), np.float32)
        has[owner[some], held[some] - at] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    _, label = np.unique(component, return_inverse=True)
    alike = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    if not (alike & (label[:, None] != label[None, :])).any():
        return []
    np.fill_diagonal(alike, True)
    alike |= label[:, None] == label[None, :]
    first = np.arange(n)
    while True:
        near = np.where(alike, first[None, :], n).min(axis=1)
        if (near == first).all():
            break
        first = near
    return [(ids[f], ids[k]) for k, f in enumerate(first.tolist()) if ids[f] != ids[k]]


def _block_verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and pair of blocks."""
    words = _Words()
    group: tuple | None = None
    docs: list[tuple[int, int, np.ndarray]] = []

    def links() -> pa.RecordBatch:
        found = _joined(*map(list, zip(*docs, strict=True))) if len(docs) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    for batch in slices(batches):
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "i", "j", "rep", "component", "text"))
        for key, i, j, rep, component, text in zip(*columns, strict=True):
            if (key, i, j) != group:
                if docs:
                    yield links()
                group, docs = (key, i, j), []
            docs.append((rep, component, shingle_set(text, words)))  # an id's several texts are of one component
    if docs:
        yield links()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (``a`` leads ``b``) whose full shingle sets are similar enough.

    Each text is shuffled by its id once, and again to its leaders' groups.
    """
    groups = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(groups, "a").select(F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).alias("salt"), F.col("b").alias("doc_id"))
    dealt = written(dealt, "dealt")
    members = dealt.select("doc_id", "leader", "salt", F.lit(1).alias("role"))
    leaders = dealt.select(F.col("leader").alias("doc_id"), "leader", "salt", F.lit(0).alias("role")).distinct()
    rows = members.unionAll(leaders).join(texts.hint("merge"), "doc_id").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return rows.select("leader", "salt", "role", "doc_id", "text").mapInArrow(_verifier, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the links ``a, b``.

    Each round takes the smallest label among neighbours, then the label's own
    label, so that long chains shorten by half; the rounds end when none changes.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    # Labels only fall: once their sum stays, all do.
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    before = None
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        least = near.unionAll(labels).groupBy("node").agg(F.min("component").alias("component"))
        labels = written(least.join(least.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.col("next").alias("component")), "labels")
        after = labels.agg(total).first()[0]
        if after == before:
            return labels
        before = after


def _may_link(a: str, b: str):
    """Sets whose sizes differ by more can't be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def link_classes(rows: DataFrame, texts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``node, component`` of linked representatives; ``rows``: ``key, rep, size``, one for each band of each."""
    first = F.min(F.struct("rep", "size")).alias("f")
    sizes = written(rows.groupBy("key").agg(first, F.count("*").alias("n")).where("n > 1").select("key", F.col("f.rep").alias("first"), F.col("f.size").alias("first_size")), "buckets")
    met = written(rows.join(sizes.hint("merge"), "key"), "met")
    # From here on only texts that share a bucket are read.
    own = written(texts.join(met.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id").select("doc_id", "text"), "texts")
    open_rows = met.where("rep != first").select("key", "rep", "size")
    pairs = written(met.where(F.expr("rep != first") & _may_link("size", "first_size")).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs, own), "links")
    if extra is not None:
        links = links.unionAll(extra)
    labels = components(links)
    # Buckets of more than one component; their first members have met all others.
    named = written(open_rows.join(labels, open_rows["rep"] == labels["node"], "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component")), "named")
    live = named.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.sum("size").alias("shingles"), F.count("*").alias("docs")).where("c < d").select("key", F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("docs") / BLOCK_DOCS)).cast("int").alias("blocks"))
    rest = named.join(live, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    both = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))))
    dealt = written(rest.select("key", "rep", "component", both.alias("b")).select("key", "b.i", "b.j", "rep", "component"), "dealt")
    groups = dealt.join(own.hint("merge"), dealt["rep"] == own["doc_id"]).select("key", "i", "j", "rep", "component", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    found = written(groups.mapInArrow(_block_verifier, "a long, b long").distinct(), "links")
    return labels if found.isEmpty() else components(links.unionAll(found))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    since = mark()
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(rows.mapInArrow(_sketcher, "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "sketches")
    known = sketches.where("doc_id is not null and set_hash is not null")
    classes = written(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    keys = classes.select(F.explode(F.array_distinct("bands")).alias("key"), "rep", "size")
    # An id with several texts is one vertex: it ties its classes together.
    several = known.groupBy("doc_id").agg(F.count_distinct("set_hash").alias("n")).where("n > 1").select("doc_id")
    ties = known.join(several, "doc_id").join(classes.select("set_hash", "rep"), "set_hash").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = link_classes(keys, rows.where("doc_id is not null"), written(ties, "ties"))
    of_class = written(classes.join(labels, classes["rep"] == labels["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component_id")), "of-class")
    found = settled(sketches.select("doc_id", "n_shingles", "set_hash").join(of_class.hint("merge"), "set_hash", "left").select("doc_id", "n_shingles", "component_id"), "near-duplicates", since)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The registered query for DuckDB (ids unique): similar sets share one of the rarest shingles of each, exact similarities on the full sets, closure over the links.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 2)), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) END AS s FROM w),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
terms AS (SELECT rep, n, unnest(s) AS term FROM classes),
ranked AS (
    SELECT rep, n, term, row_number() OVER (PARTITION BY rep ORDER BY often, term) AS nth
    FROM (SELECT *, count(*) OVER (PARTITION BY term) AS often FROM terms)),
rare AS (SELECT * FROM ranked WHERE nth <= n - ceil(n * {PERCENT} / 100.0) + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.term = b.term AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
checked AS (SELECT a, b, x.n AS m, y.n AS n, len(list_intersect(x.s, y.s)) AS shared FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b),
links AS (SELECT a, b FROM checked WHERE 100 * shared >= {PERCENT} * (m + n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
components AS (SELECT a AS rep, min(b) AS component FROM reached GROUP BY a)
SELECT sets.doc_id, len(sets.s)::bigint AS n_shingles, CASE WHEN sets.doc_id IS NOT NULL THEN coalesce(component, sets.doc_id) END AS component_id,
    sets.doc_id IS NULL OR coalesce(component, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN components USING (rep)
"""
