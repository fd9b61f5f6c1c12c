"""Benchmark decontamination over a distributed positional inverted index.

Documents are dealt into segments of about ``SEGMENT_WORDS`` words.  A segment's
words form one stream of positions with gaps between documents; for each term
the segment holds the ascending positions of its postings (as steps), a row of a
written table.  A benchmark item is searched as windows of consecutive words: the
window's rarest term (by counts over the whole corpus) gives the candidate
positions, and the postings of its other terms, shifted by their offsets, are
intersected with these, rarest first: an exact phrase match.  Windows whose rarest
terms stand alike, as neighbours in an item do, share these intersections.

A proximity match needs each of the window's terms within ``slop`` words of its
place, counted from an occurrence of the rarest term (the first of its rank in
the window), inside one document; the words that stand there are its words.

Items are searched in blocks of about ``BLOCK_WORDS`` words, whose terms and
windows are what the driver and the tasks get.

Null documents have no words; items whose text or id is null take no part.
Repeated documents give a row each, repeated item ids count once.  Whole texts
are indexed, however long: a segment ends with the document that fills it.  Empty
tables give an empty result or documents without hits; other columns of the
input, whatever their names, play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mark, settled, slices, written

WINDOW = 10
SEGMENT_WORDS = 1_000_000
#: Words of the benchmark items searched at once: they bound what is broadcast.
BLOCK_WORDS = 100_000
#: How far a term may stand from its place in a proximity match of the registered query.
SLOP = 2

#: A to Z fold to lower case; ASCII characters other than letters and digits part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "segment string, term binary, n long, postings binary, doc_ids array<string>"
_INDEX = pa.schema([("segment", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.string()))])
HITS = "segment string, place long, doc_id long, n_words long, hits array<int>, items array<string>, near_hits array<int>, near_items array<string>"


def words(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A to Z became lower case, as UTF-8."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, one after the other, and the number of each text's: ``words`` without Python objects."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()), b"")])
    _, offsets, data = texts.buffers()
    # A byte becomes a byte, so that the texts keep their places.
    folded = (data.to_pybytes() if data else b"").translate(_FOLD)
    parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))
    found, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(found), 0)  # blanks at a text's ends leave empty parts
    counts = np.bincount(np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return found.filter(full).cast(pa.large_binary()), counts


def _indexer(gap: int, segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        docs: list = []
        counts: list[np.ndarray] = []
        n = 0

        def segment() -> Iterator[pa.RecordBatch]:
            name = uuid.uuid4().hex
            own_counts = np.concatenate(counts)
            encoded = pa.concat_arrays(held).dictionary_encode()
            terms, stream = encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy()
            places = np.arange(len(stream)) + gap * np.repeat(np.arange(len(docs)), own_counts)
            order = places[np.argsort(stream, kind="stable")]
            sizes = np.bincount(stream, minlength=len(terms))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            # Each term's positions as steps, which compress better.
            steps = np.diff(order, prepend=0)
            steps[ends[:-1]] = order[ends[:-1]]
            postings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(steps.astype("<u4"))]).cast(pa.binary())
            own = [pa.array([name] * len(sizes)), terms, pa.array(sizes, pa.int64()), postings, pa.nulls(len(sizes), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(own, schema=_INDEX)
            head = ([name], [None], [len(docs)], [own_counts.astype("<u4").tobytes()], [docs])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(head, _INDEX, strict=True)], schema=_INDEX)

        for batch in slices(batches):
            found, sizes = _words_of(batch.column(1))
            ids = [None if doc is None else str(doc) for doc in batch.column(0).to_pylist()]  # as text, a null among numbers stays exact in pandas
            ends = np.cumsum(sizes)
            filled = np.cumsum(sizes + gap)
            at = 0
            while at < len(ids):
                # Up to the document that fills the segment.
                end = min(len(ids), int(np.searchsorted(filled, (filled[at - 1] if at else 0) + segment_words - n)) + 1)
                first = int(ends[at - 1]) if at else 0
                held.append(found.slice(first, int(ends[end - 1]) - first))
                docs += ids[at:end]
                counts.append(sizes[at:end])
                n += int(filled[end - 1] - (filled[at - 1] if at else 0))
                at = end
                if n >= segment_words:
                    yield from segment()
                    held, docs, counts, n = [], [], [], 0
        if docs:
            yield from segment()

    return run


def positional_index(documents: DataFrame, *, gap: int = WINDOW + 1, segment_words: int = SEGMENT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: a row for each segment and term, and one (null term) for the segment's documents."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_indexer(gap, segment_words), INDEX), "postings", "zstd")


def item_windows(items: list[tuple[str, str]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """The windows of the items, each with the ids of those that have it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[k : k + window]), set()).add(item)
    return {w: sorted(i) for w, i in found.items()}


def window_tree(windows: dict[tuple[bytes, ...], list[str]], counts: dict[bytes, int]) -> tuple[dict[bytes, int], list[tuple[list[str], list]]]:
    """The windows as paths of terms, rarest first: roots by the rarest term, and nodes ``items, [(term, offset, node)]``.

    Offsets count from the rarest term (the first of its rank in the window).
    Windows whose rarest terms stand alike, as neighbours in an item do, share
    nodes, so that these terms are intersected once for all of them.
    """
    roots: dict[bytes, int] = {}
    nodes: list[tuple[list[str], list]] = []
    known: dict[tuple, int] = {}

    def fresh() -> int:
        nodes.append(([], []))
        return len(nodes) - 1

    for own_terms, items in windows.items():
        if not all(t in counts for t in own_terms):
            continue
        (rarest, at), *others = sorted(((t, k) for k, t in enumerate(own_terms)), key=lambda x: (counts[x[0]], x[1]))
        if rarest not in roots:
            roots[rarest] = fresh()
        node = roots[rarest]
        for term, k in others:
            step = (node, term, k - at)
            if step not in known:
                known[step] = fresh()
                nodes[node][1].append((term, k - at, known[step]))
            node = known[step]
        nodes[node][0].extend(items)
    return roots, nodes


def _matcher(roots: dict[bytes, int], nodes: list[tuple[list[str], list]], window: int, gap: int, slop: int):
    far = np.iinfo(np.int64).max

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["term"].isnull()].iloc[0]
        counts = np.frombuffer(head["postings"], "<u4").astype(np.int64)
        starts = np.cumsum(counts + gap) - counts - gap
        stored = {bytes(t): p for t, p in zip(rows["term"], rows["postings"], strict=True) if t is not None and not isinstance(t, float)}
        read: dict[bytes, np.ndarray] = {}
        n = len(counts)
        of = lambda at: starts.searchsorted(at, side="right") - 1

        def postings(term: bytes) -> np.ndarray:
            """A term's positions, read when first asked for; a last one that none reaches ends them."""
            if term not in read:
                steps = np.frombuffer(stored[term], "<u4")
                read[term] = held = np.empty(len(steps) + 1, np.int64)
                np.cumsum(steps, out=held[:-1])
                held[-1] = far
            return read[term]

        def bounds(at: np.ndarray, place: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
            """The first and the last position where a term may stand, inside the document."""
            if gap >= window + reach:  # no position of another document is as near
                return place - reach, place + reach
            doc = of(at)
            return np.maximum(place - reach, starts[doc]), np.minimum(place + reach, starts[doc] + counts[doc] - 1)

        def fits(term: bytes, at: np.ndarray, offset: int, reach: int) -> np.ndarray:
            lo, hi = bounds(at, at + offset, reach)
            held = postings(term)
            return held[held.searchsorted(lo)] <= hi

        class Found:
            """The words of all matches and the items that match, for each document."""

            def __init__(self, reach: int):
                self.reach, self.items = reach, {}
                self.anchors: list[np.ndarray] = [np.zeros(0, np.int64)]
                self.places: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}

            def add(self, path: tuple, at: np.ndarray, items: list[str]) -> None:
                self.anchors.append(at)
                for term, offset in path:
                    self.places.setdefault(term, []).append((at, at + offset))
                for d in set(of(at).tolist()):
                    self.items.setdefault(d, set()).update(items)

            def hits(self) -> np.ndarray:
                covered = np.zeros(int((counts + gap).sum()) + 2, np.int8)
                covered[np.concatenate(self.anchors)] = 1
                for term, found in self.places.items():
                    lo, hi = bounds(*map(np.concatenate, zip(*found, strict=True)), self.reach)
                    held = postings(term)
                    k = held.searchsorted(lo)
                    for _ in range(2 * self.reach + 1):
                        inside = held[k] <= hi
                        k, hi = k[inside], hi[inside]
                        covered[held[k]] = 1
                        k = k + 1
                return np.flatnonzero(covered)

            def columns(self) -> tuple[list, list]:
                hit = self.hits()
                lo, hi = np.searchsorted(hit, starts), np.searchsorted(hit, starts + counts)
                return [(hit[a:b] - s).astype(np.int32) for a, b, s in zip(lo, hi, starts, strict=True)], [sorted(self.items.get(d, ())) for d in range(n)]

        exact, near = Found(0), Found(slop)
        for anchor, root in roots.items():
            if anchor not in stored:
                continue
            # A phrase is a proximity match too, so phrases are sought among these.
            start = postings(anchor)[:-1]
            todo = [(root, (), start, start if slop else start[:0])]
            while todo:
                node, path, at, phrase = todo.pop()
                items, below = nodes[node]
                if items:
                    near.add(path, at, items)
                    if len(phrase):
                        exact.add(path, phrase, items)
                for term, offset, child in below:
                    if term in stored:
                        close = at[fits(term, at, offset, slop)]
                        if len(close):
                            todo.append((child, (*path, (term, offset)), close, phrase[fits(term, phrase, offset, 0)] if len(phrase) else phrase))
        near_hits, near_items = near.columns()
        hits, items = exact.columns() if slop else (near_hits, near_items)
        ids = pd.array([None if x is None else int(x) for x in head["doc_ids"]], dtype="Int64")
        return pd.DataFrame({"segment": [head["segment"]] * n, "place": np.arange(n), "doc_id": ids, "n_words": counts, "hits": hits, "items": items, "near_hits": near_hits, "near_items": near_items})

    return match


def search_windows(index: DataFrame, items: list[tuple[str, str]], *, window: int = WINDOW, slop: int = 0, gap: int = WINDOW + 1) -> DataFrame:
    """Every document with the positions of its words inside matches, and the items that match: ``HITS``."""
    windows = item_windows(items, window)
    terms = index.sparkSession.createDataFrame([(bytearray(t),) for t in sorted({t for w in windows for t in w})], "term binary")
    asked = index.join(F.broadcast(terms), "term")  # one block's terms
    counts = {bytes(r["term"]): r["n"] for r in asked.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    roots, nodes = window_tree(windows, counts)
    return asked.unionByName(index.where(F.col("term").isNull())).groupBy("segment").applyInPandas(_matcher(roots, nodes, window, gap, slop), HITS)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS, segment_words: int = SEGMENT_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, n_near_items, items, near_items``.

    ``n_hit`` counts the document's words inside any occurrence of a window,
    ``n_near`` those of proximity matches within ``slop`` (of phrases, if that is 0).
    """
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("words")).where("item is not null and words is not null")
    # Characters bound words from above.
    blocks = 1 + int(tests.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("n")).first()["n"]) // (4 * block_words)
    # The gap between documents is wider than any place that a match could reach.
    gap = window + slop + 1
    since = mark()
    index = positional_index(documents, gap=gap, segment_words=segment_words, id_col=id_col, text_col=text_col)
    found = None
    for k in range(blocks):
        items = [(r["item"], r["words"]) for r in tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
        part = search_windows(index, items, window=window, slop=slop, gap=gap)
        if blocks > 1:
            part = written(part, "hits")
        found = part if found is None else found.unionAll(part)
    lists = ("hits", "items", "near_hits", "near_items")
    if blocks > 1:
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists))
    size = lambda c: F.size(c).cast("long")
    out = found.select("doc_id", "n_words", size("hits").alias("n_hit"), size("items").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), size("near_hits").alias("n_near"), size("near_items").alias("n_near_items"), "items", "near_items")
    return settled(out, "contamination", since)


#: The same in DuckDB's SQL, over the tables ``documents`` and ``benchmark``: phrases by joins on windows, proximity by joins on words.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS t, least(len(w), {WINDOW}) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW} + 1))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, item, n FROM places JOIN windows USING (t, n)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
words AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
counts AS (SELECT term, count(*) AS n FROM words GROUP BY term),
shapes AS (SELECT t, row_number() OVER () AS shape FROM (SELECT DISTINCT t FROM windows)),
parts AS (SELECT shape, len(t) AS size, unnest(t) AS term, generate_subscripts(t, 1) AS k FROM (SELECT shape, string_split(t, ' ') AS t FROM shapes)),
ranked AS (SELECT parts.*, row_number() OVER (PARTITION BY shape ORDER BY n, k) AS rank FROM parts JOIN counts USING (term)),
anchors AS (SELECT shape, size, k AS anchor_k, r, p AS anchor_p FROM ranked JOIN words USING (term) WHERE rank = 1),
reach AS (
  SELECT a.r, a.shape, a.anchor_p, a.size, q.k, q.term, unnest(generate_series(a.anchor_p - a.anchor_k + q.k - s, a.anchor_p - a.anchor_k + q.k + s)) AS p
  FROM anchors a JOIN (SELECT *, CASE WHEN rank = 1 THEN 0 ELSE {SLOP} END AS s FROM ranked) q USING (shape)),
close AS (SELECT r, shape, anchor_p, size, k, p FROM reach JOIN words USING (r, p, term)),
whole AS (SELECT r, shape, anchor_p FROM close GROUP BY r, shape, anchor_p, size HAVING count(DISTINCT k) = size),
near AS (SELECT r, count(DISTINCT p) AS n_near FROM close JOIN whole USING (r, shape, anchor_p) GROUP BY r),
near_items AS (SELECT r, count(DISTINCT item) AS n_near_items FROM whole JOIN shapes USING (shape) JOIN windows USING (t) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r) LEFT JOIN near_items USING (r)
"""
