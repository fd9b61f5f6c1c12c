"""The index and the search of decontamination: segments, words and shared intersections."""

import numpy as np
import pyarrow as pa

from quirelake.llm import decontamination


def test_windows_share_the_intersections_of_their_rarest_terms():
    """Neighbouring windows begin with the same rarest terms: one node for these, not one a window."""
    item = "common common rare common common other common common common common common common"
    windows = decontamination.item_windows([("1", item), ("2", "other common")])
    counts = {b"rare": 1, b"other": 2, b"common": 50}
    roots, nodes = decontamination.window_tree(windows, counts)
    assert len(windows) == 4 and set(roots) == {b"rare", b"other"}
    assert [(t, k) for t, k, _ in nodes[roots[b"rare"]][1]] == [(b"other", 3)]  # all three windows hold it there
    assert sorted(i for items, _ in nodes for i in items) == ["1", "1", "1", "2"]
    assert decontamination.window_tree(windows, {b"other": 2, b"common": 50})[0].keys() == {b"other"}  # a window with an unknown term is none


def test_words_of_texts_at_once_are_those_of_each():
    texts = ["  Ab-c  d_é x\u0085y ", "", None, "...", "İ K\tZ\x00z", "x" * 5000, "no blank\n"]
    for part in (texts, texts[3:]):
        whole = pa.array(texts, pa.string())
        found, counts = decontamination._words_of(whole.slice(len(texts) - len(part)))
        assert found.to_pylist() == [w for t in part for w in decontamination.words(t)]
        assert counts.tolist() == [len(decontamination.words(t)) for t in part]


def test_segments_end_with_the_document_that_fills_them():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, None]), pa.array(["a b c", "b", None, "c " * 30, "a"])], names=["doc_id", "text"])
    out = [b.to_pylist() for b in decontamination._indexer(11, 20)(iter([batch]))]
    assert [rows[0]["doc_ids"] for rows in out[1::2]] == [["1", "2"], ["3", "4"], [None]]
    at = {r["term"]: np.cumsum(np.frombuffer(r["postings"], "<u4")).tolist() for r in out[0]}
    assert at == {b"a": [0], b"b": [1, 14], b"c": [2]}
    assert [r["n"] for r in out[2]] == [30] and np.frombuffer(out[2][0]["postings"], "<u4")[:3].tolist() == [11, 1, 1]


def test_narrow_gaps_part_documents(spark):
    """An index whose gaps a window can cross: a match stays inside its document."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "x a b c d e f a c b d")], "doc_id long, text string").coalesce(1)
    index = decontamination.positional_index(rows, gap=1)
    for slop, near in ((0, {3: [1, 2, 3, 4, 5, 6]}), (1, {3: [1, 2, 3, 4, 5, 6]})):
        found = decontamination.search_windows(index, [("i", "a b c d e f")], window=8, slop=slop, gap=1).collect()
        assert {r["doc_id"]: r["hits"] for r in found if r["hits"]} == {3: [1, 2, 3, 4, 5, 6]}
        assert {r["doc_id"]: r["near_hits"] for r in found if r["near_hits"]} == near
