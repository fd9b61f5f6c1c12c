"""Fill-in-middle samples against plain regular expressions."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import fill_in_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
SIGNS = list("ab Z.,\n\x00é中😀<>") + ["word", "<P>", "<S", "S>", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=60).map("".join), st.integers(1, 7), st.integers(1, 9))
def test_checkpoints(text, stride, window):
    index = fim.Checkpoints(text.encode(), stride, window)
    units = UNIT.findall(text)
    assert (index.units, index.points) == (len(units), len(text))
    assert index.offsets[0].tolist() == list(range(0, len(units), stride))
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.locate(k) == (len(before.encode()), len(before))


def test_long_units_and_far_rescans():
    """A unit longer than a window and than a rescan's step, and checkpoints far apart."""
    text = ("x" * 200_000 + " é" * 5000 + "yy zz") * 2
    units = UNIT.findall(text)
    index = fim.Checkpoints(text.encode(), 4096)
    for k in (0, 1, 2, 4095, 4096, 9999, 10_001, 10_002, 15_000, len(units) - 1, len(units)):
        before = "".join(units[:k])
        assert index.locate(k) == (len(before.encode()), len(before))


def brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_samples(spark):
    texts = [None, "", "a", "<P", "P>", "<<S<", "x <M> y", "Écrit à l'été — ça va? 😀", "long " * 30_000, "w" * 50_000, "same text", "same text"]
    rows = [(k, texts[k % len(texts)], "z", "clash") for k in range(240)] + [(None, "null id < here", "z", "clash"), (3, "<<<S>>", "z", "clash"), (3, "another of id 3", "z", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    samples = fim.fill_in_middle(docs, stride=7)
    got = sorted(samples.collect(), key=str)
    wanted = [(i, *brute(i, t)) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    digests = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n"], r["output_sha256"], r["restored_sha256"]) for r in fim.sample_digests(samples).collect())
    assert digests == sorted((i is not None, i or 0, brute(i, t)[0], digest(brute(i, t)[4]), digest(t)) for i, t, _, _ in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0 and fim.checkpoint_index(docs.limit(0)).count() == 0
    index = {r["doc_id"]: r for r in fim.checkpoint_index(docs, stride=1000).collect()}
    assert index[8]["units"] == list(range(0, 60_000, 1000)) and index[8]["bytes"][1] == 2500 and index[8]["chars"] == 150_000


def test_other_marks(spark):
    docs = spark.createDataFrame([(k, f"text {k} with <P> inside") for k in range(50)], "doc_id long, text string")
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    samples = fim.fill_in_middle(docs, seed=9, plain=0, spm=50, marks=marks)
    assert {r["form"] for r in samples.select("form").collect()} == {"psm", "spm"}
    back = samples.select("doc_id", fim.restored(samples["output"], samples["form"], marks).alias("text"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
