"""Conversations, vectors and the chain of stages against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import bit_sliced_search, chat, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("<|\\>ab\n") + ["<|im_end|>", "<|im_start|>", "é"]), max_size=20).map("".join))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [{"role": "user", "text": text}, {"role": "assistant", "text": text}]
    assert chat.parse(chat.render(turns)[0]) == [("user", text), ("assistant", text)]


def test_conversations(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", " leading and trailing \n"), (2, 0, "system", None), (3, None, None, ""), (4, 0, "assistant", "Ünï 😀 ñ"), (4, 0, "assistant", "Ünï 😀 ñ"), (5, 0, "assistant", "x" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    for conv in range(1, 6):
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss)), conv
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def brute(ids, vectors, every, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = [(-int(np.dot(vectors[q], vectors[j])), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]]
            out[ids[q]] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(0, 0.2, 6).astype("float32").tolist() for _ in range(300)]
    vectors[7] = vectors[8] = vectors[9]  # ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [np.floor(1024 * np.array(v, "float32").astype("float64")).astype(np.int64) for v in vectors]
    got: dict = {}
    for r in bit_sliced_search.top_k(df, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(list(range(300)), whole, 10, 10)
    assert bit_sliced_search.top_k(df.limit(0)).count() == 0
    # Row by row: repeated query ids are queries of their own and candidates of each other; sizes beyond 2**53.
    odd = [(0, [0.5, -0.25]), (0, [-0.5, 0.125]), (0, [0.5, -0.25]), (3, [2.0**43, -1.0]), (4, [-(2.0**43), 1.0]), (5, [0.5, -0.25])]
    got = [tuple(r) for r in bit_sliced_search.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), every=5, k=2).collect()]
    wanted = []
    for a, (q, x) in enumerate(odd):
        if q % 5 == 0:
            scores = sorted((-sum(int(np.floor(1024 * u)) * int(np.floor(1024 * v)) for u, v in zip(x, y, strict=True)), i, b) for b, (i, y) in enumerate(odd) if a != b)
            wanted += [(q, r, i, -s) for r, (s, i, _) in enumerate(scores[:2], 1)]
    assert sorted(got) == sorted(wanted)
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bit_sliced_search.top_k(few, every=100).orderBy("rank").collect()] == [(0, 1, 2, 0), (0, 2, 1, -1048576)]


def test_line_dedup_matches_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{data}/documents.parquet'")
    wanted = sorted(map(tuple, duck.execute(queries.oracle_sql()["op10_line_dedup"]).fetchall()))
    assert sorted(map(tuple, queries.queries()["op10_line_dedup"](spark, data).select("doc_id", "text", "n_lines", "n_dropped").collect())) == wanted


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_chat_formatting", "op3_minhash_near_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    wanted = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, data)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, wanted.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
