"""Importance resampling against plain Python and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import importance_resampling as ir
from quirelake.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run=2):
    words = WORD.findall((text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "word", "é", "中文", " ", "\n", "--", "_", "9"]), max_size=60).map("".join), st.integers(1, 4), st.integers(1, 12))
def test_chunks_own_every_feature_once(text, run, size):
    n, wanted = features(text, run)
    found, words = Counter(), 0
    for own, carry in ir.chunks(text.encode().lower(), run, size):
        k, buckets = ir.feature_buckets(own, carry, run, 997)
        words += k
        found.update(buckets.tolist())
    assert words == n and found == Counter(bucket(f, 997) for f in wanted)


def brute(docs, target, buckets, percent, least):
    lists = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f, buckets) for _, _, fs in lists for f in fs)
    t = Counter(bucket(f, buckets) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in lists:
        weight = sum(gain[bucket(f, buckets)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ranked = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(ranked) // 100
    return [(*r, None) for r in rows if r[1] < least] + [(*r, k if k <= drawn else None) for k, r in enumerate(ranked, 1)]


def test_against_plain_python(spark):
    texts = [None, "", "one", "--- ///", "Écrit ÉCRIT été", "alpha beta gamma delta " * 40, "w " * 5000, "x" * 30_000 + " tail", "alpha_beta\x00gamma9 中文 字"]
    docs = [(k, f"{texts[k % len(texts)] or ''} doc {k % 7}" if k % 3 else texts[k % len(texts)]) for k in range(150)] + [(None, "a null id with several words"), (5, "alpha beta gamma"), (5, "alpha beta gamma")]
    target = ["alpha beta gamma delta epsilon", None, "", "zeta eta"]
    left = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, score string, rank long").repartition(4)
    right = spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "item_id long, text string, key long")
    got = ir.resample(left, right, buckets=50, percent=40, least_words=3, chunk_bytes=64)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, target, 50, 40, 3), key=str)
    assert ir.drawn(left, got).count() >= got.where("rank is not null").count()
    assert ir.resample(left.limit(0), right).count() == 0
    assert sorted(map(tuple, ir.resample(left, right.limit(0), percent=0).collect()), key=str) == sorted(brute(docs, [], 10_000, 0, 20), key=str)
    with pytest.raises(ValueError):
        ir.resample(left, right, buckets=1 << 17)


def test_query_matches_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    for name in ("op11_importance_resampling", "op13_fill_in_middle"):
        wanted = duck.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        found = queries.queries()[name](spark, data)
        assert sorted(found.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(str, wanted.fetchall()))
