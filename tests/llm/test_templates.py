"""Templates of lines against all pairs of forms, and the sample of the language model."""

import random
import re

import numpy as np
import pytest

from quirelake.llm import language_id, line_templates

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def dropped(spark, docs, **more):
    rows = line_templates.recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"), **more).collect()
    return {(r["doc_id"], k) for r in rows for k in r["lines"]}


def brute(docs, long=8, often=20, similar=75):
    lines = []
    for doc, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            tokens = tuple(t for t in re.split("[ \t\r]+", re.sub(r"[^ \t\r]*[0-9][^ \t\r]*", "<*>", line)) if t)
            if tokens:
                lines.append((doc, k, tokens))
    forms: dict = {}
    for doc, k, t in lines:
        forms.setdefault(t, []).append((doc, k))
    out = set()
    for t, places in forms.items():
        keeper = min(places)[0]
        if len(t) >= long:
            for other, there in forms.items():
                if other != t and len(other) == len(t) and other[:3] == t[:3] and 100 * sum(a == b for a, b in zip(t, other, strict=True)) >= similar * len(t):
                    keeper = min(keeper, min(there)[0])
        if keeper < max(places)[0] and (len(t) >= long or len(places) >= often):
            out |= {(d, k) for d, k in places if d != keeper}
    return out


def test_fields_in_three_places(spark):
    """One field each in three quarters, two in two, and fields that leave too little equal."""
    line = lambda at, k: " ".join(f"{w}{'abcdefghij'[k]}" if n in at else w for n, w in enumerate(WORDS))
    for at, n in (((5, 10, 15), 9), ((5, 6, 15, 16), 9), ((4, 8, 11, 14, 19), 9), ((4, 6, 8, 11, 14, 19), 0), ((1,), 0)):
        docs = [(k, line(at, k)) for k in range(10)]
        assert len(dropped(spark, docs)) == n, at
        assert dropped(spark, docs) == brute(docs)


@pytest.mark.parametrize("similar", [50, 75, 90])
def test_against_all_pairs(spark, similar):
    """Random lines of one leaf, so that forms are alike in chains, and buckets hold forms that aren't."""
    rng = random.Random(similar)
    docs = []
    for k in range(150):
        n = rng.choice([8, 8, 9, 12])
        docs.append((k // 2, "\n".join(" ".join(["start", "of", "line", *(rng.choice("abc") for _ in range(n - 3))]) for _ in range(rng.randint(1, 2)))))
    docs = [(i, t) for i, t in dict(docs).items()]
    assert dropped(spark, docs, similar=similar) == brute(docs, similar=similar)


def test_many_members_of_one_template(spark):
    docs = [(k, "the very same words begin and value" + "abcdefghijklmnopqrstuvwxyz"[k % 26] + "abcdefghij"[k // 26 % 10] + " ends the line here") for k in range(260)]
    assert len(dropped(spark, docs)) == 259


def test_sample_of_labelled_rows(spark):
    assert all((language_id._threshold(n, 20_000) + (1 << 63)) / 2**64 == pytest.approx(20_000 / n) for n in (20_001, 10**6, 10**11, 10**15))
    rng = np.random.default_rng(4)
    texts = {"en": "the of and to in that is was he for it with as his on be at by", "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle"}
    rows = [(k, " ".join(rng.choice(texts[lang].split(), 30)), lang) for k, lang in enumerate(["en", "fr"] * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, rows=60)  # a tenth of the rows
    assert model["langs"] == ["en", "fr"]
    found = language_id.predict(docs, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.99
    assert language_id.fit(docs.where("lang = 'none'"))["langs"] == []
