"""The documents that each stage keeps, against plain Python."""

import re

import corpus_pipeline
from quirelake.llm import line_templates

DATA = "/root/testdata/sf0.001"


def form(line):
    return tuple(w for w in re.split("[ \t\r]+", re.sub(r"[^ \t\r]*[0-9][^ \t\r]*", "<*>", line)) if w)


def plain_lines(texts):
    L, lead = line_templates.LONG, line_templates.LEAD
    lines = {i: [form(x) for x in t.split("\n")] for i, t in texts.items()}
    places: dict = {}
    for i, own in lines.items():
        for k, f in enumerate(own):
            if f:
                places.setdefault(f, []).append((i, k))
    leaves: dict = {}
    for f in places:
        if len(f) >= L:
            leaves.setdefault((len(f), f[:lead]), []).append(f)
    keeper = {f: min(p)[0] for f, p in places.items()}
    for own in leaves.values():
        for f in own:
            for g in own:
                if 100 * sum(x == y for x, y in zip(f, g, strict=True)) >= line_templates.SIMILAR * len(f):
                    keeper[f] = min(keeper[f], min(places[g])[0])
    recurring = {f: keeper[f] for f, p in places.items() if keeper[f] < max(p)[0] and (len(f) >= L or len(p) >= line_templates.OFTEN)}
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    out = {}
    for i, own in lines.items():
        keepers = {recurring[f] for f in own if len(f) >= L and recurring.get(f, i) != i} | {first[texts[i]]} - {i}
        held = {f for d in keepers for f in lines[d] if 0 < len(f) < L}
        kept = [x for x, f in zip(texts[i].split("\n"), own, strict=True) if recurring.get(f, i) == i and f not in held]
        text = "\n".join(kept)
        if text == texts[i] or re.search(r"[^ \t\r\n]", text):
            out[i] = text
    return out


def plain_near(texts):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in sorted(texts.items())}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: t for i, t in texts.items() if root[i] == i}


def plain_clean(texts, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return {i: t for i, t in texts.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id is not null and text is not null")
    wanted = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r["text"]]
    copies = {i for i, t in wanted.items() if any(j < i and t == u for j, u in wanted.items())}
    assert copies
    stages = {"line dedup": plain_lines, "near duplicates": plain_near, "decontamination": lambda t: plain_clean(t, items)}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, DATA).cache()
        wanted = stages[name](wanted)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == wanted, name
        assert not copies & set(wanted)


def test_language_stage(spark):
    labelled = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "1234 !! 55"), (10**9 + 1, ""), (10**9 + 2, None), (10**9 + 3, "the thing that was of the and the with from this that")], "doc_id long, text string")
    docs = labelled.unionByName(odd, allowMissingColumns=True)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()}
    assert got & set(range(10**9, 10**9 + 4)) == {10**9 + 3}
    assert got >= {r["doc_id"] for r in labelled.where("lang = 'en' and length(text) > 200").collect()}
