"""Containment, framing, numbered contents and MARC files against plain Python."""

import random
import re

from pyspark.sql import functions as F

from quirelake.operators import fields, framing, hierarchy
from quirelake.operators.framing import Field, Frame
from quirelake.sources import marc


def plain_tree(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], -r[3], r[1]))
        for n, (_, i, _, e) in enumerate(own):
            parent = next((own[k][1] for k in range(n - 1, -1, -1) if own[k][3] >= e), None)
            out[key, i] = (parent, 0 if parent is None else out[key, parent][1] + 1)
    return out


def test_containment(spark):
    """One key over many partitions, with ranges that span all of them, beside small keys."""
    rng = random.Random(6)
    rows = [("hot", "all", 0, 10_000), ("hot", "half", 10, 6000)]
    for k in range(900):
        a = rng.randint(0, 9000)
        rows.append(("hot", f"r{k}", a, a + rng.choice([0, 1, 5, 30, 900])))
    rows += [(f"k{k % 7}", f"s{k}", k, k + rng.randint(0, 40)) for k in range(60)] + [("one", "x", 3, 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "key string, id string, start long, `end` long")
        got = hierarchy.containment(df).collect()
        assert hierarchy.containment(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r["key"], r["id"]): (r["parent"], r["depth"]) for r in got} == plain_tree(rows)
    children: dict = {}
    for r in got:
        children.setdefault((r["key"], r["parent"]), []).append(((r["start"], -r["end"], r["id"]), r["position"]))
    assert all([p for _, p in sorted(c)] == list(range(1, len(c) + 1)) for c in children.values())


def test_framing(spark):
    t = "s string, p string, o string, o_kind string, datatype string, lang string"
    iri = lambda s, p, o, kind="iri": (s, p, o, kind, None, None)
    text = lambda s, p, o, lang=None: (s, p, o, "literal", None if lang else "xsd:string", lang)
    rows = [
        iri("b1", "rdf:type", "Book"), text("b1", "title", "A", "en"), text("b1", "title", "א", "he"), text("b1", "tag", "x"), text("b1", "tag", "y"), iri("b1", "by", "_:n", "bnode"), iri("b1", "by", "p2"),
        iri("_:n", "rdf:type", "Person"), text("_:n", "name", "N"), iri("p2", "rdf:type", "Person"), text("p2", "name", "P"), iri("p3", "rdf:type", "Person"), iri("b2", "rdf:type", "Book"), iri("x", "rdf:type", "Other"), text("x", "title", "Z", "en"),
    ]
    graph = spark.createDataFrame(rows, t)
    frame = Frame((Field("title", "title", lang="he", datatype=None), Field("tags", "tag", many=True), Field("people", "by", many=True, frame=Frame((Field("name", "name"),), "Person"))), "Book")
    got = {r["id"]: r for r in framing.framed(graph, frame).collect()}
    assert set(got) == {"b1", "b2"}
    assert got["b1"]["title"] == "א" and got["b1"]["tags"] == ["x", "y"] and [tuple(p) for p in got["b1"]["people"]] == [("_:n", "N"), ("p2", "P")]
    assert got["b2"]["title"] is None and got["b2"]["tags"] == [] and got["b2"]["people"] == []
    back = {tuple(r)[:4] for r in framing.unframed(framing.framed(graph, frame), frame).collect()}
    assert back == {r[:4] for r in rows if r[0] in ("b1", "b2", "_:n", "p2") and r[2] != "A"}


CONTENTS = [
    "1) דף [2]א-[119]ב: מדרש תנחומא. 2) דף 120א–130: ספר שני (12) סוף.\n3) דף [131]-[140]ב: שלישי", "1) ראשון דף 3א - 5ב : כותר. 2) בלי דף.", "no numbers at all", "", None, "7) x", "1) דף [2]א-[119]ב:  שם\nבשתי שורות . 2) not of the form",
]


def plain_contents(text):
    side = {"א": "r", "ב": "v", "": ""}
    whole = [
        (int(n), t.strip().rstrip("."), f"{a}{side[x]}-{b}{side[y]}", f"{a}{side[x]}", f"{b}{side[y]}")
        for n, a, x, b, y, t in re.findall(r"(\d+)\)\s*דף\s*\[?(\d+)\]?([אב]?)[-–]\[?(\d+)\]?([אב]?):\s*(.+?)(?=\d+\)|$)", text or "", re.DOTALL)
    ]
    if whole:
        return whole
    out = []
    for n, t in re.findall(r"(\d+)\)\s*(.+?)(?=\d+\)|$)", text or "", re.DOTALL):
        m = re.search(r"דף\s*\[?(\d+[אב]?)\]?\s*[-–]\s*\[?(\d+[אב]?)\]?", t)
        c = re.search(r":\s*(.+)", t)
        out.append((int(n), (c[1].strip() if c else t.strip()).rstrip("."), f"{m[1]}-{m[2]}".replace("א", "r").replace("ב", "v") if m else None, None, None))
    return out


def test_numbered_contents(spark):
    df = spark.createDataFrame(list(enumerate(CONTENTS)), "k int, t string")
    got = {r["k"]: [tuple(i) for i in r["i"] or []] for r in df.select("k", fields.numbered_contents(F.col("t")).alias("i")).collect()}
    assert got == {k: plain_contents(t) for k, t in enumerate(CONTENTS)}


def test_marc_files(spark, tmp_path):
    long = [
        ("r1", "001", 0, "", "", "", 0, "r1"), ("r1", "245", 1, "1", "0", "a", 0, "כותר"), ("r1", "245", 1, "1", "0", "b", 1, "é\x1dx"), ("r1", "500", 2, None, " ", "a", 0, ""),
        ("r2", "001", 0, "", "", "", 0, "r2"), ("r2", "500", 1, " ", " ", "a", 0, "y" * 9_994), ("r3", "001", 0, "", "", "", 0, "r3"), ("r3", "500", 1, " ", " ", "a", 0, "z" * 9_995),
        ("r4", "001", 0, "", "", "", 0, "r4"), *[("r4", "500", k, " ", " ", "a", 0, "w" * 9_000) for k in range(1, 13)], (None, "001", 0, "", "", "", 0, "lost"),
    ]
    df = spark.createDataFrame(long, marc.LONG)
    failed = {r["control_number"]: r["error"] for r in marc.write_marc(df, str(tmp_path / "m")).collect()}
    assert set(failed) == {"r3", "r4"} and "field" in failed["r3"] and "record" in failed["r4"]
    got = sorted(tuple(r)[:8] for r in marc.read_marc(spark, str(tmp_path / "m")).collect())
    wanted = [(n, t, o, a or " ", b, c, s, v.replace("\x1d", " ")) for n, t, o, a, b, c, s, v in long if n in ("r1", "r2")]
    assert got == sorted((n, t, o, "" if t < "010" else a, "" if t < "010" else b, c, s, v) for n, t, o, a, b, c, s, v in wanted)
    for raw in marc.encoded_records(df.where("control_number = 'r1'")).collect():
        data = raw["value"].encode()
        assert int(data[:5]) == len(data) + 1 and data[int(data[12:17]) - 1 : int(data[12:17])] == b"\x1e"
