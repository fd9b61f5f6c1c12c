"""Bibliographic records: ISO 2709 files, record XML and header-driven delimited files.

All readers give the long form: one row for each subfield,
``control_number, tag, field_ord, ind1, ind2, code, sub_ord, value``; control
fields have the code ``""``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG = "control_number string, tag string, field_ord int, ind1 string, ind2 string, code string, sub_ord int, value string"
NAMES = [x.split()[0] for x in LONG.split(", ")]
FIELD_END, RECORD_END, SUBFIELD = b"\x1e", b"\x1d", b"\x1f"


def decode_record(raw: bytes) -> list[tuple]:
    """The long rows of one ISO 2709 record; raises ValueError if it can't be read."""
    base = int(raw[12:17])
    directory = raw[24 : base - 1]
    if len(directory) % 12:
        raise ValueError("the directory is broken")
    rows, number = [], "unknown"
    for k in range(0, len(directory), 12):
        tag, size, at = directory[k : k + 3].decode("ascii"), int(directory[k + 3 : k + 7]), int(directory[k + 7 : k + 12])
        data = raw[base + at : base + at + size].rstrip(FIELD_END)
        if tag < "010":
            value = data.decode("utf-8", "replace")
            number = value.strip() if tag == "001" else number
            rows.append((tag, k // 12, "", "", "", 0, value))
        else:
            head, *subs = data.split(SUBFIELD)
            ind = head.decode("ascii", "replace").ljust(2)
            rows += [(tag, k // 12, ind[0], ind[1], s[:1].decode("ascii", "replace"), j, s[1:].decode("utf-8", "replace")) for j, s in enumerate(subs) if s]
    return [(number, *r) for r in rows]


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for raw in batch["value"]:
            raw = bytes(raw).lstrip(b"\r\n")
            if len(raw) < 25:
                continue
            try:
                rows += [(*r, None) for r in decode_record(raw)]
            except (ValueError, IndexError, UnicodeDecodeError) as e:
                rows.append((None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=[*NAMES, "error"])


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of ISO 2709 files, plus ``error``: a record that can't be read gives one row with its error.

    The text reader splits files at the record terminator, so that one large file
    is read by many tasks.
    """
    raw = spark.read.option("lineSep", RECORD_END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInPandas(_decoded, LONG + ", error string")


XML_RECORD = "controlfield array<struct<_VALUE string, _tag string>>, datafield array<struct<_tag string, _ind1 string, _ind2 string, subfield array<struct<_VALUE string, _code string>>>>, leader string"


def read_marcxml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Long rows of record XML; the schema is stated, so that no tag is taken for a number."""
    records = spark.read.format("xml").option("rowTag", row_tag).schema(XML_RECORD).load(path)
    number = F.coalesce(F.get(F.filter("controlfield", lambda c: c["_tag"] == "001"), 0)["_VALUE"], F.lit("unknown"))
    control = F.transform(F.coalesce("controlfield", F.array()), lambda c, i: F.struct(c["_tag"].alias("tag"), i.cast("int").alias("field_ord"), F.lit("").alias("ind1"), F.lit("").alias("ind2"), F.array(F.struct(c["_VALUE"].alias("_VALUE"), F.lit("").alias("_code"))).alias("sub")))
    n = F.size(F.coalesce("controlfield", F.array()))
    data = F.transform(F.coalesce("datafield", F.array()), lambda d, i: F.struct(d["_tag"].alias("tag"), (i + n).cast("int").alias("field_ord"), d["_ind1"].alias("ind1"), d["_ind2"].alias("ind2"), d["subfield"].alias("sub")))
    fields = records.select(number.alias("control_number"), F.explode(F.concat(control, data)).alias("f"))
    return fields.select("control_number", "f.tag", "f.field_ord", "f.ind1", "f.ind2", F.posexplode("f.sub").alias("sub_ord", "s")).select("control_number", "tag", "field_ord", "ind1", "ind2", F.col("s._code").alias("code"), "sub_ord", F.col("s._VALUE").alias("value"))


#: Column names that stand for fields.
SYNONYMS = {"title": "245$a", "author": "100$a", "date": "260$c", "place": "260$a", "language": "041$a", "notes": "500$a", "subject": "650$a", "provenance": "561$a", "contents": "505$a", "shelfmark": "090$a", "url": "856$u", "extent": "300$a", "material": "340$a", "control_number": "001", "כותר": "245$a", "מחבר": "100$a", "הערות": "500$a"}
_FIELD = re.compile(r"^(\d{3})(?:\$([a-z0-9]))?$")


def header_fields(header: list[str]) -> dict[str, tuple[str, str]]:
    """Each column's tag and code; unknown columns become general notes."""
    out = {}
    for name in header:
        m = _FIELD.match(name.strip()) or _FIELD.match(SYNONYMS.get(name.strip().lower(), "500$a"))
        out[name] = (m[1], "" if m[1] < "010" else m[2] or "a")
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Long rows of a delimited file with a header; values hold several parts between bars.

    Rows without a control number are named by file and place.
    """
    table = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", inferSchema=False)
    fields = header_fields(table.columns)
    number = [c for c, (tag, _) in fields.items() if tag == "001"]
    clean = lambda c: F.trim(F.regexp_replace(F.trim(F.col(f"`{c}`")), r'^"+|"+$', ""))
    control = F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in number), F.concat(F.lit("csv_row_"), F.monotonically_increasing_id().cast("string")))
    cells = F.array(*(F.struct(F.lit(tag).alias("tag"), F.lit(code).alias("code"), F.lit(k).alias("column"), F.split(clean(c), r"\|").alias("parts")) for k, (c, (tag, code)) in enumerate(fields.items())))
    rows = table.select(control.alias("control_number"), F.explode(cells).alias("c")).select("control_number", "c.*")
    parts = rows.select("control_number", "tag", "code", "column", F.posexplode("parts").alias("part", "value")).withColumn("value", F.trim("value")).where("value != ''")
    return parts.select("control_number", "tag", (F.col("column") * 1000 + F.col("part")).cast("int").alias("field_ord"), F.lit(" ").alias("ind1"), F.lit(" ").alias("ind2"), "code", F.lit(0).alias("sub_ord"), "value")


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file, or of a folder's or a pattern's first file, through Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(target)
    first = next((s for s in found or [] if s.isFile() or s.isDirectory()), None)
    if first is not None and first.isDirectory():
        first = next((s for s in files.listStatus(first.getPath()) if s.isFile() and s.getPath().getName()[0] not in "._"), None)
    if first is None:
        raise FileNotFoundError(path)
    stream = files.open(first.getPath())
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """``format, separator, encoding`` of a file from its name and first bytes, read through Spark."""
    head = _head(spark, path, 5000)
    encoding = next((e for e in ("UTF-8", "windows-1255", "ISO-8859-8", "ISO-8859-1") if _decodes(head, e)), "ISO-8859-1")
    low = path.lower()
    if low.endswith((".mrc", ".marc")) or re.match(rb"\d{5}", head) and RECORD_END in head:
        return "marc", "", encoding
    if low.endswith(".xml") or head.lstrip().startswith(b"<"):
        return "xml", "", encoding
    tabbed = low.endswith(".tsv") or not low.endswith(".csv") and b"\t" in head.split(b"\n", 1)[0]
    return "delimited", "\t" if tabbed else ",", encoding


def _decodes(head: bytes, encoding: str) -> bool:
    try:
        head.decode(encoding)
    except UnicodeDecodeError as e:
        return e.start > len(head) - 4
    return True


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind, sep, encoding = sniff(spark, path)
    if kind == "marc":
        return read_marc(spark, path).where("error is null").select(*NAMES)
    return read_marcxml(spark, path) if kind == "xml" else read_delimited(spark, path, sep, encoding)


def authority_records(long: DataFrame) -> DataFrame:
    """``authority_id, entity_type, script, name, preferred, dates`` of authority records: headings (1xx) and variants (4xx).

    A name's script is its ``$9`` (``lat`` if none); trailing commas and full stops go.
    """
    kinds = F.create_map(*[F.lit(x) for kv in {"00": "person", "10": "corporate", "11": "meeting", "30": "work", "51": "place"}.items() for x in kv])
    fields = long.where(F.col("tag").rlike("^[14](00|10|11|30|51)$")).groupBy("control_number", "tag", "field_ord").agg(*(F.max(F.when(F.col("code") == c, F.struct("sub_ord", "value")))["value"].alias(n) for c, n in (("a", "a"), ("d", "dates"), ("9", "script"))))
    name = F.regexp_replace("a", "[,. ]+$", "")
    return fields.where(F.col("a").isNotNull()).select(F.col("control_number").alias("authority_id"), kinds[F.substring("tag", 2, 2)].alias("entity_type"), F.coalesce("script", F.lit("lat")).alias("script"), name.alias("name"), F.col("tag").startswith("1").alias("preferred"), "dates")


def flat_projection(long: DataFrame) -> DataFrame:
    """``control_number, title, notes, genres``: 245 a and b, the first five 500 a, 655 a, joined by bars."""
    place = F.struct("field_ord", "sub_ord", "value")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, place)))
    tag, code = F.col("tag"), F.col("code")
    got = long.groupBy("control_number").agg(of((tag == "245") & code.isin("a", "b")).alias("t"), of((tag == "500") & (code == "a")).alias("n"), of((tag == "655") & (code == "a")).alias("g"))
    joined = lambda c, mark: F.array_join(F.transform(c, lambda x: x["value"]), mark)
    return got.select("control_number", joined("t", " ").alias("title"), joined(F.slice("n", 1, 5), "|").alias("notes"), joined("g", "|").alias("genres"))


def encoded_records(long: DataFrame) -> DataFrame:
    """``control_number, value, error``: ISO 2709 records of long rows, without their terminators.

    Lengths and offsets are counted in bytes of UTF-8.  A field longer than 9,999
    bytes, or a record longer than 99,999, can't be written: it gives an error and
    no value.
    """
    subfields = long.where("control_number is not null").groupBy("control_number", "field_ord", "tag").agg(F.array_sort(F.collect_list(F.struct("sub_ord", "code", "value"))).alias("subs"), F.min(F.struct("ind1", "ind2")).alias("ind"))
    text = lambda c: F.coalesce(c, F.lit(""))
    # What frames a record can't stand in it.
    clean = lambda c: F.translate(text(c), "\x1d\x1e\x1f", "   ")
    sub = F.array_join(F.transform("subs", lambda s: F.concat(F.lit("\x1f"), clean(s["code"]), clean(s["value"]))), "")
    data = F.when(F.col("tag") < "010", clean(F.get("subs", 0)["value"])).otherwise(F.concat(F.rpad(clean(F.col("ind.ind1")), 1, " "), F.rpad(clean(F.col("ind.ind2")), 1, " "), sub))
    fields = subfields.withColumn("data", F.concat(data, F.lit("\x1e"))).select("control_number", "field_ord", F.rpad("tag", 3, " ").alias("tag"), "data", F.octet_length("data").alias("size"))
    # A record's fields are few: their running offsets are sums over one window of it.
    before = F.sum("size").over(Window.partitionBy("control_number").orderBy("field_ord", "tag").rowsBetween(Window.unboundedPreceding, -1))
    entry = F.concat("tag", F.lpad(F.col("size").cast("string"), 4, "0"), F.lpad(F.coalesce(before, F.lit(0)).cast("string"), 5, "0"))
    placed = fields.withColumn("entry", entry)
    parts = placed.groupBy("control_number").agg(F.array_sort(F.collect_list(F.struct("field_ord", "tag", "entry", "data"))).alias("f"), F.sum("size").alias("bytes"), F.max("size").alias("longest"), F.count("*").alias("n"))
    base = 24 + 12 * F.col("n") + 1
    total = base + F.col("bytes") + 1
    number = lambda c: F.lpad(c.cast("string"), 5, "0")
    join = lambda c: F.array_join(F.transform("f", lambda x: x[c]), "")
    record = F.concat(number(total), F.lit("nam a22"), number(base), F.lit("   4500"), join("entry"), F.lit("\x1e"), join("data"))
    error = F.when(F.col("longest") > 9999, "a field is longer than 9,999 bytes").when(total > 99_999, "the record is longer than 99,999 bytes")
    return parts.select("control_number", F.when(error.isNull(), record).alias("value"), error.alias("error"))


def write_marc(long: DataFrame, path: str) -> DataFrame:
    """ISO 2709 files, one a task, each record ended by its terminator; returns the records that can't be written, with their errors."""
    records = encoded_records(long)
    records.where("value is not null").select("value").write.option("lineSep", RECORD_END.decode()).text(path)
    return records.where("value is null").select("control_number", "error")
