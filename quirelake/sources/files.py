"""Other sources and sinks: triples, tagged sentences, annotations, gazetteers, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import escaped

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+{_TERM}\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of line-based files; blank lines and comments are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    kind = F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")
    value = F.when(kind == "literal", F.regexp_replace(F.regexp_replace(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1), r'\\"', '"'), r"\\\\", r"\\")).otherwise(bare(o))
    datatype = F.nullif(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1), F.lit(""))
    lang = F.nullif(F.regexp_extract(o, r"\"@([A-Za-z-]+)$", 1), F.lit(""))
    return lines.where(F.col("value").rlike(_LINE)).select(bare(part(1)).alias("s"), part(2).alias("p"), value.alias("o"), kind.alias("o_kind"), datatype.alias("datatype"), lang.alias("lang"))


def _node(kind: Column, value: Column) -> Column:
    return F.when(kind == "bnode", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line of text for each triple."""
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    text = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))
    o = F.when(F.col("o_kind") == "literal", text).otherwise(_node(F.col("o_kind"), F.col("o")))
    return triples.select(F.concat(s, F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """One block of text for each subject, its statements in order."""
    line = F.concat(F.lit("<"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))).otherwise(_node(F.col("o_kind"), F.col("o"))))
    blocks = triples.select("s", line.alias("line")).groupBy("s").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return blocks.select("s", F.concat(F.lit("<"), "s", F.lit("> "), F.array_join("lines", " ;\n    "), F.lit(" .")).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def statement_value(kind: Column, value: Column, precision: Column, language: Column) -> Column:
    """A value as statement text."""
    quoted = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    return F.when(kind == "item", value).when(kind == "time", F.concat(value, F.lit("/"), precision.cast("string"))).when(kind == "quantity", value).when(kind == "monolingual", F.concat(language, F.lit(":"), quoted)).otherwise(quoted)


def quickstatements(items: DataFrame, statements: DataFrame) -> DataFrame:
    """Lines of statement text ``local_id, ord, value``: CREATE for new items, then labels, then claims.

    ``items(local_id, existing_qid, label, lang)`` and
    ``statements(local_id, ord, property, kind, value, precision, language)``.
    """
    subject = F.when(F.col("existing_qid").isNotNull(), F.col("existing_qid")).otherwise("LAST")
    create = items.where("existing_qid is null").select("local_id", F.lit(-2).alias("ord"), F.lit("CREATE").alias("value"))
    labels = items.where("label is not null").select("local_id", F.lit(-1).alias("ord"), F.concat_ws("\t", subject, F.concat(F.lit("L"), "lang"), F.concat(F.lit('"'), escaped(F.col("label")), F.lit('"'))).alias("value"))
    claims = statements.join(items.select("local_id", "existing_qid"), "local_id").select("local_id", "ord", F.concat_ws("\t", subject, "property", statement_value(F.col("kind"), F.col("value"), F.col("precision"), F.col("language"))).alias("value"))
    return create.unionAll(labels).unionAll(claims)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """``sentence, tokens, tags`` of files with a token and its tag on each line and blank lines between sentences.

    Files are split at blank lines by the reader, so that sentences stay whole.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("sentence"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)
    column = lambda k: F.transform("lines", lambda x: F.element_at(F.split(F.trim(x), r"\s+"), k))
    return blocks.select("sentence", column(1).alias("tokens"), column(-1).alias("tags"))


#: Columns of the six kinds of annotation.
ANNOTATIONS = {
    "certainty": "manuscript_id string, certainty_level string, attribution_source string, certainty_percentage int, note string",
    "text_tradition": "manuscript_id string, tradition_name string, siglum string, work_title string, variant_text string, standard_text string, folio string, line int, significance string",
    "scribal_intervention": "manuscript_id string, intervention_type string, folio_range string, description string, scribe_name string",
    "canonical_reference": "manuscript_id string, reference_type string, book_name string, chapter string, verse string, tractate string, folio string",
    "textual_relationship": "source_id string, target_id string, relationship_type string",
    "foreign_unit": "manuscript_id string, unit_id string, is_foreign string, status string, addition_period string, folio_range string",
}


def read_annotations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=ANNOTATIONS[kind], mode="PERMISSIVE")
    return rows.withColumn("is_foreign", F.lower(F.trim("is_foreign")).isin("true", "yes", "1")) if kind == "foreign_unit" else rows


def read_annotation_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One kind of annotation out of a document that holds an array for each."""
    whole = spark.read.schema(f"{kind} array<struct<{ANNOTATIONS[kind].replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return whole.select(F.explode(kind).alias("a")).select("a.*")


def read_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``places`` and ``names(place_id, name)`` of a folder of three tab-separated files; empty ids become null."""
    places = spark.read.csv(f"{path}/places.tsv", header=True, sep="\t")
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = places.select(F.col("Id").cast("int").alias("place_id"), empty("primary_heb_full").alias("primary_heb"), empty("primary_rom_full").alias("primary_rom"), empty("WD").alias("wikidata_id"), empty("VIAF_ID").alias("viaf_id"), empty("Geoname_ID").alias("geonames_id"), empty("MAZAL_ID").alias("authority_id"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))
    variants = spark.read.csv(f"{path}/variants.tsv", header=True, sep="\t").select(F.col("PlaceId").cast("int").alias("place_id"), F.col("variant").alias("name"))
    names = out.select("place_id", F.explode(F.array_compact(F.array("primary_heb", "primary_rom"))).alias("name")).union(variants).where("name is not null").distinct()
    return out, names


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's JSON array of records; fails if a record lacks a control number."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("_control_number", F.coalesce("_control_number", F.raise_error(F.lit("a record has no _control_number")).cast("string")))


def write_stage(df: DataFrame, path: str) -> None:
    df.write.json(path)
