"""A corpus pipeline of five stages, each calling one operator of ``quirelake.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; all but the last return the columns of ``documents``.  Stages are written
as Parquet in the shared folder and read again.

1. language ID: fits on the labelled rows and drops documents without a letter,
   and those in which no language holds half of the letters.
2. line dedup: recurring lines stay in the first document that has them, copies
   lose their short lines too; documents that lose all their words leave.
3. near duplicates: the document with the smallest id of each group stays.
4. decontamination: documents with a passage of the benchmark leave.
5. packing: every piece of every document and its place in a sequence.

Null ids pass stages 2 to 4 unless their own text rules them out; rows that share
an id share their fate.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontamination, language_id, line_templates, near_duplicates, packing
from quirelake.llm.shared import written

#: The least share of the letters that the predicted language must hold.
MIN_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(True))))
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MIN_SHARE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring_lines(docs, keep_empty=False, copies=True).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = written(near_duplicates.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = written(decontamination.find_contamination(docs, benchmark).where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Predictions and signatures are beyond SQL; tests/llm/test_pipeline.py compares the documents that stages 2 to 4 keep with plain Python, and checks stage 1 on known rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
