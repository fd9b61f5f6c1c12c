"""Measures and data sets for sequence and label models: P/R/F1, thresholds, folds, spans, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(gold: Column, predicted: Column) -> list[Column]:
    """Aggregates ``tp, fp, fn, precision, recall, f1`` of two boolean columns."""
    tp, fp, fn = F.count_if(gold & predicted), F.count_if(~gold & predicted), F.count_if(gold & ~predicted)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def micro(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    return df.agg(*prf(gold, predicted))


def per_class(df: DataFrame, label: str, gold: Column, predicted: Column) -> DataFrame:
    return df.groupBy(label).agg(*prf(gold, predicted), F.count_if(gold).alias("support"))


def threshold_grid(df: DataFrame, gold: Column, score: Column, first: int = 20, last: int = 80, step: int = 5) -> DataFrame:
    """``threshold`` (hundredths), tp, fp, fn, precision, recall and f1 for each threshold.

    The rows are counted by score bucket first; only the counts meet the grid.
    """
    spark = df.sparkSession
    bucket = F.floor(F.round(score * 100, 6)).cast("int")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count_if(gold).alias("pos"), F.count_if(~gold).alias("neg"))
    grid = spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("threshold"))
    at = F.col("bucket") >= F.col("threshold")
    tp, fp, fn = (F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)) for c, n in ((at, "pos"), (at, "neg"), (~at, "pos")))
    return F.broadcast(grid).crossJoin(counts).groupBy("threshold").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The threshold of the largest f1, the first on a tie."""
    return grid.agg(F.min(F.struct((-F.col("f1")).alias("f"), F.col("threshold").alias("t"))).alias("m")).select(F.col("m.t").alias("threshold"), (-F.col("m.f")).alias("f1"))


def numbered(df: DataFrame, label: str, key: str) -> DataFrame:
    """Each row's ``place`` (from 0) in its label, in order of a checksum of the key, and the label's ``size``.

    Rows are numbered in groups of a label and the checksum's first two digits, so
    that a label isn't sorted in one task; counts of the groups before are added.
    """
    salt = F.coalesce(F.substring(F.md5(F.col(key).cast("string")), 1, 2), F.lit(""))
    rows = df.withColumn("__salt", salt)
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__salt").alias("__group")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__label")
    before = F.sum("__n").over(w.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("__label", "__group", F.coalesce(before, F.lit(0)).alias("__base"), F.sum("__n").over(w).alias("size"))
    place = F.row_number().over(Window.partitionBy(label, "__salt").orderBy(F.md5(F.col(key).cast("string")), key))
    found = rows.withColumn("__place", place).join(bases, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__group")))
    return found.select(*df.columns, (F.col("__base") + F.col("__place") - 1).alias("place"), "size")


def folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """A stratified ``fold`` for each row, dealt in order of a checksum of the key."""
    return numbered(df, label, key).select(*df.columns, F.pmod("place", F.lit(k)).cast("int").alias("fold"))


def rebalance(df: DataFrame, label: str, key: str, size: int, replace: bool = False) -> DataFrame:
    """At most ``size`` rows of each label, the first by a checksum of the key.

    With ``replace``, a label of fewer rows repeats them until it has ``size``: all
    of them as often as they fit, and the first ones once more.
    """
    rows = numbered(df, label, key)
    if not replace:
        return rows.where(F.col("place") < size).select(df.columns)
    copies = F.when(F.col("size") >= size, (F.col("place") < size).cast("long")).otherwise(F.floor(F.lit(size) / F.col("size")) + (F.col("place") < F.lit(size) % F.col("size")).cast("long"))
    return rows.withColumn("__c", copies).where("__c > 0").select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("__c"))).alias("copy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Negatives over positives of each label, with one positive at least."""
    total = df.agg(F.count("*").alias("total"))
    n = df.groupBy(label).agg(F.count("*").alias("pos"))
    return n.crossJoin(F.broadcast(total)).select(label, F.round((F.col("total") - F.col("pos")) / F.greatest("pos", F.lit(1)), 6).alias("weight"))


def vocabulary(df: DataFrame, label: str, top: int, least: int = 1) -> DataFrame:
    """The ``top`` commonest labels with ``least`` rows or more (ties by label)."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), label).limit(top)


def multi_hot(labels: Column, vocab: list[str]) -> Column:
    """One number for each label of the vocabulary, and a last one if none of them is there."""
    hot = [F.array_contains(labels, v).cast("int") for v in vocab]
    return F.array(*hot, F.when(reduce(Column.__add__, hot) == 0, 1).otherwise(0))


# BIO sequences --------------------------------------------------------------


def bmes_to_bio(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.when(t.startswith("M-") | t.startswith("E-"), F.concat(F.lit("I-"), F.substring(t, F.lit(3), F.length(t)))).when(t.startswith("S-"), F.concat(F.lit("B-"), F.substring(t, F.lit(3), F.length(t)))).otherwise(t))


def bio_valid(tags: Column) -> Column:
    """No inside tag without one of its type before it."""
    before = F.slice(F.concat(F.array(F.lit("O")), tags), F.lit(1), F.size(tags))
    return F.forall(F.zip_with(tags, before, lambda t, b: ~t.startswith("I-") | (F.substring(b, F.lit(3), F.length(b)) == F.substring(t, F.lit(3), F.length(t))) & ~(b == "O")), lambda ok: ok)


def bio_spans(tokens: Column, tags: Column) -> Column:
    """``array<struct<type, start, end, text>>``: entities (end exclusive), by a fold over the tags.

    An inside tag that doesn't continue its type begins an entity of its own.
    """
    kind = lambda t: F.substring(t, F.lit(3), F.length(t))
    empty = F.array().cast("array<struct<type:string,start:int,end:int>>")
    numbered = F.transform(tags, lambda t, i: F.struct(t.alias("t"), i.cast("int").alias("i")))

    def step(acc: Column, x: Column) -> Column:
        joins = x["t"].startswith("I-") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] == x["i"]) & (F.get(acc, F.size(acc) - 1)["type"] == kind(x["t"]))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["type"].alias("type"), F.get(acc, F.size(acc) - 1)["start"].alias("start"), (x["i"] + 1).alias("end"))))
        begun = F.concat(acc, F.array(F.struct(kind(x["t"]).alias("type"), x["i"].alias("start"), (x["i"] + 1).alias("end"))))
        return F.when(x["t"] == "O", acc).when(joins, longer).otherwise(begun)

    spans = F.aggregate(numbered, empty, step)
    return F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), F.array_join(F.slice(tokens, s["start"] + 1, s["end"] - s["start"]), " ").alias("text")))


def entity_counts(gold: Column, predicted: Column) -> list[Column]:
    """Per sentence ``tp, fp, fn`` of two sets of entities."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    return [F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn")]


def lenient_hits(gold: Column, predicted: Column) -> Column:
    """Predictions that contain a gold entity or are contained in one."""
    return F.size(F.filter(predicted, lambda p: F.exists(gold, lambda g: F.contains(p, g) | F.contains(g, p))))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The overlap of two spans as a share of the shorter one."""
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, both / shorter).otherwise(F.lit(0.0))


def weighted_votes(votes: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """The label of the largest summed weight of each group and its share (ties: smallest label)."""
    summed = votes.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    return summed.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(label).alias("l"))).alias("m"), F.sum("w").alias("total")).select(*keys, F.col("m.l").alias(label), F.round(-F.col("m.w") / F.col("total"), 6).alias("confidence"))


def drop_overlaps(spans: Column) -> Column:
    """Longest first, then by start: spans (``start, end``) that overlap none kept before."""
    order = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<k:int,start:int,end:int>>")
    kept = F.aggregate(F.array_sort(order), empty, lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def adjacent_overlaps(df: DataFrame, record: str, start: str, end: str, *ties: str) -> DataFrame:
    """Spans that reach into the next one of their record."""
    following = F.lead(start).over(Window.partitionBy(record).orderBy(start, end, *ties))
    return df.withColumn("next_start", following).where(F.col(end) > F.col("next_start"))
