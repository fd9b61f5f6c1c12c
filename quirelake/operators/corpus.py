"""Analytics of annotated corpora: records, entities, spans and their statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from quirelake.functions import text


def without_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column doesn't match; nulls stay."""
    return df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def joined(*columns: str) -> Column:
    """Columns joined by blanks; a null counts as empty and keeps its blank."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    aggregates = [F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.avg(column), 6).alias("mean"), F.median(column).alias("median")]
    return df.groupBy(*by).agg(*aggregates)


def keep_longest(df: DataFrame, keys: list[str], column: str, *order: str) -> DataFrame:
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length(column)), *order)))
    return ranked.where("__r = 1").drop("__r")


def top_per_group(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def top_values(df: DataFrame, by: str, value: str, n: int = 10) -> DataFrame:
    counted = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return top_per_group(counted, by, n, F.desc("n"), F.col(value))


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """Rows of each group and their share of all, in percent."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(by, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def rate_rollup(df: DataFrame, by: str, good: Column) -> DataFrame:
    """Rows, good rows and their rate for each group, and for all together as OVERALL."""
    rolled = df.rollup(by).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.grouping(by).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col(by)).alias(by), "n", "good", F.round(100 * F.col("good") / F.col("n"), 6).alias("rate"))


def per_record(df: DataFrame, record: str) -> DataFrame:
    """Least, most, mean and median number of rows of a record."""
    n = df.groupBy(record).agg(F.count("*").alias("k"))
    return n.agg(F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"), F.median("k").alias("median"))


def unpivot(df: DataFrame, key: str, groups: dict[str, list[str]], mark: str = "|") -> DataFrame:
    """``key, entity_type, source_field, entity``: the parts of several columns, by kind of entity."""
    cells = F.array(*(F.struct(F.lit(kind).alias("entity_type"), F.lit(c).alias("source_field"), text.pieces(F.col(f"`{c}`"), mark).alias("parts")) for kind, columns in groups.items() for c in columns))
    rows = df.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return rows.select(key, "entity_type", "source_field", F.explode("parts").alias("entity"))


def validated(entities: DataFrame, contexts: DataFrame, key: str, context: str) -> DataFrame:
    """Entities with whether their record's text holds them, whatever the case."""
    both = entities.join(contexts.select(key, context), key, "left")
    return both.withColumn("found", F.coalesce(F.contains(F.lower(context), F.lower("entity")), F.lit(False))).drop(context)


@pandas_udf(ArrayType(IntegerType()))
def _starts(context: pd.Series, needle: pd.Series) -> pd.Series:
    def places(text: str, part: str) -> list[int]:
        out, at = [], text.find(part)
        while at >= 0:
            out.append(at)
            at = text.find(part, at + len(part))
        return out

    return pd.Series([places(c, n) if c and n else [] for c, n in zip(context, needle, strict=True)])


def occurrences(df: DataFrame, context: str, needle: str) -> DataFrame:
    """One row for each occurrence that doesn't overlap the one before, with ``start`` and ``end``.

    The cost is linear in a text and its occurrences, and nothing is shuffled; any
    signs may stand in a needle.
    """
    found = df.where(F.contains(context, F.col(needle))).select("*", F.explode(_starts(F.col(context), F.col(needle))).alias("start"))
    return found.withColumn("end", F.col("start") + F.length(needle))


def offsets(df: DataFrame, by: str, position: str, column: str) -> DataFrame:
    """Each segment's first character, were the segments joined by one character."""
    w = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.length(column) + 1).over(w), F.lit(0)).cast("long"))


def training_records(entities: DataFrame, record: str, position: str, content: str, score: str) -> DataFrame:
    """A record's first text, number of entities and mean score."""
    return entities.groupBy(record).agg(F.min_by(content, position).alias("text"), F.count("*").alias("validation_score"), F.round(F.avg(score), 6).alias("validation_rate"))


def sequences(entities: DataFrame, content: str) -> DataFrame:
    """``text, tokens, tags``: one row a text with BIO tags of its entities ``start, end, entity_type`` (tokens)."""
    spans = entities.groupBy(content).agg(F.array_sort(F.collect_set(F.struct("start", "end", "entity_type"))).alias("spans"))
    tokens = F.split(text.squeezed(F.col(content)), " ")
    tag = lambda i: F.coalesce(F.get(F.transform(F.filter("spans", lambda s: (s["start"] <= i) & (i < s["end"])), lambda s: F.concat(F.when(s["start"] == i, "B-").otherwise("I-"), s["entity_type"])), 0), F.lit("O"))
    return spans.select(F.col(content).alias("text"), tokens.alias("tokens"), F.transform(tokens, lambda t, i: tag(i)).alias("tags"))


def find_tokens(tokens: Column, entity: Column) -> Column:
    """Where an entity's tokens first stand in a row among the tokens, or -1."""
    n = F.size(entity)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.slice(tokens, i + 1, n) == entity)
    return F.coalesce(F.get(starts, 0), F.lit(-1))


def first_role(context: Column, table: list[tuple[str, str]], default: str = "author") -> tuple[Column, Column]:
    """The role of the first keyword of a table in a context, and how sure it is."""
    role = F.coalesce(*(F.when(F.contains(F.lower(context), F.lit(k)), F.lit(r)) for k, r in table))
    return F.coalesce(role, F.lit(default)), F.when(role.isNotNull(), 0.85).otherwise(0.60)


def quality_report(df: DataFrame, source: str, record: str, score: str, high: float) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.count_distinct(record).alias("records"), F.round(100 * F.count_if(F.col(score) >= high) / F.count("*"), 6).alias("high_percent"))


def imbalance(df: DataFrame, label: str, most: float = 10.0) -> DataFrame:
    """Largest and smallest class and whether their ratio calls for rebalancing."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).select("largest", "smallest", F.round(F.col("largest") / F.col("smallest"), 6).alias("ratio"), (F.col("largest") / F.col("smallest") > most).alias("rebalance"))


# Filters over recognised entities ----------------------------------------------


def retyped(df: DataFrame, entity: str, kind: str) -> DataFrame:
    """Authors that are folio references or titles get their right type; ``retyped_from`` keeps the old one."""
    folio = F.col(entity).rlike(r"(?i)^\s*ff?\.?\s*\d+[rv]?|^\s*\d+[rv]\b")
    work = F.col(entity).rlike(r"(?i)^(?:sefer|book of|ספר)\b")
    new = F.when((F.col(kind) == "WORK_AUTHOR") & folio, "FOLIO").when((F.col(kind) == "WORK_AUTHOR") & work, "WORK")
    return df.withColumn("retyped_from", F.when(new.isNotNull(), F.col(kind))).withColumn(kind, F.coalesce(new, F.col(kind)))


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and all others."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(hit), df.where(~hit)


def collection_citation(entity: Column) -> Column:
    return entity.rlike(r"(?i)^(?:catalog(?:ue)?|cat\.|ms\.?|no\.|nr\.)\s*[A-Z0-9]")


def date_shaped(entity: Column) -> Column:
    return entity.rlike(r"\d{3,4}|[א-ת]+[\"״][א-ת]|(?i)century")


def entity_grid(df: DataFrame, sources: list[str], kinds: list[str], roles: list[str]) -> DataFrame:
    """Rows of the chosen sources, kinds and roles; a blank role always passes."""
    role = F.coalesce(F.trim("role"), F.lit(""))
    return df.where(F.col("source").isin(sources) & F.col("entity_type").isin(kinds) & ((role == "") | role.isin(roles)))


def _chosen(column: str, values: list[str]) -> Column:
    """A grid's filter: nothing chosen shows all."""
    return F.coalesce(F.col(column), F.lit("")).isin(values) if values else F.lit(True)


def confidence_band(confidence: Column) -> Column:
    return F.when(F.lower(confidence).isin("high", "medium", "low"), F.lower(confidence)).otherwise("none")


def authority_grid(df: DataFrame, sources: list[str] = (), kinds: list[str] = (), bands: list[str] = ()) -> DataFrame:
    """Matches of the chosen sources, kinds and bands of confidence."""
    banded = df.withColumn("__band", confidence_band(F.col("confidence").cast("string")))
    return banded.where(_chosen("source", list(sources)) & _chosen("match_type", list(kinds)) & _chosen("__band", list(bands))).drop("__band")


def export_grid(df: DataFrame, kinds: list[str] = (), statuses: list[str] = ()) -> DataFrame:
    """Items of the chosen kinds and states."""
    return df.where(_chosen("entity_type", list(kinds)) & _chosen("status", list(statuses)))


def type_definitions(entities: DataFrame, kind: str, score: str, metadata: DataFrame) -> DataFrame:
    """``kind, description, source_fields, count, avg_validation_score``; a kind without metadata gets empty texts."""
    counted = entities.groupBy(kind).agg(F.count("*").alias("count"), F.round(F.avg(score), 6).alias("avg_validation_score"))
    known = metadata.select(kind, "description", "source_fields").dropDuplicates([kind])
    return counted.join(known, kind, "left").fillna("", ["description", "source_fields"]).select(kind, "description", "source_fields", "count", "avg_validation_score")
