"""Conformance rules, lint, audits and detectors of duplicates and conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIOLATION = "focus_node, path, severity, message"
SEVERITIES = ("Info", "Warning", "Violation")


def cardinality(focus: DataFrame, values: DataFrame, key: str, path: str, *, least: int = 0, most: int | None = None, severity: str = "Violation") -> DataFrame:
    """Focus nodes with too few or too many values: counts are joined, never collected."""
    n = values.groupBy(key).agg(F.count("*").alias("__n"))
    counted = focus.select(key).join(n, key, "left").select(key, F.coalesce("__n", F.lit(0)).alias("n"))
    few, many = F.col("n") < least, (F.col("n") > most) if most is not None else F.lit(False)
    message = F.when(few, F.concat(F.lit(f"Less than {least} values of {path}: "), F.col("n").cast("string"))).otherwise(F.concat(F.lit(f"More than {most} values of {path}: "), F.col("n").cast("string")))
    return counted.where(few | many).select(F.col(key).cast("string").alias("focus_node"), F.lit(path).alias("path"), F.lit(severity).alias("severity"), message.alias("message"))


def matches_pattern(values: DataFrame, key: str, value: str, path: str, pattern: str, severity: str = "Violation") -> DataFrame:
    bad = values.where(~F.coalesce(F.col(value).rlike(pattern), F.lit(False)))
    return bad.select(F.col(key).cast("string").alias("focus_node"), F.lit(path).alias("path"), F.lit(severity).alias("severity"), F.concat(F.lit("Value does not match: "), F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("message"))


def of_class(values: DataFrame, key: str, value: str, members: DataFrame, member: str, path: str, severity: str = "Violation") -> DataFrame:
    """Values that aren't members of a class."""
    bad = values.join(members.select(F.col(member).alias(value)).distinct(), value, "left_anti")
    return bad.select(F.col(key).cast("string").alias("focus_node"), F.lit(path).alias("path"), F.lit(severity).alias("severity"), F.concat(F.lit("Value is not of the class: "), F.col(value).cast("string")).alias("message"))


#: Documented shapes: class, path, least, most, severity (fixed values).
SHAPES = (
    ("Manuscript", "rdfs:label", 1, None, "Violation"), ("Manuscript", "record_id", 1, 1, "Violation"), ("Expression", "rdfs:label", 1, None, "Violation"), ("Expression", "realises", 1, None, "Warning"), ("Expression", "folio_range", 1, None, "Warning"), ("Colophon", "text", 1, None, "Violation"),
    ("Colophon", "mentions_scribe", 1, None, "Warning"), ("Production", "time_span", 1, None, "Violation"), ("Production", "materialised", 1, None, "Violation"), ("VolumeSet", "has_volume", 2, None, "Violation"), ("Manuscript", "embodies", 1, None, "Warning"),
)


def validate(triples: DataFrame, shapes=SHAPES) -> DataFrame:
    """Violations of cardinality shapes, of all shapes in one pass over the triples.

    The table of shapes is small and fixed; it meets the typed nodes by an
    equi-join on the class and the counted values by one on node and path.
    """
    table = reduce(DataFrame.unionAll, (triples.sparkSession.range(1).select(F.lit(c).alias("o"), F.lit(p).alias("path"), F.lit(a).alias("least"), F.lit(b).cast("int").alias("most"), F.lit(s).alias("severity")) for c, p, a, b, s in shapes))
    focus = triples.where(F.col("p") == "rdf:type").select("s", "o").join(F.broadcast(table), "o")
    # Only the shapes' own paths are counted.
    n = triples.where(F.col("p").isin(*{p for _, p, *_ in shapes})).groupBy("s", F.col("p").alias("path")).agg(F.count_distinct("o").alias("n"))
    counted = focus.join(n, ["s", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = counted.where((F.col("n") < F.col("least")) | (F.col("n") > F.col("most")))
    return bad.select(F.col("s").alias("focus_node"), "path", "severity", F.concat_ws(" ", F.lit("values:"), F.col("n").cast("string")).alias("message"))


def http_urls(triples: DataFrame, path: str = "digital_url") -> DataFrame:
    return matches_pattern(triples.where(F.col("p") == path), "s", "o", path, "^https?://")


def single_set(members: DataFrame, volume: str, volume_set: str) -> DataFrame:
    """Volumes in more than one set."""
    return members.groupBy(volume).agg(F.count_distinct(volume_set).alias("n")).where("n > 1")


def worst_severity(violations: DataFrame, key: str = "focus_node") -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = violations.groupBy(key).agg(F.max(rank).cast("int").alias("r"), F.count("*").alias("n"))
    return worst.select(key, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r")).alias("severity"), "n")


def lint(items: DataFrame, key: str, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """``severity, code, message, ref``: one row for each rule ``(severity, code, condition, message)`` that an item breaks."""
    found = F.array(*(F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"))) for severity, code, condition, message in rules))
    return items.select(F.col(key).cast("string").alias("ref"), F.explode(F.array_compact(found)).alias("x")).select("x.*", "ref")


def report(violations: DataFrame, examples: int = 20) -> DataFrame:
    """Counts by severity and message, with the first focus nodes."""
    ranked = violations.withColumn("__r", F.row_number().over(Window.partitionBy("severity", "message").orderBy("focus_node")))
    return ranked.groupBy("severity", "message").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__r") <= examples, F.col("focus_node")))).alias("examples"))


def duplicate_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    return claims.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def redundant_claims(claims: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All but the first of equal claims."""
    return claims.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r > 1").drop("__r")


def conflicting_values(claims: DataFrame, key: str, prop: str, value: str, suspects: list[str] | None = None) -> DataFrame:
    """Keys with two different values or more of a property."""
    rows = claims if suspects is None else claims.where(F.col(prop).isin(suspects))
    return rows.groupBy(key, prop).agg(F.count_distinct(value).alias("n_values")).where("n_values >= 2")


def coverage(items: DataFrame, claims: DataFrame, key: str, prop: str, expected: list[str]) -> DataFrame:
    """For each expected property: items that have it, items that lack it, share."""
    total = items.select(key).distinct().agg(F.count("*").alias("total"))
    held = claims.where(F.col(prop).isin(expected)).join(items.select(key).distinct(), key, "left_semi").groupBy(prop).agg(F.count_distinct(key).alias("held"))
    wanted = reduce(DataFrame.unionAll, (items.sparkSession.range(1).select(F.lit(p).alias(prop)) for p in expected))
    # One row meets one row a property.
    full = wanted.join(held, prop, "left").crossJoin(F.broadcast(total))
    return full.select(prop, F.coalesce("held", F.lit(0)).cast("long").alias("held"), (F.col("total") - F.coalesce("held", F.lit(0))).cast("long").alias("missing"), F.when(F.col("total") > 0, F.round(F.coalesce("held", F.lit(0)) / F.col("total"), 6)).alias("share"))


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a measure before and after, and their difference; a missing side counts as zero."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(key, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def disjoint_claims(a: Column, b: Column) -> Column:
    """Both sides have values and share none: items that must not be merged."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


# Row rules ------------------------------------------------------------------


def rule(column: str, op: str, value) -> Column:
    """One rule of the row language: ``> >= <= < = != in`` and ``not in``.

    Both sides count as numbers if both are numbers (a null as 0), or else as
    strings (a null as the empty one).
    """
    c = F.col(column).cast("string")
    if op in ("in", "not in"):
        hit = F.coalesce(c, F.lit("")).isin([str(v) for v in value])
        return hit if op == "in" else ~hit
    number = F.when(F.col(column).isNull(), F.lit(0.0)).otherwise(c.try_cast("double"))
    text = F.coalesce(c, F.lit(""))
    compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__, "!=": Column.__ne__}[op]
    try:
        wanted = float(value)
    except (TypeError, ValueError):
        return compare(text, F.lit(str(value)))
    return F.when(number.isNotNull(), compare(number, F.lit(wanted))).otherwise(compare(text, F.lit(str(value))))


def rules(tests: list[tuple[str, str, object]], combine: str = "AND") -> Column:
    """Rules joined by AND or OR; no rules match nothing."""
    if not tests:
        return F.lit(False)
    return reduce(Column.__and__ if combine == "AND" else Column.__or__, (rule(*t) for t in tests))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 0) of a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)
