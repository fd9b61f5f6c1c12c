"""Verdicts on matches of a name: how far to trust them, and which identifiers to keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")


def _given(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def confidence(sources: list[Column], latin_form: Column, doubt: Column, *, disagrees: Column, confirms: Column, forced_low: Column) -> Column:
    """``low``, ``medium`` or ``high``.

    Two agreeing sources and a Latin form give high, one source medium.  A doubt
    or a forced low can't be made good; a disagreement costs one level, and a
    confirmation lifts medium to high.
    """
    n = sum((s.cast("int") for s in sources[1:]), sources[0].cast("int"))
    base = F.when(doubt | forced_low | (n == 0), 0).when((n >= 2) & latin_form, 2).otherwise(1)
    level = F.when(base == 0, 0).when(disagrees, base - 1).when(confirms, 2).otherwise(base)
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def verdict(*, placeholder: Column, date_conflict: Column, homonym: Column, authority_id: Column, cluster_uri: Column, item: Column, latin_form: Column, disagrees: Column, confirms: Column, over_merged: Column, clash: Column) -> Column:
    """``confidence, matched, authority_id, cluster_uri, item, rejection, flags`` of one match.

    ``date_conflict`` is a reason or null.  A placeholder's name rejects the match
    with its identifiers; a conflict of dates, or a cluster of several people,
    takes the cluster's identifier only.
    """
    conflict = date_conflict.isNotNull()
    cluster = F.when(~conflict, cluster_uri)
    level = confidence([_given(authority_id), _given(cluster), _given(item)], _given(latin_form), conflict | homonym, disagrees=disagrees, confirms=confirms, forced_low=over_merged | clash | placeholder)
    tests = {"date_conflict": conflict, "short_name_homonym": homonym, "over_merge_detected": over_merged, "wikidata_disagrees": disagrees, "wikidata_confirms": confirms, "has_wikidata": _given(item), "cross_source_conflict": clash}
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return F.struct(
        level.alias("confidence"),
        (level == "high").cast("int").alias("matched"),
        F.when(~placeholder, authority_id).alias("authority_id"),
        F.when(~placeholder & ~over_merged, cluster).alias("cluster_uri"),
        item.alias("item"),
        F.when(placeholder, F.lit("placeholder_name")).otherwise(date_conflict).alias("rejection"),
        F.when(placeholder, F.array(F.lit("placeholder_name"))).otherwise(flags).alias("flags"),
    )
