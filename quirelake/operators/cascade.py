"""Names matched against four sources in turn; each source sees what the earlier ones left.

Mentions: ``mention, name, dates, role, kind, year`` (of the manuscript).  Sources
are snapshots: ``authority(id, name, dates, preferred_lat)``, ``clusters(viaf_id,
name, name_type, birth, death, preferred_lat)``, ``items(qid, name, viaf_id,
authority_id, kind)``; names are normalised alike beforehand.  Every step is an
equi-join of what is left with one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import items as item_guards
from quirelake.operators import matching, verdicts

#: Fixed value: items numbered from here on are likely duplicates; an older item of the same label goes before them.
LATE_ITEM = 138_000_000


def _with(found: DataFrame, key: str, **columns: Column) -> DataFrame:
    return found.groupBy(key).agg(*(c.alias(n) for n, c in columns.items()))


def by_authority(mentions: DataFrame, authority: DataFrame) -> DataFrame:
    """``authority_id`` and ``path``: the smallest id of the same name and dates, else of the same name (``strict``), else within two edits if one name alone is that near (``near``)."""
    rows = matching.lookup_with_dates(mentions, authority).withColumnRenamed("id", "authority_id").withColumn("path", F.when(F.col("authority_id").isNotNull(), "strict"))
    left = rows.where("authority_id is null").select("name").distinct()
    near = matching.within_distance(left, authority.select(F.col("name").alias("known"), "id"), "name", "known")
    closest = near.groupBy("name", "edits").agg(F.count_distinct("known").alias("names"), F.min("id").alias("near_id"), F.min("known").alias("suggestion"))
    best = closest.groupBy("name").agg(F.min_by(F.struct("names", "near_id", "suggestion"), "edits").alias("b")).where("b.names = 1").select("name", "b.near_id", "b.suggestion")
    both = rows.join(best, "name", "left")
    return both.withColumn("path", F.coalesce("path", F.when(F.col("near_id").isNotNull(), "near"))).withColumn("authority_id", F.coalesce("authority_id", "near_id")).drop("near_id")


def by_cluster(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """``viaf_id`` of mentions without an authority: the one cluster of people with that name, smallest id."""
    people = _with(clusters.where(F.coalesce(F.nullif("name_type", F.lit("")), F.lit("Personal")) == "Personal"), "name", cluster=F.min("viaf_id"))
    # A key of its own for each row that is done: nothing meets it, and such rows stay spread.
    asked = F.when(F.col("authority_id").isNull(), F.col("name")).otherwise(F.concat(F.lit("#"), F.col("mention").cast("string")))
    found = rows.withColumn("__asked", asked).join(people.withColumnRenamed("name", "__asked"), "__asked", "left").drop("__asked")
    return found.withColumnRenamed("cluster", "viaf_id").withColumn("path", F.coalesce("path", F.when(F.col("viaf_id").isNotNull(), "cluster")))


def by_item(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``qid`` by the only item of the cluster, else of the authority id; an older item of the name goes before a late one, and a missing cluster is filled from the item."""
    only = lambda key: matching.unique_or_abstain(items.where(F.col(key).isNotNull()), key, "qid").withColumnRenamed("qid", f"q_{key}")
    number = text.qid_number(F.col("qid"))
    labelled = items.where("kind = 'person'").groupBy("name").agg(F.min_by("qid", F.struct(number, "qid")).alias("q_label"))
    both = rows.join(only("viaf_id"), "viaf_id", "left").join(only("authority_id"), "authority_id", "left").join(labelled, "name", "left")
    qid = F.coalesce("q_viaf_id", "q_authority_id")
    older = qid.isNotNull() & (text.qid_number(qid) >= LATE_ITEM) & (text.qid_number(F.col("q_label")) < text.qid_number(qid))
    chosen = both.withColumn("qid", F.when(older, F.col("q_label")).otherwise(qid))
    filled = matching.unique_or_abstain(items.where("viaf_id is not null"), "qid", "viaf_id").withColumnRenamed("viaf_id", "item_viaf")
    return chosen.join(filled, "qid", "left").withColumn("viaf_id", F.when(F.col("qid").isNotNull(), F.coalesce("viaf_id", "item_viaf")).otherwise(F.col("viaf_id"))).drop("item_viaf")


def by_label(rows: DataFrame) -> DataFrame:
    """``qid`` by name for mentions that no source has found."""
    open_row = F.col("qid").isNull() & F.col("authority_id").isNull() & F.col("viaf_id").isNull()
    found = open_row & F.col("q_label").isNotNull()
    return rows.withColumn("path", F.when(found, "label").otherwise(F.col("path"))).withColumn("qid", F.when(found, F.col("q_label")).otherwise(F.col("qid")))


def match_people(mentions: DataFrame, authority: DataFrame, clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Each person mentioned with its identifiers, evidence and verdict.

    ``mention, name, path, authority_id, viaf_id, qid, confidence, flags,
    rejection, sources, source, source_count``.
    """
    steps = by_label(by_item(by_cluster(by_authority(mentions.where("kind = 'person'"), authority), clusters), items))
    # Evidence of each source, kept as a struct.
    of_authority = authority.groupBy("id").agg(F.min(F.struct("dates", "preferred_lat")).alias("a")).withColumnRenamed("id", "authority_id")
    of_cluster = clusters.groupBy("viaf_id").agg(F.min(F.struct("birth", "death", "preferred_lat")).alias("c"))
    held = items.where("viaf_id is not null").groupBy("viaf_id").agg(F.collect_set("name").alias("labels"), F.count_distinct("qid").alias("qids"), F.count_distinct("birth").alias("births"))
    rows = steps.join(of_authority, "authority_id", "left").join(of_cluster, "viaf_id", "left").join(held, "viaf_id", "left")
    years = F.filter(F.transform(F.split("a.dates", "[-–]"), lambda p: F.regexp_replace(F.trim(p), "[?]+$", "").try_cast("int")), lambda y: (y > 100) & (y < 2100))
    birth = F.coalesce("c.birth", F.get(years, 0))
    death = F.coalesce("c.death", F.when(F.size(years) > 1, F.element_at(years, -1)))
    false = lambda c: F.coalesce(c, F.lit(False))
    conflict = matching.date_conflict(birth, death, F.col("year"), F.col("role") == "scribe")
    homonym = item_guards.short_name_homonym(F.col("name"), F.coalesce("a.preferred_lat", "c.preferred_lat"), F.col("authority_id").isNotNull(), F.coalesce(F.col("dates") != "", F.lit(False)) | F.col("name").rlike(r"\d{3,4}"))
    has = F.col("viaf_id").isNotNull() & conflict.isNull() & ~false(homonym)
    labelled = F.coalesce(F.size("labels"), F.lit(0)) > 0
    confirms = has & labelled & F.array_contains("labels", F.col("name"))
    clash = F.col("authority_id").isNotNull() & F.col("viaf_id").isNotNull() & (F.col("q_authority_id") != F.col("q_viaf_id"))
    verdict = verdicts.verdict(
        placeholder=text.is_placeholder(F.col("name")), date_conflict=conflict, homonym=false(homonym), authority_id=F.col("authority_id"), cluster_uri=F.concat(F.lit("https://viaf.org/viaf/"), "viaf_id"), item=F.col("qid"),
        latin_form=F.coalesce("a.preferred_lat", "c.preferred_lat"), disagrees=false(has & labelled & ~F.array_contains("labels", F.col("name"))), confirms=false(confirms), over_merged=false(has & (F.col("qids") >= 2) & (F.col("births") >= 2)), clash=false(clash),
    )
    judged = rows.withColumn("v", verdict)
    sources = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in (("mazal", "v.authority_id"), ("viaf", "v.cluster_uri"), ("wikidata", "v.item")))))
    n = F.size("sources")
    return judged.withColumn("sources", sources).select(
        "mention", "name", "path", "v.authority_id", F.regexp_extract("v.cluster_uri", r"viaf/(\d+)$", 1).alias("viaf_id"), F.col("v.item").alias("qid"), "v.confidence", "v.flags", "v.rejection", "sources", F.when(n >= 2, "cross_source").when(n == 1, F.get("sources", 0)).otherwise("marc_only").alias("source"), n.alias("source_count"),
    )


def match_organisations(mentions: DataFrame, items: DataFrame) -> DataFrame:
    """Organisations, and people whose names are institutions', by the label of an organisation's item; always of medium confidence."""
    asked = mentions.where((F.col("kind") == "organization") | ((F.col("kind") == "person") & text.is_institution(F.col("name"))))
    known = items.where("kind = 'organization'").groupBy("name").agg(F.min_by("qid", F.struct(text.qid_number(F.col("qid")), "qid")).alias("qid"))
    return asked.join(known, "name").select("mention", "name", "qid", F.lit("medium").alias("confidence"), F.lit("wikidata").alias("source"))


def result_counts(matches: DataFrame) -> DataFrame:
    """Matches by source, and how many of them count as matched."""
    return matches.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("matched"), F.count_if(F.col("rejection").isNotNull()).alias("rejected"))


def places_by_record(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``record, places``: a map of each record's place names that the gazetteer ``name, uri`` knows."""
    known = gazetteer.groupBy("name").agg(F.min("uri").alias("uri"))
    found = mentions.select("record", "name").distinct().join(known, "name")
    return found.groupBy("record").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "uri")))).alias("places"))


def known_places(asked: DataFrame, existing: DataFrame, uri: str = "uri") -> DataFrame:
    """Those places that exist."""
    return asked.join(existing.select(uri).distinct(), uri, "left_semi")


def by_collection(asked: DataFrame, items: DataFrame) -> DataFrame:
    """``collection, shelfmark`` to the one item that has both; null if none or several have."""
    found = items.groupBy("collection", "shelfmark").agg(F.when(F.count_distinct("qid") == 1, F.min("qid")).alias("qid"))
    return asked.join(found, ["collection", "shelfmark"], "left")
