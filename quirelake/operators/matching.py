"""Authority matching: exact, tie-broken, fuzzy and interval joins, and how sure a match is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(names: DataFrame, index: DataFrame, name: str, key: str, found: str) -> DataFrame:
    """``names`` with the smallest id of the index row of the same ``key``; null if there is none."""
    best = index.groupBy(F.col(key).alias(name)).agg(F.min(found).alias(found))
    return names.join(best, name, "left")


def lookup_with_dates(names: DataFrame, index: DataFrame) -> DataFrame:
    """``name, dates`` to an id: the smallest with both equal, or else the smallest with the name."""
    exact = index.groupBy("name", "dates").agg(F.min("id").alias("exact_id"))
    by_name = index.groupBy("name").agg(F.min("id").alias("name_id"))
    joined = names.join(exact, ["name", "dates"], "left").join(by_name, "name", "left")
    return joined.withColumn("id", F.coalesce("exact_id", "name_id")).drop("exact_id", "name_id")


def unique_or_abstain(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's value, or null where it has more than one."""
    return df.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def last_write_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def _segments(text: Column, n: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the parts of a string of length n."""
    base = F.floor(n / parts).cast("int")
    long = (n - base * parts).cast("int")
    out = []
    for i in range(parts):
        short_before = F.greatest(F.lit(0), F.lit(i) - (parts - long))
        out.append((base * i + short_before, base + F.when(F.lit(i) >= parts - long, 1).otherwise(0)))
    return out


def _probes(text: Column, distance: int) -> Column:
    """``array<struct<n, i, part>>``: for each length that a near text can have, the places where one of its parts may stand unchanged.

    Part i (from 0) of ``distance + 1`` is the first that needs no edit of its own
    only if at most i edits lie before it and ``distance - i`` behind it, which
    bounds its shift from both ends.
    """
    probes = []
    for d in range(-distance, distance + 1):
        m = F.length(text) + d
        for i, (a, b) in enumerate(_segments(text, m, distance + 1)):
            for shift in range(max(-i, -d - (distance - i)), min(i, -d + (distance - i)) + 1):
                start = a + shift
                probes.append(F.when((m >= 0) & (start >= 0) & (start + b <= F.length(text)), F.struct(m.cast("int").alias("n"), F.lit(i).alias("i"), F.substring(text, (start + 1).cast("int"), b.cast("int")).alias("part"))))
    return F.array_distinct(F.array_compact(F.array(*probes)))


def within_distance(left: DataFrame, right: DataFrame, l_text: str, r_text: str, distance: int = 2) -> DataFrame:
    """All pairs of rows whose texts are at most ``distance`` edits apart, with ``edits``.

    Of ``distance + 1`` parts of the left text one must occur unchanged in the
    right text, a little shifted: an equi-join of distinct texts on the part finds
    the pairs, the edit distance confirms them, and rows are joined back.  No pair
    is lost, none is crossed.
    """
    a, b = F.col("__a"), F.col("__b")
    lefts = left.select(F.col(l_text).alias("__a")).where("__a is not null").distinct()
    rights = right.select(F.col(r_text).alias("__b")).where("__b is not null").distinct()
    keys = F.array(*(F.struct(F.length(a).cast("int").alias("n"), F.lit(i).alias("i"), F.substring(a, (s + 1).cast("int"), w.cast("int")).alias("part")) for i, (s, w) in enumerate(_segments(a, F.length(a), distance + 1))))
    met = lefts.select("__a", F.explode(F.array_distinct(keys)).alias("k")).join(rights.select("__b", F.explode(_probes(b, distance)).alias("k")), "k").select("__a", "__b").distinct()
    near = met.withColumn("edits", F.levenshtein(a, b, distance)).where("edits >= 0")
    whole = lambda df, text, key, name: df.select(F.col(text).alias(key), F.struct(*df.columns).alias(name))
    return whole(left, l_text, "__a", "l").join(near, "__a").join(whole(right, r_text, "__b", "r"), "__b").select("l.*", "r.*", "edits")


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def exact_then_fuzzy(names: DataFrame, index: DataFrame, distance: int = 2) -> DataFrame:
    """``name`` to ``id, edits``: equal names first; what is left goes to the nearest (ties: smallest id)."""
    exact = lookup(names.select("name").distinct(), index, "name", "name", "id")
    left = exact.where("id is null").select("name")
    near = within_distance(left, index.select(F.col("name").alias("known"), "id"), "name", "known", distance)
    best = near.groupBy("name").agg(F.min(F.struct("edits", "id")).alias("m")).select("name", F.col("m.id").alias("near_id"), "m.edits")
    return exact.join(best, "name", "left").select("name", F.coalesce("id", "near_id").alias("id"), F.when(F.col("id").isNotNull(), 0).otherwise(F.col("edits")).cast("int").alias("edits"))


def years_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = 5, fill: int = 120) -> Column:
    """Closed year ranges overlap within a tolerance; an open end is ``fill`` years off, a wholly unknown range overlaps all."""
    unknown = (a_start.isNull() & a_end.isNull()) | (b_start.isNull() & b_end.isNull())
    s1, e1 = F.coalesce(a_start, a_end - fill), F.coalesce(a_end, a_start + fill)
    s2, e2 = F.coalesce(b_start, b_end - fill), F.coalesce(b_end, b_start + fill)
    return unknown | ((s1 - tolerance <= e2) & (s2 - tolerance <= e1))


#: Each level's buckets are so many times as wide as those of the level below.
_WIDER = 8


def interval_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:  # noqa: E741
    """Pairs of rows whose closed intervals overlap, by an equi-join on buckets.

    Buckets have levels, of ``width`` at the lowest.  An interval belongs to the
    level at which it is no longer than a bucket, so that it touches two at most,
    however long it is; a pair meets at the higher of its two levels, in the bucket
    of the later start, and nowhere else.
    """
    size = lambda level: F.lit(width).cast("long") * F.pow(F.lit(_WIDER), level).cast("long")
    level = lambda c: F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col(c[1]) - F.col(c[0]), F.lit(width)) / width) / F.log(F.lit(float(_WIDER)))).cast("int"))
    rows = lambda df, c, tag: df.where(F.col(c[0]) <= F.col(c[1])).select(F.struct(*df.columns).alias(tag), F.col(c[0]).alias(f"{tag}s"), F.col(c[1]).alias(f"{tag}e"), level(c).alias(f"{tag}l"))
    a, b = rows(left, l, "a"), rows(right, r, "b")
    # The few levels that occur on the other side.
    present = {tag: sorted(x[0] for x in df.select(f"{tag}l").distinct().collect()) for tag, df in (("a", a), ("b", b))}

    def placed(df: DataFrame, tag: str, others: list[int]) -> DataFrame:
        own = F.col(f"{tag}l")
        levels = F.array_union(F.array(own), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own))
        at = lambda c, x: F.floor(F.col(c) / size(x)).cast("long")
        buckets = F.flatten(F.transform(levels, lambda x: F.transform(F.sequence(at(f"{tag}s", x), at(f"{tag}e", x)), lambda k: F.struct(x.alias("level"), k.alias("bucket")))))
        return df.withColumn("__k", F.explode(buckets))

    met = placed(a, "a", present["b"]).join(placed(b, "b", present["a"]), "__k")
    here = (F.col("__k.level") == F.greatest("al", "bl")) & (F.col("__k.bucket") == F.floor(F.greatest("as", "bs") / size(F.col("__k.level"))).cast("long"))
    return met.where((F.col("as") <= F.col("be")) & (F.col("bs") <= F.col("ae")) & here).select("a.*", "b.*")


def name_tokens(name: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of two characters or more that aren't stopwords."""
    words = F.filter(F.split(F.lower(name), r"(?U)[^\w]+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stopwords)).cast("array<string>")))


def token_overlap(a: Column, b: Column) -> Column:
    """Two tokens in common, or all of the shorter name's."""
    both = F.size(F.array_intersect(a, b))
    return (both >= 2) | ((both > 0) & (both == F.least(F.size(a), F.size(b))))


def overlapping_names(left: DataFrame, right: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``a, b``: names of both sides (``name``) that ``token_overlap`` holds alike.

    Two names with two tokens in common share one that isn't the commonest of
    either, so names meet on all but their commonest token; a name of one token
    meets all names that hold it.  Only names travel until pairs are known.
    """
    sides = {}
    for tag, df in (("a", left), ("b", right)):
        own = df.select(F.col("name").alias(tag)).where(F.col(tag).isNotNull()).distinct()
        sides[tag] = own.withColumn("w", name_tokens(F.col(tag), stopwords)).where(F.size("w") > 0)
    each = {tag: df.select(tag, F.size("w").alias("n"), F.explode("w").alias("token")) for tag, df in sides.items()}
    often = each["a"].select("token").unionAll(each["b"].select("token")).groupBy("token").agg(F.count("*").alias("often"))
    last = lambda tag: F.row_number().over(Window.partitionBy(tag).orderBy(F.desc("often"), "token"))
    ranked = {tag: df.join(often, "token").withColumn("r", last(tag)).select(tag, "n", "token", "r") for tag, df in each.items()}
    rarer = {tag: df.where("n >= 2 and r > 1").select(tag, "token") for tag, df in ranked.items()}
    alone = {tag: df.where("n = 1").select(tag, "token") for tag, df in each.items()}
    every = {tag: df.select(tag, "token") for tag, df in each.items()}
    met = rarer["a"].join(rarer["b"], "token").unionByName(alone["a"].join(every["b"], "token")).unionByName(every["a"].join(alone["b"], "token")).select("a", "b").distinct()
    both = met.join(sides["a"].withColumnRenamed("w", "wa"), "a").join(sides["b"].withColumnRenamed("w", "wb"), "b")
    return both.where(token_overlap(F.col("wa"), F.col("wb"))).select("a", "b")


def first_without_conflict(candidates: DataFrame, existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """The best-ranked candidate of each name whose existing identifiers don't contradict the proposed ones.

    ``candidates(name, qid, rank)``, ``existing(qid, prop, value)``,
    ``proposed(name, prop, value)``.  A property conflicts if the candidate has
    values for it and none is the proposed one.
    """
    asked = candidates.join(proposed, "name").join(existing.groupBy("qid", "prop").agg(F.collect_set("value").alias("has")), ["qid", "prop"])
    conflicts = asked.where(~F.array_contains("has", F.col("value"))).select("name", "qid").distinct()
    free = candidates.join(conflicts, ["name", "qid"], "left_anti")
    return free.groupBy("name").agg(F.min(F.struct("rank", "qid")).alias("m")).select("name", F.col("m.qid").alias("qid"))


def confidence(corroborated: Column, exact: Column, dated: Column, conflict: Column, low: Column) -> Column:
    """How sure a match is; ``low`` sticks, a conflict lowers, agreement of two kinds is needed for high."""
    agreed = corroborated.cast("int") + exact.cast("int") + dated.cast("int")
    return F.when(low | conflict, "low").when(agreed >= 2, "high").when(agreed == 1, "medium").otherwise("low")


def match_rate(df: DataFrame, by: str, matched: Column) -> DataFrame:
    n = F.count("*")
    return df.groupBy(by).agg(n.alias("n"), F.count_if(matched).alias("matched"), F.round(F.count_if(matched) / n, 6).alias("rate"))


def collapsed_clusters(df: DataFrame, record: str, cluster: str, name: str) -> DataFrame:
    """Clusters that gather two cleaned names or more within one record."""
    return df.where(F.col(cluster).isNotNull()).groupBy(record, cluster).agg(F.count_distinct(F.lower(F.trim(name))).alias("names")).where("names >= 2")


def colliding_clusters(df: DataFrame, cluster: str, name: str, identifier: str) -> DataFrame:
    """Clusters with two names or more and two ids or more."""
    return df.groupBy(cluster).agg(F.count_distinct(name).alias("names"), F.count_distinct(identifier).alias("ids")).where("names >= 2 and ids >= 2")


def over_merged(df: DataFrame, key: str, qid: str, *facts: str) -> DataFrame:
    """Keys with two items or more and two values or more of any fact."""
    found = df.groupBy(key).agg(F.count_distinct(qid).alias("qids"), *(F.count_distinct(f).alias(f"n_{f}") for f in facts))
    return found.where("qids >= 2 and (" + " or ".join(f"n_{f} >= 2" for f in facts) + ")")


def role_priority(df: DataFrame, record: str, name: str, role: str, position: str, order: list[str]) -> DataFrame:
    """One row for each name in a record: that of the first role in ``order`` (others last), then the first."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(role)), F.lit(0)), F.lit(len(order) + 1))
    keyed = df.withColumn("__name", F.lower(name)).withColumn("__rank", rank)
    return keep_first(keyed, [record, "__name"], F.col("__rank"), F.col(position)).drop("__name", "__rank")


def any_identifier(*columns: str) -> Column:
    return reduce(Column.__or__, (F.col(c).isNotNull() for c in columns))


def date_conflict(birth: Column, death: Column, written: Column, scribe: Column) -> Column:
    """Why a person's dates can't fit a manuscript's year; null if they can."""
    return (
        F.when(birth > written + 5, "born after")
        .when(scribe & (written - death > 80), "died long before")
        .when(birth.isNull() & (death > written + 120), "died long after")
    )


# Lookups in snapshots of remote indexes ------------------------------------------


def by_identifier(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """``asked(prop, value)`` with the one item that has the identifier; null if none or several have it."""
    found = claims.groupBy("prop", "value").agg(F.when(F.count_distinct("qid") == 1, F.min("qid")).alias("qid"))
    return asked.join(found, ["prop", "value"], "left")


def identifier_of(items: DataFrame, claims: DataFrame, prop: str, pattern: str) -> DataFrame:
    """``qid, value``: an item's only well-formed identifier of a kind, or null."""
    good = claims.where((F.col("prop") == prop) & F.col("value").rlike(pattern))
    return items.select("qid").join(unique_or_abstain(good, "qid", "value"), "qid", "left")


def by_label(names: DataFrame, labels: list[DataFrame], members: DataFrame, number) -> DataFrame:
    """``name`` to the member with the lowest number among all tables ``name, qid`` of labels and aliases."""
    known = reduce(DataFrame.unionByName, (t.select("name", "qid") for t in labels)).distinct()
    allowed = known.join(members.select("qid").distinct(), "qid", "left_semi")
    best = allowed.groupBy("name").agg(F.min_by("qid", F.struct(number(F.col("qid")), F.col("qid"))).alias("qid"))
    return names.join(best, "name", "left")


def first_found(asked: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Each key's ``qid`` from the first source that has one."""
    out = asked.select(key).distinct()
    for k, source in enumerate(sources):
        out = out.join(source.groupBy(key).agg(F.min("qid").alias(f"q{k}")), key, "left")
    return out.select(key, F.coalesce(*(f"q{k}" for k in range(len(sources)))).alias("qid"), F.coalesce(*(F.when(F.col(f"q{k}").isNotNull(), k) for k in range(len(sources)))).alias("source"))


def works_by_label(works: DataFrame, labels: DataFrame, authors: DataFrame) -> DataFrame:
    """``works(title, author)`` to an item of that label that has no other author: the smallest id."""
    found = works.join(labels.select(F.col("name").alias("title"), "qid"), "title").join(authors.groupBy("qid").agg(F.collect_set("author").alias("known")), "qid", "left")
    free = found.where(F.col("known").isNull() | F.col("author").isNull() | F.array_contains("known", F.col("author")))
    best = free.groupBy("title", "author").agg(F.min("qid").alias("qid"))
    return works.join(best, (works["title"] == best["title"]) & works["author"].eqNullSafe(best["author"]), "left").select(works["title"], works["author"], "qid")
