"""People and works named in many records, each resolved to one item: the first record that names it decides.

Mentions are rows ``record, seq, pos, name, viaf_uri, authority_id, role``; ``seq``
orders records and ``pos`` mentions inside one.  A record's own entries about
people are rows ``record, list, pos, name, viaf_uri, authority_id, birth, death,
dates, name_type`` and further identifiers; ``list`` orders the lists in which a
name is looked up (``MATCHES`` is that of the authority matches).

Mentions meet by key, with partial aggregates, so that a name in a third of all
records costs one row a task; entries meet them by record and id, or by record and
the first five characters of the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text

# Names that identify nobody, names of roles and towns alone, occupations and their words.
ANONYMOUS = ("unknown", "anonymous", "anon", "לא ידוע", "לא נודע", "סופר לא ידוע", "מחבר לא ידוע", "author unknown", "scribe unknown", "unknown author", "unknown scribe")
ROLE_NAMES = ("משומד", "משומדת", "מומר", "מומרת", "הגר", "כוהן", "הכוהן", "לוי", "הלוי", "הסופר", "הנביא", "הרב", "הרופא", "הדיין", "הנגיד", "הפרנס")
TOWN_NAMES = ("שאלוניקי", "סלוניקי", "קושטא", "קושטנדינא", "אשכנז", "ספרד", "ונציה", "פאס", "תוניס", "מצרים", "בגדאד", "פראג", "קרקא", "ויניציאה", "ליוורנו", "אמשטרדם")
ROLE_LABELS = {"author": "author", "scribe": "scribe", "transcriber": "scribe", "owner": "owner", "translator": "translator", "editor": "editor", "commentator": "commentator", "patron": "patron"}
#: The list of authority matches among a record's entries, the characters by which names meet, and identifiers that an entry may add.
MATCHES, PREFIX = 2, 5
MORE_IDENTIFIERS = ("gnd_id", "lc_id", "isni", "bnf_id")
#: Descriptions are cut here.
MOST = 250


def person_key(name: Column, viaf_uri: Column, authority_id: Column) -> Column:
    """By authority id, else by cluster, else by the name's words."""
    given = lambda c: F.nullif(c, F.lit(""))
    by_name = F.concat(F.lit("name:"), F.regexp_replace(F.lower(F.trim(name)), r"(?U)[,.\s]+", "_"))
    return F.coalesce(F.concat(F.lit("mazal:"), given(authority_id)), F.concat(F.lit("viaf:"), text.viaf_id(viaf_uri)), by_name)


def work_key(title: Column) -> Column:
    return F.concat(F.lit("work:"), F.regexp_replace(F.lower(F.trim(title)), "(?U)[,.\\s\"׳״]+", "_"))


def clean_name(name: Column) -> Column:
    """Without quotes around it and signs at its end."""
    bare = F.trim(F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", ""))
    return F.regexp_replace(bare, "[,;:.]+$", "")


def is_role_name(name: Column) -> Column:
    """The whole name is a role's or a town's."""
    return F.trim(name).isin(*ROLE_NAMES, *TOWN_NAMES)


def is_placeholder_title(title: Column) -> Column:
    """A catalogue's word for a compilation, alone or with a short topic."""
    bare = F.regexp_replace(F.trim(title), "[,;:.]+$", "")
    return F.coalesce(bare.isin("קובץ", "קבץ") | (bare.rlike("^(?:קובץ|קבץ) ") & (F.length(bare) <= 25)), F.lit(False))


def person_description(role: Column, dates: Column, organisation: Column) -> Column:
    label = F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])[F.lower(F.trim(F.coalesce(role, F.lit(""))))]
    when = F.nullif(F.regexp_replace(text.ascii_only(F.coalesce(dates, F.lit(""))), "^[ .,;:-]+|[ .,;:-]+$", ""), F.lit(""))
    bracketed = lambda what: F.concat(what, F.lit(" ("), when, F.lit(")"))
    about = F.when(organisation, F.coalesce(bracketed(F.lit("organization")), F.lit("organization associated with Hebrew manuscripts"))).otherwise(
        F.coalesce(bracketed(label), F.concat(F.lit("Hebrew manuscript "), label), bracketed(F.lit("person")), F.lit("person associated with Hebrew manuscripts"))
    )
    return text.cut(about, MOST)


def work_description(author: Column, century: Column) -> Column:
    name = F.nullif(F.regexp_replace(F.trim(F.coalesce(author, F.lit(""))), "[,;:]+$", ""), F.lit(""))
    return text.cut(F.concat_ws(" ", F.lit("Hebrew manuscript work"), F.concat(F.lit("by "), name), F.concat(F.lit("("), F.nullif(century, F.lit("")), F.lit(")"))), MOST)


def _first_mentions(mentions: DataFrame, key: Column, *columns: str) -> DataFrame:
    """One row a key: the first mention, and how many there are."""
    first = F.min_by(F.struct("record", "seq", "pos", *columns), F.struct("seq", "pos", *columns)).alias("f")
    return mentions.withColumn("key", key).groupBy("key").agg(first, F.count("*").alias("mentions")).select("key", "f.*", "mentions")


def _has_year(entry: Column) -> Column:
    return entry["birth"].isNotNull() | entry["death"].isNotNull()


def _years(dates: Column) -> tuple[Column, Column]:
    """The first plausible number of a range, and the last one after it."""
    numbers = F.filter(F.transform(F.split(F.trim(dates), "[-–]"), lambda p: F.when(F.trim(p).rlike("^[0-9]+$"), F.trim(p).try_cast("int"))), lambda y: (y > 100) & (y < 2100))
    return F.get(numbers, 0), F.when(F.size(numbers) > 1, F.element_at(numbers, -1))


def persons(mentions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items, and what becomes of every key.

    Items: ``local_id, label, label_lang, description, organisation, birth, death,
    role, viaf_id, authority_id, record`` (the first one), ``mentions``.  Keys:
    ``key, reason``, null where an item was made; a rejected key's mentions
    stay names.  Gates, in order: a name of under two characters, one that
    identifies nobody, a role or town alone, and no identifier.

    Dates come from the record's entry with the same id; if that has no year, from
    the first entry of each list, in order, that shares the name's first five
    characters, until one has a year; and else from the digits of its date text.
    """
    own = _first_mentions(mentions, person_key(F.col("name"), F.col("viaf_uri"), F.col("authority_id")), "name", "viaf_uri", "authority_id", "role")
    same = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"e_{c}"))
    facts = F.struct("birth", "death", "dates", "name_type", *MORE_IDENTIFIERS)
    matched = own.select("key", "record", "viaf_uri", "authority_id").join(entries.where(F.col("list") == MATCHES).withColumnsRenamed({"viaf_uri": "e_viaf_uri", "authority_id": "e_authority_id", "pos": "e_pos", "name": "e_name"}), "record")
    by_id = matched.where(F.coalesce(same("authority_id"), F.lit(False)) | F.coalesce(same("viaf_uri"), F.lit(False))).groupBy("key").agg(F.min_by(facts, "e_pos").alias("by_id"))
    prefix = lambda c: F.left(c, F.lit(PREFIX))
    near = own.select("key", "record", prefix(F.col("name")).alias("prefix")).join(entries.where("name != ''").select("record", prefix(F.col("name")).alias("prefix"), "list", F.col("pos").alias("e_pos"), F.struct("birth", "death", "dates").alias("fact")), ["record", "prefix"])
    in_list = lambda k: F.min_by(F.when(F.col("list") == k, F.col("fact")), F.when(F.col("list") == k, F.col("e_pos"))).alias(f"l{k}")
    by_prefix = near.groupBy("key").agg(*(in_list(k) for k in range(MATCHES + 1)))
    rows = own.join(by_id, "key", "left").join(by_prefix, "key", "left")
    lists = [F.col(f"l{k}") for k in range(MATCHES + 1)]
    fallback = F.coalesce(*(F.when(_has_year(e), e) for e in lists), *reversed(lists))
    exact = F.struct("by_id.birth", "by_id.death", "by_id.dates")
    fact = F.when(F.coalesce(_has_year(F.col("by_id")), F.lit(False)), exact).otherwise(F.coalesce(fallback, exact))
    first, last = _years(F.col("fact.dates"))
    none = ~_has_year(F.col("fact"))
    name = clean_name(F.col("name"))
    identified = F.greatest(*(F.coalesce(c != "", F.lit(False)) for c in (F.col("viaf_uri"), F.col("authority_id"), *(F.col(f"by_id.{c}") for c in MORE_IDENTIFIERS))))
    reason = F.when(F.length(name) < 2, "short").when(F.regexp_replace(F.lower(F.trim(name)), "[.,;:]+$", "").isin(*ANONYMOUS), "anonymous").when(is_role_name(name), "role or town").when(~identified, "no identifier")
    organisation = text.is_institution(F.col("name"))
    known = rows.withColumn("fact", fact).withColumn("clean", name).withColumn("organisation", organisation).withColumn("reason", F.when(name.isNull(), "short").otherwise(reason))
    person = ~F.col("organisation")
    items = known.where("reason is null").select(
        F.col("key").alias("local_id"), text.natural_order(F.col("clean")).alias("label"), F.when(text.has_hebrew(F.col("clean")), "he").otherwise("en").alias("label_lang"), person_description(F.col("role"), F.col("fact.dates"), F.col("organisation")).alias("description"), "organisation",
        F.when(person, F.when(none, first).otherwise(F.col("fact.birth"))).alias("birth"), F.when(person, F.when(none, last).otherwise(F.col("fact.death"))).alias("death"), "role",
        F.when(person & (F.coalesce(F.nullif(F.col("by_id.name_type"), F.lit("")), F.lit("Personal")) == "Personal"), text.viaf_id(F.col("viaf_uri"))).alias("viaf_id"), F.nullif(F.col("authority_id"), F.lit("")).alias("authority_id"), "record", "seq", "pos", "mentions",
    )
    return items, known.select("key", "reason")


def works(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """``local_id, title, label_lang, description, author, record, mentions`` of ``record, seq, pos, title, author_name, century``.

    A work's author is an item only if one was made by name alone, by a mention
    that comes before the work's.
    """
    title = F.regexp_replace(F.trim("title"), r"[ .,;:/-]+$", "")
    rows = mentions.withColumn("title", title).where(F.coalesce(F.col("title") != "", F.lit(False)))
    own = _first_mentions(rows, work_key(F.col("title")), "title", "author_name", "century")
    no = F.lit(None).cast("string")
    named = people.where(F.startswith("local_id", F.lit("name:"))).select(F.col("local_id").alias("author"), F.struct("seq", "pos").alias("made"))
    asked = own.withColumn("author", F.when(F.trim("author_name") != "", person_key(F.col("author_name"), no, no)))
    both = asked.join(named, "author", "left")
    return both.select(
        F.col("key").alias("local_id"), "title", F.when(text.has_hebrew(F.col("title")), "he").otherwise("en").alias("label_lang"), work_description(F.col("author_name"), F.col("century")).alias("description"),
        F.when(F.col("made") <= F.struct("seq", "pos"), F.col("author")).alias("author"), "record", "mentions",
    )


def mention_items(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """Each mention with its item's ``local_id``, or with its name to stand as a string."""
    keyed = mentions.withColumn("key", person_key(F.col("name"), F.col("viaf_uri"), F.col("authority_id")))
    found = keyed.join(keys, "key", "left")
    return found.select("record", "seq", "pos", "role", F.when(F.col("reason").isNull(), F.col("key")).alias("local_id"), F.when(F.col("reason").isNotNull(), clean_name(F.col("name"))).alias("name_string"), "reason")


def all_items(people: DataFrame, titles: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """``rank, entity_type, local_id, label``: works, then people, then manuscripts, the order in which they can refer to each other."""
    part = lambda df, rank, kind, key, label: df.select(F.lit(rank).alias("rank"), F.lit(kind).alias("entity_type"), F.col(key).alias("local_id"), F.col(label).alias("label"))
    return part(titles, 0, "work", "local_id", "title").unionAll(part(people, 1, "person", "local_id", "label")).unionAll(part(manuscripts, 2, "manuscript", "local_id", "label"))
