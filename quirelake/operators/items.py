"""Items with statements: lint rules, guards of matches, statement parts, claims as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import escaped
from quirelake.operators import quality

#: Words and labels that the rules look for.
ANONYMOUS_LABELS = ("unknown", "anonymous", "anon", "anon.", "לא ידוע", "אלמוני", "אלמונית", "פלוני", "משומד", "שאלוניקי", "?", "-", "—", "[?]")
INSTITUTION_WORDS = (
    "library", "libraries", "museum", "archive", "archives", "collection", "foundation", "institute", "institution", "society", "academy", "school", "college", "university", "seminary", "theological", "yeshiva", "beit", "bet",
    "ספרייה", "ספריה", "ספריית", "מוסד", "מכון", "חברה", "אקדמיה", "ישיבה", "בית", "אוסף", "מועדון", "מוזיאון", "מוזיאוני", "ארכיון", "ארכיוני", "bodleian", "palatina", "biblioteca",
)
PLACEHOLDER_LABELS = ("קובץ", "קובץ.", "קבץ", "קבץ.", "קובץ בקבלה", "קובץ בקבלה.", "קובץ מדרשים", "קובץ מדרשים.", "כתב יד", "כתב יד.", "מחזור", "סידור", "אוסף")
IDENTIFIERS = ("P214", "P8189", "P244", "P227", "P213", "P268")
HEBREW, LATIN = "[֐-׿]", "[A-Za-z]"


def _latin_only(text: Column) -> Column:
    return text.rlike(LATIN) & ~text.rlike(HEBREW)


def lint_rules() -> list[tuple[str, str, Column, str]]:
    """``severity, code, condition, message`` over items with their claims gathered by ``with_claims``."""
    label = F.trim(F.coalesce("label", F.lit("")))
    person, some = F.col("entity_type") == "person", label != ""
    lower = F.lower(label)
    given = F.trim(F.regexp_extract(label, r"^[^,]*,(.*)$", 1))
    known = F.coalesce(F.col("existing_qid") != "", F.lit(False))
    without_id = person & ~known & ~F.exists("claims", lambda c: c["property"].isin(*IDENTIFIERS) & (c["value"] != ""))
    names = F.filter("claims", lambda c: (c["property"] == "P1559") & (F.coalesce(c["language"], F.lit("")) != ""))
    single = label.rlike(LATIN) & ~label.rlike(HEBREW) & ~label.rlike("[ ,]") & (F.length(label) < 15)
    has = lambda p: F.exists("claims", lambda c: (c["property"] == p) & (c["value"] != ""))
    return [
        ("error", "EMPTY_LABEL", ~some, "no label in any language"),
        ("error", "ANONYMOUS_PERSON", person & lower.isin(*ANONYMOUS_LABELS), "a person's label that identifies nobody"),
        ("error", "KOVETZ_PLACEHOLDER", (F.col("entity_type") == "manuscript") & label.isin(*PLACEHOLDER_LABELS), "a catalogue's placeholder as label"),
        ("error", "TRAILING_PUNCTUATION", label.rlike("[,;:.]$"), "the label ends with a sign"),
        ("error", "INVERTED_NAME_LABEL", person & label.rlike(r"^[^,]*[^, ][^,]*,") & (given != "") & ~given.rlike("^[0-9]"), "surname before given name"),
        ("error", "INSTITUTION_AS_PERSON", person & lower.rlike("|".join(INSTITUTION_WORDS)), "an institution's word in a person's label"),
        ("error", "P3959_ON_HUMAN", person & has("P3959"), "a bibliographic identifier on a person"),
        ("error", "P8189_BAD_PREFIX", F.exists("claims", lambda c: (c["property"] == "P8189") & (c["value"] != "") & ~c["value"].startswith("9870")), "an authority identifier without its prefix"),
        ("warning", "VIAF_ON_NON_PERSON", ~person & has("P214"), "a cluster of names on another kind of item"),
        ("error", "P1559_LATIN_AS_HE", F.exists(names, lambda c: (c["language"] == "he") & _latin_only(c["value"])), "a Latin name tagged as Hebrew"),
        ("error", "MULTIPLE_P1559_SAME_LANG", F.size(F.array_distinct(F.transform(names, lambda c: c["language"]))) < F.size(names), "two native names in one language"),
        ("error", "NO_IDENTIFIER", without_id, "a person without an identifier"),
        ("error", "HE_LABEL_IS_LATIN", _latin_only(F.coalesce("he_label", F.lit(""))), "a Latin text in the Hebrew label"),
        ("error", "AMBIGUOUS_SINGLE_NAME", without_id & single, "one short name without an identifier"),
    ]


def with_claims(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Each item with its claims ``property, value, language`` (one item's, so a bounded list)."""
    own = claims.groupBy("local_id").agg(F.collect_list(F.struct("property", F.coalesce("value", F.lit("")).alias("value"), "language")).alias("claims"))
    none = F.array().cast("array<struct<property:string,value:string,language:string>>")
    return items.join(own, "local_id", "left").withColumn("claims", F.coalesce("claims", none))


def lint_items(items: DataFrame, claims: DataFrame) -> DataFrame:
    """``severity, code, message, ref``: each rule that an item breaks."""
    return quality.lint(with_claims(items, claims), "local_id", lint_rules())


def guard_tokens(name: Column) -> Column:
    """A name's words without the signs at its end."""
    clean = F.trim(F.regexp_replace(F.trim(name), "[,;:.]+$", ""))
    return F.filter(F.split(clean, r"[\s,]+"), lambda t: t != "")


def short_name_homonym(name: Column, found: Column, in_authority: Column, has_dates: Column) -> Column:
    """One word met a name of three or more, and nothing else speaks for the match."""
    rich = F.coalesce(F.size(guard_tokens(found)) > 2, F.lit(False))
    return (F.size(guard_tokens(name)) == 1) & rich & ~in_authority & ~has_dates


def place_confidence(*sources: Column) -> Column:
    n = sum((s.cast("int") for s in sources[1:]), sources[0].cast("int"))
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def snak(prop: Column, kind: Column, value: Column, precision: Column, reference: bool = False) -> Column:
    """A qualifier, or a reference (whose property starts with S), as statement text."""
    name = F.replace(prop, F.lit("P"), F.lit("S")) if reference else prop
    time = F.concat(value, F.lit("/"), F.coalesce(precision, F.lit(11)).cast("string"))
    quoted = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    return F.concat(name, F.lit("\t"), F.when(kind == "item", value).when(kind == "time", time).otherwise(quoted))


def index_statistics(authorities: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """``kind, n``: authorities in all (``total``) and by type, and their name variants (``variants``)."""
    total = authorities.groupBy(kind).agg(F.count("*").alias("n"))
    every = authorities.agg(F.count("*").alias("n")).select(F.lit("total").alias(kind), "n")
    return total.unionByName(every).unionByName(names.agg(F.count("*").alias("n")).select(F.lit("variants").alias(kind), "n"))


def last_binding(keys: DataFrame, bindings: DataFrame, key: str, order: str) -> DataFrame:
    """Many keys looked up at once: of several bindings of a key the last wins; keys without one stay."""
    return keys.join(bindings.groupBy(key).agg(F.max_by("value", order).alias("value")), key, "left")


def claims_by_property(claims: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """One row an item, one column a property: the smallest value of each."""
    return claims.where(F.col("property").isin(properties)).groupBy(key).pivot("property", properties).agg(F.min("value"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a keyed digest: the same rows on any cluster."""
    return df.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("draw", key).limit(n)


def aligned(frames: list[DataFrame], fill: str = "") -> DataFrame:
    """Frames one after another; columns that one lacks, and nulls of text columns, are filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(fill)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def as_csv(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one line of comma-separated text, quoted where it holds a comma, a quote or a line feed."""
    def field(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *map(field, columns)).alias("value"))
