"""Registered queries over verdicts and labels of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import date_ranges as ranges
from quirelake.operators import labelling, verdicts
from quirelake.plans.graphs import plain, shared
from quirelake.plans.queries import query, table

# An order's key holds eleven facts about a match, one bit each.
_FACTS = ("placeholder", "conflict", "homonym", "authority", "cluster", "item", "latin", "disagrees", "confirms", "merged", "clash")
_BITS = ", ".join(f"(id & {1 << k}) <> 0 AS {name}" for k, name in enumerate(_FACTS))


@query(f"""WITH f AS (SELECT id, {_BITS} FROM (SELECT o_orderkey AS id FROM orders)), n AS (SELECT *, CAST(authority AS INT) + CAST(cluster AND NOT conflict AS INT) + CAST(item AS INT) AS n FROM f),
b AS (SELECT *, CASE WHEN placeholder OR clash OR merged OR conflict OR homonym OR n = 0 THEN 'low' WHEN n >= 2 AND latin THEN 'high' ELSE 'medium' END AS base FROM n),
c AS (SELECT *, CASE WHEN base = 'low' THEN 'low' WHEN disagrees AND base = 'high' THEN 'medium' WHEN disagrees THEN 'low' WHEN confirms THEN 'high' ELSE base END AS confidence FROM b)
SELECT id, confidence, CAST(confidence = 'high' AS INT) AS matched, CASE WHEN authority AND NOT placeholder THEN 'a' END AS authority_id, CASE WHEN cluster AND NOT (placeholder OR conflict OR merged) THEN 'c' END AS cluster_uri,
CASE WHEN placeholder THEN 'placeholder_name' WHEN conflict THEN 'too late' END AS rejection,
CASE WHEN placeholder THEN 'placeholder_name' ELSE concat_ws(',', CASE WHEN conflict THEN 'date_conflict' END, CASE WHEN homonym THEN 'short_name_homonym' END, CASE WHEN merged THEN 'over_merge_detected' END, CASE WHEN disagrees THEN 'wikidata_disagrees' END, CASE WHEN confirms THEN 'wikidata_confirms' END, CASE WHEN item THEN 'has_wikidata' END, CASE WHEN clash THEN 'cross_source_conflict' END) END AS flags FROM c""")
def match_verdicts(spark, d):
    bit = {name: F.col("id").bitwiseAND(1 << k) != 0 for k, name in enumerate(_FACTS)}
    text = lambda name, value: F.when(bit[name], F.lit(value))
    found = verdicts.verdict(
        placeholder=bit["placeholder"], date_conflict=text("conflict", "too late"), homonym=bit["homonym"], authority_id=text("authority", "a"), cluster_uri=text("cluster", "c"), item=text("item", "i"),
        latin_form=text("latin", "l"), disagrees=bit["disagrees"], confirms=bit["confirms"], over_merged=bit["merged"], clash=bit["clash"],
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select("id", found.alias("v")).select("id", "v.confidence", "v.matched", "v.authority_id", "v.cluster_uri", "v.rejection", F.array_join("v.flags", ",").alias("flags"))


_LATIN = "[A-Za-z''.-]+"
_BEFORE = lambda of, k: f"coalesce(list_sum(list_transform({of}[1:{k}], lambda x: length(x))), 0)"


@query(f"""WITH t AS (SELECT item_id, text, regexp_extract_all(text, '{_LATIN}') AS r, regexp_split_to_array(text, '{_LATIN}') AS g FROM benchmark), k AS (SELECT *, unnest(generate_series(1, len(r))) AS k FROM t),
s AS (SELECT item_id, length(text) AS n, CAST({_BEFORE("g", "k")} + {_BEFORE("r", "(k - 1)")} AS INT) AS start, CAST(length(r[k]) AS INT) AS size FROM k)
SELECT item_id, start, start + size AS "end" FROM s WHERE size >= 3 OR start + size = n""")
def latin_runs(spark, d):
    return labelling.latin_spans(table(spark, d, "benchmark"), "item_id", "text")


@query("WITH p AS (SELECT doc_id, text, substr(text, 21, 15) || CASE WHEN doc_id % 3 = 0 THEN '#absent#' ELSE '' END AS payload FROM documents), a AS (SELECT *, CASE WHEN payload <> '' AND strpos(text, payload) > 0 THEN CAST(strpos(text, payload) - 1 AS INT) END AS start FROM p) SELECT doc_id, start, CAST(start + length(payload) AS INT) AS \"end\" FROM a")
def rebased_offsets(spark, d):
    payload = F.concat(F.substring("text", 21, 15), F.when(F.col("doc_id") % 3 == 0, F.lit("#absent#")).otherwise(""))
    start, end = labelling.rebased(payload, F.col("text"))
    return table(spark, d, "documents").select("doc_id", start.cast("int").alias("start"), end.cast("int").alias("end"))


MARKERS = ["בן", "בר", "בת"]
_NAMED = """
SELECT id, pre || name || post AS text, CAST(length(pre) AS INT) AS start, CAST(length(pre || name) AS INT) AS stop FROM (
  SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'כתב ' ELSE o_orderpriority || ' ' END AS pre, CASE o_orderkey % 5 WHEN 0 THEN 'משה בן' WHEN 1 THEN 'דוד בר ' WHEN 2 THEN 'שרה בת' WHEN 3 THEN 'יצחק' ELSE 'בן' END AS name,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' יעקב הלוי בשנת' WHEN 2 THEN '  יעקב' WHEN 3 THEN ' ' || o_orderstatus WHEN 4 THEN ' רחל כתבה' WHEN 5 THEN 'יעקב' ELSE ' אברהם, כתב' END AS post FROM {orders})"""
NAMED = f"({plain(_NAMED)}) AS n"


@query(f"SELECT id, CASE WHEN regexp_matches(trim(substr(text, start + 1, stop - start)), '({'|'.join(MARKERS)})$') THEN stop + CAST(length(regexp_extract(substr(text, stop + 1, 50), '^\\s+[֐-׿]+(?:\\s+[֐-׿]+)?')) AS INT) ELSE stop END AS stop FROM {NAMED}")
def completed_names(spark, d):
    return shared(spark, d, _NAMED).select("id", labelling.completed_end(F.col("text"), F.col("start"), F.col("stop"), MARKERS).alias("stop"))


# Dates in all their forms ----------------------------------------------------------

#: Hebrew letters for some numbers, to write years and centuries with.
_HUNDREDS = "CASE h WHEN 0 THEN 'ש' WHEN 1 THEN 'ת' WHEN 2 THEN 'תק' ELSE 'תר' END"
_TENS = "CASE t WHEN 0 THEN 'כ' WHEN 1 THEN 'ל' WHEN 2 THEN 'ס' ELSE 'פ' END"
_UNITS = "CASE u WHEN 0 THEN 'א' WHEN 1 THEN 'ג' WHEN 2 THEN 'ד' ELSE 'ח' END"
_VALUE = "(CASE h WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN 500 ELSE 600 END + CASE t WHEN 0 THEN 20 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 80 END + CASE u WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 8 END)"
_WRITTEN = f"""
SELECT k, form, y, c, v, CASE form
  WHEN 0 THEN letters || ' לשטרות' WHEN 1 THEN letters || ' לשטרות (' || y || ')' WHEN 2 THEN 'א' || letters || ' לשטרות.' WHEN 3 THEN letters || ' (' || y || ').' WHEN 4 THEN y || ' בערך-' || (y + 40) WHEN 5 THEN 'בערך ' || y || '-' || (y + 40) WHEN 6 THEN 'נפטר ' || y || ' בערך' WHEN 7 THEN 'נפטר ' || y WHEN 8 THEN 'נולד ' || y
  WHEN 9 THEN y || ' בערך' WHEN 10 THEN 'פעל במאה ה-' || c || '-' || (c + 1) WHEN 11 THEN 'פעל במאה הי"' || unit WHEN 12 THEN 'פעיל ' || y WHEN 13 THEN 'המאה ה-' || c || '-' || (c + 1) WHEN 14 THEN 'המאה ה-' || c WHEN 15 THEN 'המאה הי"' || unit WHEN 16 THEN 'ca. ' || y || '-ca. ' || (y + 40) WHEN 17 THEN 'c.' || y
  WHEN 18 THEN c || 'th-' || (c + 1) || 'th cent.' WHEN 19 THEN c || 'th Cent' WHEN 20 THEN y || '?-' || (y + 40) WHEN 21 THEN '?' || y || '-?' || (y + 40) WHEN 22 THEN y || '- . ' WHEN 23 THEN y || ' – ' || (y + 40) WHEN 24 THEN '[' || y || ']' WHEN 25 THEN 'in ' || y || ', ' || (y + 3) WHEN 26 THEN letters WHEN 27 THEN '  ' WHEN 28 THEN 'no date' ELSE '-' || y END AS s
FROM (SELECT k, form, y, c, v, hundreds || tens || '"' || units AS letters, units AS unit FROM (
  SELECT k, form, y, c, {_VALUE} AS v, {_HUNDREDS} AS hundreds, {_TENS} AS tens, {_UNITS} AS units FROM (
    SELECT o_orderkey AS k, CAST(o_orderkey % 30 AS INT) AS form, CAST(1001 + o_orderkey % 900 AS INT) AS y, CAST(11 + o_orderkey % 8 AS INT) AS c, CAST(o_orderkey % 4 AS INT) AS h, CAST(o_custkey % 4 AS INT) AS t, CAST((o_orderkey + o_custkey) % 4 AS INT) AS u FROM {{orders}})))""".replace("{{", "{").replace("}}", "}")
_CENTURY = "(CASE right(s, 1) WHEN 'א' THEN 11 WHEN 'ג' THEN 13 WHEN 'ד' THEN 14 ELSE 18 END)"
_START = f"CASE WHEN form = 0 THEN v - 312 WHEN form = 2 THEN v + 1 + 1000 - 312 WHEN form IN (1, 3, 4, 5, 8, 9, 12, 16, 17, 20, 21, 22, 23, 24, 25, 29) THEN y WHEN form IN (10, 13, 14, 18, 19) THEN (c - 1) * 100 + 1 WHEN form IN (11, 15) THEN ({_CENTURY} - 1) * 100 + 1 WHEN form = 26 THEN v + 1240 END"
_END = f"CASE WHEN form IN (4, 5, 16, 20, 21, 23) THEN y + 40 WHEN form IN (6, 7) THEN y WHEN form IN (8, 22) THEN NULL WHEN form IN (10, 13, 18) THEN (c + 1) * 100 WHEN form IN (14, 19) THEN c * 100 WHEN form IN (11, 15) THEN {_CENTURY} * 100 WHEN form IN (6, 27, 28) THEN NULL ELSE {_START} END"
_SOURCE = "CASE WHEN form <= 2 THEN 'seleucid_era' WHEN form = 3 THEN 'publication_hebrew_year' WHEN form <= 9 THEN 'hebrew_approximate' WHEN form <= 12 THEN 'hebrew_active' WHEN form <= 15 THEN 'hebrew_century' WHEN form <= 17 THEN 'english_approximate' WHEN form <= 19 THEN 'english_century' WHEN form <= 21 THEN 'gregorian_uncertain_range' WHEN form = 22 THEN 'gregorian_open' WHEN form = 23 THEN 'gregorian_range' WHEN form IN (24, 25, 29) THEN 'gregorian_single' WHEN form = 26 THEN 'standalone_hebrew_year' ELSE '' END"
_RANGED = f"(SELECT *, CAST({_START} AS INT) AS first, CAST({_END} AS INT) AS last, {_SOURCE} AS source, form IN (0, 2, 4, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 24, 26) AS approximate FROM ({plain(_WRITTEN)}))"


# Letters of the Seleucid era alone give years before 400; those up to 100 aren't counted as years, so that other forms may read them.
@query(f"SELECT k, s, first AS year_start, last AS year_end, approximate, source FROM {_RANGED} WHERE form <> 0 OR first > 100")
def date_ranges(spark, d):
    found = shared(spark, d, _WRITTEN).withColumn("r", ranges.date_range(F.col("s")))
    return found.where("form <> 0 or v - 312 > 100").select("k", "s", F.col("r.start").alias("year_start"), F.col("r.end").alias("year_end"), "r.approximate", "r.source")


@query(f"""SELECT k, CASE WHEN source NOT IN ('hebrew_century', 'english_century', 'hebrew_active') AND first IS DISTINCT FROM last THEN first END AS birth, CASE WHEN source NOT IN ('hebrew_century', 'english_century', 'hebrew_active') AND first IS DISTINCT FROM last THEN last END AS death,
CASE WHEN source IN ('hebrew_century', 'english_century', 'hebrew_active') OR first = last THEN CAST((first + last) // 2 AS INT) END AS active FROM {_RANGED} WHERE form <> 0 OR first > 100""")
def person_years(spark, d):
    found = shared(spark, d, _WRITTEN).where("form <> 0 or v - 312 > 100")
    return found.select("k", ranges.person_years(F.col("s")).alias("r")).select("k", "r.*")


@query(f"""SELECT k, CASE WHEN k % 3 = 0 THEN y WHEN form IN (4, 5, 6, 7, 8, 9, 12, 16, 17, 20, 21, 22, 23, 24, 25, 29, 1, 3) THEN y END AS manuscript_year, CASE WHEN k % 3 = 0 THEN y WHEN k % 5 = 0 THEN c WHEN form IN (4, 5, 6, 7, 8, 9, 12, 16, 20, 21, 22, 23, 24, 25, 29, 1, 3, 17) THEN y END AS inception,
CASE WHEN form IN (14, 15) THEN NULL WHEN k % 2 = 0 THEN c || 'th century' END AS century FROM ({plain(_WRITTEN)})""")
def manuscript_years(spark, d):
    rows = shared(spark, d, _WRITTEN)
    year, k = F.when(F.col("k") % 3 == 0, F.col("y")), F.col("k")
    text = F.when(F.col("form").isin(14, 15), F.lit("")).when(k % 2 == 0, F.concat(F.lit("copied "), "c", F.lit("TH Century")))
    return rows.select("k", ranges.manuscript_year(year, F.col("s")).alias("manuscript_year"), ranges.inception_year(year, F.when(k % 5 == 0, F.col("c")), F.lit(None).cast("int"), F.col("s")).alias("inception"), ranges.century_text(text).alias("century"))
