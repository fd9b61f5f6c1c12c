"""Registered queries over matches: four sources in turn, verdicts, biographical snapshots.

Inputs are written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import biodata, cascade
from quirelake.plans.graphs import plain, shared
from quirelake.plans.queries import query, table
from quirelake.sources.tables import dealt


_NAMED = "SELECT c_custkey AS k, p_name || ' ' || lower(c_mktsegment) AS name FROM {customer} JOIN {part} ON p_partkey = c_custkey % 97"
MENTIONS = f"""
SELECT k AS mention, CASE WHEN k % 29 = 0 THEN 'unknown' WHEN k % 31 = 0 THEN 'library of ' || name WHEN k % 37 = 0 THEN substr(name, 1, 3) ELSE name END AS name, CASE WHEN k % 4 = 0 THEN (1000 + k % 400) || '-' || (1050 + k % 400) END AS dates,
  CASE WHEN k % 5 = 0 THEN 'scribe' ELSE 'author' END AS role, CASE WHEN k % 10 = 0 THEN 'organization' WHEN k % 11 = 0 THEN 'meeting' ELSE 'person' END AS kind, CAST(900 + k % 700 AS INT) AS year FROM ({_NAMED})"""
AUTHORITY = f"""
SELECT 'a' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN substr(name, 1, length(name) - 2) || 'qy' ELSE name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN (1000 + s_suppkey % 400) || '-' || (1050 + s_suppkey % 400) END AS dates,
  CASE WHEN s_suppkey % 5 <> 0 THEN upper(name) || ' the elder' END AS preferred_lat FROM {{supplier}} JOIN ({_NAMED}) ON k = s_suppkey""".replace("{{", "{").replace("}}", "}")
CLUSTERS = f"""
SELECT '1000' || (10000 + k) AS viaf_id, name, CASE WHEN k % 13 = 0 THEN 'Geographic' WHEN k % 2 = 0 THEN 'Personal' END AS name_type, CAST(CASE WHEN k % 5 <> 2 THEN 1000 + k % 600 END AS INT) AS birth, CAST(1060 + k % 600 AS INT) AS death, CASE WHEN k % 7 < 3 THEN upper(name) END AS preferred_lat
FROM ({_NAMED}) WHERE k % 3 = 1"""
ITEMS = f"""
SELECT 'Q' || (CASE WHEN k % 8 = 0 THEN 138000000 + k ELSE 1000 + k END) AS qid, CASE WHEN k % 14 = 0 THEN name || ' x' WHEN k % 20 = 0 THEN 'library of ' || name ELSE name END AS name, CASE WHEN k % 3 = 1 THEN '1000' || (10000 + k) END AS viaf_id, CASE WHEN k % 6 = 0 OR k % 10 = 4 THEN 'a' || k END AS authority_id,
  CASE WHEN k % 20 = 0 THEN 'organization' ELSE 'person' END AS kind, CAST(1000 + k % 600 AS INT) AS birth FROM ({_NAMED}) WHERE k % 2 = 0
UNION ALL SELECT 'Q' || (5000000 + k), name || ' y', '1000' || (10000 + k), NULL, 'person', CAST(1010 + k % 600 AS INT) FROM ({_NAMED}) WHERE k % 9 = 1"""

_VIEWS = f"mentions AS MATERIALIZED ({plain(MENTIONS)}), authority AS MATERIALIZED ({plain(AUTHORITY)}), clusters AS MATERIALIZED ({plain(CLUSTERS)}), items AS MATERIALIZED ({plain(ITEMS)})"
_NUMBER = "CAST(substr(qid, 2) AS BIGINT)"
_MATCHED = f"""{_VIEWS},
exact AS (SELECT name, dates, min(id) AS id FROM authority GROUP BY ALL), named AS (SELECT name, min(id) AS id FROM authority GROUP BY 1),
s1 AS (SELECT m.*, coalesce(e.id, n.id) AS strict_id FROM mentions m LEFT JOIN exact e ON e.name = m.name AND e.dates = m.dates LEFT JOIN named n ON n.name = m.name WHERE kind = 'person'),
near AS (SELECT l.name, levenshtein(l.name, a.name) AS edits, count(DISTINCT a.name) AS names, min(a.id) AS id FROM (SELECT DISTINCT name FROM s1 WHERE strict_id IS NULL) l JOIN authority a ON levenshtein(l.name, a.name) <= 2 GROUP BY ALL),
best AS (SELECT name, id FROM near QUALIFY row_number() OVER (PARTITION BY name ORDER BY edits) = 1 AND names = 1),
s2 AS (SELECT s1.*, coalesce(strict_id, best.id) AS authority_id, CASE WHEN strict_id IS NOT NULL THEN 'strict' WHEN best.id IS NOT NULL THEN 'near' END AS p2 FROM s1 LEFT JOIN best USING (name)),
people AS (SELECT name, min(viaf_id) AS cluster FROM clusters WHERE coalesce(name_type, 'Personal') = 'Personal' GROUP BY 1),
s3 AS (SELECT s2.*, CASE WHEN authority_id IS NULL THEN cluster END AS v3, CASE WHEN authority_id IS NULL AND cluster IS NOT NULL THEN 'cluster' ELSE p2 END AS p3 FROM s2 LEFT JOIN people USING (name)),
of_viaf AS (SELECT viaf_id, CASE WHEN count(DISTINCT qid) = 1 THEN min(qid) END AS qid FROM items WHERE viaf_id IS NOT NULL GROUP BY 1), of_auth AS (SELECT authority_id, CASE WHEN count(DISTINCT qid) = 1 THEN min(qid) END AS qid FROM items WHERE authority_id IS NOT NULL GROUP BY 1),
of_name AS (SELECT name, arg_min(qid, {_NUMBER}) AS qid FROM items WHERE kind = 'person' GROUP BY 1), of_qid AS (SELECT qid, CASE WHEN count(DISTINCT viaf_id) = 1 THEN min(viaf_id) END AS viaf FROM items WHERE viaf_id IS NOT NULL GROUP BY 1),
s4 AS (SELECT s3.*, v.qid AS qv, a.qid AS qa, n.qid AS qn, coalesce(v.qid, a.qid) AS q0 FROM s3 LEFT JOIN of_viaf v ON v.viaf_id = v3 LEFT JOIN of_auth a ON a.authority_id = s3.authority_id LEFT JOIN of_name n ON n.name = s3.name),
s5 AS (SELECT *, CASE WHEN CAST(substr(q0, 2) AS BIGINT) >= 138000000 AND CAST(substr(qn, 2) AS BIGINT) < CAST(substr(q0, 2) AS BIGINT) THEN qn ELSE q0 END AS q5 FROM s4),
s6 AS (SELECT s5.*, CASE WHEN q5 IS NOT NULL THEN coalesce(v3, viaf) ELSE v3 END AS viaf_id FROM s5 LEFT JOIN of_qid ON of_qid.qid = q5),
s7 AS (SELECT *, CASE WHEN q5 IS NULL AND authority_id IS NULL AND viaf_id IS NULL THEN qn ELSE q5 END AS q7, CASE WHEN q5 IS NULL AND authority_id IS NULL AND viaf_id IS NULL AND qn IS NOT NULL THEN 'label' ELSE p3 END AS path FROM s6),
facts_a AS (SELECT id, dates AS a_dates, preferred_lat AS a_lat FROM authority), facts_c AS (SELECT viaf_id, birth AS c_birth, death AS c_death, preferred_lat AS c_lat FROM clusters),
held AS (SELECT viaf_id, list(DISTINCT name) AS labels, count(DISTINCT qid) AS qids, count(DISTINCT birth) AS births FROM items WHERE viaf_id IS NOT NULL GROUP BY 1),
f1 AS (SELECT s7.*, c_birth, c_death, coalesce(a_lat, c_lat) AS lat, labels, qids, births, list_filter(list_transform(string_split(a_dates, '-'), lambda x: TRY_CAST(x AS INT)), lambda y: y > 100 AND y < 2100) AS years FROM s7 LEFT JOIN facts_a ON id = authority_id LEFT JOIN facts_c ON facts_c.viaf_id = s7.viaf_id LEFT JOIN held ON held.viaf_id = s7.viaf_id),
f2 AS (SELECT *, coalesce(c_birth, years[1]) AS birth, coalesce(c_death, CASE WHEN len(years) > 1 THEN years[-1] END) AS death FROM f1),
f3 AS (SELECT *, CASE WHEN birth > year + 5 THEN 'born after' WHEN role = 'scribe' AND year - death > 80 THEN 'died long before' WHEN birth IS NULL AND death > year + 120 THEN 'died long after' END AS conflict,
  name = 'unknown' AS placeholder, coalesce(len(string_split(name, ' ')) = 1 AND len(string_split(lat, ' ')) > 2 AND authority_id IS NULL AND dates IS NULL, false) AS homonym, coalesce(authority_id IS NOT NULL AND viaf_id IS NOT NULL AND qa <> qv, false) AS clash FROM f2),
f4 AS (SELECT *, viaf_id IS NOT NULL AND conflict IS NULL AND NOT homonym AS has FROM f3),
f5 AS (SELECT *, coalesce(has AND len(labels) > 0 AND NOT list_contains(labels, name), false) AS disagrees, coalesce(has AND list_contains(labels, name), false) AS confirms, coalesce(has AND qids >= 2 AND births >= 2, false) AS merged,
  CAST(authority_id IS NOT NULL AS INT) + CAST(viaf_id IS NOT NULL AND conflict IS NULL AS INT) + CAST(q7 IS NOT NULL AS INT) AS n FROM f4),
f6 AS (SELECT *, CASE WHEN placeholder OR clash OR merged OR conflict IS NOT NULL OR homonym OR n = 0 THEN 0 WHEN n >= 2 AND lat IS NOT NULL THEN 2 ELSE 1 END AS base FROM f5),
f7 AS (SELECT *, ['low', 'medium', 'high'][1 + CASE WHEN base = 0 THEN 0 WHEN disagrees THEN base - 1 WHEN confirms THEN 2 ELSE base END] AS confidence, CASE WHEN NOT placeholder THEN authority_id END AS va, CASE WHEN NOT placeholder AND NOT merged AND conflict IS NULL THEN viaf_id END AS vv FROM f6),
matched AS (
  SELECT mention, name, path, va AS authority_id, vv AS viaf_id, q7 AS qid, confidence, CASE WHEN placeholder THEN 'placeholder_name' ELSE concat_ws(',', CASE WHEN conflict IS NOT NULL THEN 'date_conflict' END, CASE WHEN homonym THEN 'short_name_homonym' END, CASE WHEN merged THEN 'over_merge_detected' END, CASE WHEN disagrees THEN 'wikidata_disagrees' END, CASE WHEN confirms THEN 'wikidata_confirms' END, CASE WHEN q7 IS NOT NULL THEN 'has_wikidata' END, CASE WHEN clash THEN 'cross_source_conflict' END) END AS flags,
    CASE WHEN placeholder THEN 'placeholder_name' ELSE conflict END AS rejection, list_filter([CASE WHEN va IS NOT NULL THEN 'mazal' END, CASE WHEN vv IS NOT NULL THEN 'viaf' END, CASE WHEN q7 IS NOT NULL THEN 'wikidata' END], lambda x: x IS NOT NULL) AS s FROM f7)"""


def _inputs(spark, d):
    return [shared(spark, d, sql) for sql in (MENTIONS, AUTHORITY, CLUSTERS, ITEMS)]


@query(f"WITH {_MATCHED} SELECT mention, name, path, authority_id, viaf_id, qid, confidence, flags, rejection, array_to_string(s, ',') AS sources, CASE len(s) WHEN 0 THEN 'marc_only' WHEN 1 THEN s[1] ELSE 'cross_source' END AS source, CAST(len(s) AS INT) AS source_count FROM matched")
def match_cascade(spark, d):
    return cascade.match_people(*_inputs(spark, d)).withColumns({"flags": F.array_join("flags", ","), "sources": F.array_join("sources", ",")})


@query(f"WITH {_MATCHED}, x AS (SELECT *, CASE len(s) WHEN 0 THEN 'marc_only' WHEN 1 THEN s[1] ELSE 'cross_source' END AS source FROM matched) SELECT source, count(*) AS n, count(*) FILTER (confidence = 'high') AS matched, count(*) FILTER (rejection IS NOT NULL) AS rejected FROM x GROUP BY 1")
def match_counts(spark, d):
    return cascade.result_counts(cascade.match_people(*_inputs(spark, d)))


@query(f"WITH {_VIEWS}, k AS (SELECT name, arg_min(qid, {_NUMBER}) AS qid FROM items WHERE kind = 'organization' GROUP BY 1) SELECT mention, m.name, k.qid, 'medium' AS confidence, 'wikidata' AS source FROM mentions m JOIN k ON k.name = m.name WHERE m.kind = 'organization' OR (m.kind = 'person' AND contains(m.name, 'library'))")
def match_organisations(spark, d):
    mentions, _, _, items = _inputs(spark, d)
    return cascade.match_organisations(mentions, items)


_GAZETTEER = "SELECT n_name AS name, 'place/' || n_nationkey AS uri, n_regionkey AS region FROM {nation} WHERE n_nationkey % 4 <> 3"
_PLACES = "SELECT c_nationkey % 7 AS record, n_name AS name, 'place/' || n_nationkey AS uri FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"


@query(f"SELECT record, string_agg(DISTINCT p.name || '=' || g.uri, ',' ORDER BY p.name || '=' || g.uri) AS places FROM ({plain(_PLACES)}) p JOIN ({plain(_GAZETTEER)}) g ON g.name = p.name GROUP BY 1")
def places_by_record(spark, d):
    found = cascade.places_by_record(shared(spark, d, _PLACES), shared(spark, d, _GAZETTEER))
    return found.select("record", F.array_join(F.array_sort(F.transform(F.map_entries("places"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("places"))


@query(f"SELECT DISTINCT uri FROM ({plain(_PLACES)}) WHERE uri IN (SELECT uri FROM ({plain(_GAZETTEER)}))")
def known_places(spark, d):
    return cascade.known_places(shared(spark, d, _PLACES).select("uri").distinct(), shared(spark, d, _GAZETTEER))


@query("WITH i AS (SELECT 'Q' || o_orderkey AS qid, o_custkey AS collection, o_orderpriority AS shelfmark FROM orders), f AS (SELECT collection, shelfmark, CASE WHEN count(DISTINCT qid) = 1 THEN min(qid) END AS qid FROM i GROUP BY ALL) SELECT c_custkey AS collection, '2-HIGH' AS shelfmark, qid FROM customer LEFT JOIN f ON collection = c_custkey AND shelfmark = '2-HIGH'")
def manuscript_by_collection(spark, d):
    items = table(spark, d, "orders").select(F.concat(F.lit("Q"), "o_orderkey").alias("qid"), F.col("o_custkey").alias("collection"), F.col("o_orderpriority").alias("shelfmark"))
    return cascade.by_collection(table(spark, d, "customer").select(F.col("c_custkey").alias("collection"), F.lit("2-HIGH").alias("shelfmark")), items)


# Snapshots of the sources ----------------------------------------------------------

_FLAT = "{0}['birth'] AS birth, {0}['death'] AS death, {0}['date_range'] AS date_range"


def _flat(df, key, b):
    """A snapshot's fields as text columns."""
    dates, names = F.col(f"{b}.dates"), F.col(f"{b}.names")
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|")
    places = F.array_join(F.array_sort(F.transform(F.map_entries(F.col(f"{b}.places")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), "|")
    return df.select(key, dates["birth"].alias("birth"), dates["death"].alias("death"), dates["date_range"].alias("date_range"), joined(names["he"]).alias("he"), joined(names["lat"]).alias("lat"), places.alias("places"), joined(F.col(f"{b}.occupations")).alias("occupations"), joined(F.col(f"{b}.notes")).alias("notes"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CAST(1000 + s_suppkey AS VARCHAR) END AS birth, CASE WHEN s_suppkey % 3 = 0 THEN CAST(1060 + s_suppkey AS VARCHAR) END AS death, CASE WHEN s_suppkey % 3 = 1 THEN 'active ' || (1100 + s_suppkey) END AS date_range,
CASE WHEN s_suppkey % 2 = 0 THEN 'משה' ELSE '' END AS he, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE s_name || '|' || upper(s_name) END AS lat, CASE WHEN s_suppkey % 4 = 0 THEN 'associated_places=' || n_name || ',' || r_name ELSE 'associated_places=' || n_name || ',' || r_name || '|birth_place=' || n_name END AS places, 'scribe' AS occupations, 'NLI authority: ' || s_suppkey || '|' || r_name AS notes
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def authority_biodata(spark, d):
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("s_suppkey")
    dates = F.when(k % 3 == 0, F.concat((1000 + k).cast("string"), F.lit(" - "), (1060 + k).cast("string"))).when(k % 3 == 1, F.concat(F.lit(" active "), (1100 + k).cast("string")))
    own = biodata.of_authority(
        heb=F.when(k % 2 == 0, "משה"), lat=F.col("s_name"), variants=F.array(F.when(k % 5 != 0, F.upper("s_name")), F.lit(" ")), dates=dates, birth_place=F.when(k % 4 != 0, F.col("n_name")), death_place=F.lit(""), associated=F.array("n_name", "r_name"),
        occupations=F.array(F.lit("scribe"), F.lit("scribe")), authority_id=k, notes=F.array("r_name"),
    )
    return _flat(rows.withColumn("b", own), "s_suppkey", "b")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CAST(1000 + c_custkey % 500 AS VARCHAR) END AS birth, CAST(NULL AS VARCHAR) AS death, CAST(NULL AS VARCHAR) AS date_range, CASE WHEN c_custkey % 2 = 0 THEN 'דוד' ELSE '' END AS he, c_name || CASE WHEN c_custkey % 2 = 0 THEN '|' || c_mktsegment ELSE '' END AS lat,
'country=' || n_name AS places, lower(c_mktsegment) AS occupations, 'VIAF: ' || c_custkey || '|field: ' || c_mktsegment AS notes FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def cluster_biodata(spark, d):
    rows = dealt(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    even = F.col("c_custkey") % 2 == 0
    one = F.concat(F.lit('{"text":"'), "c_name", F.lit('"}'))
    head = F.when(even, F.concat(F.lit("["), one, F.lit(',{"text":"דוד"}]'))).otherwise(one)
    other = F.when(even, F.concat(F.lit(',"x400s":{"x400":{"datafield":{"subfield":[{"#text":"'), "c_mktsegment", F.lit('"}]}}}'))).otherwise("")
    birth = F.when(F.col("c_custkey") % 3 == 0, "0").otherwise((1000 + F.col("c_custkey") % 500).cast("string"))
    text = lambda name, value: F.concat(F.lit(f',"{name}":{{"data":{{"text":"'), value, F.lit('"}}'))
    body = F.concat(F.lit('{"viafID":"'), F.col("c_custkey").cast("string"), F.lit('","birthDate":"'), birth, F.lit('","mainHeadings":{"data":'), head, F.lit("}"), other, text("nationalityOfEntity", F.col("n_name")), text("occupation", F.lower("c_mktsegment")), text("fieldOfActivity", F.col("c_mktsegment")), F.lit("}"))
    wrapped = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('{"viafCluster":'), body, F.lit("}"))).otherwise(body)
    return _flat(rows.withColumn("b", biodata.of_cluster(wrapped)), "c_custkey", "b")


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS birth, CAST(NULL AS VARCHAR) AS death, CAST(NULL AS VARCHAR) AS date_range, '' AS he, n_name AS lat, 'admin_region=' || r_name || '|coords=' || (n_nationkey + 0.5) || ', ' || (30.25) || '|country=' || r_name AS places, '' AS occupations, 'Place: ' || n_nationkey AS notes FROM nation JOIN region ON r_regionkey = n_regionkey")
def place_biodata(spark, d):
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    none = F.lit(None).cast("array<string>")
    own = biodata.of_place(heb=F.lit(None).cast("string"), lat=F.col("n_name"), variants=none, country=F.col("r_name"), region=F.col("r_name"), lat_deg=F.col("n_nationkey") + F.lit(0.5), lon_deg=F.lit(30.25), place_id=F.col("n_nationkey"))
    return _flat(rows.withColumn("b", own), "n_nationkey", "b")


# An order matches its customer; the customer and a namesake stand among the record's people.
@query("""SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 2 = 0 THEN '1100' WHEN c_custkey % 3 = 0 THEN '1200' END AS birth, CASE WHEN o_orderkey % 2 = 0 THEN '1150' WHEN c_custkey % 3 = 0 THEN '1260' END AS death, CAST(NULL AS VARCHAR) AS date_range, '' AS he, 'ben ' || c_name || '|' || c_name || ' of ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '|' || c_name ELSE '' END AS lat,
'manuscript_place=' || o_orderpriority AS places, 'author|scribe' || CASE WHEN c_custkey % 3 = 0 THEN '|owner' ELSE '' END AS occupations, 'MARC control number: ' || o_orderkey || '|authority id: ' || c_custkey || '|manuscript language: ' || lower(o_orderstatus) AS notes FROM orders JOIN customer ON c_custkey = o_custkey""")
def record_biodata(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("record", F.col("o_orderkey").cast("string"))
    matches = both.select(F.col("o_orderkey").alias("match_id"), "record", F.concat(F.lit("ben "), "c_name").alias("name"), F.lit("author").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, "1100-1150").alias("dates"), F.col("c_custkey").cast("string").alias("matched_id"))
    person = lambda pos, name, dates, role: both.select("record", F.lit(pos).alias("pos"), name.alias("name"), F.lit(dates).cast("string").alias("dates"), F.lit(role).alias("role"), "c_custkey")
    people = person(0, F.concat("c_name", F.lit(" of "), "c_mktsegment"), "", "scribe").unionAll(person(1, F.col("c_name"), "1200-1260", "owner").where("c_custkey % 3 = 0")).unionAll(person(2, F.lit("someone else"), "1", "patron")).drop("c_custkey")
    records = both.select("record", F.lit(None).cast("string").alias("year"), F.col("o_orderpriority").alias("place"), F.array(F.lower("o_orderstatus")).alias("languages"))
    return _flat(biodata.of_records(matches, people, records), "match_id", "biodata")
