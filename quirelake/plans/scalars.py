"""Registered queries over identifiers, addresses, cleaned texts, roles and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text
from quirelake.operators import corpus
from quirelake.plans.graphs import plain, shared, table
from quirelake.plans.queries import query

_RAW = """
SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'n' WHEN 1 THEN ' nb  ' WHEN 2 THEN 'no ' WHEN 3 THEN 'x' WHEN 4 THEN 'sh' ELSE 'N' END || (10 + o_custkey) AS lccn,
  CASE o_orderkey % 4 WHEN 0 THEN '0000 0001 2' WHEN 1 THEN '000000012' WHEN 2 THEN '12' ELSE '0000 0001 2' END || (1000000 + o_custkey) || CASE WHEN o_orderkey % 4 = 3 THEN 'Y' ELSE '' END AS isni,
  CASE o_orderkey % 3 WHEN 0 THEN 'cb' WHEN 1 THEN ' ' ELSE 'CB1' END || (10000000 + o_orderkey) || CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '7' WHEN 2 THEN 'a' WHEN 3 THEN 'B' ELSE '' END AS bnf, ' 99000' || o_orderkey || ' ' AS number FROM {orders}"""


@query(f"""SELECT k, CASE WHEN regexp_matches(trim(lccn), '^(n|nb|nr|no|ns|sh|sj)\\s*[0-9]{{2,10}}$') THEN regexp_extract(trim(lccn), '^([a-z]+)', 1) || ' ' || regexp_extract(lccn, '([0-9]+)', 1) END AS lccn,
CASE WHEN regexp_matches(replace(isni, ' ', ''), '^[0-9]{{15}}[0-9X]$') THEN substr(replace(isni, ' ', ''), 1, 4) || ' ' || substr(replace(isni, ' ', ''), 5, 4) || ' ' || substr(replace(isni, ' ', ''), 9, 4) || ' ' || substr(replace(isni, ' ', ''), 13, 4) END AS isni,
CASE WHEN regexp_matches(regexp_replace(lower(trim(bnf)), '^cb', ''), '^[0-9]{{8}}[0-9bcdfghjkmnpqrstvwxz]$') THEN regexp_replace(lower(trim(bnf)), '^cb', '') END AS bnf, trim(number) AS j9u, 'https://www.nli.org.il/en/manuscripts/' || trim(number) || '/NLI' AS url FROM ({plain(_RAW)})""")
def canonical_identifiers(spark, d):
    rows = shared(spark, d, _RAW)
    return rows.select("k", text.canonical_lccn(F.col("lccn")).alias("lccn"), text.canonical_isni(F.col("isni")).alias("isni"), text.canonical_bnf(F.col("bnf")).alias("bnf"), text.j9u_id(F.col("number")).alias("j9u"), text.catalogue_url(F.col("number")).alias("url"))


_VALUES = """
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'https://viaf.org/viaf/' || (1000 + c_custkey) || '/' WHEN 1 THEN '(viaf) ' || (10 + c_custkey) WHEN 2 THEN '' || (10000 + c_custkey) WHEN 3 THEN '12' ELSE ' ' END AS a,
  CASE c_custkey % 4 WHEN 0 THEN 'http://www.wikidata.org/entity/q' || c_custkey WHEN 1 THEN ' q' || c_custkey WHEN 2 THEN 'https://www.nli.org.il/en/authorities/' || c_custkey ELSE 'Q1x' END AS b,
  CASE WHEN c_custkey % 7 = 0 THEN 'HTTP://VIAF.ORG/viaf/' || (2000 + c_custkey) WHEN c_custkey % 7 = 1 THEN 'https://a.example/x y nli.org.il' END AS c FROM {customer}"""
_VIAF_AT = "CASE WHEN k % 7 = 0 THEN '' || (2000 + k) WHEN k % 5 = 0 THEN '' || (1000 + k) WHEN k % 5 = 1 THEN '' || (10 + k) WHEN k % 5 = 2 THEN '' || (10000 + k) END"
_SAME = "list_filter([CASE WHEN k % 5 = 0 THEN 'https://viaf.org/viaf/' || (1000 + k) END, CASE WHEN k % 4 = 0 THEN 'https://www.wikidata.org/entity/Q' || k WHEN k % 4 = 2 THEN b END, CASE WHEN k % 7 = 0 THEN 'https://viaf.org/viaf/' || (2000 + k) END], lambda x: x IS NOT NULL)"


@query(f"SELECT k, {_VIAF_AT} AS viaf_id, CASE WHEN k % 4 IN (0, 1) THEN 'Q' || k END AS wikidata_id, CASE WHEN k % 4 = 2 THEN b END AS external_uri_nli, array_to_string({_SAME}, '|') AS same_as FROM ({plain(_VALUES)})")
def authority_parts(spark, d):
    rows = shared(spark, d, _VALUES).select("k", text.authority_parts(F.array("a", "b", "c")).alias("p"))
    return rows.select("k", "p.viaf_id", "p.wikidata_id", "p.external_uri_nli", F.array_join("p.same_as_uris", "|").alias("same_as"))


_ADDRESSES = "SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN url || '/Person_' || page_id WHEN 2 THEN 'MS_' || page_id WHEN 3 THEN 'x/workplace' WHEN 4 THEN 'Place/' || page_id WHEN 5 THEN 'CU_' || page_id WHEN 6 THEN 'a/Production/' || page_id WHEN 7 THEN 'Group ' || page_id ELSE 'expression_of_event' END AS uri FROM {pages}"


@query(f"SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'person' WHEN 2 THEN 'manuscript' WHEN 3 THEN 'work' WHEN 4 THEN 'place' WHEN 5 THEN 'codicological_unit' WHEN 6 THEN 'event' WHEN 7 THEN 'organization' WHEN 8 THEN 'expression' ELSE CASE WHEN contains(u, 'person') THEN 'person' WHEN contains(u, 'work') THEN 'work' WHEN contains(u, 'place') THEN 'place' ELSE 'default' END END AS kind FROM (SELECT *, lower(uri) AS u FROM ({plain(_ADDRESSES)}))")
def address_kinds(spark, d):
    return shared(spark, d, _ADDRESSES).select("page_id", text.kind_of_address(F.col("uri")).alias("kind"))


_FIELDS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"' || left(text, 60) || '",,;' WHEN 1 THEN left(text, 60) || '||' || source WHEN 2 THEN ' ''"  ' || left(text, 40) || ' "' ELSE '"' END AS f FROM {documents}"""


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(f, ''), '^["'']+|["'']+$', '', 'g'), '||', '|'), '\\s+', ' ', 'g'), '[,;]+$', '')) AS field, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), '\\s+', ' ', 'g'), '') AS entity,
replace(replace(f, chr(92), chr(92) || chr(92)), '"', '') AS literal FROM ({plain(_FIELDS)})""")
def cleaned_texts(spark, d):
    f = F.col("f")
    return shared(spark, d, _FIELDS).select("doc_id", text.clean_field(f).alias("field"), text.clean_entity(f).alias("entity"), text.literal_escape(f).alias("literal"))


_CONTEXTS = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'בעלים של הספר ' WHEN 1 THEN 'קנה ' WHEN 2 THEN 'מחבר ' WHEN 3 THEN 'בעלים ' WHEN 4 THEN 'כתב העתיק ' ELSE '' END || 'Moses' || CASE l_suppkey % 4 WHEN 0 THEN ' והיה לו בעלים אחר' WHEN 1 THEN ' מחבר' WHEN 2 THEN ' מעתיק' ELSE '' END AS context, 'MOSES' AS entity,
  CASE l_orderkey % 3 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'AUTHOR' ELSE 'TRANSCRIBER' END AS predicted, CAST(l_linenumber AS DOUBLE) / 7.5 AS confidence FROM {lineitem}"""
_count = lambda words: " + ".join(f"CAST(contains(context, '{w}') AS INT)" for w in words)


@query(f"""WITH c AS (SELECT *, {_count(text.OWNER_WORDS)} AS o, {_count(text.AUTHOR_WORDS)} AS a, {_count(text.SCRIBE_WORDS)} AS t, strpos(lower(context), 'moses') AS p FROM ({plain(_CONTEXTS)})),
f AS (SELECT *, contains(context, 'מחבר') AND contains(context, 'בעלים') AS both_words, abs(strpos(context, 'מחבר') - p) AS fa, abs(strpos(context, 'בעלים') - p) AS fo FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN contains(context, 'בעלים של') THEN 'OWNER' WHEN regexp_matches(context, 'קנה|ירש|נקנה|רכש') AND predicted <> 'OWNER' THEN 'OWNER' WHEN both_words AND fa < fo AND predicted = 'OWNER' THEN 'AUTHOR' WHEN both_words AND fo < fa AND predicted = 'AUTHOR' THEN 'OWNER'
WHEN confidence > 0.8 THEN predicted WHEN confidence < 0.5 AND greatest(o, a, t) > 0 THEN CASE WHEN o = greatest(o, a, t) THEN 'OWNER' WHEN a = greatest(o, a, t) THEN 'AUTHOR' ELSE 'TRANSCRIBER' END ELSE predicted END AS role FROM f""")
def roles_in_context(spark, d):
    role = text.role_in_context(*map(F.col, ("context", "entity", "predicted", "confidence")))
    return shared(spark, d, _CONTEXTS).select("l_orderkey", "l_linenumber", "l_partkey", role.alias("role"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Certain' ELSE 'Probable' END AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'by hand' END AS date_note, CASE WHEN o_orderkey % 2 = 0 THEN 'Possible' END AS place FROM orders""")
def certainty_levels(spark, d):
    k = F.col("o_orderkey")
    earlier = F.when(k % 2 == 0, F.create_map(F.lit("place"), F.lit("Possible"), F.lit("date"), F.lit("Uncertain")))
    levels = text.with_certainty(earlier, "date", F.when(k % 4 == 0, "Certain").otherwise("Probable"), F.when(k % 3 == 0, "by hand").when(k % 3 == 1, ""))
    rows = table(spark, d, "orders").select("o_orderkey", levels.alias("m"))
    return rows.select("o_orderkey", F.col("m")["date"].alias("date"), F.col("m")["date_note"].alias("date_note"), F.col("m")["place"].alias("place"))


_MATCHES = "SELECT event_id, event_type AS source, CASE WHEN event_id % 3 <> 2 THEN CASE event_id % 3 WHEN 0 THEN 'person' ELSE 'place' END END AS match_type, CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, event_type AS entity_type, CASE WHEN value < 10 THEN 'new' ELSE 'found' END AS status FROM {events}"


@query(f"SELECT event_id, source, match_type, confidence FROM ({plain(_MATCHES)}) WHERE source IN ('click', 'view') AND match_type IN ('person') AND (event_id % 4 = 0 OR event_id % 4 = 3)")
def authority_grid(spark, d):
    rows = shared(spark, d, _MATCHES).select("event_id", "source", "match_type", "confidence")
    return corpus.authority_grid(rows, sources=["click", "view"], kinds=["person"], bands=["high", "none"])


@query(f"SELECT event_id, entity_type, status FROM ({plain(_MATCHES)}) WHERE status = 'new'")
def export_grid(spark, d):
    return corpus.export_grid(shared(spark, d, _MATCHES).select("event_id", "entity_type", "status"), statuses=["new"])


@query("SELECT e.event_type, CASE WHEN length(e.event_type) > 4 THEN 'events of ' || e.event_type ELSE '' END AS description, CASE WHEN length(e.event_type) > 4 THEN upper(e.event_type) ELSE '' END AS source_fields, count(*) AS count, round(avg(value), 6) AS avg_validation_score FROM events e GROUP BY e.event_type")
def type_definitions(spark, d):
    events = table(spark, d, "events")
    metadata = events.where(F.length("event_type") > 4).select("event_type", F.concat(F.lit("events of "), "event_type").alias("description"), F.upper("event_type").alias("source_fields"))
    return corpus.type_definitions(events, "event_type", "value", metadata)
