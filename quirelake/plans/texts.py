"""Registered queries over names and spans in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import search, spans
from quirelake.plans.queries import query, table

# Names of a dictionary ---------------------------------------------------------

#: Names of parts, phrases of the benchmark, and pairs of words that needn't stand side by side.
_PHRASES = ((2, 4), (5, 6), (3, 3))


def _dictionary(spark, d):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    phrase = lambda a, b: F.array_join(F.slice(words, a, b - a + 1), " ")
    phrases = table(spark, d, "benchmark").select(F.explode(F.array(*(phrase(a, b) for a, b in _PHRASES), F.concat_ws(" ", F.get(words, 6), F.get(words, 2)))).alias("name"))
    parts = table(spark, d, "part")
    return phrases.unionAll(parts.select(F.lower("p_name"))).unionAll(parts.select(F.explode(F.split(F.lower("p_name"), " "))))


_DICTIONARY_SQL = f"""
b AS (SELECT string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark),
names AS (
  SELECT DISTINCT name FROM (
    {" UNION ALL ".join(f"SELECT array_to_string(w[{a}:{b}], ' ') AS name FROM b" for a, b in _PHRASES)} UNION ALL SELECT concat_ws(' ', w[7], w[3]) FROM b
    UNION ALL SELECT lower(p_name) FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part) WHERE length(name) >= 3)"""
_EDGE = r"' ', chr(9), chr(10), '.', ',', ';', ':', '\"', '|', '(', ')', '[', ']'".replace('\\"', '"')


@query(f"""WITH RECURSIVE {_DICTIONARY_SQL},
t AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
held AS MATERIALIZED (SELECT doc_id, name, text FROM t JOIN names ON contains(text, name)),
hits AS (
  SELECT doc_id, name, text, CAST(strpos(text, name) AS BIGINT) AS pos FROM held
  UNION ALL SELECT doc_id, name, text, pos + strpos(substr(text, pos + 1), name) FROM hits WHERE strpos(substr(text, pos + 1), name) > 0),
whole AS (
  SELECT doc_id, name, pos - 1 AS start, pos - 1 + length(name) AS "end", true AS exact FROM hits
  WHERE (pos = 1 OR substr(text, pos - 1, 1) IN ({_EDGE})) AND (pos + length(name) > length(text) OR substr(text, pos + length(name), 1) IN ({_EDGE}))),
pairs AS (SELECT name, list_filter(string_split(name, ' '), lambda x: length(x) >= 3) AS w FROM names),
apart AS (SELECT doc_id, name, strpos(text, w[1]) - 1 AS a, strpos(text, w[2]) - 1 AS b, length(w[-1]) AS n FROM t JOIN pairs ON len(w) >= 2 AND contains(text, w[1]) AND contains(text, w[2]) AND NOT contains(text, name))
SELECT doc_id, name, start, "end", exact FROM whole
UNION ALL SELECT doc_id, name, least(a, b), greatest(a, b) + n, false FROM apart WHERE abs(a - b) < 30""")
def dictionary_matches(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return search.dictionary_matches(texts, "doc_id", "text", _dictionary(spark, d), "name").withColumnRenamed("key", "doc_id")


@query(f"""WITH RECURSIVE o AS (SELECT doc_id, lower(text) AS text, list_transform(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')[3:4], lambda x: x) AS w FROM documents WHERE text IS NOT NULL),
names AS (SELECT DISTINCT doc_id, text, unnest([w[1], w[2], concat_ws(' ', w[1], w[2]), concat_ws(' ', w[2], w[1])]) AS name FROM o),
hits AS (
  SELECT doc_id, name, text, CAST(strpos(text, name) AS BIGINT) AS pos FROM names WHERE length(name) >= 3 AND contains(text, name)
  UNION ALL SELECT doc_id, name, text, pos + strpos(substr(text, pos + 1), name) FROM hits WHERE strpos(substr(text, pos + 1), name) > 0),
pairs AS (SELECT doc_id, name, text, list_filter(string_split(name, ' '), lambda x: length(x) >= 3) AS w FROM names WHERE NOT contains(text, name)),
apart AS (SELECT doc_id, name, strpos(text, w[1]) - 1 AS a, strpos(text, w[2]) - 1 AS b, length(w[-1]) AS n FROM pairs WHERE len(w) >= 2)
SELECT doc_id, name, pos - 1 AS start, pos - 1 + length(name) AS "end", true AS exact FROM hits
WHERE (pos = 1 OR substr(text, pos - 1, 1) IN ({_EDGE})) AND (pos + length(name) > length(text) OR substr(text, pos + length(name), 1) IN ({_EDGE}))
UNION ALL SELECT doc_id, name, least(a, b), greatest(a, b) + n, false FROM apart WHERE a >= 0 AND b >= 0 AND abs(a - b) < 30""")
def record_matches(spark, d):
    words = F.slice(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "), 3, 2)
    names = F.array(F.get(words, 0), F.get(words, 1), F.concat_ws(" ", F.get(words, 0), F.get(words, 1)), F.concat_ws(" ", F.get(words, 1), F.get(words, 0)))
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"), names.alias("names"))
    return search.record_matches(rows, "doc_id", "text", "names").withColumnRenamed("key", "doc_id")


# The window most like a name: beyond SQL; tests/test_texts.py compares it with every window, one by one.


@query()
def fuzzy_windows(spark, d):
    """Each document against a phrase of the benchmark item of its key, with letters left out."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.regexp_replace(F.array_join(F.slice(words, 2, 4), " "), "([a-z])([a-z])([a-z])", "$1$3").alias("name"))
    total = phrases.agg((F.max("k") + 1).alias("n"))
    documents = table(spark, d, "documents").crossJoin(F.broadcast(total)).select("doc_id", "text", F.pmod("doc_id", "n").alias("k"))
    return search.best_windows(documents.join(phrases, "k"), "doc_id", "name", "text").select(F.col("key").alias("doc_id"), "name", F.round("score", 6).alias("score"), "start", "end")


# Spans and votes ----------------------------------------------------------------

RULES = (
    spans.Pattern("sentence_start", 0.6, "[A-Z][a-z]+ [a-z]+"),
    spans.Pattern("of_phrase", 0.5, "[a-z]+ (?:of|de|and|the) [a-z]+"),
    spans.Pattern("capital", 0.4, "[A-Z][a-z]+"),
    spans.Pattern("long_word", 0.5, "[A-Za-z]{9,}"),
)
_SUM = lambda of, k: f"coalesce(list_sum(list_transform({of}[1:{k}], lambda x: length(x))), 0)"
_PROPOSED = " UNION ALL ".join(f"SELECT doc_id, {n} AS rule, '{r.source}' AS source, {r.weight} AS weight, regexp_extract_all(text, '{r.expression}') AS m, regexp_split_to_array(text, '{r.expression}') AS g FROM documents WHERE text IS NOT NULL" for n, r in enumerate(RULES))
_OVERLAP = "least(x.e, own.e) - greatest(x.s, own.s) > 0 AND least(x.e, own.e) - greatest(x.s, own.s) >= 0.5 * least(x.e - x.s, own.e - own.s)"
_VOTED_SQL = f"""
found AS ({_PROPOSED}), each AS (SELECT doc_id, rule, source, weight, m, g, unnest(generate_series(1, len(m))) AS k FROM found),
placed AS (SELECT doc_id, rule, source, weight, CAST({_SUM("g", "k")} + {_SUM("m", "(k - 1)")} AS BIGINT) AS s, length(m[k]) AS n FROM each),
spans AS (SELECT doc_id, source, weight, s, s + n AS e, row_number() OVER (PARTITION BY doc_id ORDER BY rule, s) AS ord FROM placed),
opened AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
runs AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, ord) AS island FROM opened),
own AS MATERIALIZED (SELECT doc_id, island, list({{'s': s, 'e': e, 'w': weight, 'src': source, 'ord': ord}} ORDER BY ord) AS o FROM runs GROUP BY ALL),
fold AS (
  SELECT doc_id, island, o, 1 AS k, [0] AS g FROM own
  UNION ALL
  SELECT doc_id, island, o, k + 1, list_append(g, coalesce(list_min(list_transform(list_filter(range(1, k + 1), lambda i: {_OVERLAP.replace("own.", "o[k + 1].").replace("x.", "o[i].")}), lambda i: g[i])), list_max(g) + 1))
  FROM fold WHERE k < len(o)),
members AS (SELECT doc_id, island, unnest(o, recursive := true), unnest(g) AS grp FROM fold WHERE k = len(o)),
by_span AS (SELECT doc_id, island, grp, s, e, round(sum(w), 9) AS w, count(*) AS n, min(ord) AS first, arg_min(src, ord) AS source FROM members GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, grp ORDER BY w DESC, first) AS r, sum(w) OVER (PARTITION BY doc_id, island, grp) AS total, sum(n) OVER (PARTITION BY doc_id, island, grp) AS votes FROM by_span),
voted AS (SELECT doc_id, s AS start, e AS "end", 'PERSON' AS label, source, round(w / total, 6) AS confidence, CAST(votes AS BIGINT) AS num_votes FROM ranked WHERE r = 1)"""


def _voted(spark, d):
    return spans.voted(spans.labelled(table(spark, d, "documents"), "doc_id", "text", RULES))


@query(f"WITH RECURSIVE {_VOTED_SQL} SELECT doc_id, start, \"end\", label, source, confidence, num_votes FROM voted")
def span_votes(spark, d):
    return _voted(spark, d).withColumnRenamed("key", "doc_id")


@query(f"""WITH RECURSIVE {_VOTED_SQL},
words AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t, regexp_split_to_array(text, '\\S+') AS g FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, t, g, unnest(generate_series(1, len(t))) AS k FROM words),
places AS (SELECT doc_id, k, t[k] AS token, {_SUM("g", "k")} + {_SUM("t", "(k - 1)")} AS a FROM w),
touched AS (SELECT p.doc_id, p.k, v.start, v."end", p.a, row_number() OVER (PARTITION BY p.doc_id, p.k ORDER BY v.start DESC, v."end" DESC) AS last FROM places p JOIN voted v ON v.doc_id = p.doc_id AND v.start < p.a + length(p.token) AND v."end" > p.a),
tagged AS (SELECT p.doc_id, p.k, CASE WHEN t.k IS NULL THEN 'O' WHEN t.start >= t.a THEN 'B' ELSE 'I' END AS tag FROM places p LEFT JOIN touched t ON t.doc_id = p.doc_id AND t.k = p.k AND last = 1)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (tag = 'O') AS outside, string_agg(tag, '' ORDER BY k) AS tags FROM tagged WHERE doc_id IN (SELECT doc_id FROM voted) GROUP BY doc_id""")
def span_samples(spark, d):
    samples = spans.training_samples(table(spark, d, "documents"), "doc_id", "text", _voted(spark, d))
    initials = F.transform("tags", lambda t: F.left(t, F.lit(1)))
    return samples.select(F.col("key").alias("doc_id"), F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("tags", lambda t: t == "O")).cast("long").alias("outside"), F.array_join(initials, "").alias("tags"))
