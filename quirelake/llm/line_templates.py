"""Recurring lines across documents, by a log-template tree, in DataFrame functions only.

A line's tokens are its runs without blanks and tabs; a token with a digit is a
variable field and becomes ``<*>``.  The tree's path is fixed: the number of
tokens, then the first ``LEAD`` tokens, then a leaf of distinct forms.  Two forms of
a leaf are alike if ``SIMILAR`` percent of their tokens or more are equal, position
by position; a form's template is the first form (by document, then line) that it
is alike to, and the positions that differ are the template's variable fields.

Of n tokens d may differ, so that of d + 1 parts behind the leading tokens one is
wholly equal: alike forms share a bucket of leaf and part, and none is lost.  In
rounds, the first forms of each bucket (one, then eight times as many each round)
meet those of its forms that have no earlier template yet; the rounds end when no
bucket has an earlier form left that one of its forms hasn't met.  Members of one
template so meet its first form only, never each other.

A form recurs if it, or its template, occurs in two documents or more; one of
fewer than ``LONG`` tokens takes no template and needs ``OFTEN`` occurrences
itself (``often=2`` drops all that recur).  The document with the smallest id
keeps a recurring form's lines, all others lose them, so that one copy of every
text stays.

Blank lines are left alone, as are rows without an id; rows that share an id are
one document.  A null text stays null, an empty one empty; whole texts are read,
however long.  An empty table gives an empty result.  The input's columns may
have any names; ``n_lines`` and ``n_dropped`` are replaced.

With ``copies``, a document also loses each shorter line that is held by a
document which keeps one of its long lines or which is the first with the very
same text, however seldom the line occurs.  So a copy empties out, while a short
line that documents share by chance stays.  The first document with a line never
loses it.  Forms are grouped by 64-bit hashes of all their tokens, beside their
number and leading tokens; templates are compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import mark, settled, written

LEAD = 3
LONG = 8
OFTEN = 20
#: Percent of a line's tokens that equal its template's.
SIMILAR = 75
FIELD = "<*>"


def line_tokens(line: Column) -> Column:
    """Tokens of a line, variable fields generalised; blank lines have none."""
    return F.filter(F.split(F.regexp_replace(line, r"[^ \t\r]*[0-9][^ \t\r]*", FIELD), "[ \t\r]+"), lambda t: t != "")


def _keys(tokens: Column) -> tuple[Column, Column]:
    """A line's leaf and its form."""
    n = F.size(tokens)
    return F.xxhash64(n, F.slice(tokens, 1, LEAD)), F.xxhash64(n, tokens)


def _parts(words: Column, similar: int) -> Column:
    """Keys of the parts of the tokens after the leading ones, one more than may differ."""
    n = F.size(words)
    rest = F.greatest(n - LEAD, F.lit(0))
    differ = F.floor(n * (100 - similar) / 100).cast("int")
    parts = F.when(differ < rest, differ + 1).otherwise(F.lit(0))  # where all may differ, a leaf is one bucket
    cut = lambda k: F.lit(LEAD) + F.floor(rest * k / parts).cast("int")
    return F.when(parts == 0, F.array(F.xxhash64(F.lit(-1)))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.xxhash64(k, F.slice(words, cut(k) + 1, cut(k + 1) - cut(k)))))


def _first_alike(own: DataFrame, similar: int) -> DataFrame:
    """``form, found``: the place of the first earlier form that each form is alike to; ``own``: ``form, leaf, at, words``."""
    bucket = Window.partitionBy("leaf", "key")
    members = own.select("form", "at", "leaf", F.explode(_parts(F.col("words"), similar)).alias("key"))
    several = members.groupBy("leaf", "key").agg(F.count("*").alias("k")).where("k > 1").select("leaf", "key")
    ranked = written(members.join(several.hint("merge"), ["leaf", "key"]).withColumn("rank", F.row_number().over(bucket.orderBy("at"))), "members")
    words = own.select("form", "words")
    found, low, high = None, 0, 1
    while True:
        # A form is through with a bucket once its next form isn't earlier than the form itself, or than its template.
        following = ranked.where(F.col("rank") == low + 1).select("leaf", "key", F.col("at").alias("next"))
        open_ = ranked.where(F.col("rank") > low + 1).join(following.hint("merge"), ["leaf", "key"])
        open_ = open_.withColumn("until", F.col("at")) if found is None else open_.join(found.hint("merge"), "form", "left").withColumn("until", F.least("at", "found")).drop("found")
        open_ = written(open_.where(F.col("next") < F.col("until")).select("form", "leaf", "key", "until"), "open")
        if open_.isEmpty():
            return found
        first = ranked.where((F.col("rank") > low) & (F.col("rank") <= high)).select("leaf", "key", F.col("form").alias("template"), F.col("at").alias("place"))
        pairs = open_.join(first.hint("merge"), ["leaf", "key"]).where(F.col("place") < F.col("until")).select("form", "template", "place").distinct()
        met = written(pairs, "template-pairs").join(words.hint("merge"), "form").join(words.select(F.col("form").alias("template"), F.col("words").alias("others")).hint("merge"), "template")
        equal = F.aggregate(F.zip_with("words", "others", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        alike = met.where((F.size("words") == F.size("others")) & (100 * equal >= similar * F.size("words"))).select("form", F.col("place").alias("found"))
        found = written((alike if found is None else alike.unionAll(found)).groupBy("form").agg(F.min("found").alias("found")), "found")
        low, high = high, 8 * high


def _templates(documents: DataFrame, forms: DataFrame, long: int, similar: int) -> DataFrame:
    """``form, template_doc``: the first document of the template that a long form belongs to."""
    leaves = forms.where(F.col("n") >= long).groupBy("leaf").agg(F.count("*").alias("k"), F.min("at.doc_id").alias("a"), F.max("last").alias("b")).where("k > 1 and a < b").select("leaf")
    # Only leaves of several forms have templates: their tokens are read again, one line a form.
    asked = written(forms.join(written(leaves, "leaves").hint("merge"), "leaf").where(F.col("n") >= long).select(F.col("at.doc_id").alias("doc_id"), F.struct("form", "leaf", F.col("at.line").alias("line")).alias("one")).groupBy("doc_id").agg(F.collect_list("one").alias("asked")), "asked")
    lines = documents.join(asked.hint("merge"), "doc_id").select("doc_id", F.split("text", "\n").alias("lines"), F.explode("asked").alias("one"))
    tokens = lines.select("doc_id", "one.*", line_tokens(F.get("lines", F.col("one.line"))).alias("tokens"))
    # Rows that share an id may have other texts.
    again = tokens.where(_keys(F.col("tokens"))[1] == F.col("form")).select("form", "leaf", F.struct("doc_id", "line").alias("at"), "tokens").dropDuplicates(["form"])
    own = written(again.select("form", "leaf", "at", F.transform("tokens", lambda t: F.xxhash64(t)).alias("words")), "form-tokens")
    found = _first_alike(own, similar)
    if found is None:
        return own.select("form", F.col("at.doc_id").alias("template_doc")).limit(0)
    return found.select("form", F.col("found.doc_id").alias("template_doc"))


def _lines_of_copies(keyed: DataFrame, lost: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id, line``: short lines that a keeper of the document's long lines, or the first document of its text, holds too."""
    same = texts.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last").select("digest", "keeper")
    copied = texts.join(written(same, "same-texts").hint("merge"), "digest").where("doc_id != keeper").select("doc_id", "keeper")
    keepers = written(lost.where("long").select("doc_id", "keeper").unionAll(copied).distinct(), "keepers")
    short = keyed.where("not long").select("doc_id", "line", "form")
    held = short.select(F.col("doc_id").alias("keeper"), "form").distinct()
    return short.join(keepers.hint("merge"), "doc_id").join(held.hint("merge"), ["keeper", "form"]).select("doc_id", "line")


def recurring_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", copies: bool = False, long: int = LONG, often: int = OFTEN, similar: int = SIMILAR) -> DataFrame:
    """``doc_id, lines``: the numbers (from 0) of the lines that each document loses."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    # Bound by a lambda, a line's tokens are made once; a filter before the write would make them again.
    one = F.transform(F.array(line_tokens(F.col("words"))), lambda t: F.struct(F.size(t).alias("n"), _keys(t)[0].alias("leaf"), _keys(t)[1].alias("form")))
    keyed = written(lines.select("doc_id", "line", F.get(one, F.lit(0)).alias("k")).select("doc_id", "line", "k.*"), "lines").where("n > 0").withColumn("long", F.col("n") >= long)
    forms = written(keyed.groupBy("form").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("leaf").alias("leaf")), "forms")
    templates = _templates(rows, forms, long, similar)
    # Sort-merge joins whatever the size: no side has a proven bound, and adaptive execution splits hot keys.
    keepers = forms.join(written(templates, "templates").hint("merge"), "form", "left").select("form", "n", "last", "times", F.least(F.col("at.doc_id"), F.coalesce("template_doc", "at.doc_id")).alias("keeper"))
    recurring = written(keepers.where((F.col("keeper") < F.col("last")) & ((F.col("n") >= long) | (F.col("times") >= often))).select("form", "keeper"), "recurring")
    lost = keyed.join(recurring.hint("merge"), "form").where("doc_id != keeper")
    if copies:
        lost = written(lost.select("doc_id", "line", "long", "keeper"), "lost-lines")
        texts = rows.select("doc_id", F.xxhash64("text").alias("digest"))
        lost = lost.select("doc_id", "line").unionAll(_lines_of_copies(keyed, lost, written(texts, "digests")))
    return lost.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_empty: bool = True, copies: bool = False, long: int = LONG, often: int = OFTEN, similar: int = SIMILAR) -> DataFrame:
    """``documents`` without their recurring lines, plus ``n_lines`` and ``n_dropped``.

    With ``copies``, short lines of copies go too.  Without ``keep_empty``, documents
    that lose all their words leave.
    """
    since = mark()
    lost = settled(recurring_lines(documents, id_col=id_col, text_col=text_col, copies=copies, long=long, often=often, similar=similar), "lost", since)
    rows = documents.drop("n_lines", "n_dropped")
    # The input's columns stay inside a struct, so that none can clash with the join's.
    whole = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*rows.columns).alias("row"))
    both = whole.join(lost.hint("merge"), "doc_id", "left")
    own = F.col("row")[text_col]

    def made(x: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(x["lines"]) - 1)
        left = F.array_join(F.transform(F.array_sort(F.array_except(every, x["lost"])), lambda i: F.get(x["lines"], i)), "\n")
        text = F.when(F.size(x["lost"]) == 0, x["text"]).otherwise(left)
        n_dropped = F.when(F.size(x["lost"]) == 0, F.lit(0)).otherwise(F.size(F.array_intersect(every, x["lost"])))
        return F.struct(text.alias("text"), F.when(x["text"].isNull(), F.lit(0)).otherwise(F.size(x["lines"])).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))

    # Bound by lambdas, a text is cut and joined once; exploding one result (or none) keeps it so.
    parts = F.struct(own.alias("text"), F.split(own, "\n").alias("lines"), F.when(own.isNull() | F.col("lines").isNull(), F.array().cast("array<int>")).otherwise(F.col("lines")).alias("lost"))
    new = F.transform(F.array(parts), made)
    if not keep_empty:
        new = F.filter(new, lambda x: (x["n_dropped"] == 0) | x["text"].rlike(r"[^ \t\r\n]"))
    out = both.select("row", F.explode(new).alias("new"))
    return out.select(*((F.col("new.text") if c == text_col else F.col("row")[c]).alias(c) for c in rows.columns), "new.n_lines", "new.n_dropped")


#: The same in DuckDB's SQL, over the table ``documents``: all forms of a leaf are compared with each other.
ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tokens AS (
  SELECT doc_id, line, list_filter(string_split_regex(regexp_replace(words, '[^ \t\r]*[0-9][^ \t\r]*', '{FIELD}', 'g'), '[ \t\r]+'), lambda t: t <> '') AS t FROM lines),
forms AS (
  SELECT t, len(t) AS n, t[1:{LEAD}] AS lead, min(doc_id) AS opening, max(doc_id) AS last, count(*) AS times, min(struct_pack(d := doc_id, l := line)) AS place
  FROM tokens WHERE len(t) > 0 GROUP BY t),
templates AS (
  SELECT a.t, min(b.opening) AS template_doc FROM forms a JOIN forms b ON a.n = b.n AND a.lead = b.lead AND a.t <> b.t
  WHERE a.n >= {LONG} AND 100 * len(list_filter(list_zip(a.t, b.t), lambda z: z[1] = z[2])) >= {SIMILAR} * a.n GROUP BY a.t),
recurring AS (
  SELECT t, keeper FROM (SELECT t, n, last, times, least(opening, coalesce(template_doc, opening)) AS keeper FROM forms LEFT JOIN templates USING (t))
  WHERE keeper < last AND (n >= {LONG} OR times >= {OFTEN})),
lost AS (SELECT doc_id, line FROM tokens JOIN recurring USING (t) WHERE doc_id <> keeper),
kept AS (
  SELECT doc_id, string_agg(words, chr(10) ORDER BY line) AS text FROM lines ANTI JOIN lost USING (doc_id, line) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_dropped FROM lost GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n_dropped IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
