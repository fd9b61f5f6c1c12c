"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams follows: a
text can match only if it holds these trigrams.  Within a task, each batch of
whole texts gets an inverted index of the trigrams that any rule asks for
(trigram to sorted document ordinals).  A rule's query intersects and unites
these postings, and its expression then runs on the candidates only.  A rule
without mandatory trigrams (``hex``) scans every text.

Null text: empty, no spans.  Repeated rows: one result each.  Offsets count code
points, ends are exclusive.  Matches of one rule don't overlap; those of
different rules may.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger character classes and larger sets of alternatives count as unknown.
CLASS_LIMIT, SET_LIMIT = 8, 64
#: Bytes that one pass of the indexer looks at.
WINDOW = 1 << 22


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (ASCII) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three rules that are counted, then those that add spans.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: None (any text), a trigram, ("and", parts) or ("or", parts).
Query = None | bytes | tuple


def _all(parts: list) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> Query:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([s[i : i + 3].encode() for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings that ``nodes`` match, if they are few, and what any match must hold."""
    runs: set[str] = {""}
    must: list = []
    exact = True
    for op, arg in nodes:
        op, some, need = str(op), None, None
        if op == "LITERAL":
            some = {chr(arg).lower()} if arg < 128 else None
        elif op == "IN" and all(str(o) == "LITERAL" and a < 128 for o, a in arg) and len(arg) <= CLASS_LIMIT:
            some = {chr(a).lower() for _, a in arg}
        elif op == "SUBPATTERN":
            some, need = _walk(arg[-1])
        elif op == "BRANCH":
            found = [_walk(b) for b in arg[1]]
            some = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            need = _any([_all([q, None if s is None else _of_strings(s)]) for s, q in found])
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            some, need = _walk(inner)
            if some is not None and high <= 4 and len(some) ** int(high) <= SET_LIMIT:
                some = {"".join(p) for n in range(low, int(high) + 1) for p in product(sorted(some), repeat=n)}
            else:
                need, some = (_all([need, None if some is None else _of_strings(some)]) if low else None), None
        elif op == "AT":
            some = {""}
        joined = {a + b for a in runs for b in some} if some is not None else set()
        if some is not None and len(joined) <= SET_LIMIT:
            runs = joined
        else:
            must += [_of_strings(runs), need, None if some is None else _of_strings(some)]
            runs, exact = {""}, False
    return (runs, _all(must)) if exact else (None, _all([*must, _of_strings(runs)]))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, in lower case; None if it has no mandatory trigram."""
    strings, need = _walk(re._parser.parse(pattern))
    return _all([need, None if strings is None else _of_strings(strings)])


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def index_texts(texts: list[bytes], wanted: set[bytes]) -> dict[bytes, np.ndarray]:
    """Postings of the wanted trigrams over UTF-8 texts, case folded: sorted ordinals of texts."""
    letters = sorted({b for t in wanted for b in t})
    base = len(letters) + 1
    class_of = np.zeros(256, np.uint32)
    for k, b in enumerate(letters, 1):
        class_of[b] = k
        class_of[ord(chr(b).upper())] = k
    code_of = {t: int(((class_of[t[0]] * base) + class_of[t[1]]) * base + class_of[t[2]]) for t in wanted}
    is_wanted = np.zeros(base**3, bool)
    is_wanted[list(code_of.values())] = True
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    found = []
    for at in range(0, len(joined), WINDOW):
        c = class_of[joined[at : at + WINDOW + 2]]
        code = (c[:-2] * base + c[1:-1]) * base + c[2:]
        hits = np.flatnonzero(is_wanted[code])
        found.append(np.unique(code[hits].astype(np.int64) * len(texts) + np.searchsorted(starts, hits + at, side="right") - 1))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    codes, ordinals = np.divmod(pairs, len(texts))
    lo, hi = (np.searchsorted(codes, list(code_of.values()), side=s) for s in ("left", "right"))
    return {t: ordinals[a:b] for t, a, b in zip(code_of, lo, hi, strict=True)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The texts that satisfy a query; the shortest lists are intersected first."""
    if query is None:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.union1d(out, p) if query[0] == "or" else out[np.isin(out, p, assume_unique=True)]
    return out


def matches(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; those that are too short are dropped afterwards."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...], n_base: int):
    asked = [trigram_query(r.pattern) for r in rules]
    wanted = set().union(*map(trigrams, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expressions = [r.compiled() for r in rules]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans: dict[int, list] = {}
            postings = index_texts([t.encode() for t in texts], wanted)
            for k, (rule, expression, query) in enumerate(zip(rules, expressions, asked, strict=True)):
                for i in candidates(query, postings, len(texts)).tolist():
                    for a, b in matches(rule, expression, texts[i]):
                        spans.setdefault(i, []).append((a, k, b))
            rows = {"doc_id": batch.column(0), "spans": []}
            rows |= {f"n_{r.kind}": [0] * len(texts) for r in rules[:n_base]} | {"base_sha256": []}
            for i in range(len(texts)):
                own = sorted(spans.get(i, ()))
                for _, k, _ in own:
                    if k < n_base:
                        rows[f"n_{rules[k].kind}"][i] += 1
                text = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in own]
                rows["base_sha256"].append(hashlib.sha256(",".join(s for k, s in text if k < n_base).encode()).hexdigest())
                rows["spans"].append(",".join(s for _, s in text))
            names = ["doc_id", *(f"n_{r.kind}" for r in rules[:n_base]), "base_sha256", "spans"]
            kinds = [pa.int64(), *(pa.int64() for _ in rules[:n_base]), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) if isinstance(rows[c], list) else rows[c].cast(t) for c, t in zip(names, kinds, strict=True)], names=names)

    return run


def scan_secrets(documents: DataFrame, *, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base rules, a digest of their spans, and all spans as ``kind:start:end``."""
    schema = "doc_id long, " + "".join(f"n_{r.kind} long, " for r in base) + "base_sha256 string, spans string"
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner((*base, *more), len(base)), schema)


def redact_secrets(documents: DataFrame, scanned: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "*") -> DataFrame:
    """``documents`` with every character of a found span replaced by ``mark`` (ids must be unique)."""
    spans = scanned.where("spans != ''").select(F.col("doc_id").alias(id_col), F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b"))).alias("__spans"))
    hidden = F.aggregate("__spans", F.col(text_col), lambda t, s: F.concat(t.substr(F.lit(1), s["a"]), F.repeat(F.lit(mark), s["b"] - s["a"]), t.substr(s["b"] + 1, F.length(t))))
    return documents.join(spans, id_col, "left").withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(hidden)).drop("__spans").select(documents.columns)


def _in_sql(rule: Rule) -> str:
    """The expression for DuckDB; letters of either case are spelt out, since its own folding isn't limited to ASCII."""
    if not rule.any_case:
        return rule.pattern
    head, tail = rule.pattern.split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail


def _matches_sql(k: int, rule: Rule) -> str:
    quoted = _in_sql(rule).replace("'", "''")
    return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, unnest(string_split_regex(text, '{quoted}')) AS gap,
        unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(regexp_extract_all(text, '{quoted}', {rule.group})) AS held, unnest(range(len(string_split_regex(text, '{quoted}')))) AS nth FROM d"""


#: The registered query for DuckDB: every expression on every text; places follow from the lengths of the matches and of what lies between them.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(_matches_sql(k, rule) for k, rule in enumerate((*BASE_RULES, *MORE_RULES)))}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY r, k ORDER BY nth) AS stop FROM parts),
spans AS (SELECT r, k, kind, (stop - length(m))::bigint AS start, kind || ':' || (stop - length(m))::bigint || ':' || stop::bigint AS span FROM placed WHERE m IS NOT NULL AND length(held) >= least)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE_RULES)},
    sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""
