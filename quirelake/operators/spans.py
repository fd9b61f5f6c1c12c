"""Labelled spans: labelling rules over texts, votes in groups of overlapping spans, tagged training samples.

Spans are rows ``key, ord, start, end, label, source, weight``; ``ord`` is the
order in which a text's spans were proposed: rule by rule, then by place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.sources.tables import dealt


class Pattern(NamedTuple):
    """Every match of an expression."""

    source: str
    weight: float
    expression: str
    label: str = "PERSON"

    def spans(self, text: str, names: list[str]) -> Iterator[tuple[int, int]]:
        yield from (m.span() for m in re.finditer(self.expression, text))


class Known(NamedTuple):
    """Every occurrence of a name that the row's metadata hold ``least`` times or more."""

    source: str
    weight: float
    least: int = 1
    label: str = "PERSON"

    def spans(self, text: str, names: list[str]) -> Iterator[tuple[int, int]]:
        counted = Counter(n for n in names if n)
        for name in names if self.least == 1 else counted:  # a repeated name votes again, unless it had to be repeated
            if name and counted[name] >= self.least:
                yield from (m.span() for m in re.finditer(re.escape(name), text))


class Near(NamedTuple):
    """Matches of an expression within ``reach`` characters of the first place of each keyword."""

    source: str
    weight: float
    keywords: tuple[str, ...]
    expression: str
    reach: int = 30
    least: int = 3
    stopwords: tuple[str, ...] = ()
    label: str = "PERSON"

    def spans(self, text: str, names: list[str]) -> Iterator[tuple[int, int]]:
        for keyword in self.keywords:
            at = text.find(keyword)
            if at < 0:
                continue
            first = max(0, at - self.reach)
            for m in re.finditer(self.expression, text[first : at + len(keyword) + self.reach]):
                name = m[0].strip()
                if len(name) >= self.least and name not in self.stopwords:
                    yield first + m.start(), first + m.end()


# The Hebrew rules' words and weights.
_NAME = "[֐-׿]+"
ROLE_WORDS = ("מעתיק", "העתיק", "כתב", "העתקה", "מחבר", "חיבר", "כותב", "מאת", "חובר", "בעלים", "קנה", "ירש", "רכש", "ברשותו", "מפרש", "פירש", "ביאור", "פירוש", "מתרגם", "תירגם", "תרגום")
TITLES = ("רבי", "הרב", "רבינו", "מורנו", 'הרמב"ם', 'הרמב"ן', "כבוד")
HEBREW_RULES = (
    Known("structured_fields", 1.0),
    Known("cross_field", 1.0, least=2),
    *(Pattern("title", 0.6, rf"{re.escape(t)}\s+({_NAME}(?:\s{_NAME}){{0,2}})") for t in TITLES),
    Pattern("patronymic", 0.5, rf"({_NAME}(?:\s{_NAME})?)\s+(בן|בת|אבן)\s+({_NAME}(?:\s{_NAME})?)"),
    Near("role_keyword", 0.4, ROLE_WORDS, rf"{_NAME}(?:\s{_NAME}){{0,3}}", stopwords=("של", "את", "על", "אל")),
)


def labelled(df: DataFrame, key: str, text: str, rules: tuple = HEBREW_RULES, names: str | None = None) -> DataFrame:
    """All spans that the rules propose; ``names`` is a column of arrays that ``Known`` rules look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for k, content, known in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = ((rule, span) for rule in rules for span in rule.spans(content or "", known or []))
                    rows += [(k, n, *span, rule.label, rule.source, rule.weight) for n, (rule, span) in enumerate(found)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_out)

    names_out = ["key", "ord", "start", "end", "label", "source", "weight"]
    types = [pa.int64() if dict(df.dtypes)[key] == "bigint" else pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.float64()]
    known = F.col(names).cast("array<string>") if names else F.lit(None).cast("array<string>")
    kind = "long" if dict(df.dtypes)[key] == "bigint" else "string"
    rows = df.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"), known.alias("names"))
    return rows.mapInArrow(run, f"key {kind}, ord long, start long, end long, label string, source string, weight double")


def _elected(island: list[tuple], share: float) -> list[tuple]:
    """The elected span of each group of an island's spans ``ord, start, end, label, source, weight``.

    In proposed order, a span joins the first group with a member that it overlaps
    by ``share`` of the shorter one.
    """
    groups: list[dict[tuple, list]] = []  # of each distinct span its first vote, its weight and its votes
    for ord_, start, end, label, source, weight in sorted(island):
        for own in groups:
            if any(min(e, end) - max(s, start) > 0 and min(e, end) - max(s, start) >= share * min(e - s, end - start) for s, e in own):
                break
        else:
            groups.append(own := {})
        held = own.setdefault((start, end), [(ord_, label, source), 0.0, 0])
        held[1] += weight
        held[2] += 1
    out = []
    for own in groups:
        ranked = min((-round(w, 9), first, span) for span, (first, w, _) in own.items())
        out.append((*ranked[2], *ranked[1][1:], -ranked[0], sum(round(w, 9) for _, w, _ in own.values()), sum(n for _, _, n in own.values())))
    return out


def voted(spans: DataFrame, share: float = 0.5) -> DataFrame:
    """For each group of overlapping spans the span of the largest summed weight (ties: first proposed).

    ``key, start, end, label, source`` (of that span's first vote), ``confidence``
    (its share of the group's weight), ``num_votes``.  Spans without a place take no
    part.  Groups lie within islands, runs of spans that touch none of another run:
    one shuffle brings a text's spans together in order, and a task holds a batch of
    them and the island that goes on behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "end", "label", "source", "w", "total", "num_votes"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        rest: pa.Table | None = None  # the last island, which the next batch may go on with

        def chosen(rows: pa.Table, begun: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Islands of one span as they are, the others elected one by one."""
            sizes = np.diff(np.append(begun, rows.num_rows))
            alone = rows.take(begun[sizes == 1])
            held = pa.Table.from_arrays([*(alone[c] for c in ("key", "start", "end", "label", "source", "weight", "weight")), pa.array(np.ones(alone.num_rows, np.int64))], names=names)
            yield from held.to_batches()
            several = rows.take(np.flatnonzero(np.repeat(sizes > 1, sizes)))
            spans = list(zip(*(several[c].to_pylist() for c in several.column_names[1:]), strict=True))
            ends = np.cumsum(sizes[sizes > 1]).tolist()
            found = [_elected(spans[i:j], share) for i, j in zip([0, *ends], ends, strict=False)]
            if found:
                owners = several["key"].take(np.repeat([0, *ends[:-1]], [len(x) for x in found])).combine_chunks()
                columns = zip(*(x for each in found for x in each), strict=True)
                yield pa.RecordBatch.from_arrays([owners, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not rows.num_rows:
                continue
            codes = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh = np.append(True, codes[1:] != codes[:-1])
            start, end = (rows[c].to_numpy() for c in ("start", "end"))
            # Each text's ends are lifted above those of the text before, so that one running maximum serves all.
            lift = np.cumsum(fresh) * (int(end.max()) - int(end.min()) + 1)
            reach = np.maximum.accumulate(end + lift)[:-1] - lift[1:]
            begun = np.flatnonzero(fresh | np.append(True, start[1:] >= reach))
            rest = rows.slice(begun[-1])
            yield from chosen(rows.slice(0, begun[-1]), begun[:-1])
        if rest is not None:
            yield from chosen(rest, np.zeros(1, np.int64))

    placed = spans.where("start is not null and end is not null").select("key", *(F.col(c).cast("long").alias(c) for c in ("ord", "start", "end")), "label", "source", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    kind = dict(spans.dtypes)["key"]
    # Dealt by number: small rows that cost much would be left to a few tasks.
    together = dealt(placed, "key").sortWithinPartitions("key", "start", "end", "ord")
    chosen = together.mapInArrow(run, f"key {kind}, start long, end long, label string, source string, w double, total double, num_votes long")
    return chosen.select("key", "start", "end", "label", "source", F.round(F.try_divide("w", "total"), 6).alias("confidence"), "num_votes")


def training_samples(df: DataFrame, key: str, text: str, chosen: DataFrame) -> DataFrame:
    """``key, tokens, tags`` of the texts that have spans: blank-parted tokens, tagged by the spans ``key, start, end, label`` over characters.

    A later span overwrites the tags of an earlier one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch may hold thousands of texts: their tokens are made, and sent, a few texts at a time.
            for at in range(0, batch.num_rows, 64):
                out = []
                for k, content, spans in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", content)]
                    starts, tags = [a for a, _ in tokens], ["O"] * len(tokens)
                    for s in spans:
                        first, last = bisect_right(starts, s["start"]) - 1, bisect_right(starts, s["end"] - 1) - 1
                        if first >= 0 and s["start"] < tokens[first][1] and s["end"] - 1 < tokens[last][1]:
                            tags[first : last + 1] = [f"B-{s['label']}", *[f"I-{s['label']}"] * (last - first)]
                    out.append((k, [content[a:b] for a, b in tokens], tags))
                columns = list(zip(*out, strict=True)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.list_(pa.string()))], names=["key", "tokens", "tags"])

    from bisect import bisect_right

    kind = dict(chosen.dtypes)["key"]
    own = chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    rows = df.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text")).join(own, "key")
    return rows.select("key", "text", "spans").mapInArrow(run, f"key {kind}, tokens array<string>, tags array<string>")
