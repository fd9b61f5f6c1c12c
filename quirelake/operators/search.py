"""Names searched for in texts: all names of a dictionary in one pass, and the window most like a name.

``dictionary_matches`` compiles names into an automaton that a task runs once over
each text; ``record_matches`` does the same with the names of the text's own
record.  ``best_windows`` compares a name with every run of words of a text by
bit-parallel rows of the longest common subsequence, all starting words at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of one automaton; larger dictionaries take a pass for each so many.
BLOCK_NAMES = 100_000
#: What may stand beside a name, the fewest letters of a name and of its significant words, and how near two of them must be.
BOUNDARIES = frozenset(" \t\n.,;:\"|()[]")
LEAST_NAME, LEAST_WORD, NEAR = 3, 3, 30
#: Words of the longest window.
MOST_WORDS = 9
#: Words of the texts that are searched side by side, about.
BLOCK_WORDS = 8_000
#: Letters after which starts that can't reach the best score any more are left out.
CHECK_STEPS = 8


class NameSearch:
    """An automaton over names and over the first two significant words of names of several words."""

    def __init__(self, names: list[str]):
        import ahocorasick

        self.names = sorted({n for n in names if n and len(n) >= LEAST_NAME})
        self.pairs: list[tuple[int, str, str, int]] = []
        held: dict[str, list] = defaultdict(lambda: [None, False])
        for k, name in enumerate(self.names):
            held[name][0] = k
            words = [w for w in name.split() if len(w) >= LEAST_WORD]
            if len(words) >= 2:
                self.pairs.append((k, words[0], words[1], len(words[-1])))
                held[words[0]][1] = held[words[1]][1] = True
        self.automaton = ahocorasick.Automaton()
        for word, (k, of_pair) in held.items():
            self.automaton.add_word(word, (k, of_pair, word))
        if held:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, bool]]:
        """``name's number, start, end, exact``: names between boundaries, or else near places of their first two words.

        A name of several words that stands nowhere in the text, inside other words
        neither, is found where its two words' first places are near.
        """
        out, present, first = [], set(), {}
        if not text or not self.names:
            return out
        for last, (k, of_pair, word) in self.automaton.iter(text):
            start, end = last + 1 - len(word), last + 1
            if k is not None:
                present.add(k)
                if (start == 0 or text[start - 1] in BOUNDARIES) and (end == len(text) or text[end] in BOUNDARIES):
                    out.append((k, start, end, True))
            if of_pair:
                first.setdefault(word, start)
        if first:
            for k, one, two, width in self.pairs:
                if k not in present and one in first and two in first and abs(first[one] - first[two]) < NEAR:
                    out.append((k, min(first[one], first[two]), max(first[one], first[two]) + width, False))
        return out


def _rows(key: pa.DataType, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 5
    types = [key, pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "name", "start", "end", "exact"])


def _kind(df: DataFrame, key: str) -> str:
    return "long" if dict(df.dtypes)[key] in ("bigint", "int") else "string"


def dictionary_matches(texts: DataFrame, key: str, text: str, dictionary: DataFrame, name: str, block: int = BLOCK_NAMES) -> DataFrame:
    """``key, name, start, end, exact``: all names of a dictionary in all texts, one scan for each ``block`` names.

    Both sides must be normalised alike beforehand.  Null texts have no matches.
    """
    names = dictionary.select(F.col(name).alias("name")).where(F.length("name") >= LEAST_NAME).distinct()
    blocks = 1 + names.count() // block
    kind = _kind(texts, key)
    rows = texts.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        own = [r["name"] for r in names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]  # of bounded number

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            search = NameSearch(own)
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    yield _rows(batch.schema.field(0).type, [(i, search.names[n], a, b, exact) for i, x in zip(*(c.to_pylist() for c in part.columns), strict=True) for n, a, b, exact in search.find(x)])

        found = rows.mapInArrow(run, f"key {kind}, name string, start long, end long, exact boolean")
        out = found if out is None else out.unionAll(found)
    return out


def record_matches(df: DataFrame, key: str, text: str, names: str) -> DataFrame:
    """``key, name, start, end, exact``: the names (an array column) of each row in the row's own text."""
    kind = _kind(df, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = []
                for i, x, own in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    search = NameSearch(own or [])
                    found += [(i, search.names[n], a, b, exact) for n, a, b, exact in search.find(x)]
                yield _rows(batch.schema.field(0).type, found)

    rows = df.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"), F.col(names).cast("array<string>").alias("names"))
    return rows.mapInArrow(run, f"key {kind}, name string, start long, end long, exact boolean")


class _Wanted:
    """A name and a text as numbers, with the text's words and the letters' places in the name, one bit each in words of 64."""

    def __init__(self, name: str, context: str, threshold: float, most_words: int):
        name_ = np.array([ord(c) for c in name.lower().strip()], np.int64)
        self.words = [m.span() for m in re.finditer(r"\S+", context)]
        self.length = len(name_) if self.words else 0
        if not self.length:
            return
        lowered = [context[a:b].lower() for a, b in self.words]
        text = np.array([ord(c) for c in " ".join(lowered)], np.int64)
        sizes = np.array([len(w) for w in lowered])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.ends = self.starts + sizes
        # 2 * common / (both lengths) >= threshold bounds a window's length, since common is at most the name's length.
        longest = int(self.length * (2 - threshold) / threshold + 1e-9) if threshold > 0 else len(text)
        order = np.arange(len(self.words))
        self.last = np.minimum(np.searchsorted(self.ends, self.starts + longest, side="right"), np.minimum(order + most_words, len(order)))  # windows end before word `last`
        self.steps = int((np.where(self.last > order, self.ends[np.maximum(self.last - 1, 0)], self.starts) - self.starts).max(initial=0))
        letters, places = np.unique(name_, return_inverse=True)
        masks = np.zeros((-(-self.length // 64), len(letters) + 1), np.uint64)
        for at, letter in enumerate(places.tolist()):
            masks[at // 64, letter] |= np.uint64(1 << (at % 64))
        at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        self.held = masks[:, np.where(letters[at] == text, at, len(letters))]


def _best_of(block: list[_Wanted], threshold: float) -> list[tuple[float, int, int]]:
    """For each text ``score, first word, last word`` of its best window (-1: none), all starts of all texts a letter further each step.

    A cleared bit of a row is a letter of the name that is matched.
    """
    steps, size = max(x.steps for x in block), max(len(x.held) for x in block)
    pad = steps + 2  # beyond a text nothing matches and no word ends
    lengths = [x.held.shape[1] + pad for x in block]
    held, word_end = np.zeros((size, sum(lengths)), np.uint64), np.full(sum(lengths), -1)
    at, own, last, doc = [], [], [], []
    offset = 0
    for k, (x, length) in enumerate(zip(block, lengths, strict=True)):
        held[: len(x.held), offset : offset + x.held.shape[1]] = x.held
        word_end[offset + x.ends] = np.arange(len(x.words))
        at.append(x.starts + offset)
        own.append(np.arange(len(x.words)))
        last.append(x.last)
        doc.append(np.full(len(x.words), k))
        offset += length
    at, own, last, doc = (np.concatenate(c) for c in (at, own, last, doc))
    named = np.array([x.length for x in block])
    full = np.array([[(1 << min(64, max(0, x.length - 64 * w))) - 1 for x in block] for w in range(size)], np.uint64)
    rows = [np.full(len(at), ~np.uint64(0)) for _ in range(size)]
    common = lambda some: sum(np.bitwise_count(~r[some] & f[doc[some]]).astype(np.int64) for r, f in zip(rows, full, strict=True))
    best, least = [(0.0, -1, -1)] * len(block), np.full(len(block), float(threshold))
    for step in range(1, steps + 1):
        carry = None
        for w in range(size):
            hit = held[w].take(at)
            hit &= rows[w]
            total = rows[w] + hit
            if size > 1:
                over = total < hit
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            hit ^= rows[w]
            total |= hit
            rows[w] = total
        at += 1
        closing = word_end.take(at)
        some = np.flatnonzero((closing >= 0) & (closing < last))
        score = 2 * common(some) / (named[doc[some]] + step)
        good = np.flatnonzero(score >= least[doc[some]])
        if len(good):
            some, score = some[good], score[good]
            order = np.lexsort((own[some], -score, doc[some]))  # a text's highest score, then its first start
            for i in order[np.unique(doc[some][order], return_index=True)[1]].tolist():
                k, found = int(doc[some[i]]), (float(score[i]), int(own[some[i]]), int(closing[some[i]]))
                if found[0] > best[k][0] or found[1:] < best[k][1:]:
                    best[k], least[k] = found, max(threshold, found[0])
        if step % CHECK_STEPS == 0 and threshold > 0:
            # What a start left unmatched stays so; a score of `least` bounds how much that may be, were all other letters matched.
            most = 2 * named * (1 - least) / least + 1e-6
            kept = np.flatnonzero(step - common(slice(None)) <= most[doc])
            if len(kept) < 0.8 * len(at):
                rows, at, own, last, doc = [r[kept] for r in rows], at[kept], own[kept], last[kept], doc[kept]
                if not len(kept):
                    break
    return best


def best_of_each(pairs: list[tuple[str | None, str | None]], threshold: float = 0.6, most_words: int = MOST_WORDS) -> list[tuple[float, int, int] | None]:
    """``best_window`` of each name and context: texts are searched side by side, so that a short one costs no steps of its own."""
    found: list[tuple[float, int, int] | None] = [None] * len(pairs)
    block: list[tuple[int, _Wanted]] = []

    def end() -> None:
        for (k, x), (score, first, last) in zip(block, _best_of([x for _, x in block], threshold) if block else [], strict=True):
            found[k] = (score, x.words[first][0], x.words[last][1]) if first >= 0 else None
        block.clear()

    for k, (name, context) in enumerate(pairs):
        if not name or not context:
            continue
        lowered = context.lower()
        at = lowered.find(name.lower())
        if at >= 0 and len(lowered) == len(context):
            found[k] = 1.0, at, at + len(name)
            continue
        x = _Wanted(name, context, threshold, most_words)
        if x.length:
            block.append((k, x))
        if sum(len(x.words) for _, x in block) >= BLOCK_WORDS:
            end()
    end()
    return found


def best_window(name: str, context: str, threshold: float = 0.6, most_words: int = MOST_WORDS) -> tuple[float, int, int] | None:
    """``score, start, end`` of the run of words most like a name, or None.

    An occurrence of the whole name, whatever the case, scores 1.  Else a window of
    up to ``most_words`` words scores twice the longest common subsequence over
    both lengths; of equal scores the first start, then the shortest, wins.  Runs of
    blanks in the context count as one; offsets are those of the context itself.
    """
    return best_of_each([(name, context)], threshold, most_words)[0]


def best_windows(pairs: DataFrame, key: str, name: str, context: str, threshold: float = 0.6) -> DataFrame:
    """``key, name, score, start, end`` for each row whose context holds a window like its name."""
    kind = _kind(pairs, key)
    names = ["key", "name", "score", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, own, contexts = (x.to_pylist() for x in part.columns)
                found = [(k, n, *hit) for k, n, hit in zip(keys, own, best_of_each(list(zip(own, contexts, strict=True)), threshold), strict=True) if hit]
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=names)

    rows = pairs.select(F.col(key).cast(kind).alias("key"), F.col(name).alias("name"), F.col(context).alias("context"))
    return rows.mapInArrow(run, f"key {kind}, name string, score double, start long, end long")
