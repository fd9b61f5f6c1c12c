"""Language identification of whole, possibly mixed texts.

A model holds log probabilities of character n-grams (one to three characters,
with word ends) for each language and the languages seen in each script.  A
word's script narrows its candidates; its score for each of them is the log
posterior under equal priors.  A Viterbi path over the words, with a penalty for
each switch, labels spans; the language that holds most letters is the
prediction and its share of the letters is the score.

The model is fitted on the text and label of labelled rows.  At most about
``FIT_ROWS`` of them are used, chosen by a hash of id and text; the model holds every
n-gram of theirs.  Texts that are null or have no letter are ``und`` with score 0;
with nothing to learn from, every text is.  Ties go to the language whose name
comes first.  Whole texts are read, however long; repeated rows get the same
result each, and an empty table an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TOGETHER, slices

#: The labelled rows that a model is fitted on, at most: their texts bound what the driver and the tasks get.
FIT_ROWS = 20_000
GRAM = 3
SWITCH = 16.0
#: A word's log posteriors are no lower.
FLOOR = -6.0
UNKNOWN = "und"
#: A task forgets its words beyond this number; results don't depend on it.
REMEMBERED = 100_000
#: A script's candidates: the languages that have this share of their letters in it.
SCRIPT_SHARE = 0.02

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)

_WORD = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of a word's first letter."""
    c = ord(next((x for x in word if x.isalpha()), "\0"))
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def letters(word: str) -> int:
    return sum(map(str.isalpha, word))


def grams(word: str) -> Iterator[str]:
    w = f"<{word}>"
    for n in range(1, GRAM + 1):
        for k in range(len(w) - n + 1):
            yield w[k : k + n]


_FIT = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(map(str.lower, _WORD.findall(text)))
    for lang, own in seen.items():
        found: dict[str, Counter] = {"gram": Counter(), "script": Counter()}
        for word, n in own.items():
            found["script"][script(word)] += n * letters(word)
            for g in grams(word):
                found["gram"][g] += n
        for kind, counts in found.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([kind] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=_FIT)


def _threshold(n: int, rows: int) -> int:
    """Below it lie about ``rows`` of ``n`` evenly spread signed 64-bit numbers."""
    return (rows << 64) // n - (1 << 63)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> dict:
    """A model from rows that have a text and a label; the sample of ``rows`` rows bounds its size.

    The model: the languages, each script's candidates, the numbered characters,
    and for each gram length the sorted codes with a row of log probabilities each.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = known.count()
    if n > rows:
        # A threshold on whole 64-bit digests, so that the sample has about ``rows`` rows however many there are.
        known = known.where(F.xxhash64(F.col(id_col), F.col(text_col)) < F.lit(_threshold(n, rows)))
    counts = known.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(_counter, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    language = np.array([langs.index(x) for x in counts["lang"].to_pylist()], np.int64)
    is_gram = np.array([x == "gram" for x in counts["kind"].to_pylist()], bool)
    items, ns = counts["item"].to_pylist(), counts["n"].to_numpy().astype(float)
    rows_of = {g: k for k, g in enumerate(sorted({items[i] for i in np.flatnonzero(is_gram)}))}
    table = np.full((len(rows_of), len(langs)), 0.5)
    at = np.flatnonzero(is_gram)
    table[[rows_of[items[i]] for i in at], language[at]] += ns[at]
    total = np.bincount(language[at], ns[at], len(langs)) + 0.5 * len(rows_of)
    letters_of = "".join(sorted(set("".join(rows_of))))
    number = {c: k for k, c in enumerate(letters_of, 1)}
    grams_of = []
    for size in range(1, GRAM + 1):
        own = [g for g in rows_of if len(g) == size]
        codes = np.array([_code([number[c] for c in g], len(number) + 1) for g in own], np.int64)
        order = np.argsort(codes)
        grams_of.append((codes[order], np.log(table[[rows_of[g] for g in own]][order] / total).astype(np.float32)))
    scripts: dict[str, list[int]] = {}
    for k in range(len(langs)):
        own = {items[i]: ns[i] for i in np.flatnonzero(~is_gram & (language == k))}
        for s, c in own.items():
            if c >= SCRIPT_SHARE * sum(own.values()):
                scripts.setdefault(s, []).append(k)
    return {"langs": langs, "letters": letters_of, "grams": grams_of, "unseen": np.log(0.5 / total), "scripts": scripts}


def _code(numbers: list, base: int):
    """A gram's code: its characters' numbers, as digits."""
    out = 0
    for x in numbers:
        out = out * base + x
    return out


class Scorer:
    """Per-word scores of a model, remembered by word; new words are scored together."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.base = len(model["letters"]) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in model["letters"]]] = np.arange(1, self.base)
        self.grams = [(codes, np.vstack([values, model["unseen"].reshape(1, -1)])) for codes, values in model["grams"]]
        # Candidates of each script; all languages where a script was never seen.
        names = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
        self.allowed = np.array([[k in model["scripts"].get(name, range(len(self.langs))) for k in range(len(self.langs))] for name in names], bool).reshape(len(names), len(self.langs))
        spans = sorted((a, b, names.index(name)) for name, a, b in SCRIPTS)
        self.first, self.last, self.kind = (np.array(x) for x in zip(*spans, strict=True))
        self.other = len(names) - 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))
        self.sizes = np.zeros(1024, np.int64)

    def score(self, words: list[str]) -> np.ndarray:
        """Log posteriors of lower-case words under equal priors, within their scripts' candidates."""
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), lengths)
        number = self.number[points].astype(np.int64)
        found = np.zeros((len(words), len(self.langs)))
        for n, (codes, values) in enumerate(self.grams, 1):
            if len(word) < n:
                break
            last = len(number) - n + 1
            inside = word[:last] == word[n - 1 :]
            code = _code([number[k : k + last] for k in range(n)], self.base)[inside]
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            row = np.where(codes[at] == code, at, len(codes)) if len(codes) else np.zeros(len(code), np.int64)
            for k in range(len(self.langs)):
                found[:, k] += np.bincount(word[:last][inside], values[row, k], len(words))
        begin = points[np.cumsum(lengths) - lengths + 1].astype(np.int64)
        for i in [i for i, w in enumerate(words) if w and not w[0].isalpha()]:
            begin[i] = ord(next((x for x in words[i] if x.isalpha()), "\0"))
        span = np.searchsorted(self.first, begin, side="right") - 1
        kind = np.where((span >= 0) & (begin <= self.last[span]), self.kind[span], self.other)
        allowed = self.allowed[kind]
        found = np.where(allowed, found, np.where(allowed, found, np.inf).min(axis=1, keepdims=True) - 10.0)
        found -= found.max(axis=1, keepdims=True)
        return np.maximum(found - np.log(np.exp(found).sum(axis=1, keepdims=True)), FLOOR)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        at = len(self.known)
        if at + len(new) > len(self.sizes):
            room = 2 * (at + len(new))
            self.rows = np.concatenate([self.rows[:at], np.zeros((room - at, len(self.langs)))])
            self.sizes = np.concatenate([self.sizes[:at], np.zeros(room - at, np.int64)])
        self.rows[at : at + len(new)] = self.score([w.lower() for w in new])
        self.sizes[at : at + len(new)] = [len(w) if w.isalpha() else letters(w) for w in new]
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def lookup(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def path(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each word on the best path, and each word's letters."""
        sizes = self.sizes[ids]
        scores = np.where(sizes[:, None] > 0, self.rows[ids], 0.0)
        return viterbi(scores, SWITCH), sizes


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The states of the path of the largest score, where each change of state costs ``switch``.

    The best single state is the answer if no stretch favours another one by more
    than ``switch``, and the best beginning and the best end together don't
    either: a path's inner stretches then gain less than the changes around them
    cost, and so do its first and last one.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax()) if n else 0
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
    stretch = (gain - np.minimum.accumulate(gain, axis=0)).max(initial=0.0)
    if stretch <= switch and gain.max(initial=0.0) + (gain[-1] - gain.min(axis=0)).max(initial=0.0) <= switch:
        return np.full(n, best)
    here = list(range(k))
    value = [0.0] * k
    back = []
    for row in scores.tolist():
        top = max(value)
        of = value.index(top)
        back.append([j if value[j] >= top - switch else of for j in here])
        value = [(v if v >= top - switch else top - switch) + s for v, s in zip(value, row, strict=True)]
    state = value.index(max(value))
    out = np.empty(n, np.int64)
    for t in range(n - 1, -1, -1):
        out[t] = state
        state = back[t][state]
    return out


def _spans(path: np.ndarray, places: list[tuple[int, int]], langs: list[str]) -> list[dict]:
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]


def _predictor(model: dict, fields: list[str], text_at: int, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, TOGETHER):
            found, scores, spans = [], [], []
            texts = batch.column(text_at).to_pylist()
            if len(scorer.known) > REMEMBERED:
                scorer.forget()
            all_words = [_WORD.findall(t or "") if model["langs"] else [] for t in texts]
            scorer.learn(set().union(*all_words))
            for text, own in zip(texts, all_words, strict=True):
                path, sizes = scorer.path(scorer.lookup(own)) if own else (None, None)
                share = np.bincount(path, sizes, len(model["langs"])) if own else np.zeros(1)
                k = int(share.argmax())
                some = share[k] > 0
                found.append(model["langs"][k] if some else UNKNOWN)
                scores.append(float(share[k] / share.sum()) if some else 0.0)
                if with_spans:
                    spans.append(_spans(path, [m.span() for m in _WORD.finditer(text)], model["langs"]) if some else [])
            columns = [*(batch.column(k) for k in range(len(fields))), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            names = [*fields, "lang_pred", "lang_score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                names.append("lang_spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def predict(documents: DataFrame, model: dict, *, text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``documents`` with ``lang_pred``, ``lang_score`` and, if asked for, ``lang_spans`` (code points, end exclusive).

    Columns of these names in the input are replaced.
    """
    rows = documents.drop("lang_pred", "lang_score", "lang_spans")
    more = ", lang_spans array<struct<start:int,end:int,lang:string>>" if with_spans else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, lang_score double" + more
    return rows.mapInArrow(_predictor(model, rows.columns, rows.columns.index(text_col), with_spans), schema)


def held_out(id_col: str = "doc_id"):
    """One row in five, by the id's checksum: never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def identify_languages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that aren't held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    model = fit(documents.where(~F.coalesce(held_out(id_col), F.lit(True))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
