"""Fill-in-middle samples, cut with a sparse checkpoint index.

Units are runs of ASCII letters and all other code points one by one.  A text's
bytes are counted once, window by window; while counting, the byte and code-point
offsets of every ``STRIDE``-th unit are recorded.  A cut after any number of units
is then found by a binary search of the checkpoints and a rescan of fewer than
``STRIDE`` units from there.  Neither the units nor their offsets are ever held
for a whole text.

Two numbers drawn from the id's digest give the ends of prefix and middle, two
more the form: ``plain`` (the text as it is, also where the text is empty or holds
a mark), ``spm`` or ``psm``.  Marks can't arise where pieces meet, because each
begins and ends with signs of its own, so ``restored`` takes an output apart
without the source text.

Null texts count as empty.  A null id is drawn as the empty string; rows that
share an id are rows of their own with the same draws.  Texts of any length are
read whole, an empty table gives an empty result, and other columns of the input,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Units between two checkpoints.
STRIDE = 512
#: Bytes that are counted at once.
WINDOW = 1 << 16
SEED = 1
#: Percentages: outputs that stay plain, and spm among the others.
PLAIN, SPM = 10, 20
#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_FOLD = np.zeros(256, bool)
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1] = True


def _unit_starts(part: np.ndarray, after_letter: bool) -> np.ndarray:
    """Where units begin in some bytes; ``after_letter``: whether a letter stands right before them."""
    letter = _FOLD[part]
    before = np.empty_like(letter)
    before[0] = after_letter
    before[1:] = letter[:-1]
    return ~(letter & before) & ((part & 0xC0) != 0x80)


class Checkpoints:
    """The sparse index of one text: unit, byte and code-point offsets of every ``stride``-th unit, and the totals."""

    def __init__(self, text: bytes, stride: int = STRIDE, window: int = WINDOW):
        self.data = np.frombuffer(text, np.uint8)
        units = points = 0
        found: list[np.ndarray] = []
        after_letter = False
        for at in range(0, len(self.data), window):
            part = self.data[at : at + window]
            starts = np.flatnonzero(_unit_starts(part, after_letter))
            heads = np.flatnonzero((part & 0xC0) != 0x80)
            some = np.arange(-units % stride, len(starts), stride)
            if len(some):
                found.append(np.stack([units + some, at + starts[some], points + np.searchsorted(heads, starts[some])]))
            units, points, after_letter = units + len(starts), points + len(heads), bool(_FOLD[part[-1]])
        self.units, self.points = units, points
        #: One column a checkpoint: its unit, byte and code point.
        self.offsets = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)

    def locate(self, unit: int) -> tuple[int, int]:
        """The byte and the code point at which a unit begins; the text's end for the number of units."""
        if unit >= self.units:
            return len(self.data), self.points
        near = int(np.searchsorted(self.offsets[0], unit, side="right")) - 1
        counted, byte, point = map(int, self.offsets[:, near])
        size = 4096
        after_letter = False  # a checkpoint begins a unit, so what stands before it doesn't matter
        while True:
            part = self.data[byte : byte + size]
            starts = np.flatnonzero(_unit_starts(part, after_letter))
            if counted + len(starts) > unit:
                at = int(starts[unit - counted])
                return byte + at, point + int(((part[:at] & 0xC0) != 0x80).sum())
            counted, byte, point = counted + len(starts), byte + len(part), point + int(((part & 0xC0) != 0x80).sum())
            after_letter = bool(_FOLD[part[-1]])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four groups of eight hex digits of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(text: bytes, drawn: list[int], *, plain: int = PLAIN, spm: int = SPM, marks: tuple[str, str, str] = MARKS, stride: int = STRIDE) -> tuple[int, str, int | None, int | None, bytes]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    index = Checkpoints(text, stride)
    n = index.units
    p, s, m = (x.encode() for x in marks)
    if not text or any(x in text for x in (p, s, m)) or drawn[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    (a, a_point), (b, b_point) = index.locate(first), index.locate(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if drawn[3] % 100 < spm else "psm"
    parts = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
    return n, form, a_point, b_point - a_point, b"".join(parts)


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def fill_in_middle(documents: DataFrame, *, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, marks: tuple[str, str, str] = MARKS, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n`` (units), ``form, prefix_chars, middle_chars`` (null if plain) and ``output``, the whole sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            rows = [transformed(text, draws(doc, seed), plain=plain, spm=spm, marks=marks, stride=stride) for doc, text in zip(ids, _texts(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *columns], _OUT.types, strict=True)], schema=_OUT)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The source text, from a sample and its form alone."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def checkpoint_index(documents: DataFrame, *, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table, to cut the same texts elsewhere: ``doc_id, n, chars, units, bytes, points`` (arrays, one entry a checkpoint)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("units", "bytes", "points"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [Checkpoints(text, stride) for text in _texts(batch.column(1))]
            columns = [batch.column(0).to_pylist(), [x.units for x in found], [x.points for x in found], *([x.offsets[k].tolist() for x in found] for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, chars long, units array<long>, bytes array<long>, points array<long>")


def sample_digests(samples: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Samples with the digests of their output and of the text that is rebuilt from it."""
    return samples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), marks), 256).alias("restored_sha256"),
    )


#: The registered query for DuckDB.
ORACLE_SQL = f"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(w) AS n, {", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
