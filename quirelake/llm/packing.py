"""Best-fit packing by a configuration linear program over the length histogram.

1. Every whole document becomes token ids with an end id; only documents beyond
   the capacity are cut, into pieces of the full capacity and one rest.
2. Spark counts the pieces of each length: a histogram of ``capacity`` rows at
   most, whatever the corpus holds.
3. The driver solves the configuration linear program on that histogram, as a
   packing in whole copies.  Dual feasible functions (the sizes, and step functions
   of them) give first prices: no configuration is worth more than one, so the
   counts' worth bounds the sequences of any packing, and the function of the
   largest bound is where the multiplicative weights begin.  A length's weight
   falls exponentially as its packed share grows.  In each round a knapsack dynamic
   program over the lengths that lag most prices every room, and the configurations
   worth most around each of them are used, each by a step of its width (the share
   ``STEP`` of its scarcest length), rounded down to whole copies, one at least.  By
   complementary slackness a configuration must be tight: worth at most ``SLACK``
   less than the best one at the first prices.  The rounds end when no tight
   configuration is left.  The counts' worth at a round's prices over the best
   configuration's worth bounds the sequences as well; the largest bound proves the
   gap that is left.
4. What is left goes best fit, largest pieces first.
5. The result is a list of configurations with a number of copies.  Spark ranks
   the pieces of each length (in salted groups, so that a length held by a third
   of all rows is no single task's) and gives rank r the r-th slot.

Nulls: a null text is an empty one (the end id alone); null ids are kept.  Whole
texts are packed, however long.  Repeated rows are packed each; an empty table
gives an empty result; other columns of the input, whatever their names, play no
part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import WORD_LEVEL, encoder, vocabulary
from .shared import slices, written

CAPACITY = 4096
END_ID = 1
#: The share of a length's pieces that a step of the program packs at most.
STEP = 1 / 4
#: So much less than the best configuration a tight one is worth, at most.
SLACK = 0.01
#: Step functions of the sizes that give first prices, by their number of steps.
STEPS = 24
#: The share of the sizes in the first prices, so that of equally tight configurations the fuller one is worth more.
FULLER = 0.1
#: How fast a length's price falls with its packed share.
STEEP = 4.0
#: So much more of the largest pieces than of the smallest is packed at any time: small ones fill what is left.
AHEAD = 2.0
#: The lengths that a round prices: those that lag most.  Each ``BOUND_EVERY``-th round prices all of them for the bound.
POOL = 512
#: The last pieces of a configuration are looked up where they are worth this share of the table's value.
NEAR = 0.98
BOUND_EVERY = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cutter(path: str, end_id: int, capacity: int, keep_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.binary())) if keep_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, False)
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def token_pieces(documents: DataFrame, *, vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cutter(vocab or vocabulary(WORD_LEVEL), end_id, capacity, keep_ids), PIECES + ", ids binary" * keep_ids)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``: the largest total price that fits, and its last piece (-1: one less room does)."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        fit = np.searchsorted(lengths, room, side="right")
        worth = value[room - lengths[:fit]] + prices[:fit]
        k = int(worth.argmax())
        if worth[k] > value[room - 1]:
            value[room], last[room] = worth[k], k
        else:
            value[room] = value[room - 1]
    return value, last


@dataclass
class Program:
    """Configurations (index of length, count) in whole copies, and a lower bound on the sequences of any packing."""

    configurations: dict[tuple[tuple[int, int], ...], int]
    bound: float


class _Stock:
    """What is left of each length, and the pairs of lengths that fill a room exactly."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.left = counts.copy()
        self.lengths = lengths
        self.at = np.full(capacity + 1, -1, np.int64)
        self.at[lengths] = np.arange(len(lengths))
        self.by_size = np.zeros(capacity + 1, np.int64)
        self.by_size[lengths] = counts

    def take(self, k: int, n: int) -> None:
        self.left[k] -= n
        self.by_size[self.lengths[k]] -= n

    def filling(self, room: int, prices: np.ndarray) -> tuple[float, list[int]]:
        """The one or two pieces left that fill ``room`` and are worth most."""
        best, found = -1.0, []
        if self.by_size[room] > 0:
            best, found = float(prices[self.at[room]]), [int(self.at[room])]
        half = room // 2
        small = np.flatnonzero(self.by_size[1 : half + 1]) + 1
        small = small[self.by_size[room - small] > (2 * small == room)]
        if len(small):
            worth = prices[self.at[small]] + prices[self.at[room - small]]
            j = int(worth.argmax())
            if worth[j] > best:
                best, found = float(worth[j]), [int(self.at[small[j]]), int(self.at[room - small[j]])]
        return best, found


def _around(k: int, pool: np.ndarray, prices: np.ndarray, value: np.ndarray, stock: _Stock, capacity: int) -> dict[int, int]:
    """The configuration worth most, by the table, that holds length ``k`` and no more pieces than are left.

    The table's value may count on more pieces of a length than there are, so the
    last one or two pieces are looked up where that is worth as much, or where the
    table leads to a gap.
    """
    taken, room = [k], capacity - int(stock.lengths[k])
    stock.take(k, 1)
    spare: tuple[int, list[int]] | None = None
    sizes = stock.lengths[pool]
    while room > 0:
        worth, last = stock.filling(room, prices)
        if last and worth >= NEAR * value[room]:
            taken, room = taken + last, 0
            for j in last:
                stock.take(j, 1)
            break
        if last:
            spare = (len(taken), last)
        fit = np.searchsorted(sizes, room, side="right")
        gain = np.where(stock.left[pool[:fit]] > 0, prices[pool[:fit]] + value[room - sizes[:fit]], -1.0)
        if not fit or gain.max() < 0:
            break
        j = int(pool[int(gain.argmax())])
        taken.append(j)
        stock.take(j, 1)
        room -= int(stock.lengths[j])
    for j in taken:
        stock.take(j, -1)
    if room and spare:
        taken = taken[: spare[0]] + spare[1]
    return {j: taken.count(j) for j in taken}


def dual_functions(lengths: np.ndarray, capacity: int, steps: int = STEPS) -> Iterator[np.ndarray]:
    """Prices at which no configuration is worth more than one: the sizes, and for each k the steps of k + 1 parts of the capacity.

    Of pieces that fill more than j of k + 1 parts each, parts add up to k at most,
    unless they fill the capacity exactly; those that do so count by their size.
    """
    yield lengths / capacity
    for k in range(1, steps + 1):
        parts = (k + 1) * lengths
        yield np.where(parts % capacity == 0, lengths / capacity, parts // capacity / k)


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Program:
    """Multiplicative weights with knapsack pricing, in whole copies, until no tight configuration is left."""
    stock, found = _Stock(lengths, counts, capacity), {}
    first = max(dual_functions(lengths, capacity), key=lambda f: float((f * counts).sum()))
    bound = float((first * counts).sum())
    base = (1 - FULLER) * first + FULLER * lengths / capacity
    tight = (1 - SLACK) * float(knapsack(lengths, first, capacity)[0][capacity])
    turn, width_of_pool = 0, POOL
    while stock.left.any():
        share = 1 - stock.left / counts - AHEAD * lengths / capacity
        least = share.min()
        prices = base * np.exp(-STEEP * (share - least))
        if turn % BOUND_EVERY == 0:
            bound = max(bound, float((prices * counts).sum() / knapsack(lengths, prices, capacity)[0][capacity]))
        open_ = int((stock.left > 0).sum())
        lagging = np.argsort(np.where(stock.left > 0, share, np.inf), kind="stable")[: min(width_of_pool, open_)]
        pool = np.sort(lagging)
        value, _ = knapsack(lengths[pool], prices[pool], capacity)
        placed = 0
        for k in lagging.tolist():
            if not stock.left[k]:
                continue
            config = _around(k, pool, prices, value, stock, capacity)
            if sum(first[j] * n for j, n in config.items()) < tight:
                continue
            width = min(counts[j] / n for j, n in config.items())
            copies = min(max(1, int(STEP * width)), *(int(stock.left[j]) // n for j, n in config.items()))
            for j, n in config.items():
                stock.take(j, n * copies)
                prices[j] = base[j] * math.exp(-STEEP * (1 - stock.left[j] / counts[j] - AHEAD * lengths[j] / capacity - least))
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0) + copies
            placed += copies
        turn += 1
        if not placed:  # more lengths may fill what these can't
            if width_of_pool >= open_:
                break
            width_of_pool *= 2
    return Program(found, bound)


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, largest first, on a histogram; equal bins are made together.

    A bin takes the largest piece left that fits, again and again; as many copies
    of it are made as the remaining counts allow.
    """
    left = counts.copy()
    bins = []
    while left.any():
        config = np.zeros(len(lengths), np.int64)
        room = capacity
        while True:
            fit = np.searchsorted(lengths, room, side="right")
            open_ = np.flatnonzero(left[:fit] > config[:fit])
            if not len(open_):
                break
            k = open_[-1]
            n = min(room // int(lengths[k]), int(left[k] - config[k]))
            config[k] += n
            room -= n * int(lengths[k])
        used = config > 0
        copies = int((left[used] // config[used]).min())
        left -= copies * config
        bins.append((config, copies))
    return bins


@dataclass
class Plan:
    """Configurations (pairs of length and count, as a matrix) with whole numbers of copies; how many sequences are the program's; and a bound."""

    configurations: list[tuple[np.ndarray, int]]
    by_program: int
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def plan_sequences(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> Plan:
    """The program's configurations, then best fit of what they leave."""
    if not histogram:
        return Plan([], 0, 0)
    lengths, counts = (np.asarray(x, np.int64) for x in zip(*sorted(histogram), strict=True))
    program = configuration_program(lengths, counts, capacity)
    left, plan = counts.copy(), []
    for config, copies in program.configurations.items():
        at, n = np.asarray(config, np.int64).T
        left[at] -= copies * n
        plan.append((np.stack([lengths[at], n], axis=1), copies))
    for config, copies in best_fit(lengths, left, capacity):
        plan.append((np.stack([lengths[config > 0], config[config > 0]], axis=1), copies))
    return Plan(plan, sum(program.configurations.values()), math.ceil(program.bound - 1e-6))


def slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """For each length, its runs of slots: first rank, slots a copy, first sequence, first offset."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, copies in plan:
        offset = 0
        for length, n in config[::-1].tolist():
            out.setdefault(length, []).append((ranks.get(length, 0), n, sequence, offset))
            ranks[length] = ranks.get(length, 0) + n * copies
            offset += n * length
        sequence += copies
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def _placer(runs: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = runs[int(n)]
                row = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
                copy, place = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + copy, row[:, 3] + place * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (as from ``token_pieces``, written) with ``sequence_id`` and ``offset``."""
    histogram = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]  # one row a length
    runs = slots(plan_sequences(histogram, capacity).configurations)
    # Rank within a length: salted groups are counted, and each group's ranks begin where the last one's end.
    salts = max(64, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Rows of one id and text are dealt by their place in the written table, so that a mass of them is no single group.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(runs), PIECES + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, *, vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document and its place in a sequence of at most ``capacity`` ids."""
    return pack_pieces(written(token_pieces(documents, vocab=vocab, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
