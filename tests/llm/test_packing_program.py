"""The configuration program on histograms of several kinds: every piece placed, the gap proven, few sequences left to best fit."""

import itertools

import numpy as np
import pytest

from quirelake.llm import packing


def histogram(lengths):
    values, counts = np.unique(lengths, return_counts=True)
    return list(zip(values.tolist(), counts.tolist(), strict=True))


RNG = np.random.default_rng(0)
KINDS = {
    "lognormal": np.minimum(1 + RNG.lognormal(6, 1, 55_000).astype(int), 4096), "four lengths": np.repeat([1500, 1700, 2100, 2500], 10_000), "two or three fit": RNG.integers(900, 2800, 50_000), "two fit": RNG.integers(1366, 2049, 50_000), "one fits": np.full(77, 2049), "exact halves": np.full(1001, 2048),
}


@pytest.mark.parametrize("kind", KINDS)
def test_program(kind):
    lengths = KINDS[kind]
    plan = packing.plan_sequences(histogram(lengths))
    used: dict = {}
    for config, copies in plan.configurations:
        assert (config[:, 0] * config[:, 1]).sum() <= 4096
        for length, k in config.tolist():
            used[length] = used.get(length, 0) + k * copies
    assert used == dict(histogram(lengths))
    assert plan.bound <= plan.sequences <= 1.01 * plan.bound
    assert plan.by_program >= 0.9 * plan.sequences


def test_dual_functions_are_feasible():
    """No set of pieces that fits is worth more than one."""
    capacity = 24
    lengths = np.arange(1, capacity + 1)
    for prices in packing.dual_functions(lengths, capacity, 8):
        assert packing.knapsack(lengths, prices, capacity)[0][capacity] <= 1 + 1e-9


def test_few_pieces_against_all_packings():
    rng = np.random.default_rng(1)
    for _ in range(25):
        pieces = rng.integers(1, 11, rng.integers(1, 8)).tolist()
        best = len(pieces)
        for bins in itertools.product(range(len(pieces)), repeat=len(pieces)):
            if len(set(bins)) < best and all(sum(p for p, b in zip(pieces, bins, strict=True) if b == k) <= 10 for k in set(bins)):
                best = len(set(bins))
        plan = packing.plan_sequences(histogram(np.array(pieces)), 10)
        assert plan.bound <= best <= plan.sequences <= best + 1
