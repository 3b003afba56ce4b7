"""Poisson draws from a counter instead of a generator.

A draw is a function of (seed of the cell, replicate) alone, so whole blocks are
computed at once and nothing depends on how rows are dealt to tasks or batches.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniforms(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """Numbers in [0, 1), a row a seed and a column a replicate."""
    counters = np.arange(1, replicates + 1, dtype=np.uint64) * _STEP
    return (_mixed(seeds.astype(np.uint64)[:, None] + counters) >> np.uint64(11)) * 2.0 ** -53


@lru_cache(maxsize=64)
def _distribution(rate: int) -> tuple[int, np.ndarray]:
    """(least value, cumulative probabilities) of a Poisson law; what lies more than
    12 standard deviations out has no weight in a double."""
    spread = int(12 * math.sqrt(rate)) + 12
    low = max(0, rate - spread)
    k = np.arange(low, rate + spread + 1)
    # log k! by sums of logarithms from ``low`` on
    start = math.lgamma(low + 1)
    log_factorial = start + np.concatenate([[0.0], np.cumsum(np.log(k[1:].astype(float)))])
    return low, np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial))


def poisson(rates: np.ndarray, seeds: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson numbers, a row for each (rate, seed); rates are whole numbers.

    A rate is drawn as the sum of its powers of two, each by inversion of its own
    table: at most one draw per binary digit, whatever the rate.
    """
    out = np.zeros((len(rates), replicates), np.int64)
    rates, digit = rates.astype(np.int64), 0
    while rates.any():
        rows = np.flatnonzero(rates & 1)
        if len(rows):
            low, law = _distribution(1 << digit)
            own = _mixed(seeds[rows].astype(np.uint64) + np.uint64(digit))
            out[rows] += low + np.searchsorted(law, uniforms(own, replicates), side="right")
        rates, digit = rates >> 1, digit + 1
    return out
