"""Vector best-fit decreasing over counts of equal items.

An item of ``length`` tokens demands (length tokens, 1 document, length^2 attention) of a
bin. Items of one length are alike, so the plan works on their number, and bins with the
same residual capacities are one run of consecutive bin numbers. Filling bin by bin, each
length meets a run at most once and splits at most one, so the size of the plan is bounded
by the capacity, not by the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

RULES = ("norm", "dot")


@dataclass(frozen=True)
class Capacity:
    """What a bin holds in all; ``attention`` counts the pairs of tokens within documents."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("a bin must hold a token of a document")

    @property
    def longest(self) -> int:
        """Tokens of the longest item that fits an empty bin."""
        return min(self.tokens, math.isqrt(self.attention))

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@dataclass(frozen=True)
class Step:
    """Items ``rank`` to ``rank + items - 1`` of a length fill bins from ``bin`` on, ``each`` to a bin, from token ``offset``."""

    length: int
    rank: int
    items: int
    bin: int
    each: int
    offset: int


def _choice(free: np.ndarray, demand: np.ndarray, whole: np.ndarray, weights: np.ndarray, rule: str) -> int:
    """The run whose residuals suit the item best, or -1 if none can take it.

    ``norm``: the least weighted norm of what stays free; ``dot``: the least weighted dot
    product of demand and residuals, so little is free where the item needs much.
    """
    able = np.flatnonzero((free >= demand).all(axis=1))
    if not len(able):
        return -1
    if rule == "norm":
        score = ((((free[able] - demand) / whole) ** 2) * weights).sum(axis=1)
    else:
        score = (free[able] / whole * (demand / whole) * weights).sum(axis=1)
    return int(able[np.argmin(score)])


def plan(counts: Mapping[int, int], capacity: Capacity, weights: tuple[float, float, float], rule: str = "norm") -> tuple[list[Step], int]:
    """Steps that place all items, longest first, and the number of bins."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if any(not 1 <= k <= capacity.longest for k in counts):
        raise ValueError("an item is empty or fits no bin")
    whole, scale = capacity.vector(), np.array(weights, float)
    first, size, free = [], [], np.zeros((0, 3), np.int64)  # runs of bins alike
    steps, bins = [], 0

    def keep(begin: int, number: int, left: np.ndarray) -> None:
        nonlocal free
        if number and left.min() > 0:
            first.append(begin)
            size.append(number)
            free = np.vstack([free, left])

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        rank, left = 0, counts[length]
        while left:
            at = _choice(free, demand, whole, scale, rule)
            if at < 0:
                held = whole
                each = int((held // demand).min())
                begin, number = bins, -(-left // each)
                bins += number
            else:
                held = free[at]
                each, begin, number = int((held // demand).min()), first.pop(at), size.pop(at)
                free = np.delete(free, at, axis=0)
            items = min(left, each * number)
            steps.append(Step(length, rank, items, begin, each, int(capacity.tokens - held[0])))
            filled, some = divmod(items, each)
            keep(begin, filled, held - each * demand)
            keep(begin + filled, 1 if some else 0, held - some * demand)
            keep(begin + filled + (some > 0), number - filled - (some > 0), held)
            rank, left = rank + items, left - items
    return steps, bins
