"""Cheapest edits that bring a row sequence into the form ``(s?(ua)+)?``.

States: 0 nothing yet, 1 behind a system row, 2 behind a user row, 3 behind an assistant
row; 0 and 3 may end. In each state one role can be inserted or given to a row, so the
edits' initials D, I, K, R tell a repair in full.

A row is a symbol: what its role is and whether it must go or ends too early. Costs of all
that is still to come are a vector over the states. Going back, only every square root of n-th
vector is stored; going forward, each stretch's vectors are computed again from the stored
one behind it. Vectors are kept less their least cost, which leaves few of them, so a step is a look-up.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

KEEP, DELETE, INSERT, REROLE, CUT = 0, 2, 5, 1, 5
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, MUST_GO, ENDS_EARLY = range(3)
STATES = range(4)
START = 0
#: The state behind the one role that may be inserted or given in each state.
FILLED = (2, 2, 3, 2)
FILLER = ("user", "user", "assistant", "user")
#: By role and state, the state behind a kept row; None where it may not stand.
_KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: Cost of ending in each state, and the insertions for it.
END = (0, 2 * INSERT, INSERT, 0)
AT_END = ("", "II", "I", "")
BLOCK = 1 << 16  # rows whose edits one step works out
_FAR = 1 << 40


def symbol(role: int, fault: int) -> int:
    return 3 * role + fault


def role_of(initial: str) -> int:
    return "sua".find(initial) if initial and initial in "sua" else OTHER


@lru_cache(None)
def _edits(sign: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of a row's own edits, letters ascending."""
    role, fault = divmod(sign, 3)
    found = [("D", DELETE, state)]
    if fault != MUST_GO:
        extra = CUT if fault == ENDS_EARLY else 0
        if _KEPT[role][state] is not None:
            found.append(("K", KEEP + extra, _KEPT[role][state]))
        found.append(("R", REROLE + extra, FILLED[state]))
    return tuple(found)


@lru_cache(1 << 16)
def _costs(sign: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before the row, insertions included, given those behind it."""
    own = [min(cost + after[then] for _, cost, then in _edits(sign, s)) for s in STATES]
    one = [min(own[s], INSERT + own[FILLED[s]]) for s in STATES]
    return tuple(min(one[s], INSERT + one[FILLED[s]]) for s in STATES)


def back(sign: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before the row, less the least of them."""
    costs = _costs(sign, after)
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(1 << 18)
def _ahead(sign: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """The least letters of a cheapest way over the row, the state behind it, and their cost."""
    before = _costs(sign, after)
    for letter, cost, then in _edits(sign, state):
        if letter > "I" and before[state] == INSERT + before[FILLED[state]]:
            break
        if cost + after[then] == before[state]:
            return letter, then, cost
    letters, then, cost = _ahead(sign, after, FILLED[state])
    return "I" + letters, then, cost + INSERT


def walk(symbols: bytes, after: tuple[int, ...] = END, state: int = START) -> tuple[str, int, int]:
    """Letters of the ASCII-least cheapest edits of all rows, the state behind them, and their cost.

    ``after``: costs of what follows the rows, by state. Memory: two square roots of n vectors.
    """
    n = len(symbols)
    step = max(1, math.isqrt(n))
    marks, vector = {}, after  # the vector behind each stretch
    for at in range(n - 1, -1, -1):
        if at == n - 1 or (at + 1) % step == 0:
            marks[at // step] = vector
        vector = back(symbols[at], vector)
    letters, total = [], 0
    for begin in range(0, n, step):
        stretch = symbols[begin : begin + step]
        vectors = [marks[begin // step]]
        for sign in reversed(stretch[1:]):
            vectors.append(back(sign, vectors[-1]))
        for sign in stretch:
            found, state, cost = _ahead(sign, vectors.pop(), state)
            letters.append(found)
            total += cost
    return "".join(letters), state, total


@lru_cache(1 << 16)
def _short(symbols: bytes) -> tuple[str, int]:
    letters, state, cost = walk(symbols)
    return letters + AT_END[state], cost + END[state]


def repair(symbols: bytes) -> tuple[str, int]:
    """Letters and cost of a whole conversation."""
    return _short(symbols) if len(symbols) <= 32 else _short.__wrapped__(symbols)


def _table() -> np.ndarray:
    """By symbol, the least cost from each state before a row to each behind it."""
    out = np.full((12, 4, 4), _FAR, np.int64)
    for sign in range(12):
        for begin in STATES:
            state, paid = begin, 0
            for _ in range(3):  # no, one or two insertions
                for _, cost, then in _edits(sign, state):
                    out[sign, begin, then] = min(out[sign, begin, then], paid + cost)
                state, paid = FILLED[state], paid + INSERT
    return out


def block_costs(symbols: bytes) -> np.ndarray:
    """Least costs over all rows from each state to each, joined pairwise."""
    held = _table()[np.frombuffer(symbols, np.uint8)]
    while len(held) > 1:
        odd = held[-1:] if len(held) % 2 else held[:0]
        pairs = (held[0:-1:2, :, :, None] + held[1::2, None, :, :]).min(axis=2)
        held = np.concatenate([np.minimum(pairs, _FAR), odd])
    return held[0]


def vectors_behind(blocks: list[np.ndarray]) -> list[tuple[int, ...]]:
    """For consecutive blocks, the costs of all that follows each."""
    out, vector = [], np.array(END)
    for costs in reversed(blocks):
        out.append(tuple(int(c) for c in vector - vector.min()))
        vector = (costs + vector[None, :]).min(axis=1)
    return out[::-1]
