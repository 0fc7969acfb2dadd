"""Cutting stock by column generation: how to fill sequences of fixed length from a histogram of lengths.

The linear program over patterns (how often each length goes into one sequence) starts with patterns of a
single length. Its prices go into an unbounded knapsack, solved by dynamic programming over the capacity, whose
best pattern enters the basis, until no pattern gains more than ``gap``. Patterns are used as often as the program
says, rounded down; what remains is packed first-fit decreasing. Everything here is as large as the number of
lengths, not of documents.
"""

import numpy as np


def _best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """(value, counts) of the most valuable set of lengths that fits."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        n = int(np.searchsorted(lengths, c, "right"))
        if n:
            with_length = value[c - lengths[:n]] + prices[:n]
            k = int(with_length.argmax())
            if with_length[k] > value[c] + 1e-12:
                value[c], choice[c] = with_length[k], k
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(lengths[choice[c]])
    return float(value[capacity]), counts


def _solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, steps: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, use of each) of a nearly optimal basis of the linear program.

    The inverse is only updated; what rounding errors cost shows as demand left over, which is packed anyway.
    """
    n = len(lengths)
    alone = capacity // lengths
    basis = np.diag(alone).astype(float)
    inverse = np.diag(1.0 / alone)
    use = demand / alone
    for _ in range(steps):
        prices = inverse.sum(0)
        value, pattern = _best_pattern(lengths, np.maximum(prices, 0), capacity)
        if value <= 1 + gap:
            break
        entering = inverse @ pattern
        positive = entering > 1e-9
        if not positive.any():
            break
        ratio = np.full(n, np.inf)
        ratio[positive] = use[positive] / entering[positive]
        out = int(ratio.argmin())
        amount = ratio[out]
        use = np.maximum(use - amount * entering, 0)
        use[out] = amount
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
        basis[:, out] = pattern
    return basis.astype(np.int64), use


def _first_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that pack all of ``demand``, each filled with the longest that fit."""
    left, found = demand.copy(), []
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            counts[k] = min(left[k], room // lengths[k])
            room -= int(counts[k] * lengths[k])
            if not room:
                break
        times = int((left[counts > 0] // counts[counts > 0]).min())
        left -= times * counts
        found.append((counts, times))
    return found


def cut_patterns(histogram: dict[int, int], capacity: int, gap: float = 1e-3, steps: int = 4000
                 ) -> list[tuple[dict[int, int], int]]:
    """[(length -> how often in a sequence, number of such sequences)]: covers the histogram exactly."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    basis, use = _solve(lengths, demand.astype(float), capacity, gap, steps)
    left, found = demand.copy(), []
    for k in np.argsort(-use, kind="stable"):
        pattern = basis[:, k]
        used = pattern > 0
        if used.any():
            times = min(int(use[k] + 1e-9), int((left[used] // pattern[used]).min()))
            if times > 0:
                left -= times * pattern
                found.append((pattern, times))
    found += _first_fit(lengths, left, capacity)
    return [({int(a): int(b) for a, b in zip(lengths, p) if b}, t) for p, t in found]
