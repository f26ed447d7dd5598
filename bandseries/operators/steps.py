"""The least step of a growing grid whose bins part given pairs of times, found by arithmetic and not by walking."""

from __future__ import annotations

from fractions import Fraction
from math import fmod, frexp, ldexp

import numpy as np


class Grid:
    """start, start + step, ... by repeated addition in doubles.

    Between two powers of two, all sums are rounded to one spacing, so each addition adds the same double: the grid is
    some ten stretches of equal steps, whose values need no additions.  Where the step is lost in rounding, it ends.
    """

    def __init__(self, start: float = 1.0, step: float = 0.1) -> None:
        self.stretches: list[tuple[int, float, float, int]] = []  # (first index, first value, added each time, values)
        at, f = 0, start
        while f + step > f:
            added, end = f + step - f, ldexp(1.0, frexp(f)[1])
            n = -((Fraction(f) - Fraction(end)) // Fraction(added))  # values below the next power of two
            self.stretches.append((at, f, added, int(n)))
            at, f = at + int(n), f + (int(n) - 1) * added + step
        self.size = at

    def value(self, k: int) -> float:
        at, f, added, _ = next(s for s in reversed(self.stretches) if s[0] <= k)
        return f + (k - at) * added


def shared(p: float | np.ndarray, t: float | np.ndarray, f: float) -> bool | np.ndarray:
    """Whether two times are in one bin of width 1 / f, by floating remainder as everywhere."""
    width = 1.0 / f
    rest = np.fmod if isinstance(p, np.ndarray) else fmod
    bins = [np.rint((x - rest(x, width)) / width) for x in (p, t)]
    return bins[0] == bins[1]


def first_in(a: int, m: int, lo: int, hi: int) -> int | None:
    """The least x >= 0 with lo <= a x mod m <= hi (0 <= lo <= hi < m), None if there is none; steps as in Euclid's algorithm."""
    if lo == 0:
        return 0
    a %= m
    if a == 0:
        return None
    x = -(-lo // a)
    if a * x <= hi:
        return x
    y = first_in(m % a, a, -hi % a, -lo % a)
    return None if y is None else -(-(lo + m * y) // a)


def next_parted(grid: Grid, p: float, t: float, k: int) -> int | None:
    """The first index from k on at which p < t are in two bins; None if the grid has none.

    They are in two where a whole number lies in (p f, t f].  In a stretch, p f goes up by equal amounts, and its
    fraction has to be within (t - p) f of 1: `first_in` finds where, with room for rounding, and the bins themselves decide.
    Where t f hasn't reached the next whole number, the index at which it does is next.
    """
    if p < 0:  # bins are counted away from 0
        p, t = (-t, -p) if t <= 0 else (0.0, max(-p, t))
    low, high = Fraction(p), Fraction(t)
    for at, f, added, n in grid.stretches:
        j, first, step = max(0, k - at), Fraction(f), Fraction(added)
        unit = low.denominator * high.denominator * first.denominator * step.denominator
        last = first + (n - 1) * step
        room = min(unit, int(((high - low) * last + high * last / 2**50) * unit) + 2)
        spare = int(high * last / 2**50 * unit) + 2
        while j < n:
            here = int(low * (first + j * step) * unit)
            lo = (unit - room - here) % unit
            hi = lo + room + spare
            x = 0 if hi >= unit else first_in(int(low * step * unit), unit, lo, hi)
            if x is None or j + x >= n:
                break
            j += x
            value = f + j * added
            if not shared(p, t, value):
                return at + j
            whole = low * Fraction(value) // 1 + 1
            j = max(j + 1, int((whole / high - first) / step) - 2)
    return None


def first_free(grid: Grid, p: np.ndarray, t: np.ndarray, k: int) -> tuple[float, bool]:
    """(value, whether it's free): the first value from index k on at which no pair (p, t), p < t, shares a bin.

    The closest pair that shares a bin says where to look next.  If the grid ends before, its last value isn't free.
    """
    order = np.argsort(t - p, kind="stable")
    p, t = p[order], t[order]
    while True:
        f = grid.value(k)
        near = int(np.searchsorted(t - p, 1.0 / f + 1e-9, "right"))
        clash = np.flatnonzero(shared(p[:near], t[:near], f))
        if not len(clash):
            return f, True
        found = next_parted(grid, float(p[clash[0]]), float(t[clash[0]]), k + 1)
        if found is None:
            return grid.value(grid.size - 1), False
        k = found
