"""Exact statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of a share k / n, within [0, 1]; null if n is 0."""
    p, z2 = k / F.nullif(n, F.lit(0)), F.lit(z * z)
    middle, spread = p + z2 / (2 * n), F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)


def wilson_by_roots(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The same interval as the roots in x of (p - x)^2 = z^2 x (1 - x) / n, a check of the closed form."""
    p, c = k / F.nullif(n, F.lit(0)), F.lit(z * z) / n
    a, b = 1 + c, -(2 * p + c)
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * p * p))
    return F.greatest(F.lit(0.0), (-b - root) / (2 * a)), F.least(F.lit(1.0), (-b + root) / (2 * a))


_SMALL = "array(" + ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(20)) + ")"


def _ln_factorial(n: str) -> str:
    """ln n!: a table below 20, Stirling's series (within 1e-14 there) above."""
    x = f"cast({n} as double)"
    series = f"({x} * ln({x}) - {x} + 0.5D * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * power({x}, 3)) + 1 / (1260 * power({x}, 5)))"
    return f"(case when {n} < 20 then {_SMALL}[cast({n} as int)] else {series} end)"


def fisher_exact(a: str, b: str, c: str, d: str) -> Column:
    """The two-sided p-value of the table [[a, b], [c, d]]: the sum over tables with its margins that are no likelier
    (by more than a factor of 1 + 1e-7). 1 if a margin is 0. The work is in proportion to the smallest margin."""
    row, other, col = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    n = f"({row} + {other})"
    ln = _ln_factorial
    chance = lambda k: f"exp({ln(row)} + {ln(other)} + {ln(col)} + {ln(f'({n} - {col})')} - {ln(n)} - {ln(k)} - {ln(f'({row} - {k})')} - {ln(f'({col} - {k})')} - {ln(f'({other} - {col} + {k})')})"
    lo, hi = f"greatest(0L, {col} - {other})", f"least({row}, {col})"
    total = f"aggregate(sequence({lo}, {hi}), 0D, (s, k) -> s + case when {chance('k')} <= {chance(a)} * (1 + 1e-7D) then {chance('k')} else 0D end)"
    return F.expr(f"case when {row} = 0 or {other} = 0 or {col} = 0 or {n} = {col} then 1D else least(1D, {total}) end")


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where the denominator is 0."""
    share = lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return p, r, share(2 * p * r, p + r)
