"""Column forms of intervals and report texts, and tests on small aggregated tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed value: two-sided 95 % normal quantile ---
Z95 = 1.959963984540054


def wilson_bounds(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; null for n = 0."""
    share = hits / F.when(n > 0, n)
    scale = 1 + z * z / n
    centre = (share + z * z / (2 * n)) / scale
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def mean_from_text(text: Column) -> Column:
    return F.trim(F.split(text, "±")[0]).try_cast("double")


def std_from_text(text: Column) -> Column:
    return F.trim(F.try_element_at(F.split(text, "±"), F.lit(2))).try_cast("double")


def signed_significance(
    delta: Column, p: Column, floor: float = 1e-50, cap: float = 50.0, zero_is_positive: bool = True
) -> Column:
    """Sign of the difference times -log10(p), with p floored and the result capped."""
    positive = (delta >= 0) if zero_is_positive else (delta > 0)
    sign = F.when(positive, 1.0).when(delta.isNotNull(), -1.0)
    return sign * F.least(F.lit(cap), -F.log10(F.greatest(p, F.lit(floor))))


def star(p: Column, level: float = 0.05) -> Column:
    return F.when(p < level, "*").otherwise("")


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta.isNotNull(), "down")


def short_p(p: Column) -> Column:
    """One figure, for a heat-map cell."""
    return (
        F.when(p.isNull(), "—")
        .when(p < 0.001, F.format_string("%.0e", p))
        .otherwise(F.format_string("%.2f", p))
    )


def table_p(p: Column) -> Column:
    """Three figures, for a table cell."""
    return (
        F.when(p.isNull(), "n/a")
        .when(p < 0.01, F.format_string("%.2e", p))
        .otherwise(F.format_string("%.3f", p))
    )


def request_key(*parts) -> Column:
    """sha1 of the request parts, for reuse of equal requests."""
    columns = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.concat_ws("\u001f", *columns))


# --- tests on tables with one row per comparison -----------------------------------------


def mcnemar_probability(b: int, c: int) -> float | None:
    """Exact binomial below 25 discordant pairs, else chi-square with continuity."""
    n = b + c
    if n == 0:
        return None
    if n < 25:
        tail = sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2.0**n
        return min(1.0, 2.0 * tail)
    statistic = (abs(b - c) - 1) ** 2 / n
    return math.erfc(math.sqrt(statistic / 2.0))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for b, c in batches:
        yield pd.Series([mcnemar_probability(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def exact_rank_sum_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p of a tie-free U from the count of arrangements per U value."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    # Gaussian binomial coefficient: multiply by (1 - q^(n2+i)) and divide by (1 - q^i).
    for i in range(1, n1 + 1):
        for j in range(len(ways) - 1, n2 + i - 1, -1):
            ways[j] -= ways[j - n2 - i]
        for j in range(i, len(ways)):
            ways[j] += ways[j - i]
    upper = max(u, n1 * n2 - u)
    return min(1.0, 2.0 * ways[math.ceil(upper) :].sum() / ways.sum())


def rank_sum_probability(u: float, n1: int, n2: int, tie_term: float) -> float | None:
    """Exact for small samples without ties, else normal with tie and continuity terms."""
    if n1 == 0 or n2 == 0:
        return None
    if min(n1, n2) <= 8 and tie_term == 0:
        return exact_rank_sum_p(u, n1, n2)
    n = n1 + n2
    spread = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if spread <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(spread)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def rank_sum_p(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.Series]:
    for u, n1, n2, ties in batches:
        rows = zip(u, n1, n2, ties)
        yield pd.Series(
            [rank_sum_probability(a, int(b), int(c), d) for a, b, c, d in rows], dtype="float64"
        )
