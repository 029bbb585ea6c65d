"""Missing-value semantics shared by every operator.

The measurements follow the statistical convention that an unknown input gives
an unknown result unless the operator says that unknowns are skipped. SQL
aggregates skip nulls and CASE treats an unknown test as false, so both rules
are spelt out here once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become null."""
    x = _c(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def if_known(test: Column, yes, no) -> Column:
    """Two-way choice that stays unknown when the test is unknown."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test, yes).when(~test, no)


def strict(agg: Callable[[Column], Column], c) -> Column:
    """Aggregate that is null as soon as one input of the group is null."""
    x = _c(c)
    return F.when(F.count(F.lit(1)) == F.count(x), agg(x))


def strict_mean(c) -> Column:
    return strict(F.avg, c)


def safe_corr(x, y) -> Column:
    """Pairwise-complete Pearson correlation; null for a constant or single pair."""
    x, y = _c(x), _c(y)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(px) * F.stddev_pop(py))


def strict_corr(x, y) -> Column:
    x, y = _c(x), _c(y)
    n = F.count(F.lit(1))
    return F.when((n == F.count(x)) & (n == F.count(y)), safe_corr(x, y))


def coef_var(sd, mean) -> Column:
    return F.try_divide(_c(sd), _c(mean))


def round_even(c, digits: int) -> Column:
    return F.bround(_c(c), digits)


def one_decimal_share(c) -> Column:
    """Percent of rows of the group holding a finite value, one decimal."""
    return F.bround(100.0 * F.count(finite(c)) / F.count(F.lit(1)), 1)


def round_cols(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.withColumns({c: round_even(c, digits) for c in cols})
