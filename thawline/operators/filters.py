"""Row filters and value masks on readings and days."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from thawline.functions import clock_seconds, finite, month_index
from thawline.functions.joins import salted_join
from thawline.functions.ordered import home, with_halo
from thawline.functions.tables import LIMITS, OTHER_AREAS, PLOT_DROP_CODES, keep_codes_for
from pyspark.sql import Window as W


def in_window(df: DataFrame, col: str, lo, hi, closed: bool) -> DataFrame:
    """Rows between two dates or stamps; open bounds are local midnights."""
    c = F.col(col)
    kind = dict(df.dtypes)[col]
    lo, hi = F.lit(lo).cast(kind), F.lit(hi).cast(kind)
    return df.filter((c >= lo) & (c <= hi) if closed else (c > lo) & (c < hi))


def half_hours(df: DataFrame, stamp: str = "datetime") -> DataFrame:
    return df.filter(F.minute(stamp).isin(0, 30))


def drop_prefixes(df: DataFrame, prefixes: tuple[str, ...] = OTHER_AREAS, site: str = "site") -> DataFrame:
    other = reduce(lambda a, b: a | b, [F.col(site).startswith(p) for p in prefixes])
    return df.filter(~other)


def code_kept(stage: str, variable: str, network: str = "*", probl: str = "probl") -> Column:
    return F.col(probl).isin(*keep_codes_for(stage, network, variable))


def keep_codes(df: DataFrame, stage: str, variable: str, network: str = "*", probl: str = "probl") -> DataFrame:
    return df.filter(code_kept(stage, variable, network, probl))


def is_covered(prop: str, min_pct: float = 90) -> Column:
    return F.col(prop) >= min_pct


def covered(df: DataFrame, prop: str, min_pct: float = 90) -> DataFrame:
    return df.filter(is_covered(prop, min_pct))


def season(df: DataFrame, months: tuple[int, ...], max_doy: int | None = None, date: str = "date") -> DataFrame:
    out = df.filter(F.month(date).isin(*months))
    return out if max_doy is None else out.filter(F.dayofyear(date) < max_doy)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a known value in every column; NaN counts as unknown."""
    doubles = [c for c, t in df.dtypes if c in cols and t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in doubles}).na.drop(subset=cols)


def supported(df: DataFrame, keys: list[str], stamp: str = "datetime", min_days: int = 3, min_rows: int = 100) -> DataFrame:
    """Groups with more than `min_days` distinct days and more than `min_rows` rows.

    Counted per day first, so that the distinct count needs no expansion and a
    large group is reduced before the shuffle.
    """
    daily = df.groupBy(*keys, F.to_date(stamp).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    good = (daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("_days"), F.sum("_n").alias("_rows"))
            .filter((F.col("_days") > min_days) & (F.col("_rows") > min_rows)))
    return salted_join(df, good.select(*keys), keys, [stamp], "left_semi")


def _with_spacing(df: DataFrame, keys: list[str], order: list[str], stamp: str) -> DataFrame:
    cut = with_halo(df.withColumn("_piece", month_index(stamp)), keys, order, "_piece", carry=[stamp])
    w = W.partitionBy(*keys, "_piece").orderBy(*order)
    t = clock_seconds(stamp) / 60.0
    cut = cut.withColumns({"_before": t - F.lag(t).over(w), "_after": F.lead(t).over(w) - t})
    return home(cut).drop("_piece")


def regular_spacing(df: DataFrame, minutes: tuple[int, ...] = (10, 15), keys: tuple[str, ...] = ("site",),
                    order: tuple[str, ...] = ("datetime",), stamp: str = "datetime") -> DataFrame:
    """Keep readings with a neighbour at a regular interval.

    Where a site still has an interval below the shortest regular one, a reading
    also needs the two intervals around it to add up to twice that, or one of
    them to be unknown.
    """
    keys, order = list(keys), list(order)
    shortest = min(minutes)
    cols = df.columns
    first = _with_spacing(df, keys, order, stamp)
    kept = first.filter(F.col("_before").isin(*minutes) | F.col("_after").isin(*minutes)).select(*cols)
    again = _with_spacing(kept, keys, order, stamp)
    tight = again.groupBy(*keys).agg((F.min("_before") < shortest).alias("_tight"))
    both = F.col("_before") + F.col("_after")
    return (salted_join(again, tight, keys, order)
            .filter(~F.coalesce("_tight", F.lit(False)) | both.isNull() | (both >= 2 * shortest))
            .select(*cols))


def apply_limits(df: DataFrame, network: str, limits=LIMITS, site: str = "site") -> DataFrame:
    """Impossible values to null. A limit for one site adds to the network's."""
    bad: dict[str, Column] = {}
    for net, one_site, var, lo, hi, hi_open in limits:
        if net not in ("*", network) or var not in df.columns:
            continue
        x = F.col(var)
        out = (x < lo) | ((x >= hi) if hi_open else (x > hi))
        if one_site != "*":
            out = out & (F.col(site) == one_site)
        bad[var] = bad[var] | out if var in bad else out
    return df.withColumns({v: F.when(~b, F.col(v)) for v, b in bad.items()})


def plot_masks(df: DataFrame, network: str) -> DataFrame:
    """Values hidden from the final figures, by quality code and frozen soil."""
    out = {v: F.when(~F.col("probl").isin(*codes), F.col(v))
           for (net, v), codes in PLOT_DROP_CODES.items() if net == network}
    out["moist"] = F.when(out["T1"] > 1, out["moist"])
    return df.withColumns(out)
