"""Readings to days, short-gap interpolation, day-level tables over sites."""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thawline.functions import calibrate_moisture, clock_seconds, finite, mask_frozen, month_index, one_decimal_share
from thawline.functions.ordered import home, with_halo
from thawline.functions.tables import STUDY
from thawline.operators.filters import code_kept, drop_prefixes, half_hours, in_window, is_covered

TEMPS = ("T1", "T3")
# Measure name -> (variable whose codes apply, coverage column, months kept or None).
MEASURES = {
    "T1_mean": ("T1", "T1_prop", None), "T1_max": ("T1", "T1_prop", None), "T1_min": ("T1", "T1_prop", None),
    "T3_mean": ("T3", "T3_prop", None), "T3_max": ("T3", "T3_prop", None), "T3_min": ("T3", "T3_prop", None),
    "moist_mean": ("moist", "moist_prop", (6, 7, 8)),
}


def study_readings(cleaned: DataFrame, period: tuple[dt.date, dt.date] = STUDY) -> DataFrame:
    """Half-hour readings of the study period and area."""
    df = half_hours(cleaned).withColumn("date", F.to_date("datetime"))
    return drop_prefixes(in_window(df, "date", *period, closed=True))


def calibrated(readings: DataFrame) -> DataFrame:
    """Moisture counts to volumetric percent, unknown in frozen or faulty rows."""
    df = readings.withColumn("moist", calibrate_moisture("moist"))
    return df.withColumn("moist", mask_frozen("moist", "T1", "probl"))


def interpolate(df: DataFrame, cols: tuple[str, ...] = ("T1", "T2", "T3", "moist"), maxgap: int = 3,
                keys: tuple[str, ...] = ("site",), stamp: str = "datetime") -> DataFrame:
    """Linear in time over runs of at most `maxgap` nulls; ends stay null.

    A fillable run has both anchors within `maxgap` rows, so frames and copied
    rows are that short and no window ever spans a whole site.
    """
    keys = list(keys)
    original = df.columns
    cut = with_halo(df.withColumn("_piece", month_index(stamp)), keys, [stamp], "_piece", maxgap, maxgap, carry=[*cols])
    w = W.partitionBy(*keys, "_piece").orderBy(stamp)
    cut = cut.withColumns({"_t": clock_seconds(stamp), "_p": F.row_number().over(w),
                           **{c: finite(c) for c in cols}})
    anchors = {}
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_p").alias("p"), F.col(c).alias("v")))
        anchors[f"_a_{c}"] = F.last(at, ignorenulls=True).over(w.rowsBetween(-maxgap, -1))
        anchors[f"_b_{c}"] = F.first(at, ignorenulls=True).over(w.rowsBetween(1, maxgap))
    cut = cut.withColumns(anchors)

    def filled(c: str):
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_t") - a["t"], b["t"] - a["t"])
        return F.coalesce(F.col(c), F.when(b["p"] - a["p"] - 1 <= maxgap, line))

    return home(cut.withColumns({c: filled(c) for c in cols})).select(*original)


def daily(readings: DataFrame, keep_all: bool = False) -> DataFrame:
    """Share of finite values and mean, min, max per site and day, unknowns skipped."""
    x = {c: finite(c) for c in ("T1", "T3", "moist")}
    stats = (("mean", F.avg), ("min", F.min), ("max", F.max))
    return readings.withColumn("date", F.to_date("datetime")).groupBy("site", "date").agg(
        *[one_decimal_share(c).alias(f"{c}_prop") for c in ("T1", "T3", "moist")],
        *[f(x[c]).alias(f"{c}_{n}") for c in TEMPS for n, f in stats],
        F.avg(x["moist"]).alias("moist_mean"), F.max("probl").alias("probl"))


def is_usable(measure: str, stage: str = "impute", gate_season: bool = True) -> Column:
    """Days a measure may be used on: enough coverage, accepted code, its months; unknown counts as no."""
    variable, prop, months = MEASURES[measure]
    test = is_covered(prop) & code_kept(stage, variable)
    if months and gate_season:
        test = test & F.month("date").isin(*months)
    return F.coalesce(test, F.lit(False))


def usable(days: DataFrame, measure: str, stage: str = "impute", gate_season: bool = True) -> DataFrame:
    """(site, date, value) of the days a measure may be used on."""
    return days.filter(is_usable(measure, stage, gate_season)).select("site", "date", F.col(measure).alias("value"))


def daily_range(df: DataFrame, cols: tuple[str, str, str], floor0: bool = False) -> DataFrame:
    """Date-wise min of the first, mean of the second, max of the third column over sites."""
    lo, mid, hi = (finite(c) for c in cols)
    out = df.groupBy("date").agg(F.min(lo).alias("Tmin"), F.avg(mid).alias("Tmean"), F.max(hi).alias("Tmax"))
    if floor0:
        out = out.withColumns({c: F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)) for c in ("Tmin", "Tmean", "Tmax")})
    return out


def availability(days: DataFrame, measures: tuple[str, ...] = ("T1_mean", "T3_mean", "moist_mean")) -> DataFrame:
    """Share of sites with data per date and variable.

    The denominator is the number of sites that ever pass the variable's filter. A
    date that only some variables reach has a null share for the others. All variables are counted together: one
    aggregate per date and one per site, whose counts are a single row.
    """
    names = [MEASURES[m][0] for m in measures]
    tests = {v: is_usable(m) for v, m in zip(names, measures)}
    reached = (days.filter("site is not null").groupBy("site").agg(*[F.max(t).alias(v) for v, t in tests.items()])
               .agg(F.struct(*[F.count_if(F.col(v)).alias(v) for v in names])).scalar())
    # A (site, date) is unique in days, so counting rows counts sites.
    counts = [c for m, (v, t) in zip(measures, tests.items())
              for c in (F.count_if(t).alias(f"_rows_{v}"), F.count(F.when(t, F.col(m))).alias(f"_known_{v}"))]
    dates = (days.filter(reduce(lambda a, b: a | b, tests.values())).groupBy("date").agg(*counts)
             .withColumn("_sites", reached))
    wide = dates.select("date", *[F.when(F.col(f"_rows_{v}") > 0, F.col(f"_known_{v}") / F.col(f"_sites.{v}")).alias(v) for v in names])
    return wide.unpivot("date", names, "var", "proportion")
