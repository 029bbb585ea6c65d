"""Site climate variables from imputed days.

Every variable reduces to a value per site and hydrological year and then a mean
over years. `site_variables` computes all of them from one shuffle of the daily
rows on (site, year); the single-family operators share the same building blocks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thawline.functions import coef_var, if_known, strict, strict_mean, with_hydro_calendar

SENSORS = ("T1", "T3")


def hydro(d: DataFrame) -> DataFrame:
    return with_hydro_calendar(d)


def mean_over_years(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[strict_mean(c).alias(c) for c in cols])


def exact_quantile(c, p: float) -> Column:
    return F.percentile(c, p)


def annual_mean(d: DataFrame) -> DataFrame:
    return d.groupBy("site").agg(*[strict_mean(f"{s}_mean").alias(f"{s}_mean") for s in SENSORS])


def monthly_means(d: DataFrame) -> DataFrame:
    out = (d.withColumn("month", F.month("date")).groupBy("site").pivot("month", list(range(1, 13)))
           .agg(*[strict_mean(f"{s}_mean").alias(f"{s}_mean") for s in SENSORS]))
    return out.select("site", *[F.col(f"{m}_{s}_mean").alias(f"{s}_mean_{m}")
                                for s in SENSORS for m in range(1, 13)])


def _clipped(x: Column, threshold: float, side: str) -> Column:
    """x on the wanted side of the threshold, else 0 (the threshold is not subtracted)."""
    outside = x < threshold if side == "above" else x > threshold
    return if_known(outside, 0.0, x)


def _counted(x: Column, threshold: float, side: str) -> Column:
    outside = x < threshold if side == "above" else x > threshold
    return if_known(outside, 0.0, 1.0)


def degree_days(d: DataFrame, threshold: float, side: str, name: str) -> DataFrame:
    names = [f"{s}_{name}" for s in SENSORS]
    per_year = hydro(d).groupBy("site", "year").agg(
        *[strict(F.sum, _clipped(F.col(f"{s}_mean"), threshold, side)).alias(f"{s}_{name}") for s in SENSORS])
    return mean_over_years(per_year, ["site"], names)


def degree_day_counts(d: DataFrame, threshold: float, side: str, name: str) -> DataFrame:
    names = [f"{s}_{name}" for s in SENSORS]
    per_year = hydro(d).groupBy("site", "year").agg(
        *[strict(F.sum, _counted(F.col(f"{s}_mean"), threshold, side)).alias(f"{s}_{name}") for s in SENSORS])
    return mean_over_years(per_year, ["site"], names)


def extreme_quantile(d: DataFrame, stat: str, p: float) -> DataFrame:
    names = [f"{s}_{stat}" for s in SENSORS]
    per_year = hydro(d).groupBy("site", "year").agg(*[exact_quantile(n, p).alias(n) for n in names])
    return mean_over_years(per_year, ["site"], names)


def summer_frost(d: DataFrame) -> DataFrame:
    per_year = (hydro(d).filter(F.col("month").between(5, 8) & (F.col("doy") < 227) & (F.col("T1_mean") >= 1))
                .groupBy("site", "year")
                .agg(strict(F.sum, _clipped(F.col("T3_min"), 0.0, "below")).alias("T3_frost")))
    return mean_over_years(per_year, ["site"], ["T3_frost"])


def season_dates(d: DataFrame, threshold: int) -> DataFrame:
    per_year = (hydro(d).filter((F.col("T1_mean") >= threshold) & (F.col("T3_mean") >= threshold))
                .groupBy("site", "year")
                .agg(F.min("doy").alias(f"sos{threshold}"), F.max("doy").alias(f"eos{threshold}")))
    return mean_over_years(per_year, ["site"], [f"sos{threshold}", f"eos{threshold}"])


def _crossings(hi: Column, lo: Column, prev_lo: Column, min_step: float, inclusive: bool) -> Column:
    """Sign changes of one day's two steps: last minimum -> maximum -> minimum."""
    def one(a: Column, b: Column) -> Column:
        size = F.abs(b - a)
        big = size >= min_step if inclusive else size > min_step
        return F.when(((a >= 0) != (b >= 0)) & big, 1).otherwise(0)
    return one(prev_lo, hi) + one(hi, lo)


# A value exactly one step away in floating point must fall on the same side as in
# the plain difference b - a, hence no rounding above.

def freeze_thaw(d: DataFrame, sensor: str, min_step: float, inclusive: bool) -> DataFrame:
    """Mean yearly count of freeze-thaw steps over the daily max, min sequence.

    The first step of a hydrological year has no earlier sign, so a window per
    (site, year) is exact and holds at most 366 rows.
    """
    w = W.partitionBy("site", "year").orderBy("date")
    lo, hi = F.col(f"{sensor}_min"), F.col(f"{sensor}_max")
    out = f"{sensor}_ft"
    per_year = (hydro(d).withColumn("_n", _crossings(hi, lo, F.lag(lo).over(w), min_step, inclusive))
                .groupBy("site", "year").agg(F.sum("_n").alias(out)))
    return mean_over_years(per_year, ["site"], [out])


def moisture_season(d: DataFrame, months: tuple[int, ...], suffix: str) -> DataFrame:
    stats = (("mean", F.avg), ("max", F.max), ("min", F.min), ("sd", F.stddev_samp))
    names = [f"moist_{s}_{suffix}" for s, _ in stats]
    per_year = (hydro(d).filter((F.col("T1_mean") >= 1) & F.col("month").isin(*months))
                .groupBy("site", "year")
                .agg(*[strict(f, "moist").alias(n) for (_, f), n in zip(stats, names)]))
    return (mean_over_years(per_year, ["site"], names)
            .withColumn(f"moist_cv_{suffix}", coef_var(f"moist_sd_{suffix}", f"moist_mean_{suffix}")))


# Degree-day families: name, threshold, side.
DEGREE_FAMILIES = (("TDD", 0.0, "above"), ("GDD3", 3.0, "above"), ("GDD5", 5.0, "above"), ("FDD", 0.0, "below"))
SEASONS = (("summer", (6, 7, 8)), ("july", (7,)))
FREEZE_STEPS = {"T1": (0.5, False), "T3": (1.0, True)}


def variable_names() -> list[str]:
    out = [f"{s}_mean" for s in SENSORS]
    out += [f"{s}_mean_{m}" for s in SENSORS for m in range(1, 13)]
    out += [f"{s}_{e}" for e in ("min", "max") for s in SENSORS]
    out += [f"{s}_{n}" for n, _, _ in DEGREE_FAMILIES for s in SENSORS]
    out += [f"{s}_{n}_days" for n, _, _ in DEGREE_FAMILIES for s in SENSORS]
    out += ["sos1", "eos1", "sos3", "eos3", "T1_ft", "T3_ft", "T3_frost"]
    out += [f"moist_{k}_{s}" for s, _ in SEASONS for k in ("mean", "max", "min", "sd", "cv")]
    return out


def site_variables(d: DataFrame) -> DataFrame:
    """All 63 variables, one row per site, from one pass over the daily rows."""
    w = W.partitionBy("site", "year").orderBy("date")
    days = hydro(d).withColumns({
        f"_{s}_ft": _crossings(F.col(f"{s}_max"), F.col(f"{s}_min"), F.lag(f"{s}_min").over(w), *FREEZE_STEPS[s])
        for s in SENSORS})

    def among(cond: Column, f, x: Column) -> Column:
        """Strict aggregate over the rows meeting cond."""
        return F.when(F.count_if(cond) == F.count(F.when(cond, x)), f(F.when(cond, x)))

    yearly, finals = [], {}

    def total(name: str, x: Column, cond: Column) -> None:
        # Means over all days are carried as sum, known count and row count.
        yearly.extend([F.sum(F.when(cond, x)).alias(f"{name}__s"), F.count(F.when(cond, x)).alias(f"{name}__k"),
                       F.count_if(cond).alias(f"{name}__n")])
        finals[name] = F.when(F.sum(f"{name}__n") == F.sum(f"{name}__k"),
                              F.try_divide(F.sum(f"{name}__s"), F.sum(f"{name}__k")))

    def per_year(name: str, x: Column, present: Column | None = None) -> None:
        # `present` counts the rows a year contributed; years without any do not exist.
        yearly.append(x.alias(name))
        if present is None:
            finals[name] = strict_mean(name)
        else:
            yearly.append(present.alias(f"{name}__n"))
            finals[name] = F.when(F.count_if(F.col(f"{name}__n") > 0) == F.count(name), F.avg(name))

    for s in SENSORS:
        x = F.col(f"{s}_mean")
        total(f"{s}_mean", x, F.lit(True))
        for m in range(1, 13):
            total(f"{s}_mean_{m}", x, F.col("month") == m)
        per_year(f"{s}_min", exact_quantile(f"{s}_min", 0.005))
        per_year(f"{s}_max", exact_quantile(f"{s}_max", 0.995))
        for n, t, side in DEGREE_FAMILIES:
            per_year(f"{s}_{n}", strict(F.sum, _clipped(x, t, side)))
            per_year(f"{s}_{n}_days", strict(F.sum, _counted(x, t, side)))
        per_year(f"{s}_ft", F.sum(f"_{s}_ft"))
    for t in (1, 3):
        cond = (F.col("T1_mean") >= t) & (F.col("T3_mean") >= t)
        for n, f in (("sos", F.min), ("eos", F.max)):
            per_year(f"{n}{t}", f(F.when(cond, F.col("doy"))), F.count_if(cond))
    frosty = F.col("month").between(5, 8) & (F.col("doy") < 227) & (F.col("T1_mean") >= 1)
    per_year("T3_frost", among(frosty, F.sum, _clipped(F.col("T3_min"), 0.0, "below")), F.count_if(frosty))
    for suffix, months in SEASONS:
        cond = (F.col("T1_mean") >= 1) & F.col("month").isin(*months)
        for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("sd", F.stddev_samp)):
            per_year(f"moist_{n}_{suffix}", among(cond, f, F.col("moist")), F.count_if(cond))

    out = days.groupBy("site", "year").agg(*yearly).groupBy("site").agg(*[v.alias(k) for k, v in finals.items()])
    out = out.withColumns({f"moist_cv_{s}": coef_var(f"moist_sd_{s}", f"moist_mean_{s}") for s, _ in SEASONS})
    return out.select("site", *variable_names())
