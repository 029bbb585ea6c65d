"""Cleaning of readings by visits, codes, gaps, bias and incomplete days."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from thawline.functions import (
    clock_seconds, if_known, logger_key, month_index, round_even, safe_corr, strict, strict_mean,
)
from thawline.functions.joins import salted_join
from thawline.functions.ordered import home, last_per_key, step, with_halo

SENSORS = ("T1", "T2", "T3")
VALUES = ("T1", "T2", "T3", "moist")


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return last_per_key(df, keys, order)


def last_visit(readings: DataFrame) -> DataFrame:
    """Latest stamp per site over its loggers, with the logger that has it.

    Take it from the readings before any date window is applied.
    """
    per_logger = readings.groupBy("site", "tomst_id").agg(F.max("datetime").alias("maxdt"))
    return per_logger.groupBy("site").agg(
        F.max(F.struct("maxdt", (-F.col("tomst_id")).alias("_t"), "tomst_id")).alias("_m")
    ).select("site", "_m.tomst_id", "_m.maxdt")


def mask_visits(readings: DataFrame, visits: DataFrame) -> DataFrame:
    """Blank the reading at the visit and the ones right before and after it.

    The neighbours are found by two filtered extremes per logger, which reduce
    before the shuffle, so no ordered pass over a site is needed.
    """
    stamp = F.col("datetime")
    near = (salted_join(readings.select("site", "tomst_id", "datetime"), visits.select("site", "maxdt"), ["site"], ["datetime"])
            .groupBy("site", "tomst_id", "maxdt")
            .agg(F.bool_or(stamp == F.col("maxdt")).alias("_hit"),
                 F.max(F.when(stamp < F.col("maxdt"), stamp)).alias("_prev"),
                 F.min(F.when(stamp > F.col("maxdt"), stamp)).alias("_next"))
            .filter("_hit").drop("_hit"))
    known = salted_join(readings, near, ["site", "tomst_id"], ["datetime"], "left")
    touched = (stamp == F.col("maxdt")) | (stamp == F.col("_prev")) | (stamp == F.col("_next"))
    clear = ~F.coalesce(touched, F.lit(False))
    return known.withColumns({c: F.when(clear, F.col(c)) for c in VALUES}).drop("maxdt", "_prev", "_next")


def daily_diagnostics(readings: DataFrame) -> DataFrame:
    """Eighteen statistics per site, day and logger."""
    keys = ["site", "date", "tomst_id"]
    day = W.partitionBy(*keys).orderBy("datetime")
    steps = readings.withColumn("date", F.to_date("datetime")).withColumns(
        {f"_d{s}": step(s, -1, day) for s in SENSORS})
    out = steps.groupBy(*keys).agg(
        strict(F.stddev_samp, "T1").alias("soil_sd"), strict(F.stddev_samp, "T3").alias("air_sd"),
        strict_mean("T1").alias("soil_mean"), strict_mean("T3").alias("air_mean"),
        strict(F.min, "T1").alias("soil_min"), strict(F.max, "T1").alias("soil_max"),
        strict(F.max, "T2").alias("surf_max"), strict(F.max, "T3").alias("air_max"),
        strict_mean(F.abs(F.col("T3") - F.col("T1"))).alias("mean_diff"), strict(F.min, "moist").alias("moist"),
        F.coalesce(safe_corr("T1", "T3"), F.lit(0.0)).alias("corr"),
        *[F.max(f"_d{s}").alias(f"max_diff_{s}") for s in SENSORS])
    return out.withColumns({
        "sa_diff": F.col("air_mean") - F.col("soil_mean"),
        "sa_max_diff": F.col("air_max") - F.col("soil_max"),
        "ss_max_diff": F.col("surf_max") - F.col("soil_max"),
        "sd_ratio": if_known(F.col("soil_sd") < 1, 0.0, F.try_divide("soil_sd", "air_sd")),
        "probl": F.lit(0)})


def apply_quality(diag: DataFrame, rules: DataFrame) -> DataFrame:
    """Code of the last rule (highest priority) whose date range holds the day, else 0.

    Rules are folded to one row per site, so the join neither multiplies days nor
    needs a second shuffle to reduce them again.
    """
    rule = F.struct("priority", "date_from", "date_to", "code")
    by_site = rules.groupBy("site").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))

    def holds(r):
        day = F.col("date")
        return ((r["date_from"].isNull() | (r["date_from"] <= day))
                & (r["date_to"].isNull() | (r["date_to"] >= day)))

    hit = F.try_element_at(F.filter("_rules", holds), F.lit(-1))["code"]
    return (salted_join(diag, by_site, ["site"], ["date"], "left")
            .withColumn("probl", F.coalesce(hit, F.lit(0)).cast("int")).drop("_rules"))


def regularize(readings: DataFrame, fine: int = 10, coarse: int = 15) -> DataFrame:
    """Add the stamps missing in gaps longer than the coarse interval, values null.

    A gap is filled on the coarse grid when the interval before it is a multiple
    of it (or unknown), else on the fine grid. Inserted rows keep site and logger.
    """
    keys = ["site", "tomst_id"]
    df = readings.filter(F.col("tomst_id").isNotNull()).withColumn("_piece", month_index("datetime"))
    w = W.partitionBy(*keys, "_piece").orderBy("datetime")
    t = clock_seconds("datetime") / 60.0
    stamps = with_halo(df.select(*keys, "datetime", "_piece"), keys, ["datetime"], "_piece", back=2, ahead=0)
    stamps = stamps.withColumns({"_prev": F.lag("datetime").over(w), "_gap": t - F.lag(t).over(w)})
    stamps = stamps.withColumn("_gap_before", F.coalesce(F.lag("_gap").over(w), F.lit(float(coarse))))
    gaps = home(stamps).filter(F.col("_gap") > coarse)
    minutes = F.when(F.col("_gap_before") % coarse == 0, coarse).otherwise(fine)
    # Two levels (hour blocks, then stamps) keep each row's array small in very long gaps.
    count = F.ceil(F.col("_gap") / minutes).cast("int") - 1
    block = 4096
    inserted = (gaps.withColumns({"_m": minutes, "_n": count}).filter("_n > 0")
                .withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block).cast("int"))))
                .withColumn("_k", F.explode(F.sequence(F.col("_b") * block + 1,
                                                       F.least(F.col("_n"), (F.col("_b") + 1) * block))))
                .select(*keys, (F.col("_prev") + F.make_dt_interval(mins=F.col("_k") * F.col("_m")))
                        .cast("timestamp_ntz").alias("datetime")))
    return df.drop("_piece").unionByName(inserted, allowMissingColumns=True)


def stable_readings(readings: DataFrame, max_step: float = 0.125, extra_leads: tuple[int, ...] = ()) -> DataFrame:
    """Readings of a steady spell: the T3 change to the 6 before and to the 1st and
    3rd after stays within `max_step`, with all nine neighbours and all values known.
    """
    keys = ["site", "tomst_id"]
    cols = readings.columns
    cut = with_halo(readings.withColumn("_piece", month_index("datetime")), keys, ["datetime"], "_piece",
                    back=6, ahead=3, carry=["T3"])
    w = W.partitionBy(*keys, "_piece").orderBy("datetime")
    around = {f"_c{k}": F.abs(step("T3", k, w)) for k in (1, 2, 3, 4, 5, 6, -1, -2, -3)}
    tested = [f"_c{k}" for k in (1, 2, 3, 4, 5, 6, -1, -3, *extra_leads)]
    seen = home(cut.withColumns(around))
    return (seen.filter(F.greatest(*tested) <= max_step).na.drop(subset=[*cols, *around]).select(*cols))


def office_days(diag: DataFrame) -> DataFrame:
    """Days a logger was not in the field, without its last one."""
    office = diag.filter(F.col("probl") == 2).select("site", "tomst_id", "date").distinct()
    last = office.groupBy("site", "tomst_id").agg(F.max("date").alias("date"))
    return office.join(last, ["site", "tomst_id", "date"], "left_anti")


def sensor_offsets(readings: DataFrame, diag: DataFrame, max_step: float = 0.125) -> DataFrame:
    """Per logger, each sensor's mean out of the field minus the median of the three means."""
    office = (readings.withColumn("date", F.to_date("datetime"))
              .join(office_days(diag), ["site", "tomst_id", "date"], "left_semi").drop("date"))
    means = stable_readings(office, max_step).groupBy("site", "tomst_id").agg(*[F.avg(s).alias(s) for s in SENSORS])
    middle = F.element_at(F.array_sort(F.array(*SENSORS)), 2)
    offsets = means.select(logger_key().alias("site_id"), "site", "tomst_id", *SENSORS, middle.alias("_m"))
    return offsets.withColumns({s: round_even(F.col(s) - F.col("_m"), 4) for s in SENSORS}).drop("_m")


def apply_offsets(readings: DataFrame, offsets: DataFrame) -> DataFrame:
    """Subtract the offsets; a logger without one is left as it is."""
    off = offsets.select("site", "tomst_id", *[F.col(s).alias(f"_o{s}") for s in SENSORS])
    return (salted_join(readings, off, ["site", "tomst_id"], ["datetime"], "left")
            .withColumns({s: F.col(s) - F.coalesce(F.col(f"_o{s}"), F.lit(0.0)) for s in SENSORS})
            .drop(*[f"_o{s}" for s in SENSORS]))


def drop_office(readings: DataFrame, diag: DataFrame) -> DataFrame:
    """Attach the day's code and drop out-of-field readings; no code drops the row too."""
    keys = ["site", "tomst_id", "date"]
    return (readings.withColumn("date", F.to_date("datetime"))
            .join(diag.select(*keys, "probl"), keys, "left").filter(F.col("probl") != 2))


def mask_incomplete_days(readings: DataFrame) -> DataFrame:
    """Null all measures on days that do not have all 24 hours.

    The hours are collected as bits of one integer, which reduces before the
    shuffle, unlike a distinct count.
    """
    df = readings.withColumn("date", F.to_date("datetime"))
    seen = F.bit_or(F.expr("shiftleft(1, hour(datetime))"))
    hours = df.groupBy("site", "date").agg(F.bit_count(seen).alias("_h"))
    full = F.col("_h") == 24
    return (df.join(hours, ["site", "date"])
            .withColumns({c: F.when(full, F.col(c)) for c in VALUES}).drop("_h"))
