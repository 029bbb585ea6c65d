"""Reshaping, sampling, error and correlation tables shared by several steps."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thawline.functions.joins import salted_join
from thawline.sources import cut_lineage

SELECT_FEW = 65_536  # distinct values of a group that one task may order
SELECT_CUTS = 256


def select_as(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct names for a pivot: sites, layers or responses, never data values."""
    return [r[0] for r in df.select(col).distinct().orderBy(col).collect()]


def widen(df: DataFrame, ids: list[str], name: str, value: str, names: list | None = None) -> DataFrame:
    names = distinct_values(df, name) if names is None else names
    return df.groupBy(*ids).pivot(name, names).agg(F.first(value, ignorenulls=True))


def lengthen(df: DataFrame, ids: list[str], cols: list[str] | None = None, name: str = "name", value: str = "value") -> DataFrame:
    cols = [c for c in df.columns if c not in ids] if cols is None else cols
    return df.unpivot(ids, cols, name, value)


def densify(df: DataFrame, k1: str, k2: str, value: str, fill: float = 0.0, names: list | None = None) -> DataFrame:
    """Every k1 with every k2, absent and unknown values filled."""
    names = distinct_values(df, k2) if names is None else names
    wide = widen(df, [k1], k2, value, names).fillna(fill, subset=[str(n) for n in names])
    return lengthen(wide, [k1], [str(n) for n in names], k2, value)


def hash_order(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows picked by the hash of their key: random-like, but the same on every run.

    Spark keeps the n smallest of each partition before merging them.
    """
    return (df.withColumn("_h", hash_order(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h"))


def count_desc(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def order_statistics(df: DataFrame, by: list[str], col: str, at: list[tuple[float, Callable[[Column], Column]]],
                     accuracy: int = 10000) -> DataFrame:
    """(by, place, value): exact values at given ranks of each group, for groups of any size.

    `at` lists (share, rank of the group's number of known values); `place` is the position in it. A bounded sketch of
    the values brackets each rank (its error is at most n / accuracy). What lies inside is counted by distinct value.
    While a bracket holds more than SELECT_FEW distinct values, it is cut at SELECT_CUTS of their quantiles, and the
    part that holds the rank is kept. No task orders more than SELECT_FEW values of a group. A group without known
    values has no rows; a null group key names no group.
    """
    slack = 2.0 / accuracy
    ok = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    shares = [min(max(share + s, 0.0), 1.0) for share, _ in at for s in (-slack, slack)]
    bounds = ok.groupBy(*by).agg(F.percentile_approx("_x", shares, accuracy).alias("_b"), F.count(F.lit(1)).alias("_n"))
    ranges = F.array(*[F.struct(F.lit(i).alias("place"), rank(F.col("_n")).cast("long").alias("_rank"),
                                F.col("_b")[2 * i].alias("_lo"), F.col("_b")[2 * i + 1].alias("_hi"))
                       for i, (_, rank) in enumerate(at)])
    key = [*by, "place", "_rank"]
    # Equal values are merged first, so neither a hot group nor a hot value is moved row by row. Null: below the bracket.
    merged = ok.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_m"))
    counts = (salted_join(merged, bounds.select(*by, ranges.alias("_at")), by, ["_x"])
              .select(*by, "_x", "_m", F.inline("_at")).filter(F.col("_x") <= F.col("_hi"))
              .groupBy(*key, F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_x")).agg(F.sum("_m").alias("_k")))
    counts = cut_lineage(counts)
    while (counts.groupBy(*key).agg(F.count("_x").alias("n")).agg(F.max("n")).first()[0] or 0) > SELECT_FEW:
        counts = cut_lineage(_narrowed(counts, key))
    picked = _holding(counts, key, "_x")
    return picked.select(*by, "place", F.col("_x").alias("value"))


def _holding(counts: DataFrame, key: list[str], part: str) -> DataFrame:
    """The row of each key whose part holds the rank: counts of the parts before it stay below the rank."""
    w = W.partitionBy(*key).orderBy(F.col(part).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("_c", F.sum("_k").over(w))
    return upto.filter((F.col("_c") >= F.col("_rank")) & (F.col("_c") - F.col("_k") < F.col("_rank")))


def _narrowed(counts: DataFrame, key: list[str]) -> DataFrame:
    """The counts of the part that holds the rank, and one count of all that lies below it."""
    cuts = counts.groupBy(*key).agg(F.percentile_approx("_x", [i / SELECT_CUTS for i in range(1, SELECT_CUTS)], 10000).alias("_s"))
    parts = (salted_join(counts, cuts, key, ["_x"])
             .withColumn("_p", F.when(F.col("_x").isNotNull(), F.size(F.filter("_s", lambda s: s < F.col("_x"))))).drop("_s"))
    held = _holding(parts.groupBy(*key, "_p").agg(F.sum("_k").alias("_k")), key, "_p").select(*key, F.col("_p").alias("_held"))
    kept = salted_join(parts, held, key, ["_x"]).filter(F.col("_p").isNull() | (F.col("_p") <= F.col("_held")))
    return kept.groupBy(*key, F.when(F.col("_p") == F.col("_held"), F.col("_x")).alias("_x")).agg(F.sum("_k").alias("_k"))


def exact_median(df: DataFrame, by: list[str], col: str, accuracy: int = 10000) -> DataFrame:
    """Exact median per group for groups of any size: the mean of the two middle values."""
    middle = [(0.5, lambda n: F.floor((n + 1) / 2)), (0.5, lambda n: F.floor(n / 2) + 1)]
    return order_statistics(df, by, col, middle, accuracy).groupBy(*by).agg((F.sum("value") / 2).alias("median"))


def center(df: DataFrame, col: str) -> DataFrame:
    """One row: mean and median of a column."""
    one = df.withColumn("_g", F.lit(1))
    return (one.groupBy("_g").agg(F.avg(col).alias("mean")).join(exact_median(one, ["_g"], col), "_g")
            .select("mean", "median"))


def error_metrics(df: DataFrame, by: list[str], pre_mean_by: list[str] | None = None) -> DataFrame:
    """Mean and median absolute error, bias and RMSE of ori - imp per group."""
    if pre_mean_by:
        df = (df.groupBy(*pre_mean_by).agg(F.avg("imp").alias("imp"), F.avg("ori").alias("ori"))
              .withColumn("dif", F.col("ori") - F.col("imp")))
    df = df.select(*by, "dif", F.abs("dif").alias("_abs"))
    sums = df.groupBy(*by).agg(F.avg("_abs").alias("mean_abs_err"), F.avg("dif").alias("bias"),
                               F.sqrt(F.avg(F.col("dif") * F.col("dif"))).alias("rmse"))
    med = exact_median(df, by, "_abs").withColumnRenamed("median", "median_abs_err")
    return sums.join(med, by).select(*by, "mean_abs_err", "median_abs_err", "bias", "rmse")


def _moments(cols: list[str], shift: list[float]):
    """Per-task sums of products of every column pair, one small table per task."""
    centre = np.array(shift)

    def run(batches):
        total = None
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float) - centre
            k = ~np.isnan(x)
            x, k = np.where(k, x, 0.0), k.astype(float)
            part = np.stack([k.T @ k, x.T @ k, k.T @ x, x.T @ x, (x * x).T @ k, k.T @ (x * x)])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape[1:])
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(),
                                **{c: total[m].ravel() for m, c in enumerate(("n", "sx", "sy", "sxy", "sxx", "syy"))}})
    return run


def corr_matrix(df: DataFrame, cols: list[str], pairwise: bool = True) -> DataFrame:
    """(var1, var2, r, n) for every pair of columns.

    With `pairwise`, a pair uses the rows where both are known; otherwise a pair with
    an unknown value anywhere has no r. Each task reduces its rows to one
    (columns x columns) table of sums, so the shuffle does not grow with the rows.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    data = data.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    means = data.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows")).first()
    schema = "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double"
    sums = (data.mapInPandas(_moments(cols, [means[c] or 0.0 for c in cols]), schema)
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]))
    vx, vy = (F.col("n") * F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}") for a in "xy")
    flat = (vx <= 1e-12 * F.col("n") * F.col("sxx")) | (vy <= 1e-12 * F.col("n") * F.col("syy")) | (F.col("n") < 2)
    r = F.when(~flat, F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx * vy)))
    if not pairwise:
        r = F.when(F.col("n") == means["_rows"], r)
    names = F.array(*map(F.lit, cols))
    return sums.select(F.element_at(names, F.col("i") + 1).alias("var1"), F.element_at(names, F.col("j") + 1).alias("var2"),
                       r.alias("r"), F.col("n").cast("bigint").alias("n"))


def small_matrix(r: DataFrame) -> tuple[list[str], np.ndarray]:
    """A correlation table as names and a square array: columns squared, not rows."""
    pdf = r.select("var1", "var2", "r").toPandas()
    names = sorted(set(pdf["var1"]))
    at = {n: i for i, n in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    m[[at[a] for a in pdf["var1"]], [at[b] for b in pdf["var2"]]] = pdf["r"]
    return names, m


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, mean, sd, min, q25, median, q75, max) per column; quartiles are exact values of the column."""
    long = lengthen(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "name", "value")
    out = long.groupBy("name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
                                   F.min("value").alias("min"), F.max("value").alias("max"))
    names = ("q25", "median", "q75")
    quartiles = (order_statistics(long, ["name"], "value", [(q, lambda n, q=q: F.greatest(F.ceil(n * q), F.lit(1))) for q in (0.25, 0.5, 0.75)])
                 .groupBy("name").agg(*[F.max(F.when(F.col("place") == i, F.col("value"))).alias(c) for i, c in enumerate(names)]))
    return out.join(quartiles, "name", "left").select("name", "n", "mean", "sd", "min", *names, "max")
