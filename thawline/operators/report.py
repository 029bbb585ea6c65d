"""Summaries of fitted models and of correlations."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from thawline.functions import round_even
from thawline.operators.tabular import small_matrix


def rank_models(cv: DataFrame, n: int = 20, best_first: bool = True) -> DataFrame:
    """First n models by R squared, rounded for reading."""
    order = F.desc("Rsquared") if best_first else F.asc("Rsquared")
    return (cv.orderBy(order, "resp_var").limit(n)
            .select("resp_var", round_even("Rsquared", 3).alias("Rsquared"), round_even("RMSE", 2).alias("RMSE"),
                    round_even("MAE", 2).alias("MAE")))


def importance_summary(vi: DataFrame) -> DataFrame:
    """Per predictor: number of models and mean importance rescaled to 0..1 per model.

    A predictor absent from a model counts with importance 0 there. Absent pairs are
    not written out: a model's rescaled zero is the same for all its absent
    predictors, so the mean follows from totals over the pairs that exist.
    """
    predictors = vi.agg(F.count_distinct("predictor")).scalar()
    per_model = vi.groupBy("resp_var").agg(F.min("varimp").alias("_lo"), F.max("varimp").alias("_hi"),
                                           (F.count_distinct("predictor") < predictors).alias("_absent"))
    per_model = per_model.select(
        "resp_var", F.when(F.col("_absent"), F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_absent"), F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi")).alias("_hi"))
    # A model whose importances are all equal is placed in the middle of the range.
    scale = lambda x: F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5))
    zero = per_model.withColumn("_z", scale(F.lit(0.0)))
    all_zero, models = zero.agg(F.sum("_z")).scalar(), zero.agg(F.count(F.lit(1))).scalar()
    pairs = vi.join(zero, "resp_var").select("predictor", (scale(F.col("varimp")) - F.col("_z")).alias("_d"))
    return (pairs.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("_d"))
            .select("predictor", "n", round_even((F.col("_d") + all_zero) / models, 3).alias("varimp"))
            .orderBy(F.desc("n"), "predictor"))


def greedy_uncorrelated(r: DataFrame, score: DataFrame, cutoff: float) -> list[str]:
    """Variables left after dropping, of the most correlated pair, the one whose model
    has the lower R squared, until no absolute correlation exceeds the cutoff.

    Both inputs are per variable or per pair of variables, so the loop runs on a
    small matrix.
    """
    names, m = small_matrix(r)
    a = np.abs(m)
    np.fill_diagonal(a, np.nan)
    r2 = {x["resp_var"]: x["Rsquared"] for x in score.select("resp_var", "Rsquared").collect()}
    alive = list(range(len(names)))
    while len(alive) > 1:
        part = a[np.ix_(alive, alive)]
        if np.isnan(part).all() or np.nanmax(part) <= cutoff:
            break
        i, j = divmod(int(np.nanargmax(part)), len(alive))
        alive.remove(min((alive[i], alive[j]), key=lambda k: (r2[names[k]], names[k])))
    return [names[k] for k in alive]


def corr_difference(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Second minus first correlation matrix."""
    a = r1.select("var1", "var2", F.col("r").alias("_r1"))
    return (r2.select("var1", "var2", "r").join(a, ["var1", "var2"])
            .select("var1", "var2", (F.col("r") - F.col("_r1")).alias("r")))
