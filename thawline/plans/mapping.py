"""Site variables and predictor layers to mapped variables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from thawline.functions import round_even
from thawline.operators import model as M
from thawline.operators.tabular import corr_matrix


def model_inputs(variables: DataFrame, *predictors: DataFrame) -> DataFrame:
    """One row per site with responses and predictors; elevation in decimetres."""
    out = reduce(lambda a, b: a.join(b, "site", "full"), [variables, *predictors])
    return out.withColumn("dem", round_even(F.col("dem") / 10, 0)) if "dem" in out.columns else out


def screen_predictors(table: DataFrame, predictors: list[str], cutoff: float = 0.9) -> list[str]:
    """Predictors that vary and are not nearly the same as another."""
    flat = set(M.near_zero_var(table, predictors))
    left = [p for p in predictors if p not in flat]
    close = set(M.drop_correlated(corr_matrix(table, left), cutoff))
    return [p for p in left if p not in close]


def map_responses(table: DataFrame, stack: DataFrame, responses: list[str], predictors: list[str],
                  done: DataFrame | None = None, **fit) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Predicted cells per response, with importance and metrics; finished responses are skipped."""
    kept = screen_predictors(table, predictors)
    models, importance, metrics = M.fit_all(table, responses, kept, done, **fit)
    return {y: M.predict_cells(m, stack, xs) for y, (m, xs) in models.items()}, importance, metrics
