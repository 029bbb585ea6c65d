"""Model queries call the functions with their whole design."""
import inspect

import pytest

from thawline.operators import impute as I, model as M
from thawline.plans import q_grid, q_models

SF = "/root/testdata/sf0.001"
DESIGN = {"measures", "rounds", "n", "grid", "folds", "repeats", "trees", "depth", "max_sweeps", "forest", "fit", "mtry", "node"}


class Called(Exception):
    pass


def design_of(monkeypatch, home, name, run):
    """Arguments of the design that `run` passes to home.name, other than the defaults; all arguments."""
    signature = inspect.signature(getattr(home, name))

    def record(*args, **named):
        raise Called(signature.bind(*args, **named).arguments)
    monkeypatch.setattr(home, name, record)
    with pytest.raises(Called) as e:
        run()
    given = e.value.args[0]
    return {k for k, v in given.items() if k in DESIGN and v not in ({}, signature.parameters[k].default)}, given


@pytest.mark.parametrize("home, name, run", [
    (I, "impute_cv", q_models.impute_cv_q), (I, "impute_forest", q_models.impute_forest_error),
    (M, "tune_forest", q_models.grid_search), (M, "tune_forest", q_models.model_metrics), (M, "rfe", q_models.feature_elimination),
    (q_grid.M, "fit_all", q_grid.fit_all_q)])
def test_defaults(spark, monkeypatch, home, name, run):
    cut, given = design_of(monkeypatch, home, name, lambda: run(spark, SF))
    assert not cut and not given.get("forest")
    if name == "rfe":
        assert given["xs"] == q_models.XS and given["sizes"] == list(range(3, len(q_models.XS) + 1))
    if name == "fit_all":
        assert given.get("sizes") is None


def test_climate_and_map_defaults(spark, monkeypatch):
    _, given = design_of(monkeypatch, q_models, "climate_variables", lambda: q_models.climate_variables_q(spark, SF))
    assert not given.get("forest")
    _, given = design_of(monkeypatch, q_grid, "map_responses", lambda: q_grid.map_responses_q(spark, SF))
    assert not given.get("fit")


def test_importance_on_rows_the_forest_has_not_seen(spark, monkeypatch):
    seen = {}

    def fit(rows, *args, **named):
        seen["fitted"] = rows
        cut = {k for k in inspect.signature(real).bind(rows, *args, **named).arguments if k in DESIGN}
        assert not cut
    real = M.fit_forest
    monkeypatch.setattr(M, "fit_forest", fit)
    _, given = design_of(monkeypatch, M, "permutation_importance", lambda: q_models.permutation_importance_q(spark, SF))
    fitted, scored = ({r.vec_id for r in rows.select("vec_id").collect()} for rows in (seen["fitted"], given["df"]))
    assert scored and not fitted & scored and given["xs"] == q_models.XS
