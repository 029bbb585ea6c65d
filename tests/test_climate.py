"""Threshold edges of the site variables."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from thawline.operators import climate as C

SCHEMA = ("site string, date date, T1_mean double, T1_min double, T1_max double, T3_mean double, T3_min double, "
          "T3_max double, moist double")


def days(spark, rows):
    """rows: (site, iso date, T1 mean, T1 min, T1 max, T3 mean, T3 min, T3 max, moist)."""
    fixed = [(s, dt.date.fromisoformat(d), *[None if v is None else float(v) for v in r]) for s, d, *r in rows]
    return spark.createDataFrame(fixed, SCHEMA)


def flat(site, day, t, moist=10):
    return (site, day, t, t, t, t, t, t, moist)


def one(df, *cols):
    r = df.first()
    return tuple(r[c] for c in cols)


def test_thresholds_count_the_edge_and_are_not_subtracted(spark):
    d = days(spark, [flat("A", f"2021-01-0{i + 1}", t) for i, t in enumerate((-1, 0, 3, 5))])
    assert one(C.degree_days(d, 0.0, "above", "TDD"), "T1_TDD") == (8.0,)
    assert one(C.degree_days(d, 3.0, "above", "GDD3"), "T1_GDD3") == (8.0,)
    assert one(C.degree_days(d, 5.0, "above", "GDD5"), "T1_GDD5") == (5.0,)
    assert one(C.degree_days(d, 0.0, "below", "FDD"), "T1_FDD") == (-1.0,)
    assert one(C.degree_day_counts(d, 0.0, "above", "TDD_days"), "T1_TDD_days") == (3.0,)
    assert one(C.degree_day_counts(d, 0.0, "below", "FDD_days"), "T1_FDD_days") == (2.0,)


def test_years_start_in_september_and_one_unknown_day_spoils_its_site(spark):
    d = days(spark, [flat("A", "2020-08-31", 4), flat("A", "2020-09-01", 8), flat("B", "2020-08-31", 4), flat("B", "2020-09-01", None)])
    out = {r["site"]: r["T1_GDD3"] for r in C.degree_days(d, 3.0, "above", "GDD3").collect()}
    assert out == {"A": 6.0, "B": None}


def test_freeze_thaw_step_edges(spark):
    def count(sensor, step, inclusive, minmax):
        d = days(spark, [("A", f"2021-01-{i + 1:02d}", 0, lo, hi, 0, lo, hi, 1) for i, (lo, hi) in enumerate(minmax)])
        return one(C.freeze_thaw(d, sensor, step, inclusive), f"{sensor}_ft")[0]
    # A step of exactly 0.5 does not count for the soil, one of exactly 1 does for the air.
    assert count("T1", 0.5, False, [(-0.25, 0.25), (1, 2)]) == 1
    assert count("T3", 1.0, True, [(-0.5, 0.5), (1, 2)]) == 2
    # Zero is on the warm side.
    assert count("T1", 0.5, False, [(0, 1), (0, 2)]) == 0
    # The first value of a year has nothing before it.
    assert count("T1", 0.5, False, [(-3, -2)]) == 0


def test_season_frost_and_moisture(spark):
    d = days(spark, [
        ("A", "2021-05-01", 1, 0, 2, 1, -2, 3, 20), ("A", "2021-07-10", 4, 0, 9, 5, -1, 9, 30),
        ("A", "2021-07-11", 4, 0, 9, 5, 1, 9, 50), ("A", "2021-08-15", 4, 0, 9, 5, -9, 9, 10), ("A", "2021-07-12", 0.5, 0, 1, 5, -4, 9, 99)])
    assert one(C.season_dates(d, 1), "sos1", "eos1") == (121.0, 227.0)
    assert one(C.season_dates(d, 3), "sos3", "eos3") == (191.0, 227.0)
    assert one(C.summer_frost(d), "T3_frost") == (-3.0,)  # 15 August is day 227, 12 July is too cold in the soil
    assert one(C.moisture_season(d, (7,), "july"), "moist_mean_july", "moist_max_july", "moist_min_july") == (40.0, 50.0, 30.0)
    assert one(C.moisture_season(d, (7,), "july"), "moist_cv_july")[0] == pytest.approx(14.142135 / 40)


def test_single_summer_day_has_no_spread(spark):
    d = days(spark, [flat("A", "2021-07-10", 4)])
    assert one(C.moisture_season(d, (7,), "july"), "moist_sd_july", "moist_cv_july", "moist_mean_july") == (None, None, 10.0)


def test_all_variables_equal_the_single_operators(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = []
    for s in "ABC":
        for i in range(500):
            if rng.random() < 0.1:
                continue
            t = rng.normal(2, 6, 6)
            vals = [None if s == "C" and rng.random() < 0.003 else v for v in (t[0], t[1], t[2], t[3], t[4], t[5], rng.uniform(5, 60))]
            rows.append((s, str(dt.date(2019, 10, 1) + dt.timedelta(days=i)), *vals))
    d = days(spark, rows).persist()
    parts = [C.annual_mean(d), C.monthly_means(d), C.summer_frost(d), C.season_dates(d, 1), C.season_dates(d, 3),
             C.extreme_quantile(d, "min", 0.005), C.extreme_quantile(d, "max", 0.995)]
    parts += [C.degree_days(d, t, side, n) for n, t, side in C.DEGREE_FAMILIES]
    parts += [C.degree_day_counts(d, t, side, f"{n}_days") for n, t, side in C.DEGREE_FAMILIES]
    parts += [C.freeze_thaw(d, s, *C.FREEZE_STEPS[s]) for s in C.SENSORS] + [C.moisture_season(d, m, n) for n, m in C.SEASONS]
    want = parts[0].toPandas().set_index("site")
    for p in parts[1:]:
        want = want.join(p.toPandas().set_index("site"))
    got = C.site_variables(d).toPandas().set_index("site")
    assert len(C.variable_names()) == 63 and list(got.columns) == C.variable_names()
    np.testing.assert_allclose(got.sort_index().to_numpy(dtype=float), want[got.columns].sort_index().to_numpy(dtype=float), atol=1e-9)


def test_day_counts_cover_every_day(spark):
    d = days(spark, [flat("A", f"2021-01-{i + 1:02d}", i % 3 - 1) for i in range(20)])
    r = C.site_variables(d).first()
    assert r["T1_TDD_days"] + r["T1_FDD_days"] == 20 + d.filter(F.col("T1_mean") == 0).count()
