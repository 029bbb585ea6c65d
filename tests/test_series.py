"""Ordered operators on small hand-made series, and against plain loops."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from thawline.functions import month_index
from thawline.functions.ordered import home, with_halo
from thawline.operators import daily as D, filters as FL, quality as Q, spikes as S

T0 = dt.datetime(2021, 1, 30)


def stamps(minutes, t0=T0):
    return [t0 + dt.timedelta(minutes=int(m)) for m in minutes]


def series(spark, minutes, values, site="A", cols=("T1", "T2", "T3", "moist"), t0=T0):
    rows = [(site, 7, t, *([None if v is None else float(v)] * len(cols))) for t, v in zip(stamps(minutes, t0), values)]
    return spark.createDataFrame(rows, "site string, tomst_id long, datetime timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("back,ahead", [(1, 1), (1, 0), (0, 1), (3, 3), (6, 3)])
def test_halo_gives_exact_lags_across_pieces(spark, back, ahead):
    rng = np.random.default_rng(back * 10 + ahead)
    # Months of very different length, some with one or two rows.
    day = np.sort(rng.choice(900, 60, replace=False))
    pdf = pd.DataFrame({"k": "a", "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(day, "D"), "v": rng.normal(size=60)})
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("m", month_index("t"))
    w = W.partitionBy("k", "m").orderBy("t")
    cut = with_halo(df, ["k"], ["t"], "m", back, ahead)
    cols = {f"l{i}": F.lag("v", i).over(w) for i in range(1, back + 1)} | {f"f{i}": F.lead("v", i).over(w) for i in range(1, ahead + 1)}
    got = home(cut.withColumns(cols)).orderBy("t").toPandas()
    assert len(got) == 60
    for i in range(1, back + 1):
        np.testing.assert_allclose(got[f"l{i}"], got["v"].shift(i))
    for i in range(1, ahead + 1):
        np.testing.assert_allclose(got[f"f{i}"], got["v"].shift(-i))


def interpolated(spark, values, minutes=None):
    minutes = minutes if minutes is not None else [30 * i for i in range(len(values))]
    out = D.interpolate(series(spark, minutes, values)).orderBy("datetime").toPandas()["T1"]
    return [None if pd.isna(v) else round(v, 6) for v in out]


def test_interpolation_fills_three_but_not_four_and_no_ends(spark):
    assert interpolated(spark, [None, 1, None, None, None, 5, None]) == [None, 1, 2, 3, 4, 5, None]
    assert interpolated(spark, [1, None, None, None, None, 6]) == [1, None, None, None, None, 6]


def test_interpolation_is_linear_in_time_and_crosses_months(spark):
    minutes = [0, 2800, 2870, 2900]  # 30 January 00:00 to 1 February 00:20
    assert interpolated(spark, [0, None, None, 29], minutes) == [0, 28, 28.7, 29]


def test_interpolation_keeps_known_values(spark):
    rng = np.random.default_rng(4)
    values = [None if rng.random() < 0.4 else float(v) for v in rng.normal(size=200)]
    out = interpolated(spark, values)
    assert all(v is None or abs(v - o) < 1e-6 for v, o in zip(values, out))


def test_gap_grid_follows_the_interval_before(spark):
    def filled(minutes):
        out = Q.regularize(series(spark, minutes, [1] * len(minutes))).orderBy("datetime").toPandas()["datetime"]
        return [int((t - pd.Timestamp(T0)).total_seconds() // 60) for t in out]
    assert filled([0, 15, 60]) == [0, 15, 30, 45, 60]
    assert filled([0, 10, 55]) == [0, 10, 20, 30, 40, 50, 55]
    assert filled([0, 60]) == [0, 15, 30, 45, 60]  # nothing before: the coarse grid
    assert filled([0, 15]) == [0, 15]


def test_inserted_rows_keep_site_and_logger(spark):
    out = Q.regularize(series(spark, [0, 60], [1, 2])).filter("T1 is null").select("site", "tomst_id").distinct().collect()
    assert [tuple(r) for r in out] == [("A", 7)]


def test_visit_masks_three_readings_of_every_logger_of_the_site(spark):
    a = series(spark, [0, 10, 20, 30], [1, 2, 3, 4])
    b = series(spark, [10, 20, 30, 40], [1, 2, 3, 4]).withColumn("tomst_id", F.lit(8).cast("long"))
    both = a.unionByName(b)
    out = Q.mask_visits(both, spark.createDataFrame([("A", 7, stamps([20])[0])], "site string, tomst_id long, maxdt timestamp_ntz"))
    kept = sorted((r["tomst_id"], (r["datetime"] - T0).seconds // 60) for r in out.filter("T1 is not null").collect())
    assert kept == [(7, 0), (8, 40)]


def test_visit_outside_the_window_masks_nothing(spark):
    a = series(spark, [0, 10], [1, 2])
    visit = spark.createDataFrame([("A", 7, stamps([99])[0])], "site string, tomst_id long, maxdt timestamp_ntz")
    assert Q.mask_visits(a, visit).filter("T1 is null").count() == 0


def test_later_rule_wins_and_default_is_good(spark):
    days = spark.createDataFrame([("A", dt.date(2021, 1, d)) for d in (1, 5, 8, 20)] + [("B", dt.date(2021, 1, 1))], "site string, date date")
    rules = spark.createDataFrame([("A", None, dt.date(2021, 1, 5), 2, 0), ("A", dt.date(2021, 1, 5), dt.date(2021, 1, 8), 1, 1),
                                   ("A", dt.date(2021, 1, 8), None, 11, 2)],
                                  "site string, date_from date, date_to date, code int, priority int")
    out = {(r["site"], r["date"].day): r["probl"] for r in Q.apply_quality(days, rules).collect()}
    assert out == {("A", 1): 2, ("A", 5): 1, ("A", 8): 11, ("A", 20): 11, ("B", 1): 0}


def test_published_rules_resolve_the_overlapping_site(spark):
    from thawline.functions.tables import quality_rules
    days = spark.createDataFrame([("K27", dt.date(2020, 6, 12)), ("K27", dt.date(2020, 8, 25)), ("K27", dt.date(2020, 6, 1)),
                                  ("K01", dt.date(2020, 6, 17)), ("K01", dt.date(2020, 6, 18))], "site string, date date")
    out = [r["probl"] for r in Q.apply_quality(days, quality_rules(spark)).orderBy("site", "date").collect()]
    assert out == [2, 0, 2, 1, 11]
    assert quality_rules(spark).select("site").distinct().count() == 80


def test_code_join_keeps_two_loggers_apart(spark):
    rows = series(spark, [0, 60], [1, 2]).unionByName(series(spark, [0], [9]).withColumn("tomst_id", F.lit(8).cast("long")))
    diag = spark.createDataFrame([("A", 7, T0.date(), 0), ("A", 8, T0.date(), 2)], "site string, tomst_id long, date date, probl int")
    out = Q.drop_office(rows, diag)
    assert out.count() == 2 and {r["tomst_id"] for r in out.collect()} == {7}


def test_day_with_23_hours_is_blanked(spark):
    full = series(spark, [60 * h for h in range(24)], range(24))
    short = series(spark, [60 * h for h in range(23)], range(23), site="B")
    out = Q.mask_incomplete_days(full.unionByName(short)).groupBy("site").agg(F.count("T1").alias("n")).collect()
    assert {r["site"]: r["n"] for r in out} == {"A": 24, "B": 0}


def test_spacing_drops_the_odd_reading_in_a_tight_site(spark):
    loose = FL.regular_spacing(series(spark, [0, 15, 40, 100, 110], [1] * 5))
    assert [(r["datetime"] - T0).seconds // 60 for r in loose.orderBy("datetime").collect()] == [0, 15, 100, 110]
    tight = FL.regular_spacing(series(spark, [0, 10, 14, 24, 34], [1] * 5))
    assert [(r["datetime"] - T0).seconds // 60 for r in tight.orderBy("datetime").collect()] == [0, 24, 34]


def test_offsets_use_all_but_the_last_office_day(spark):
    rows = [("A", 7, T0 + dt.timedelta(minutes=15 * i), 20.0, 20.5, 20.1, 900.0) for i in range(96 * 2)]
    df = spark.createDataFrame(rows, "site string, tomst_id long, datetime timestamp_ntz, T1 double, T2 double, T3 double, moist double")
    diag = spark.createDataFrame([("A", 7, T0.date() + dt.timedelta(days=i), 2) for i in range(2)],
                                 "site string, tomst_id long, date date, probl int")
    off = Q.sensor_offsets(df, diag)
    r = off.first()
    assert (r["site_id"], r["T1"], r["T2"], r["T3"]) == ("A_7", -0.1, 0.4, 0.0)
    assert Q.apply_offsets(df, off).first()["T2"] == pytest.approx(20.1)
    assert Q.stable_readings(df).count() == 96 * 2 - 9


# --- spikes -----------------------------------------------------------------------------------

def trimmed(x, p, back=71, ahead=72):
    part = x[max(0, p - back):p + ahead + 1]
    if len(part) % 2 == 0:
        return np.mean(part)
    mid = (len(part) + 1) // 2 - 1
    return np.mean(np.delete(part, range(mid - 2, mid + 3)))


@pytest.mark.parametrize("n", [101, 120, 143, 144, 145, 200, 301])
def test_trimmed_mean_equals_a_plain_loop(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    rows = [("A", 1, "T1", T0 + dt.timedelta(minutes=15 * i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "site string, my int, sensor string, datetime timestamp_ntz, v double")
    got = S.trimmed_means(df, {"v": "m"}).orderBy("datetime").toPandas()["m"]
    np.testing.assert_allclose(got, [trimmed(x, p) for p in range(n)], rtol=0, atol=1e-12)


def all_readings(spark, data):
    rows = [(s, stamps([i])[0], p, v, v, v) for s, p, vs in data for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "site string, datetime timestamp_ntz, probl int, T1 double, T2 double, T3 double")


def soil_rows(readings, where):
    return S.sensor_rows(readings.filter(where)).filter("sensor = 'T1' and value is not null")


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_best_peer_order(spark, blocks):
    base = [1.0, 2.0, 4.0, 3.0, 7.0]
    data = [("A", 0, base), ("B", 0, [2 * v for v in base]), ("C", 0, [3 * v for v in base]), ("D", 0, [1.0, 2.0, 4.0, None, 7.0]),
            ("E", 1, base), ("F", 0, [5.0] * 5), ("G", 0, [-v for v in base])]
    every = all_readings(spark, data)
    out = {r["site"]: (r["peer"], r["cor"]) for r in S.best_peer(soil_rows(every, "site in ('A', 'D')"), every, "oulu", blocks).collect()}
    # Equal correlations: the first name; a null, a bad code or a constant series comes last.
    assert out["A"][0] == "B" and out["A"][1] == pytest.approx(1.0)
    assert out["D"][0] == "A" and out["D"][1] == pytest.approx(1.0)


def test_a_month_is_stored_once_whatever_the_blocks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    data = [(f"s{i}", 0, [None if rng.random() < 0.02 else float(v) for v in rng.normal(size=30)]) for i in range(20)]
    every, found, stored = all_readings(spark, data), [], []
    for blocks in (1, 7):
        monkeypatch.setattr(S, "new_folder", lambda spark, name, b=blocks: f"{tmp_path}/{b}")
        plan = S.best_peer(soil_rows(every, "site < 's15'"), every, "oulu", blocks)
        found.append({(r.site, r.my): (r.peer, r.cor) for r in plan.collect()})
        stored.append(spark.read.parquet(f"{tmp_path}/{blocks}").count())
    assert found[0] == found[1] and len(found[0]) > 0
    assert stored == [every.select("site", month_index("datetime")).distinct().count()] * 2


def test_unknown_correlations_still_choose_by_name(spark):
    every = all_readings(spark, [("A", 0, [1.0, 2.0, 3.0]), ("C", 0, [None, 1.0, 2.0]), ("B", 1, [1.0, 2.0, 3.0])])
    out = S.best_peer(soil_rows(every, "site = 'A'"), every, "oulu", 3).first()
    assert (out["peer"], out["cor"]) == ("B", None)


def test_spike_is_found_spread_and_filled(spark):
    rng = np.random.default_rng(0)
    wave = [10 + 5 * np.sin(i / 20) for i in range(480)]
    a = [v + rng.normal(0, 0.02) for v in wave]
    b = [v + 1 for v in wave]
    a[200] += 15
    t0 = dt.datetime(2021, 1, 2)
    rows = [(s, t0 + dt.timedelta(minutes=15 * i), 0, float(v), float(v), float(v)) for s, vs in (("A", a), ("B", b)) for i, v in enumerate(vs)]
    every = spark.createDataFrame(rows, "site string, datetime timestamp_ntz, probl int, T1 double, T2 double, T3 double")
    out = S.correct_spikes(soil_rows(every, "site = 'A'"), every, "oulu", 1).orderBy("datetime").toPandas()
    changed = [i for i in range(480) if abs(out["corrected"][i] - a[i]) > 1e-9]
    # The spike and its two neighbours differ from the peer; the flag reaches one before and four after.
    assert 200 in changed and set(changed) <= set(range(198, 206))
    assert abs(out["corrected"][200] - wave[200]) < 0.2


def test_unknown_neighbour_gives_no_flag(spark):
    rows = [("A", 1, "T1", stamps([i])[0], f) for i, f in enumerate([1, 0, 0, 0, 0, 1, 0, 0, None, 0, 0, 0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "site string, my int, sensor string, datetime timestamp_ntz, flag int")
    out = [r["error"] for r in S.dilate_flags(df).orderBy("datetime").collect()]
    assert out == [None, None, None, None, 1, 1, 1, None, None, None, None, None, None, 0, None]
