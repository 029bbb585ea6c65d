"""Sources, sinks, samples, imputation, models and reports."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thawline.operators import impute as I, model as M, report as R, tabular as T
from thawline import sources as X


def test_logger_files_of_both_networks(spark, tmp_path):
    a = tmp_path / "raw" / "10.41"
    a.mkdir(parents=True)
    (a / "data_94204778_0.csv").write_text("0;2020.06.01 00:00;4;1,5;2,5;3,5;900;1\n1;2020.06.01 00:15;4;1,6;2,6;x;901;1\n"
                                           "2;2020.06.01 00:15;4;7,0;2,6;3,6;902;1\n3;broken;4;1;1;1;1;1\n")
    (a / "data_94204778_1.csv").write_text("0;2020.06.01 00:00;4;9,5;2,5;3,5;950;1\n")
    (a / "notes.csv").write_text("0;2020.06.01 00:00;4;9;9;9;9;1\n")
    out = X.read_loggers(spark, str(tmp_path / "raw"), "oulu").orderBy("datetime").collect()
    assert [(r["site"], r["tomst_id"], str(r["datetime"]), r["T1"], r["T3"], r["moist"]) for r in out] == [
        ("Haap.10/41", 94204778, "2020-06-01 02:00:00", 9.5, 3.5, 950.0),
        ("Haap.10/41", 94204778, "2020-06-01 02:15:00", 7.0, 3.6, 902.0)]
    b = tmp_path / "ros"
    b.mkdir()
    (b / "K01_data_94204779_0.csv").write_text("0;2020.06.01 00:00;4;1,5;2,5;3,5;900\n")
    r = X.read_loggers(spark, str(b), "roslin").first()
    assert (r["site"], r["tomst_id"], r["zone"], r["T2"]) == ("K01", 94204779, 4, 2.5)


def test_networks_union_by_name(spark):
    a = spark.createDataFrame([("A", 1, 3, 1.0)], "site string, tomst_id long, error_tomst int, T1 double")
    b = spark.createDataFrame([("B", 0, 2.0)], "site string, probl int, T2 double")
    out = X.union_networks(a, b)
    assert out.columns == ["site", "probl", "T1", "T2"] and out.filter("site = 'A'").first()["probl"] == 3


def test_write_read_pending_results_and_lineage(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.5)], "site string, v double")
    X.write_table(df, str(tmp_path / "t"), partition_by=("site",))
    back = X.read_table(spark, str(tmp_path / "t"), "v double, site string")
    assert sorted((r["site"], r["v"]) for r in back.collect()) == [("A", 1.5), ("B", 2.5)]
    assert X.pending(df, df.filter("v > 2"), ["site"]).first()["site"] == "A"
    for n, v in (("varimp_a", 1), ("varimp_b", 2), ("cvmetrics_a", 3)):
        (tmp_path / f"{n}.csv").write_text(f"predictor,varimp\nx,{v}\n")
    found = X.read_results(spark, str(tmp_path), "varimp", "predictor string, varimp double")
    assert sorted(r["varimp"] for r in found.collect()) == [1.0, 2.0]
    cut = X.cut_lineage(df)
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString() and cut.count() == 2


def test_cells_vertices_points_and_packing(spark, tmp_path):
    spark.createDataFrame([("dem", 0, 1, 1.26)], X.tables.CELL_SCHEMA).write.parquet(str(tmp_path / "c"))
    cells = X.read_cells(spark, str(tmp_path / "c"))
    assert X.pack_cells(cells, 100, "INT2S").first()["value"] == 126
    big = spark.createDataFrame([(400.0,), (-1.0,), (2.5,), (None,)], "value double")
    assert [r["value"] for r in X.pack_cells(big, 1, "INT1U").collect()] == [None, None, 2, None]
    # Packing keeps a value to within half a unit.
    near = spark.createDataFrame([(float(v),) for v in np.linspace(-3, 3, 50)], "v double").withColumn("value", F.col("v"))
    packed = X.pack_cells(near, 100, "INT2S")
    assert packed.filter(F.abs(F.col("value") / 100 - F.col("v")) > 0.005 + 1e-9).count() == 0


def test_hash_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id"))
    pick = lambda d, s: sorted(r["id"] for r in T.hash_sample(d, ["k"], 50, s).collect())
    assert pick(df.repartition(3), 1) == pick(df.repartition(17), 1) != pick(df, 2)


def test_exact_median_of_heavy_ties_and_small_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("ties", float(v)) for v in rng.integers(0, 3, 5001)] + [("even", 1.0), ("even", 4.0), ("one", 7.0)]
    rows += [("wide", float(v)) for v in rng.normal(size=30000)] + [("gap", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r["median"] for r in T.exact_median(df, ["g"], "x", accuracy=200).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).dropna().groupby("g")["x"].median().to_dict()
    assert out == pytest.approx(want)


def test_order_statistics_narrow_until_few_values_remain(spark, monkeypatch):
    monkeypatch.setattr(T, "SELECT_FEW", 8)
    monkeypatch.setattr(T, "SELECT_CUTS", 4)
    rounds, narrowed = [], T._narrowed
    monkeypatch.setattr(T, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    rng = np.random.default_rng(3)
    values = {"hot": np.r_[np.zeros(4000), rng.normal(size=8000)], "heavy": np.exp(rng.normal(scale=100, size=9000)),
              "few": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("gap", None)], "g string, x double").repartition(5)
    ranks = [(0.1, lambda n: F.greatest(F.ceil(n * 0.1), F.lit(1))), (0.5, lambda n: F.ceil(n * 0.5)), (1.0, lambda n: n)]
    out = {(r["g"], r["place"]): r["value"] for r in T.order_statistics(df, ["g"], "x", ranks, accuracy=50).collect()}
    want = {(g, i): np.sort(vs)[max(int(np.ceil(len(vs) * q - 1e-9)), 1) - 1] for g, vs in values.items() for i, q in enumerate((0.1, 0.5, 1.0))}
    assert out == want and len(rounds) > 1


def test_summary_has_exact_quartiles_and_keeps_columns_without_values(spark):
    x = pd.DataFrame({"a": np.random.default_rng(4).normal(size=1001), "b": [None] * 1001}).astype(float)
    rows = {r["name"]: r for r in T.summary(spark.createDataFrame([(float(a), None) for a in x["a"]], "a double, b double"), ["a", "b"]).collect()}
    assert [rows["a"][c] for c in ("q25", "median", "q75")] == [np.sort(x["a"])[k - 1] for k in (251, 501, 751)]
    assert rows["b"]["n"] == 0 and rows["b"]["median"] is None


def test_correlation_matrix_pairs_and_constants(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(rng.normal(size=(300, 4)) + 1e6, columns=list("abcd"))
    x["d"] = 5.0
    x.loc[rng.random(300) < 0.2, "b"] = np.nan
    df = spark.createDataFrame(x).repartition(5)
    r = {(q["var1"], q["var2"]): q for q in T.corr_matrix(df, list("abcd")).collect()}
    assert r["a", "b"]["r"] == pytest.approx(x["a"].corr(x["b"])) and r["a", "b"]["n"] == x["b"].notna().sum()
    assert r["a", "d"]["r"] is None and r["a", "a"]["r"] == pytest.approx(1)
    strict = {(q["var1"], q["var2"]): q["r"] for q in T.corr_matrix(df, list("abcd"), pairwise=False).collect()}
    assert strict["a", "b"] is None and strict["a", "c"] == pytest.approx(x["a"].corr(x["c"]))


def matrix(spark, m, names):
    return spark.createDataFrame([(a, b, float(m[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)],
                                 "var1 string, var2 string, r double")


def test_drop_correlated_and_greedy_set(spark):
    m = [[1, .95, .5, .1], [.95, 1, .2, .1], [.5, .2, 1, .1], [.1, .1, .1, 1]]
    r = matrix(spark, m, list("abcd"))
    assert M.drop_correlated(r, 0.9) == ["a"] and M.drop_correlated(r, 0.99) == []
    score = spark.createDataFrame([("a", .9), ("b", .5), ("c", .7), ("d", .1)], "resp_var string, Rsquared double")
    assert R.greedy_uncorrelated(r, score, 0.7) == ["a", "c", "d"]
    assert R.greedy_uncorrelated(r, score, 0.4) == ["a", "d"]


def test_near_zero_variance_edges(spark):
    df = spark.createDataFrame([(1.0, float(i), 1.0 if i < 97 else 2.0 + i, float(i % 2)) for i in range(100)],
                               "flat double, free double, rare double, even double")
    assert M.near_zero_var(df, ["flat", "free", "rare", "even"]) == ["flat", "rare"]


def test_shuffled_column_is_a_permutation(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 1.0)
    out = M.shuffled(df, "x", ["id"], 3, pieces=5).toPandas()
    assert sorted(out["x"]) == [float(i) for i in range(500)] and (out["x"] != out["id"]).all()


def test_importance_counts_absent_as_zero(spark):
    vi = spark.createDataFrame([("a", "y1", 10.0), ("b", "y1", 5.0), ("a", "y2", 4.0), ("c", "y2", -4.0), ("b", "y3", 2.0)],
                               "predictor string, resp_var string, varimp double")
    out = {r["predictor"]: (r["n"], r["varimp"]) for r in R.importance_summary(vi).collect()}
    # y1: a 1, b .5, c 0; y2: a 1, b .5, c 0; y3: a 0, b 1, c 0
    assert out == {"a": (2, 0.667), "b": (2, 0.667), "c": (1, 0.0)}


def smooth(spark, n=240, hide=0.0, seed=1):
    """Four sites following one season; returns (wide frame with gaps, truth, hidden)."""
    rng = np.random.default_rng(seed)
    day = np.arange(n)
    truth = pd.DataFrame({f"S{k}": 10 * np.sin(day / 40) + k + rng.normal(0, 0.2, n) for k in range(4)})
    hidden = pd.DataFrame(rng.random(truth.shape) < hide, columns=truth.columns)
    wide = truth.mask(hidden)
    wide.insert(0, "date", [dt.date(2021, 1, 1) + dt.timedelta(days=int(i)) for i in day])
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in t) for t in wide.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, S0 double, S1 double, S2 double, S3 double"), truth, hidden


def test_forest_recovers_hidden_cells_and_leaves_known_ones(spark):
    wide, truth, hidden = smooth(spark, hide=0.15)
    opts = dict(trees=20, depth=8, max_sweeps=2, seed=5)
    full, error = I.impute_forest(wide, **opts)
    got = full.orderBy("date").toPandas()[list(truth.columns)].to_numpy(dtype=float)
    known = ~hidden.to_numpy()
    np.testing.assert_array_equal(got[known], truth.to_numpy()[known])
    miss = np.abs(got - truth.to_numpy())[~known].mean()
    mean = np.abs(truth.mask(hidden).mean().to_numpy() - truth.to_numpy())[~known].mean()
    assert miss < mean / 4
    assert all(r["nrmse"] < 0.5 for r in error.collect()) and error.count() == 4
    again, _ = I.impute_forest(wide, report_error=False, **opts)
    np.testing.assert_array_equal(again.orderBy("date").toPandas()[list(truth.columns)].to_numpy(dtype=float), got)


def test_complete_matrix_needs_no_forest(spark):
    wide, truth, _ = smooth(spark, n=30)
    full, error = I.impute_forest(wide)
    assert error is None
    np.testing.assert_allclose(full.orderBy("date").toPandas()[list(truth.columns)].to_numpy(dtype=float), truth)


def test_holdout_hides_whole_months_once(spark):
    rows = [(f"S{s}", dt.date(2021, 1, 1) + dt.timedelta(days=d), 100.0, 0, float(d)) for s in range(3) for d in range(120)]
    days = spark.createDataFrame(rows, "site string, date date, T1_prop double, probl int, T1_mean double")
    train, test = I.holdout(days, "T1_mean", 4, 1)
    assert train.count() + test.count() == 360
    assert test.select("site", "year", "month").distinct().count() == 4
    assert test.join(train.select("site", "year", "month").distinct(), ["site", "year", "month"]).count() == 0


def test_forest_selection_prefers_the_signal(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(300, 5)), columns=["s1", "s2", "n1", "n2", "n3"])
    pdf["y"], pdf["site"] = 3 * pdf["s1"] + 2 * pdf["s2"], [f"p{i}" for i in range(300)]
    df = spark.createDataFrame(pdf).persist()
    xs = ["n1", "s1", "n2", "s2", "n3"]
    kept, sizes = M.rfe(df, "y", xs, [2, 3], folds=2, repeats=1, trees=10, depth=6)
    assert set(kept[:2]) == {"s1", "s2"} and [k for k, _ in sizes] == [2, 3, 5]
    model = M.fit_forest(df, "y", xs, trees=10, depth=6)
    imp = {r["predictor"]: r["varimp"] for r in M.permutation_importance(model, df, "y", xs, ["site"]).collect()}
    assert imp["s1"] > imp["s2"] > max(imp["n1"], imp["n2"], imp["n3"])
    best = M.best_model(M.tune_forest(df, "y", ["s1", "s2"], ((1, 1), (2, 1)), folds=2, trees=10, depth=6)).first()
    assert best["Rsquared"] > 0.8


def test_fit_all_with_everything_done(spark):
    from thawline.operators import model as M
    df = spark.createDataFrame([(f"s{i}", float(i), float(i % 7)) for i in range(30)], "site string, y double, x double")
    done = spark.createDataFrame([("y",)], "resp_var string")
    models, importance, metrics = M.fit_all(df, ["y"], ["x"], done)
    assert models == {} and importance.count() == 0 and metrics.count() == 0
    assert "varimp" in importance.columns and "RMSE" in metrics.columns


def test_shuffled_is_a_permutation(spark):
    from thawline.operators import model as M
    for n in (1, 3, 500):
        df = spark.createDataFrame([(i, float(i) if i % 9 else None) for i in range(n)], "k int, v double")
        got = {r["k"]: r["v"] for r in M.shuffled(df, "v", ["k"], 3).collect()}
        assert sorted(got) == list(range(n))
        assert sorted(x or -1 for x in got.values()) == sorted((float(i) if i % 9 else -1) or -1 for i in range(n))


def test_forest_leaves_out_unknown_columns(spark):
    import datetime as dt

    from thawline.operators import impute as I
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), float(2 * i) if i % 5 else None, None) for i in range(60)]
    wide = spark.createDataFrame(rows, "date date, A double, B double, C double")
    full, _ = I.impute_forest(wide, trees=3, depth=3, max_sweeps=1, report_error=False)
    assert full.columns == ["date", "A", "B"] and full.filter("B is null").count() == 0


def test_logger_files_and_results_are_written_whole_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(7, "2021-01-31 23:00:00", 4, 1.5, None, -2.0, 900.0, 2), (7, "2021-01-31 23:00:00", 4, 9.5, 1.0, 1.0, 901.0, 1),
                                  (7, "2021-02-01 00:00:00", 4, 2.5, 1.0, 1e-7, 902.0, 3), (None, "2021-02-01 00:00:00", 4, 3.5, 1.0, 1.0, 903.0, 4)],
                                 "tomst_id long, t string, zone int, T1 double, T2 double, T3 double, moist double, at int")
    rows = rows.withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    assert X.write_loggers(rows, str(tmp_path / "raw"), F.lit("10.41"), "at") == 2  # months
    back = [(r["site"], r["tomst_id"], r["T1"], r["T2"], r["T3"], r["moist"]) for r in X.read_loggers(spark, str(tmp_path / "raw"), "oulu").orderBy("datetime").collect()]
    assert back == [("Haap.10/41", 7, 1.5, None, -2.0, 900.0), ("Haap.10/41", 7, 2.5, 1.0, 1e-7, 902.0)]
    res = spark.createDataFrame([("a/b", 'x, "y"', 1.0), ("a/b", None, 2.0), ("c", "z", None)], "unit string, name string, v double")
    for _ in range(2):  # a repeated run replaces its files
        assert X.write_results(res, str(tmp_path / "res"), "varimp", "unit", ["unit", "name", "v"]) == 2
    assert sorted(p.name for p in (tmp_path / "res").iterdir()) == ["varimp_a_b.csv", "varimp_c.csv"]
    found = X.read_results(spark, str(tmp_path / "res"), "varimp", "unit string, name string, v double")
    assert {(r["unit"], r["name"], r["v"]) for r in found.collect()} == {tuple(r) for r in res.collect()}
    assert X.write_files(res.limit(0).select(F.col("unit").alias("file"), F.col("name").alias("body")), str(tmp_path / "none")) == 0


def test_cells_of_many_sites_are_made_by_many_tasks(spark, monkeypatch):
    """Every date with every site without a column per site, and no task makes all cells of a run."""
    monkeypatch.setattr(I, "CELLS_A_TASK", 500)
    day = [dt.date(2021, 6, 1) + dt.timedelta(days=i) for i in range(10)]
    rows = [(f"S{s}", day[(s + i) % 10], 100.0, 0, float(s + i)) for s in range(1500) for i in range(4)]
    days = spark.createDataFrame(rows, "site string, date date, T1_prop double, probl int, T1_mean double")
    known = {(r[1], r[0]): r[4] for r in rows}
    long = I.impute_matrix(days, "T1_mean", wide=False)
    got = {(r.date, r.site): r.value for r in long.collect()}
    assert got == {(d, f"S{s}"): known.get((d, f"S{s}")) for d in day for s in range(1500)} and long.count() == 15_000
    cells = I.dense_cells(I.measured_cells(days, ["T1_mean"]))
    assert cells.count() == 15_000 and max(r.n for r in cells.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 2_000
    wide = I.impute_matrix(days.filter("site in ('S1', 'S2')"), "T1_mean")
    assert {(r.date, s): r[s] for r in wide.collect() for s in ("S1", "S2")} == {k: v for k, v in got.items() if k[1] in ("S1", "S2") and k[0] in {r[1] for r in rows if r[0] in ("S1", "S2")}}
