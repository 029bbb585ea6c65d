"""Missing values, constants and ties."""

import pytest
from pyspark.sql import functions as F

from thawline import functions as X


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("one", 1.0, 2.0), ("gap", 1.0, 2.0), ("gap", None, 3.0), ("gap", 4.0, 8.0), ("none", None, None),
            ("flat", 2.0, 1.0), ("flat", 2.0, 3.0), ("flat", 2.0, 4.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_strict_aggregates_are_null_with_one_null(groups):
    out = dict(values(groups.groupBy("g").agg(X.strict_mean("x").alias("m")), "g", "m"))
    assert out == {"one": 1.0, "gap": None, "none": None, "flat": 2.0, "line": 2.0}
    sd = dict(values(groups.groupBy("g").agg(X.strict(F.stddev_samp, "x").alias("m")), "g", "m"))
    assert sd["one"] is None and sd["gap"] is None and sd["line"] == pytest.approx(1.0)


def test_correlation_of_constant_single_and_gappy_groups(groups):
    out = {g: (a, b) for g, a, b in values(groups.groupBy("g").agg(
        X.safe_corr("x", "y").alias("a"), X.strict_corr("x", "y").alias("b")), "g", "a", "b")}
    assert out["flat"] == (None, None) and out["one"] == (None, None) and out["none"] == (None, None)
    assert out["line"] == (pytest.approx(1.0), pytest.approx(1.0))
    assert out["gap"] == (pytest.approx(1.0), None)


def test_unknown_test_stays_unknown(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "x double")
    assert values(df.select(X.if_known(F.col("x") > 3, "hi", "lo").alias("v")), "v") == [("lo",), (None,), ("hi",)]


def test_frozen_or_faulty_or_unknown_moisture_is_null(spark):
    df = spark.createDataFrame([(20.0, 5.0, 0), (20.0, 0.5, 0), (20.0, None, 0), (20.0, 5.0, 1), (20.0, 5.0, None)],
                               "m double, t double, p int")
    assert [v for v, in values(df.select(X.mask_frozen("m", "t", "p").alias("v")), "v")] == [20.0, None, None, None, None]


def test_finite_and_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert values(df.select(X.finite("x").alias("f"), X.round_even(X.finite("x"), 2).alias("r")), "f", "r") == [
        (0.125, 0.12), (0.375, 0.38), (None, None), (None, None), (None, None)]


def test_coverage_counts_finite_values_only(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.agg(X.one_decimal_share("x").alias("p")).first()["p"] == 33.3


def test_parsing_never_raises(spark):
    df = spark.createDataFrame([("1,5", "2020.06.01 00:15"), ("-0,25", "2020.6.1 9:05"), ("x", "later")], "n string, t string")
    out = values(df.select(X.parse_decimal("n").alias("n"), X.parse_stamp("t").cast("string").alias("t")), "n", "t")
    assert out == [(1.5, "2020-06-01 02:15:00"), (-0.25, "2020-06-01 11:05:00"), (None, None)]


def test_hydrological_year_edges(spark):
    df = spark.createDataFrame([("2020-08-31",), ("2020-09-01",), ("2020-02-29",)], "d string").withColumn("date", F.to_date("d"))
    out = values(X.with_hydro_calendar(df), "year", "hyddoy", "doy")
    assert out == [(2020, 366, 244), (2021, 1, 245), (2020, 182, 60)]


def test_logger_key_needs_an_id_and_names_conform(spark):
    df = spark.createDataFrame([("saa_19", 5), ("k_01", None)], "s string, t long")
    assert values(df.select(X.conform_site("s").alias("s"), X.logger_key(F.col("s"), F.col("t")).alias("k")), "s", "k") == [
        ("SAA019", "saa_19_5"), ("K01", None)]


def test_later_design_prefix_wins(spark):
    df = spark.createDataFrame([("MAL01",), ("MI2",), ("K25",), ("Haap.1/2",), ("ZZ",)], "s string")
    assert [v for v, in values(df.select(X.design_label("s").alias("l")), "l")] == [1, 2, 5, 4, None]


def test_clock_does_not_follow_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Helsinki")
        df = spark.sql("select timestamp_ntz'2021-03-28 02:30:00' a, timestamp_ntz'2021-03-28 04:30:00' b")
        assert df.select(X.minutes_between("b", "a").alias("m")).first()["m"] == 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
