"""Queries of imputation, shared tables, modelling and reports."""

from pyspark.sql import DataFrame, functions as F

from thawline.operators import impute as I, model as M, report as R, tabular as T
from thawline.operators.daily import MEASURES
from thawline.plans.q_readings import usable_sql
from thawline.plans.climate import climate_variables
from thawline.plans.mapping import model_inputs, screen_predictors
from thawline.plans.registry import query
from thawline.plans.standins import DAY_TABLE_SQL, DAYS_SQL, day_table, days, table

SITES = [f"S{i}" for i in range(10)]
_site_cols = " ".join(SITES)


def _matrix_sql(measure):
    return "select date, " + ", ".join(f"max(case when site = '{s}' then value end) as \"{s}\"" for s in SITES) + \
        f" from ({usable_sql(measure)}) group by date"


# --- imputation -------------------------------------------------------------------------------

@query("impute_matrix", f"with {DAY_TABLE_SQL} {_matrix_sql('T1_mean')}", _site_cols, dates="date")
def impute_matrix_q(spark, d):
    return I.impute_matrix(day_table(spark, d), "T1_mean")


@query("impute_matrix_moisture", f"with {DAY_TABLE_SQL} {_matrix_sql('moist_mean')}", _site_cols, dates="date")
def impute_matrix_moisture(spark, d):
    return I.impute_matrix(day_table(spark, d), "moist_mean")


def _every_site_sql(measure):
    return (f"with {DAY_TABLE_SQL}, u as ({usable_sql(measure)}) select d.date, s.site, u.value from (select distinct date from u) d "
            "cross join (select distinct site from u) s left join u on u.date = d.date and u.site = s.site")


@query("impute_matrix_every_site", _every_site_sql("T1_mean"), "value", dates="date")
def impute_matrix_every_site(spark, d):
    """The cells of impute_matrix, whatever the number of sites."""
    return I.impute_matrix(day_table(spark, d), "T1_mean", wide=False)


@query("impute_matrix_moisture_every_site", _every_site_sql("moist_mean"), "value", dates="date")
def impute_matrix_moisture_every_site(spark, d):
    return I.impute_matrix(day_table(spark, d), "moist_mean", wide=False)


_NAMES = [("moist" if m == "moist_mean" else m) for m in MEASURES]
_U = ",\n".join(f"u{i} as ({usable_sql(m)}), k{i} as (select d.date, s.site from (select distinct date from u{i}) d, "
                f"(select distinct site from u{i}) s)" for i, m in enumerate(MEASURES))
_JOINS = " ".join(f"left join u{i} on k.date = u{i}.date and k.site = u{i}.site" for i in range(len(MEASURES)))
_VALS = ", ".join((f'u{i}.value as "{m}"' if m != "moist_mean" else
                   f"case when not (u0.value < 1) then u{i}.value end as moist") for i, m in enumerate(MEASURES))


@query("combine_imputed", f"with {DAY_TABLE_SQL},\n{_U}, k as (" +
       " union ".join(f"select date, site from k{i}" for i in range(len(MEASURES))) +
       f") select k.date, k.site, {_VALS} from k {_JOINS}", " ".join(_NAMES), dates="date")
def combine_imputed_q(spark, d):
    measures = list(MEASURES)
    return I.combine_cells(I.dense_cells(I.measured_cells(day_table(spark, d), measures)), measures)


_HOLD = f"""with {DAY_TABLE_SQL}, u as (select *, cast(year(date) as integer) as year, cast(month(date) as integer) as month
  from ({usable_sql('T3_mean')})), chosen as (select site, year, month from u group by 1, 2, 3
  having count(*) = count(value) order by md5(site || '_' || year || '_' || month || '_7'), 1, 2, 3 limit 20)
select site, year, month, date, value from u {{how}} join chosen using (site, year, month)"""


@query("holdout_test", _HOLD.format(how="semi"), "value", dates="date")
def holdout_test(spark, d):
    return I.holdout(day_table(spark, d), "T3_mean", 20, 7)[1].select("site", "year", "month", "date", "value")


@query("holdout_train", _HOLD.format(how="anti"), "value", dates="date")
def holdout_train(spark, d):
    return I.holdout(day_table(spark, d), "T3_mean", 20, 7)[0].select("site", "year", "month", "date", "value")


def errors(spark, d) -> DataFrame:
    """Day means as truth, the middle of the day's range as prediction."""
    dt = day_table(spark, d).withColumns({"month": F.month("date"), "year": F.year("date")})
    pick = lambda ori, imp: dt.select("date", "site", "month", "year", imp.alias("imp"), F.col(ori).alias("ori"))
    return I.stack_errors({"T1_mean": pick("T1_mean", (F.col("T1_min") + F.col("T1_max")) / 2),
                           "T3_mean": pick("T3_mean", (F.col("T3_min") + F.col("T3_max")) / 2),
                           "moist_mean": pick("moist_mean", F.col("moist_prop") / 10)})


_ERR = f"""{DAY_TABLE_SQL}, base as (select *, cast(month(date) as integer) as month, cast(year(date) as integer) as year
  from day_table), errors as (select *, ori - imp as dif from (
  select date, site, month, year, ("T1_min" + "T1_max") / 2 as imp, "T1_mean" as ori, 'T1_mean' as var from base union all
  select date, site, month, year, ("T3_min" + "T3_max") / 2, "T3_mean", 'T3_mean' from base union all
  select date, site, month, year, moist_prop / 10, moist_mean, 'moist' from base))"""
_MET = "avg(abs(dif)) as mean_abs_err, median(abs(dif)) as median_abs_err, avg(dif) as bias, sqrt(avg(dif * dif)) as rmse"
_CELL = "(select *, ori - imp as dif from (select site, month, year, var, avg(imp) as imp, avg(ori) as ori from errors group by 1, 2, 3, 4))"
_MC = "mean_abs_err median_abs_err bias rmse"


@query("stack_errors", f"with {_ERR} select date, site, var, imp, ori, dif from errors", "imp ori dif", dates="date")
def stack_errors_q(spark, d):
    return errors(spark, d).select("date", "site", "var", "imp", "ori", "dif")


@query("imputation_errors", f"with {_ERR} select var, {_MET} from errors group by var", _MC)
def imputation_errors(spark, d):
    return I.imputation_report(errors(spark, d))["by_variable"]


@query("imputation_errors_monthly", f"with {_ERR} select var, {_MET} from {_CELL} group by var", _MC)
def imputation_errors_monthly(spark, d):
    return I.imputation_report(errors(spark, d))["by_variable_monthly"]


@query("imputation_errors_by_month", f"with {_ERR} select month, {_MET} from {_CELL} where var <> 'moist' group by month", _MC)
def imputation_errors_by_month(spark, d):
    return I.imputation_report(errors(spark, d))["by_month"]


@query("impute_forest")
def impute_forest_q(spark, d):
    return I.impute_forest(I.impute_matrix(day_table(spark, d), "T1_mean", sites=None), report_error=False)[0]


@query("impute_forest_error")
def impute_forest_error(spark, d):
    return I.impute_forest(I.impute_matrix(day_table(spark, d), "T3_mean", sites=None))[1]


@query("impute_cv")
def impute_cv_q(spark, d):
    return I.impute_cv(day_table(spark, d))


# --- shared tables ----------------------------------------------------------------------------

@query("hash_sample", """select l_orderkey, l_linenumber, l_partkey from (select *, md5(l_orderkey || '_' || l_linenumber || '_'
  || l_partkey || '_' || l_suppkey || '_3') as h from lineitem) order by h, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500""")
def hash_sample_q(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return T.hash_sample(table(spark, d, "lineitem").select(*keys), keys, 500, 3).select(*keys[:3])


@query("count_desc", "select p_name, count(*) as n from part group by 1")
def count_desc_q(spark, d):
    return T.count_desc(table(spark, d, "part"), "p_name")


VI_SQL = "vi as (select p_name as predictor, p_brand as resp_var, avg(p_retailprice) - 950 as varimp from part group by 1, 2)"


def varimp(spark, d):
    return (table(spark, d, "part").groupBy(F.col("p_name").alias("predictor"), F.col("p_brand").alias("resp_var"))
            .agg((F.avg("p_retailprice") - 950).alias("varimp")))


@query("densify", f"""with {VI_SQL} select a.predictor, b.resp_var, coalesce(varimp, 0) as varimp from
  (select distinct predictor from vi) a cross join (select distinct resp_var from vi) b
  left join vi on vi.predictor = a.predictor and vi.resp_var = b.resp_var""", "varimp")
def densify_q(spark, d):
    return T.densify(varimp(spark, d), "predictor", "resp_var", "varimp")


@query("widen_months", """select c_mktsegment as segment, """ + ", ".join(
    f"sum(o_totalprice) filter (month(o_orderdate) = {m}) as \"{m}\"" for m in range(1, 13)) +
    " from orders join customer on o_custkey = c_custkey group by 1", " ".join(str(m) for m in range(1, 13)), digits=3)
def widen_months(spark, d):
    sales = (table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_mktsegment").alias("segment"), F.month("o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v")))
    return T.widen(sales, ["segment"], "m", "v", list(range(1, 13)))


@query("lengthen", "select p_partkey, 'p_size' as name, p_size::double as value from part union all "
       "select p_partkey, 'p_retailprice', p_retailprice from part", "value")
def lengthen_q(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return T.lengthen(part, ["p_partkey"])


@query("center", "select avg(l_extendedprice) as mean, median(l_extendedprice) as median from lineitem", "mean median", digits=4)
def center_q(spark, d):
    return T.center(table(spark, d, "lineitem"), "l_extendedprice")


@query("exact_median", "select l_returnflag, median(l_quantity) as median from lineitem group by 1", "median")
def exact_median_q(spark, d):
    return T.exact_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


_SUMMED = ("T1_mean", "T1_min", "T1_max", "T3_mean", "T3_min", "T3_max", "moist")


@query("table_summary", f"with {DAYS_SQL} " + " union all ".join(
    f"""select '{c}' as name, count("{c}") as n, avg("{c}") as mean, stddev_samp("{c}") as sd, min("{c}") as min,
  quantile_disc("{c}", 0.25) as q25, quantile_disc("{c}", 0.5) as median, quantile_disc("{c}", 0.75) as q75, max("{c}") as max from days"""
    for c in _SUMMED), "mean sd min q25 median q75 max")
def table_summary(spark, d):
    return T.summary(days(spark, d), list(_SUMMED))


# --- modelling --------------------------------------------------------------------------------

XS = [f"x{i}" for i in range(1, 65)]


def model_rows(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(XS)])


def gappy(spark, d) -> DataFrame:
    """The same rows with values near zero unknown."""
    return model_rows(spark, d).withColumns({x: F.when(F.abs(x) >= 0.005, F.col(x)) for x in XS})


ROWS_SQL = "mrows as (select vec_id, label::double as label, " + ", ".join(
    f"embedding[{i + 1}]::double as {x}" for i, x in enumerate(XS)) + " from embeddings)"
GAPPY_SQL = ROWS_SQL + ", gappy as (select vec_id, label, " + ", ".join(
    f"case when abs({x}) >= 0.005 then {x} end as {x}" for x in XS) + " from mrows)"
LONG_SQL = GAPPY_SQL + ", long as (" + " union all ".join(f"select vec_id, '{x}' as v, {x} as x from gappy" for x in XS) + ")"
_R = "case when not isnan(corr(a.x, b.x)) then corr(a.x, b.x) end"


@query("correlation_matrix", f"""with {LONG_SQL} select a.v as var1, b.v as var2, {_R} as r, count(*) as n
  from long a join long b on a.vec_id = b.vec_id where a.x is not null and b.x is not null group by 1, 2""", "r")
def correlation_matrix(spark, d):
    return T.corr_matrix(gappy(spark, d), XS)


@query("correlation_matrix_strict", f"""with {LONG_SQL} select a.v as var1, b.v as var2,
  case when count(*) = count(a.x) and count(*) = count(b.x) then {_R} end as r from long a join long b on a.vec_id = b.vec_id
  group by 1, 2""", "r")
def correlation_matrix_strict(spark, d):
    mixed = gappy(spark, d)
    return T.corr_matrix(mixed, XS, pairwise=False).select("var1", "var2", "r")


NZ = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice", "flat", "rare"]


@query("near_zero_variance", "with base as (select *, 1.0 as flat, case when l_linenumber = 7 and l_tax > 0.07 then 1.0 else 0.0 end "
       "as rare from lineitem), long as (" + " union all ".join(f"select '{c}' as name, {c}::double as value from base" for c in NZ) +
       """), counts as (select name, value, count(*) as k from long group by 1, 2),
  ranked as (select *, row_number() over (partition by name order by k desc) as rn from counts)
  select name, coalesce(max(k) filter (rn = 1)::double / max(k) filter (rn = 2), 0.0) as freq_ratio,
    100.0 * count(*) / (select count(*) from lineitem) as percent_unique, count(*) as n_distinct,
    cast(case when (coalesce(max(k) filter (rn = 1)::double / max(k) filter (rn = 2), 0.0) > 19
      and 100.0 * count(*) / (select count(*) from lineitem) <= 10) or count(*) <= 1 then 1 else 0 end as integer) as near_zero
  from ranked group by name""", "freq_ratio percent_unique")
def near_zero_variance(spark, d):
    rare = F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.07), 1.0).otherwise(0.0)
    base = table(spark, d, "lineitem").withColumns({"flat": F.lit(1.0), "rare": rare})
    return M.near_zero_stats(base, NZ)


def _names(spark, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


# Correlations of the columns by number, and the walk over pairs above the cutoff in order of falling mean: of each pair
# still there, the column with the larger mean over the columns still there goes.
CORR_SQL = ROWS_SQL + ", raw as (" + " union all ".join(f"select vec_id, {i} as v, {x} as x from mrows" for i, x in enumerate(XS)) + """),
  cor as (select a.v as i, b.v as j, abs(corr(a.x, b.x)) as r from raw a join raw b using (vec_id) where a.v <> b.v group by 1, 2),
  placed as (select i, row_number() over (order by avg(r) desc, i) as p from cor group by i),
  steps as (select row_number() over (order by x.p, y.p) as s, cor.i, cor.j from cor join placed x on x.i = cor.i
    join placed y on y.i = cor.j where x.p < y.p and r > 0.1),
  walk as (select 0::bigint as s, []::bigint[] as gone union all select w.s, case when list_contains(gone, w.i) or list_contains(gone, w.j)
    then gone when (select avg(r) from cor where cor.i = w.i and not list_contains(gone, cor.j))
      > (select avg(r) from cor where cor.i = w.j and not list_contains(gone, cor.j)) then list_append(gone, w.i)
    else list_append(gone, w.j) end from (select steps.*, walk.gone from walk join steps on steps.s = walk.s + 1) w),
  dropped as (select unnest(gone) as i from (select gone from walk order by s desc limit 1))"""


@query("drop_correlated", f"with recursive {CORR_SQL} select 'x' || (i + 1) as name from dropped")
def drop_correlated_q(spark, d):
    return _names(spark, M.drop_correlated(T.corr_matrix(model_rows(spark, d), XS), 0.1))


@query("model_table", f"with {GAPPY_SQL} select vec_id, label, x1, x2, x3 from gappy where label is not null and x1 is not null "
       "and x2 is not null and x3 is not null", "label x1 x2 x3")
def model_table_q(spark, d):
    return M.model_table(gappy(spark, d), "label", ["x1", "x2", "x3"], ("vec_id",))


@query("feature_elimination")
def feature_elimination(spark, d):
    kept, _ = M.rfe(model_rows(spark, d).persist(), "label", XS, list(range(3, len(XS) + 1)), ["vec_id"])
    return _names(spark, kept)


@query("grid_search")
def grid_search(spark, d):
    return M.tune_forest(model_rows(spark, d).persist(), "label", XS, keys=["vec_id"])


@query("model_metrics")
def model_metrics(spark, d):
    return M.best_model(grid_search(spark, d))


@query("permutation_importance")
def permutation_importance_q(spark, d):
    """Scored on a fold the forest has not seen."""
    rows = M.with_fold(model_rows(spark, d), ["vec_id"], 10, 1).persist()
    model = M.fit_forest(rows.filter("_fold <> 0"), "label", XS)
    return M.permutation_importance(model, rows.filter("_fold = 0"), "label", XS, ["vec_id"])


# --- reports ----------------------------------------------------------------------------------

CV_SQL = """cv as (select p_brand as resp_var, stddev_samp(p_retailprice) as "RMSE", avg(p_size) / 50 as "Rsquared",
  avg(abs(p_size - 25)) as "MAE" from part group by 1)"""


def cvmetrics(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("resp_var")).agg(
        F.stddev_samp("p_retailprice").alias("RMSE"), (F.avg("p_size") / 50).alias("Rsquared"),
        F.avg(F.abs(F.col("p_size") - 25)).alias("MAE"))


def _rank_sql(way):
    return (f'with {CV_SQL} select resp_var, round_even("Rsquared", 3) as "Rsquared", round_even("RMSE", 2) as "RMSE", '
            f'round_even("MAE", 2) as "MAE" from (select * from cv order by "Rsquared" {way}, resp_var limit 20)')


@query("rank_models", _rank_sql("desc"), "Rsquared RMSE MAE")
def rank_models_q(spark, d):
    return R.rank_models(cvmetrics(spark, d))


@query("rank_models_worst", _rank_sql("asc"), "Rsquared RMSE MAE")
def rank_models_worst(spark, d):
    return R.rank_models(cvmetrics(spark, d), best_first=False)


@query("importance_summary", f"""with {VI_SQL}, dense as (select a.predictor, b.resp_var, coalesce(varimp, 0) as v from
  (select distinct predictor from vi) a cross join (select distinct resp_var from vi) b
  left join vi on vi.predictor = a.predictor and vi.resp_var = b.resp_var),
  scaled as (select *, case when max(v) over w = min(v) over w then 0.5 else (v - min(v) over w) / (max(v) over w - min(v) over w) end
    as s from dense window w as (partition by resp_var))
  select predictor, n, round_even(m, 3) as varimp from (select predictor, avg(s) as m from scaled group by 1)
  join (select predictor, count(*) as n from vi group by 1) using (predictor)""", "varimp")
def importance_summary_q(spark, d):
    return R.importance_summary(varimp(spark, d))


@query("greedy_uncorrelated", f"""with recursive {CORR_SQL}, left_ as (select range(0, {len(XS)}) as alive union all
  select list_filter(alive, lambda x: x <> v) from (select alive, (select arg_max(greatest(i, j), r) from cor
    where r > 0.1 and i < j and list_contains(alive, i) and list_contains(alive, j)) as v from left_) where v is not null)
  select 'x' || (unnest(alive) + 1) as name from (select alive from left_ order by len(alive) limit 1)""")
def greedy_uncorrelated_q(spark, d):
    score = spark.createDataFrame([(x, 1.0 / (i + 1)) for i, x in enumerate(XS)], "resp_var string, Rsquared double")
    return _names(spark, R.greedy_uncorrelated(T.corr_matrix(model_rows(spark, d), XS), score, 0.1))


_DIFF = f"""with {LONG_SQL}, raw as ({' union all '.join(f"select vec_id, '{x}' as v, {x} as x from mrows" for x in XS)}),
  r1 as (select a.v as var1, b.v as var2, corr(a.x, b.x) as r from long a join long b using (vec_id)
    where a.x is not null and b.x is not null group by 1, 2),
  r2 as (select a.v as var1, b.v as var2, corr(a.x, b.x) as r from raw a join raw b using (vec_id) group by 1, 2),
  dif as (select var1, var2, r2.r - r1.r as r from r1 join r2 using (var1, var2))"""


@query("correlation_difference", f"{_DIFF} select * from dif", "r")
def correlation_difference(spark, d):
    return R.corr_difference(T.corr_matrix(gappy(spark, d), XS), T.corr_matrix(model_rows(spark, d), XS))


@query("correlation_difference_center", f"{_DIFF} select avg(abs(r)) as mean, median(abs(r)) as median from dif", "mean median")
def correlation_difference_center(spark, d):
    return T.center(correlation_difference(spark, d).withColumn("r", F.abs("r")), "r")


@query("model_inputs", f"""with {DAY_TABLE_SQL}, v as (select site, avg("T1_mean") as "T1_mean" from day_table group by 1),
  a as (select 'S' || s_suppkey as site, round_even(s_acctbal / 10, 0) as dem from supplier),
  b as (select 'S' || n_nationkey as site, n_regionkey::double as region from nation)
  select * from v full join a using (site) full join b using (site)""", "T1_mean dem region")
def model_inputs_q(spark, d):
    v = day_table(spark, d).groupBy("site").agg(F.avg("T1_mean").alias("T1_mean"))
    a = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("site"), F.col("s_acctbal").alias("dem"))
    b = table(spark, d, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("site"), F.col("n_regionkey").cast("double").alias("region"))
    return model_inputs(v, a, b)


@query("screen_predictors", f"with recursive {CORR_SQL} select 'x' || (i + 1) as name from placed where i not in (select i from dropped)")
def screen_predictors_q(spark, d):
    return _names(spark, screen_predictors(model_rows(spark, d), XS, 0.1))


@query("climate_variables")
def climate_variables_q(spark, d):
    return climate_variables(day_table(spark, d))


# --- facts about forests that SQL can state ---------------------------------------------------

@query("impute_forest_known", f"""with {DAY_TABLE_SQL}, u as ({usable_sql('T1_mean')}),
  grid as (select d.date, s.site from (select distinct date from u) d cross join (select distinct site from u) s)
  select grid.date, grid.site, u.value, true as filled from grid left join u using (date, site)""", "value", dates="date")
def impute_forest_known(spark, d):
    """Every cell of the matrix is filled, and the known ones are as they were."""
    matrix = I.impute_matrix(day_table(spark, d), "T1_mean")
    full = T.lengthen(I.impute_forest(matrix, report_error=False)[0], ["date"], None, "site", "imp")
    known = T.lengthen(matrix, ["date"], None, "site", "value")
    return full.join(known, ["date", "site"], "left").select(
        "date", "site", F.when(F.col("value").isNotNull(), F.col("imp")).alias("value"), F.col("imp").isNotNull().alias("filled"))


@query("planted_importance", f"with {ROWS_SQL}, raw as (" + " union all ".join(
    f"select '{x}' as predictor, corr(x5 * 3 + x9 * 0.2, {x}) as r from mrows" for x in XS) + ") select predictor from raw order by abs(r) desc limit 1")
def planted_importance(spark, d):
    """The predictor that makes the response is ranked first on rows the forest has not seen."""
    rows = M.with_fold(model_rows(spark, d).withColumn("label", F.col("x5") * 3 + F.col("x9") * 0.2), ["vec_id"], 4, 1)
    model = M.fit_forest(rows.filter("_fold <> 0"), "label", XS)
    found = M.permutation_importance(model, rows.filter("_fold = 0"), "label", XS, ["vec_id"])
    return found.orderBy(F.desc("varimp")).limit(1).select("predictor")


@query("grid_search_settings", "select m::integer as mtry, n::integer as min_node_size, (select count(*) from embeddings where label is not null) > 0 as scored "
       "from range(2, 9) a(m), range(1, 6) b(n)")
def grid_search_settings(spark, d):
    """One scored row for every setting."""
    return grid_search(spark, d).select("mtry", "min_node_size", F.col("RMSE").isNotNull().alias("scored"))
