"""Queries on readings: sources, scalar expressions, filters, quality control, days."""
import datetime as dt

from pyspark.sql import functions as F

from thawline import functions as X
from thawline.functions.tables import PLOT_DROP_CODES
from thawline.operators import daily as D, filters as FL, quality as Q, tabular as T
from thawline.plans.climate import study_days
from thawline.plans.registry import query
from thawline.plans.standins import (
    ARRIVALS_SQL, KINDS, DAY_TABLE_SQL, DAYS_SQL, arrivals, day_table, days, readings, readings_sql, table)
from thawline.sources import pack_cells, path_keys, pending, select_layers, union_networks

# Comparison rules in the shape of the campaign's own (a later priority wins).
RULES = [("S0", None, "2024-01-04", 2, 0), ("S1", None, "2024-01-03", 2, 0), ("S2", None, "2024-01-02", 2, 0),
         ("S1", "2024-01-10", "2024-01-12", 1, 1), ("S2", "2024-01-05", "2024-01-08", 1, 1),
         ("S2", "2024-01-08", None, 11, 2)]


def rules(spark):
    iso = lambda t: dt.date.fromisoformat(t) if t else None
    return spark.createDataFrame([(s, iso(a), iso(b), c, p) for s, a, b, c, p in RULES],
                                 "site string, date_from date, date_to date, code int, priority int")


def _lit(t):
    return f"date '{t}'" if t else "null::date"


CTE = {kind: readings_sql(kind) for kind in KINDS}
for raw in ("readings", "sparse", "quarter", "five"):
    CTE["dedup" if raw == "readings" else f"{raw}_dedup"] = f"""{'dedup' if raw == 'readings' else raw + '_dedup'} as (
  select * exclude (rn) from (select *, row_number() over (partition by site, tomst_id, datetime
    order by event_id desc) as rn from {raw}) where rn = 1)"""
CTE["visits"] = """visits as (select site, max(datetime) as maxdt from readings group by site)"""
CTE["masked"] = """masked as (
  select site, tomst_id, datetime, event_id, probl_seed, case when v = 0 then "T1" end as "T1",
    case when v = 0 then "T2" end as "T2", case when v = 0 then "T3" end as "T3", case when v = 0 then moist end as moist
  from (select d.*, sum(case when d.datetime = maxdt then 1 else 0 end) over (partition by site, tomst_id
    order by datetime rows between 1 preceding and 1 following) as v from dedup d join visits using (site)))"""


def _strict(agg, x, name):
    return f"case when count(*) = count({x}) then {agg}({x}) end as {name}"


CTE["diag"] = f"""diag0 as (
  select *, cast(datetime as date) as date, "T1" - lead("T1") over w as d1, "T2" - lead("T2") over w as d2,
    "T3" - lead("T3") over w as d3 from dedup
  window w as (partition by site, tomst_id, cast(datetime as date) order by datetime)),
diag1 as (
  select site, date, tomst_id, {_strict('stddev_samp', '"T1"', 'soil_sd')}, {_strict('stddev_samp', '"T3"', 'air_sd')},
    {_strict('avg', '"T1"', 'soil_mean')}, {_strict('avg', '"T3"', 'air_mean')}, {_strict('min', '"T1"', 'soil_min')},
    {_strict('max', '"T1"', 'soil_max')}, {_strict('max', '"T2"', 'surf_max')}, {_strict('max', '"T3"', 'air_max')},
    {_strict('avg', 'abs("T3" - "T1")', 'mean_diff')}, {_strict('min', 'moist', 'moist')},
    case when count(*) < 2 or isnan(corr("T1", "T3")) then 0.0 else coalesce(corr("T1", "T3"), 0.0) end as corr,
    max(d1) as "max_diff_T1", max(d2) as "max_diff_T2", max(d3) as "max_diff_T3"
  from diag0 group by site, date, tomst_id),
diag as (
  select *, air_mean - soil_mean as sa_diff, air_max - soil_max as sa_max_diff, surf_max - soil_max as ss_max_diff,
    case when soil_sd < 1 then 0.0 when soil_sd >= 1 and air_sd <> 0 then soil_sd / air_sd end as sd_ratio,
    0 as probl from diag1)"""
CTE["rules"] = "rules as (select * from (values " + ", ".join(
    f"('{s}', {_lit(a)}, {_lit(b)}, {c}, {p})" for s, a, b, c, p in RULES) + \
    ") r(site, date_from, date_to, code, priority))"
CTE["coded"] = """coded as (
  select d.* replace (cast(coalesce((select max_by(code, priority) from rules r where r.site = d.site
    and (date_from is null or date_from <= d.date) and (date_to is null or date_to >= d.date)), 0) as integer) as probl)
  from diag d)"""
CTE["stable"] = """office as (select site, tomst_id, date from coded c where probl = 2
    and date < (select max(date) from coded x where x.probl = 2 and x.site = c.site and x.tomst_id = c.tomst_id)),
office_rows as (select d.* from dedup d join office o on d.site = o.site and d.tomst_id = o.tomst_id
    and cast(d.datetime as date) = o.date),
stable as (select * from (
  select *, """ + ", ".join(f'abs("T3" - lag("T3", {k}) over w) as c{k}' for k in range(1, 7)) + ", " + \
    ", ".join(f'abs("T3" - lead("T3", {k}) over w) as e{k}' for k in (1, 2, 3)) + """
  from {src} window w as (partition by site, tomst_id order by datetime))
  where greatest(c1, c2, c3, c4, c5, c6, e1, e3) <= {step} and """ + " and ".join(
    f"{c} is not null" for c in ("c1", "c2", "c3", "c4", "c5", "c6", "e1", "e2", "e3",
                                 '"T1"', '"T2"', '"T3"', "moist")) + ")"
CTE["offsets"] = """means as (select site, tomst_id, avg("T1") as a, avg("T2") as b, avg("T3") as c from stable group by 1, 2),
offsets as (select site || '_' || tomst_id as site_id, site, tomst_id,
  round_even(a - list_sort([a, b, c])[2], 4) as "T1", round_even(b - list_sort([a, b, c])[2], 4) as "T2",
  round_even(c - list_sort([a, b, c])[2], 4) as "T3" from means)"""


def limits_sql(src, out, network="oulu"):
    def t(c):
        return f'case when not ("{c}" < -50 or "{c}" > 50) then "{c}" end as "{c}"'
    lo = 200 if network == "oulu" else 600
    return f"""{out} as (select * replace ({t('T1')}, {t('T2')}, {t('T3')},
  case when not (moist < {lo} or moist >= 4096) then moist end as moist) from {src})"""


def with_(*names, body):
    return "with " + ",\n".join(names) + "\n" + body


KEY = ["site", "tomst_id", "datetime"]


def dedup(spark, d, kind="readings"):
    return Q.dedupe_last(readings(spark, d, kind), KEY, "event_id")


VALS = "T1 T2 T3 moist"

# --- sources and scalar expressions -----------------------------------------------------------

@query("path_keys", """select event_id, 'Haap.' || cast(10 + user_id % 4 as varchar) || '/' || cast(event_id % 50 as varchar)
  as site, cast(94204000 + user_id as bigint) as tomst_id, 'K' || cast(user_id as varchar) as site2,
  cast(94204000 + user_id as bigint) as tomst_id2 from events""")
def path_keys_q(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    oulu = F.concat(F.lit("x/"), u % 4 + 10, F.lit("."), e % 50, F.lit("/data_"), u + 94204000, F.lit("_0.csv"))
    roslin = F.concat(F.lit("x/K"), u, F.lit("_data_"), u + 94204000, F.lit("_0.csv"))
    (s1, t1), (s2, t2) = path_keys(oulu, "oulu"), path_keys(roslin, "roslin")
    return table(spark, d, "events").select("event_id", s1.alias("site"), t1.alias("tomst_id"),
                                            s2.alias("site2"), t2.alias("tomst_id2"))


@query("parse_decimal", "select event_id, case when event_id % 12 <> 0 then value end as value from events", "value")
def parse_decimal_q(spark, d):
    text = F.regexp_replace(F.col("value").cast("decimal(12,2)").cast("string"), "\\.", ",")
    text = F.when(F.col("event_id") % 12 == 0, "n/a").otherwise(text)
    return table(spark, d, "events").select("event_id", X.parse_decimal(text).alias("value"))


@query("parse_stamp", "select event_id, date_trunc('minute', ts) + interval 2 hour as datetime from events",
       stamps="datetime")
def parse_stamp_q(spark, d):
    return table(spark, d, "events").select(
        "event_id", X.parse_stamp(F.date_format("ts", "yyyy.MM.dd HH:mm")).alias("datetime"))


@query("dedupe_last", with_(ARRIVALS_SQL, body="""select * exclude (rn) from (select *, row_number() over (
  partition by site, tomst_id, datetime order by event_id desc) as rn from arrivals) where rn = 1"""), VALS, stamps="datetime")
def dedupe_last_q(spark, d):
    return Q.dedupe_last(arrivals(spark, d), KEY, "event_id")


@query("union_networks", with_(CTE["readings"], CTE["sparse"], CTE["quarter"], body="""
  select site, datetime, "T1", "T2", "T3", moist, probl_seed as probl from readings
  union all select site, datetime, "T1", null, "T3", moist, probl_seed from sparse
  union all select site, datetime, "T1", "T2", "T3", null, probl_seed from quarter"""), VALS, stamps="datetime")
def union_networks_q(spark, d):
    a = readings(spark, d).withColumnRenamed("probl_seed", "error_tomst")
    b = readings(spark, d, "sparse").withColumnRenamed("probl_seed", "probl").drop("T2")
    c = readings(spark, d, "quarter").withColumnRenamed("probl_seed", "probl").drop("moist")
    return union_networks(*[x.drop("event_id") for x in (a, b, c)])


@query("pending_units", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_units(spark, d):
    return pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


_LAYERS = ["", "_sca", "dem_", "demm", "predstack", "slope_degree", "svi.tif", "dem"]


@query("select_layers", f"""select * from (select p_partkey, replace(p_name, ' ', '_') || {_LAYERS!r}[1 + p_size % 8] as layer
  from part) where not (layer like '%\\_sca%' escape '\\' or layer like '%dem\\_%' escape '\\' or layer like '%demm%'
  or layer like '%predstack%' or layer like '%slope\\_degree%' escape '\\' or layer like '%svi.tif%')""")
def select_layers_q(spark, d):
    tail = F.element_at(F.array(*map(F.lit, _LAYERS)), F.col("p_size") % 8 + 1)
    name = F.concat(F.regexp_replace("p_name", " ", "_"), tail)
    return select_layers(table(spark, d, "part").select("p_partkey", name.alias("layer")))


@query("pack_cells", """select p_partkey, case when round_even(p_retailprice * 40, 0) between 0 and 65535
  then round_even(p_retailprice * 40, 0) end as value from part""", "value")
def pack_cells_q(spark, d):
    out = pack_cells(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value")), 40, "INT2U")
    return out.withColumn("value", F.col("value").cast("double"))


_CAL = "round_even(((-1.34e-8) * moist * moist + 2.50e-4 * moist + (-1.58e-1)) * 100, 1)"


@query("calibrate_moisture", with_(CTE["readings"], body=f"select event_id, {_CAL} as moist from readings"), "moist")
def calibrate_moisture_q(spark, d):
    return readings(spark, d).select("event_id", X.calibrate_moisture("moist").alias("moist"))


@query("mask_frozen", with_(CTE["readings"], limits_sql("readings", "limited"), body="""select event_id,
  case when not ("T1" < 1 or probl_seed = 1) then moist end as moist from limited"""), "moist")
def mask_frozen_q(spark, d):
    return FL.apply_limits(readings(spark, d), "oulu").select(
        "event_id", X.mask_frozen("moist", "T1", "probl_seed").alias("moist"))


@query("limits", with_(CTE["readings"], limits_sql("readings", "limited", "roslin"), body="select * from limited"),
       VALS, stamps="datetime")
def limits_q(spark, d):
    return FL.apply_limits(readings(spark, d), "roslin")


@query("calendar", with_(CTE["readings"], body="""select event_id, cast(datetime as date) as date,
  cast(year(datetime) as integer) as year, cast(month(datetime) as integer) as month,
  cast(hour(datetime) as integer) as hour, cast(minute(datetime) as integer) as minute,
  cast(dayofyear(datetime) as integer) as doy, year(datetime) || '_' || month(datetime) as year_month from readings"""),
  dates="date")
def calendar_q(spark, d):
    return X.with_calendar(readings(spark, d)).select(
        "event_id", "date", "year", "month", "hour", "minute", "doy", "year_month")


@query("hydro_calendar", f"with {DAYS_SQL} select site, date, date + 122 as hyddate, y as year, m as month, doy, "
       "cast(dayofyear(date + 122) as integer) as hyddoy from hyd", dates="date hyddate")
def hydro_calendar_q(spark, d):
    return X.with_hydro_calendar(days(spark, d)).select("site", "date", "hyddate", "year", "month", "doy", "hyddoy")


@query("logger_key", with_(CTE["readings"], body="""select event_id,
  case when probl_seed <> 0 then site || '_' || tomst_id end as site_id from readings"""))
def logger_key_q(spark, d):
    known = F.when(F.col("probl_seed") != 0, F.col("tomst_id"))
    return readings(spark, d).select("event_id", X.logger_key(F.col("site"), known).alias("site_id"))


@query("conform_site", """select s_suppkey, case when s_suppkey = 19 then 'SAA019' else 'SAA' || s_suppkey end as site
  from supplier""")
def conform_site_q(spark, d):
    raw = F.concat(F.lit("saa_"), F.col("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", X.conform_site(raw).alias("site"))


_SITES = ["MAL", "AIL", "MI", "RA", "Haap.", "K", "KAI", "MIRA"]


@query("design_label", f"""select p_partkey, site, cast(case when site like 'K%' then 5 when site like 'Haap%' then 4
  when site like 'RA%' then 3 when site like 'MI%' then 2 when site like 'AIL%' or site like 'MAL%' then 1 end as integer)
  as label from (select p_partkey, {_SITES!r}[1 + p_size % 8] || p_size as site from part)""")
def design_label_q(spark, d):
    site = F.concat(F.element_at(F.array(*map(F.lit, _SITES)), F.col("p_size") % 8 + 1), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", site.alias("site"), X.design_label(site).alias("label"))


@query("round_cols", "select event_id, round_even(value / 7, 2) as a, round_even(value / 11, 2) as b from events", "a b")
def round_cols_q(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("value") / 7).alias("a"), (F.col("value") / 11).alias("b"))
    return X.round_cols(df, ["a", "b"], 2)


# --- filters ----------------------------------------------------------------------------------

@query("date_window", with_(CTE["readings"], body="""select event_id, datetime from readings
  where datetime > timestamp '2024-01-05' and datetime < timestamp '2024-01-20'"""), stamps="datetime")
def date_window(spark, d):
    return FL.in_window(readings(spark, d), "datetime", dt.date(2024, 1, 5), dt.date(2024, 1, 20), False).select(
        "event_id", "datetime")


@query("study_readings", with_(CTE["quarter"], body="""select * from quarter where minute(datetime) in (0, 30)
  and cast(datetime as date) between date '2024-01-03' and date '2024-01-28' and not (site like 'S3%' or site like 'X%')"""),
  VALS, stamps="datetime")
def study_readings_q(spark, d):
    df = FL.half_hours(readings(spark, d, "quarter")).withColumn("date", F.to_date("datetime"))
    df = FL.in_window(df, "date", dt.date(2024, 1, 3), dt.date(2024, 1, 28), True)
    return FL.drop_prefixes(df, ("S3", "X")).drop("date")


@query("keep_codes", with_(CTE["readings"], body="""select event_id, probl_seed from readings
  where probl_seed in (0, 3, 5, 6, 7, 8, 10)"""))
def keep_codes_q(spark, d):
    return FL.keep_codes(readings(spark, d), "impute", "T1", probl="probl_seed").select("event_id", "probl_seed")


@query("coverage_gate", f"with {DAY_TABLE_SQL} select site, date, \"T1_prop\" from day_table where \"T1_prop\" >= 90",
       "T1_prop", dates="date")
def coverage_gate(spark, d):
    return FL.covered(day_table(spark, d), "T1_prop").select("site", "date", "T1_prop")


@query("season_gate", f"with {DAYS_SQL} select site, date from days where month(date) between 5 and 8 and dayofyear(date) < 227",
       dates="date")
def season_gate(spark, d):
    return FL.season(days(spark, d), (5, 6, 7, 8), 227).select("site", "date")


@query("complete_rows", with_(CTE["readings"], limits_sql("readings", "limited"), body="""select event_id, "T1", moist
  from limited where "T1" is not null and moist is not null"""), "T1 moist")
def complete_rows(spark, d):
    return FL.complete(FL.apply_limits(readings(spark, d), "oulu"), ["T1", "moist"]).select("event_id", "T1", "moist")


@query("supported_groups", with_(CTE["sparse"], CTE["sparse_dedup"], body="""select site, datetime from (select *,
  count(*) over (partition by site) as n, (select count(distinct cast(datetime as date)) from sparse_dedup y
  where y.site = x.site) as nd from sparse_dedup x) where n > 130 and nd > 9"""), stamps="datetime")
def supported_groups(spark, d):
    return FL.supported(dedup(spark, d, "sparse"), ["site"], min_days=9, min_rows=130).select(
        "site", "datetime")


_GAPS = """a0 as (select *, date_diff('minute', lag(datetime) over w, datetime) as b,
  date_diff('minute', datetime, lead(datetime) over w) as f from quarter_dedup window w as (partition by site order by datetime)),
a1 as (select * exclude (b, f) from a0 where b in (30, 45) or f in (30, 45)),
a2 as (select *, date_diff('minute', lag(datetime) over w, datetime) as b,
  date_diff('minute', datetime, lead(datetime) over w) as f from a1 window w as (partition by site order by datetime))"""


@query("regular_spacing", with_(CTE["quarter"], CTE["quarter_dedup"], _GAPS, body="""select site, datetime, event_id from a2
  where (select min(b) from a2 x where x.site = a2.site) >= 30 or b + f is null or b + f >= 60"""), stamps="datetime")
def regular_spacing_q(spark, d):
    return FL.regular_spacing(dedup(spark, d, "quarter"), (30, 45)).select("site", "datetime", "event_id")


# --- quality control --------------------------------------------------------------------------

@query("last_visit", with_(CTE["sparse"], body="""select site, min(tomst_id) as tomst_id, maxdt from (
  select site, tomst_id, max(datetime) as maxdt, max(max(datetime)) over (partition by site) as top
  from sparse group by 1, 2) where maxdt = top group by site, maxdt"""), stamps="maxdt")
def last_visit_q(spark, d):
    return Q.last_visit(readings(spark, d, "sparse"))


@query("mask_visits", with_(CTE["readings"], CTE["dedup"], CTE["visits"], CTE["masked"], body="select * from masked"),
       VALS, stamps="datetime")
def mask_visits_q(spark, d):
    return Q.mask_visits(dedup(spark, d), Q.last_visit(readings(spark, d)))


_DIAG_COLS = ("soil_sd air_sd soil_mean air_mean soil_min soil_max surf_max air_max mean_diff moist corr "
              "max_diff_T1 max_diff_T2 max_diff_T3 sa_diff sa_max_diff ss_max_diff sd_ratio")
_DIAG = (CTE["readings"], CTE["dedup"], CTE["diag"])


@query("daily_diagnostics", with_(*_DIAG, body="select * from diag"), _DIAG_COLS, dates="date")
def daily_diagnostics_q(spark, d):
    return Q.daily_diagnostics(dedup(spark, d))


def coded_days(spark, d):
    return Q.apply_quality(Q.daily_diagnostics(dedup(spark, d)), rules(spark))


_CODED = (*_DIAG, CTE["rules"], CTE["coded"])


@query("apply_quality", with_(*_CODED, body="select site, date, tomst_id, probl from coded"), dates="date")
def apply_quality_q(spark, d):
    return coded_days(spark, d).select("site", "date", "tomst_id", "probl")


@query("regularize", with_(CTE["five"], CTE["five_dedup"], body="""select site, tomst_id, datetime, event_id::double as event_id,
  "T1" from five_dedup union all
  select site, tomst_id, unnest(generate_series(p + to_minutes(m), datetime - interval 1 minute, to_minutes(m))), null, null
  from (select *, case when coalesce(lag(g) over w, 15) % 15 = 0 then 15 else 10 end as m from (
    select *, lag(datetime) over w as p, date_diff('minute', lag(datetime) over w, datetime) as g from five_dedup
    window w as (partition by site, tomst_id order by datetime))
  window w as (partition by site, tomst_id order by datetime)) where g > 15"""), "T1 event_id", stamps="datetime")
def regularize_q(spark, d):
    out = Q.regularize(dedup(spark, d, "five"))
    return out.select("site", "tomst_id", "datetime", F.col("event_id").cast("double").alias("event_id"), "T1")


@query("stable_readings", with_(*_CODED, CTE["stable"].format(src="dedup", step=40.0), body="select site, datetime, \"T3\" from stable"),
       "T3", stamps="datetime")
def stable_readings_q(spark, d):
    return Q.stable_readings(dedup(spark, d), 40.0).select("site", "datetime", "T3")


_OFFSETS = (*_CODED, CTE["stable"].format(src="office_rows", step=40.0), CTE["offsets"])


@query("sensor_offsets", with_(*_OFFSETS, body="select * from offsets"), "T1 T2 T3")
def sensor_offsets_q(spark, d):
    return Q.sensor_offsets(dedup(spark, d), coded_days(spark, d), 40.0)


@query("apply_offsets", with_(*_OFFSETS, body="""select d.site, d.datetime, d."T1" - coalesce(o."T1", 0) as "T1",
  d."T2" - coalesce(o."T2", 0) as "T2", d."T3" - coalesce(o."T3", 0) as "T3" from dedup d left join offsets o
  on d.site = o.site and d.tomst_id = o.tomst_id"""), "T1 T2 T3", stamps="datetime")
def apply_offsets_q(spark, d):
    off = Q.sensor_offsets(dedup(spark, d), coded_days(spark, d), 40.0)
    return Q.apply_offsets(dedup(spark, d), off).select("site", "datetime", "T1", "T2", "T3")


@query("drop_office", with_(*_CODED, body="""select d.site, d.datetime, c.probl from dedup d join coded c on d.site = c.site
  and d.tomst_id = c.tomst_id and cast(d.datetime as date) = c.date where c.probl <> 2"""), stamps="datetime")
def drop_office_q(spark, d):
    return Q.drop_office(dedup(spark, d), coded_days(spark, d)).select("site", "datetime", "probl")


@query("mask_incomplete_days", with_(CTE["readings"], CTE["dedup"], body="""select d.site, d.datetime, case when h = 24
  then "T1" end as "T1", case when h = 24 then "T2" end as "T2", case when h = 24 then "T3" end as "T3",
  case when h = 24 then moist end as moist from dedup d join (select site, cast(datetime as date) as date,
  count(distinct hour(datetime)) as h from dedup group by 1, 2) x on d.site = x.site and cast(d.datetime as date) = x.date"""),
  VALS, stamps="datetime")
def mask_incomplete_days_q(spark, d):
    return Q.mask_incomplete_days(dedup(spark, d)).select("site", "datetime", "T1", "T2", "T3", "moist")


# --- days -------------------------------------------------------------------------------------

# A complete hourly grid per site, values null where an hour is missing or out of limits.
GRID_SQL = """grid as (
  select g.site, g.datetime, l."T1", l."T2", l."T3", l.moist, l.probl_seed from (
    select site, unnest(generate_series(min(datetime), max(datetime), interval 1 hour)) as datetime
    from limited group by site) g left join limited l on g.site = l.site and g.datetime = l.datetime)"""


def grid(spark, d):
    limited = FL.apply_limits(dedup(spark, d, "sparse"), "oulu")
    return Q.regularize(limited, 60, 60).select("site", "datetime", "T1", "T2", "T3", "moist", "probl_seed")


_GRID = (CTE["sparse"], CTE["sparse_dedup"], limits_sql("sparse_dedup", "limited"), GRID_SQL)


def _interp(c):
    return f"""case when "{c}" is not null then "{c}" when pb_{c} - pa_{c} <= 4 then va_{c} + (vb_{c} - va_{c})
    * (epoch(datetime) - ta_{c}) / (tb_{c} - ta_{c}) end as "{c}" """


def _anchors(c):
    out = []
    for tag, expr in (("v", f'"{c}"'), ("t", f'case when "{c}" is not null then epoch(datetime) end'),
                      ("p", f'case when "{c}" is not null then p end')):
        out.append(f"last_value({expr} ignore nulls) over (partition by site order by datetime rows between "
                   f"unbounded preceding and current row) as {tag}a_{c}")
        out.append(f"first_value({expr} ignore nulls) over (partition by site order by datetime rows between "
                   f"current row and unbounded following) as {tag}b_{c}")
    return ", ".join(out)


_COLS4 = ("T1", "T2", "T3", "moist")
CTE["filled"] = "filled as (select site, datetime, probl_seed, " + ", ".join(map(_interp, _COLS4)) + \
    " from (select *, " + ", ".join(map(_anchors, _COLS4)) + \
    " from (select *, row_number() over (partition by site order by datetime) as p from grid)))"


@query("interpolate", with_(*_GRID, CTE["filled"], body="select site, datetime, \"T1\", \"T2\", \"T3\", moist from filled"),
       VALS, stamps="datetime")
def interpolate_q(spark, d):
    return D.interpolate(grid(spark, d)).select("site", "datetime", "T1", "T2", "T3", "moist")


_DAILY_SQL = "select site, cast(datetime as date) as date, " + ", ".join(
    f'round_even(100.0 * count("{c}") / count(*), 1) as "{c}_prop"' for c in ("T1", "T3", "moist")) + ", " + ", ".join(
    f'{f}("{c}") as "{c}_{n}"' for c in ("T1", "T3") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + \
    ", avg(moist) as moist_mean, cast(max(probl_seed) as double) as probl from filled group by 1, 2"
_DAILY_COLS = "T1_prop T3_prop moist_prop T1_mean T1_min T1_max T3_mean T3_min T3_max moist_mean"


@query("daily_aggregate", with_(*_GRID, CTE["filled"], body=_DAILY_SQL), _DAILY_COLS + " probl", dates="date")
def daily_aggregate(spark, d):
    out = D.daily(D.interpolate(grid(spark, d)).withColumnRenamed("probl_seed", "probl"))
    return out.withColumn("probl", F.col("probl").cast("double"))


def _range_sql(lo, mid, hi, floor0=False):
    f = (lambda x: f"greatest({x}, 0.0)") if floor0 else (lambda x: x)
    return (f"with {DAYS_SQL} select date, {f(f'min({lo})')} as \"Tmin\", {f(f'avg({mid})')} as \"Tmean\", "
            f"{f(f'max({hi})')} as \"Tmax\" from days group by date")


@query("daily_range", _range_sql('"T1_min"', '"T1_mean"', '"T1_max"'), "Tmin Tmean Tmax", dates="date")
def daily_range_q(spark, d):
    return D.daily_range(days(spark, d), ("T1_min", "T1_mean", "T1_max"))


@query("daily_range_moisture", _range_sql("moist - 20", "moist - 20", "moist - 20", True), "Tmin Tmean Tmax", dates="date")
def daily_range_moisture(spark, d):
    shifted = days(spark, d).withColumn("moist", F.col("moist") - 20)
    return D.daily_range(shifted, ("moist", "moist", "moist"), floor0=True)


CODES_SQL = {"T1": "0, 3, 5, 6, 7, 8, 10", "T3": "0, 6, 9, 11", "moist": "0, 3, 4, 5, 7, 11"}


def usable_sql(measure):
    var, prop, months = D.MEASURES[measure]
    gate = f" and month(date) in ({', '.join(map(str, months))})" if months else ""
    return (f'select site, date, "{measure}" as value from day_table where "{prop}" >= 90 '
            f"and probl in ({CODES_SQL[var]}){gate}")


_AV = [f"""a{i} as (select date, count(value)::double / (select count(distinct site) from u{i}) as p from u{i} group by date)"""
       for i in range(3)]


@query("availability", with_(DAY_TABLE_SQL, *[f"u{i} as ({usable_sql(m)})" for i, m in enumerate(("T1_mean", "T3_mean", "moist_mean"))],
       *_AV, "dd as (select date from a0 union select date from a1 union select date from a2)",
       body=" union all ".join(f"select dd.date, '{v}' as var, p as proportion from dd left join a{i} on dd.date = a{i}.date"
                               for i, v in enumerate(("T1", "T3", "moist")))), "proportion", dates="date")
def availability_q(spark, d):
    return D.availability(day_table(spark, d))


# The way from cleaned readings to days: half hours, calibration, short gaps, daily values.
_STUDY = (CTE["quarter"], CTE["quarter_dedup"], limits_sql("quarter_dedup", "limited"),
          f"""grid as (select site, datetime, "T1", "T2", "T3", case when not ("T1" < 1 or probl_seed = 1) then moist end as moist,
  probl_seed from (select * replace ({_CAL} as moist) from limited where minute(datetime) in (0, 30)
  and cast(datetime as date) between date '2024-01-02' and date '2024-01-29'))""", CTE["filled"])


@query("study_days", with_(*_STUDY, body=_DAILY_SQL), _DAILY_COLS + " probl", dates="date")
def study_days_q(spark, d):
    cleaned = FL.apply_limits(dedup(spark, d, "quarter"), "oulu").withColumnRenamed("probl_seed", "probl")
    out = study_days(cleaned, period=(dt.date(2024, 1, 2), dt.date(2024, 1, 29)))
    return out.withColumn("probl", F.col("probl").cast("double"))


# --- figures and names ------------------------------------------------------------------------

@query("select_as", "select event_id as reading, user_id as logger, value as raw from events", "raw")
def select_as_q(spark, d):
    return T.select_as(table(spark, d, "events"), {"event_id": "reading", "user_id": "logger", "value": "raw"})


def _masks_sql(network):
    drop = {v: ", ".join(map(str, codes)) for (net, v), codes in PLOT_DROP_CODES.items() if net == network}
    hidden = ", ".join(f'case when probl_seed not in ({codes}) then "{v}" end as "{v}"' for v, codes in drop.items() if v != "moist")
    moist = f"case when probl_seed not in ({drop['moist']}) then moist end" if "moist" in drop else "moist"
    t1 = f'case when probl_seed not in ({drop["T1"]}) then "T1" end' if "T1" in drop else '"T1"'
    return f"select event_id, {hidden}, case when {t1} > 1 then {moist} end as moist from readings"


def _masked(network):
    cols = ["event_id", *[v for (net, v) in PLOT_DROP_CODES if net == network and v != "moist"], "moist"]
    return lambda spark, d: FL.plot_masks(readings(spark, d).withColumnRenamed("probl_seed", "probl"), network).select(*cols)


for _network in sorted({net for net, _ in PLOT_DROP_CODES}):
    query(f"plot_masks_{_network}", with_(CTE["readings"], body=_masks_sql(_network)),
          " ".join(c for (net, c) in PLOT_DROP_CODES if net == _network and c != "moist") + " moist")(_masked(_network))
