from thawline.operators import climate as C
from thawline.plans.registry import query
from thawline.plans.standins import DAYS_SQL, days


def strict_sql(agg: str, x: str) -> str:
    return f"case when count(*) = count({x}) then {agg}({x}) end"


def _with(body: str) -> str:
    return f"with {DAYS_SQL}\n{body}"


def _yearly(cols: dict[str, str], where: str = "true") -> str:
    """Per (site, year) aggregates and their strict mean over years."""
    inner = ", ".join(f'{v} as "{k}"' for k, v in cols.items())
    outer = ", ".join(f"{strict_sql('avg', chr(34) + k + chr(34))} as \"{k}\"" for k in cols)
    return f"select site, {outer} from (select site, y, {inner} from hyd where {where} group by site, y) group by site"


ANNUAL = f"""select site, {strict_sql('avg', '"T1_mean"')} as "T1_mean",
  {strict_sql('avg', '"T3_mean"')} as "T3_mean" from hyd group by site"""
MONTHLY = "select site, " + ", ".join(
    f'case when count(*) filter (m = {m}) = count("{s}_mean") filter (m = {m}) '
    f'then avg("{s}_mean") filter (m = {m}) end as "{s}_mean_{m}"'
    for s in C.SENSORS for m in range(1, 13)) + " from hyd group by site"


def _clip_sql(x, t, side):
    op = "<" if side == "above" else ">"
    return f"case when {x} {op} {t} then 0.0 when {x} is not null then {x} end"


def _count_sql(x, t, side):
    op = "<" if side == "above" else ">"
    return f"case when {x} {op} {t} then 0.0 when {x} is not null then 1.0 end"


def _family(kind, n, t, side):
    suffix = "" if kind is _clip_sql else "_days"
    return _yearly({f"{s}_{n}{suffix}": strict_sql("sum", "(" + kind(f'"{s}_mean"', t, side) + ")") for s in C.SENSORS})


EXTREMES = {"min": _yearly({f"{s}_min": f'quantile_cont("{s}_min", 0.005)' for s in C.SENSORS}),
            "max": _yearly({f"{s}_max": f'quantile_cont("{s}_max", 0.995)' for s in C.SENSORS})}
FROST = _yearly({"T3_frost": strict_sql("sum", "(" + _clip_sql('"T3_min"', 0.0, "below") + ")")},
                'm between 5 and 8 and doy < 227 and "T1_mean" >= 1')


def _season(t):
    return _yearly({f"sos{t}": "min(doy)", f"eos{t}": "max(doy)"}, f'"T1_mean" >= {t} and "T3_mean" >= {t}')


def _ft(s, step, inclusive):
    # The reference sequence: per site and day the maximum, then the minimum.
    op = ">=" if inclusive else ">"
    return f"""select site, avg(n) as "{s}_ft" from (
  select site, y, sum(case when sg * pv = -1 and abs(v - pvv) {op} {step} then 1 else 0 end) as n from (
    select site, y, v, sg, lag(sg) over (partition by site, y order by date, k) as pv,
      lag(v) over (partition by site order by date, k) as pvv from (
      select site, y, date, 1 as k, "{s}_max" as v, case when "{s}_max" >= 0 then 1 else -1 end as sg from hyd
      union all
      select site, y, date, 2 as k, "{s}_min" as v, case when "{s}_min" >= 0 then 1 else -1 end as sg from hyd))
  group by site, y) group by site"""


FT = {s: _ft(s, *C.FREEZE_STEPS[s]) for s in C.SENSORS}


def _moist(suffix, months):
    body = _yearly({f"moist_{n}_{suffix}": strict_sql(f, "moist")
                    for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("sd", "stddev_samp"))},
                   f'"T1_mean" >= 1 and m in ({", ".join(map(str, months))})')
    return f"""select *, case when moist_mean_{suffix} <> 0 then moist_sd_{suffix} / moist_mean_{suffix} end
  as moist_cv_{suffix} from ({body})"""


@query("annual_mean", _with(ANNUAL), "T1_mean T3_mean")
def annual_mean(spark, d):
    return C.annual_mean(days(spark, d))


@query("monthly_means", _with(MONTHLY), " ".join(f"{s}_mean_{m}" for s in C.SENSORS for m in range(1, 13)))
def monthly_means(spark, d):
    return C.monthly_means(days(spark, d))


def _register_families():
    for n, t, side in C.DEGREE_FAMILIES:
        query(f"degree_days_{n.lower()}", _with(_family(_clip_sql, n, t, side)), f"T1_{n} T3_{n}")(
            lambda spark, d, n=n, t=t, side=side: C.degree_days(days(spark, d), t, side, n))
        query(f"degree_day_counts_{n.lower()}", _with(_family(_count_sql, n, t, side)), f"T1_{n}_days T3_{n}_days")(
            lambda spark, d, n=n, t=t, side=side: C.degree_day_counts(days(spark, d), t, side, f"{n}_days"))
    for stat, p in (("min", 0.005), ("max", 0.995)):
        query(f"extreme_quantile_{stat}", _with(EXTREMES[stat]), f"T1_{stat} T3_{stat}")(
            lambda spark, d, stat=stat, p=p: C.extreme_quantile(days(spark, d), stat, p))
    for t in (1, 3):
        query(f"season_dates_{t}", _with(_season(t)), f"sos{t} eos{t}")(
            lambda spark, d, t=t: C.season_dates(days(spark, d), t))
    for s, (size, inc) in C.FREEZE_STEPS.items():
        query(f"freeze_thaw_{s.lower()}", _with(FT[s]), f"{s}_ft")(
            lambda spark, d, s=s, size=size, inc=inc: C.freeze_thaw(days(spark, d), s, size, inc))
    for suffix, months in C.SEASONS:
        query(f"moisture_season_{suffix}", _with(_moist(suffix, months)),
              " ".join(f"moist_{k}_{suffix}" for k in ("mean", "max", "min", "sd", "cv")))(
            lambda spark, d, suffix=suffix, months=months: C.moisture_season(days(spark, d), months, suffix))


_register_families()


@query("summer_frost", _with(FROST), "T3_frost")
def summer_frost(spark, d):
    return C.summer_frost(days(spark, d))


_PARTS = ([ANNUAL, MONTHLY, EXTREMES["min"], EXTREMES["max"]]
          + [_family(_clip_sql, *f) for f in C.DEGREE_FAMILIES] + [_family(_count_sql, *f) for f in C.DEGREE_FAMILIES]
          + [_season(1), _season(3), FT["T1"], FT["T3"], FROST] + [_moist(*s) for s in C.SEASONS])


@query("site_variables", _with("select * from " + "\nfull join ".join(
    f"({p}) p{i}" + (" using (site)" if i else "") for i, p in enumerate(_PARTS))), " ".join(C.variable_names()))
def site_variables(spark, d):
    return C.site_variables(days(spark, d))
