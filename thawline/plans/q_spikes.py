"""Queries of the spike chain and of whole cleaned readings."""
import datetime as dt

from pyspark.sql import functions as F

from thawline.functions import month_index
from thawline.functions.tables import SPIKE_RATIO_RULES, SPIKE_STEP_LIMIT, keep_codes_for
from thawline.operators import filters as FL, quality as Q, spikes as S
from thawline.plans.cleaning import cleaned_readings
from thawline.plans.q_readings import _CODED, CTE, coded_days, dedup, limits_sql, rules, with_
from thawline.plans.registry import query
from thawline.sources import cut_lineage

NET = "oulu"
HOURLY = (60,)


def _allowed_sql(stage, net):
    codes = {s: ", ".join(map(str, keep_codes_for(stage, net, s))) for s in S.SENSORS}
    return "(" + " or ".join(f"(sensor = '{s}' and probl in ({codes[s]}))" for s in S.SENSORS) + ")"


def chain_sql(field: str, net: str = NET) -> list[str]:
    """CTEs from coded field readings to corrected sensor rows."""
    b = "date_diff('minute', lag(datetime) over w, datetime) as b, date_diff('minute', datetime, lead(datetime) over w) as f"
    win = "window w as (partition by site order by datetime)"
    my = "cast(year(datetime) * 12 + month(datetime) - 1 as integer) as my"
    longs = lambda src: " union all ".join(
        f"select site, datetime, {my}, probl, '{s}' as sensor, \"{s}\" as value from {src}" for s in S.SENSORS)
    def rule(s):
        flag = "0"
        ifk = lambda c, y, n: f"(case when {c} then {y} when not ({c}) then {n} end)"
        def bound(c, v):
            return "true" if v is None else (f"{c} > {v}" if v > 0 else f"{c} < {v}")
        for d, ch, be, af, reset in SPIKE_RATIO_RULES[s]:
            c = f"(rel_diff > {d} and rel_change > {ch} and {bound('rel_before', be)} and {bound('rel_after', af)})"
            flag = ifk(c, 1, 0 if reset else flag)
        k = SPIKE_STEP_LIMIT[s]
        flag = ifk(f"(step_before > {k} and step_after > {k})", 1, flag)
        flag = ifk(f"(step_before < -{k} and step_after < -{k})", 1, flag)
        flag = ifk("(diff < 1)", 0, flag)
        return ifk("(diff > 20 or change > 20)", 1, flag)
    g = "partition by site, my, sensor order by datetime"
    trim = lambda l: (f"case when len({l}) % 2 = 0 then list_avg({l}) else (list_sum({l}) - list_sum({l}[(len({l}) + 1) // 2 - 2 : "
                      f"(len({l}) + 1) // 2 + 2])) / (len({l}) - 5) end")
    return [
        f"sp0 as (select *, {b} from {field} where probl <> 1 {win})",
        f"sp1 as (select * exclude (b, f) from sp0 where b = 60 or f = 60)",
        f"sp2 as (select *, {b} from sp1 {win})",
        "base as (select * exclude (b, f) from sp2 x where (select min(b) from sp2 y where y.site = x.site) >= 60 "
        "or b + f is null or b + f >= 120)",
        f"everyrow as ({longs(field)})",
        f"own as (select * from ({longs('base')}) where {_allowed_sql('spike_own', net)} and value is not null)",
        "good as (select site, my, sensor from own group by 1, 2, 3 "
        "having count(distinct cast(datetime as date)) > 3 and count(*) > 100)",
        "enough as (select o.* from own o join good using (site, my, sensor))",
        f"""cors as (select o.site, o.my, o.sensor, e.site as peer, case when count(*) = count(e.value) and count(*) > 1
          and not isnan(corr(o.value, e.value)) then corr(o.value, e.value) end as cor
          from enough o join (select * replace (case when {_allowed_sql('spike_peer', net)} then value end as value) from everyrow) e
          on o.datetime = e.datetime and o.sensor = e.sensor and o.site <> e.site group by 1, 2, 3, 4)""",
        """peers as (select * exclude (rn) from (select *, row_number() over (partition by site, my, sensor
          order by round(cor, 12) desc nulls last, peer) as rn from cors) where rn = 1)""",
        """paired as (select o.*, p.peer, e.value as peer_value, o.value - e.value as me from enough o
          left join peers p using (site, my, sensor)
          left join everyrow e on e.site = p.peer and e.sensor = o.sensor and e.datetime = o.datetime)""",
        f"""f1 as (select *, value - lag(value) over w as step_before, value - lead(value) over w as step_after,
          coalesce(abs(me - lag(me) over w), 0) + coalesce(abs(me - lead(me) over w), 0) as diff,
          coalesce(abs(value - lag(value) over w), 0) + coalesce(abs(value - lead(value) over w), 0) as change
          from paired window w as ({g}))""",
        f"""f2 as (select *, list(diff) over w as ld, list(change) over w as lc from f1
          window w as ({g} rows between 71 preceding and 72 following))""",
        f"f3 as (select * exclude (ld, lc), {trim('ld')} + 0.001 as roll_diff, {trim('lc')} + 0.001 as roll_change from f2)",
        """features as (select *, diff / roll_diff as rel_diff, change / roll_change as rel_change,
          step_before / roll_change as rel_before, step_after / roll_change as rel_after from f3)""",
        "flags as (select *, cast(case sensor " + " ".join(f"when '{s}' then {rule(s)}" for s in S.SENSORS)
        + " end as integer) as flag from features)",
        f"""spread as (select *, flag + lag(flag, 1) over w + lag(flag, 2) over w + lag(flag, 3) over w
          + lag(flag, 4) over w + lead(flag) over w as total from flags window w as ({g}))""",
        "wide as (select *, case when total > 1 then 1 else total end as error from spread)",
        f"""filled as (select *, case when error = 1 then avg(case when error = 1 then null else me end) over
          ({g} rows between 5 preceding and 5 following) + peer_value else value end as corrected from wide)""",
        """corrected as (select site, my, sensor, datetime, corrected from filled union all
          select site, my, sensor, datetime, value from own anti join good using (site, my, sensor))""",
        """assembled as (select b.site, b.datetime, b.moist, b.probl, max(corrected) filter (sensor = 'T1') as "T1",
          max(corrected) filter (sensor = 'T2') as "T2", max(corrected) filter (sensor = 'T3') as "T3"
          from base b left join corrected c on b.site = c.site and b.datetime = c.datetime group by 1, 2, 3, 4)""",
    ]


FIELD = """field as (select d.*, c.probl from dedup d join coded c on d.site = c.site and d.tomst_id = c.tomst_id
  and cast(d.datetime as date) = c.date where c.probl <> 2)"""
_CHAIN = (*_CODED, FIELD, *chain_sql("field"))


def field_rows(spark, d):
    return Q.drop_office(dedup(spark, d), coded_days(spark, d))


def parts(spark, d):
    field = cut_lineage(field_rows(spark, d))
    base = cut_lineage(FL.regular_spacing(field.filter(F.col("probl") != 1), HOURLY))
    own = S.own_rows(S.sensor_rows(base), NET)
    return base, field, own, FL.supported(own, S.GROUP)


def paired(spark, d):
    _, every, _, enough = parts(spark, d)
    return S.with_peer(enough, S.sensor_rows(every), S.best_peer(enough, every, NET))


FEATS = "diff change roll_diff roll_change rel_diff rel_change rel_before rel_after"
KEYS = "site, my, sensor, datetime"
_keys = ["site", "my", "sensor", "datetime"]


@query("best_peer", with_(*_CHAIN, body="select * from peers"), "cor")
def best_peer_q(spark, d):
    _, every, _, enough = parts(spark, d)
    return S.best_peer(enough, every, NET)


@query("spike_features", with_(*_CHAIN, body=f"select {KEYS}, {FEATS.replace(' ', ', ')} from features"), FEATS,
       stamps="datetime")
def spike_features_q(spark, d):
    return S.spike_features(paired(spark, d)).select(*_keys, *FEATS.split())


@query("spike_flags", with_(*_CHAIN, body=f"select {KEYS}, flag::double as flag from flags"), "flag", stamps="datetime")
def spike_flags_q(spark, d):
    return S.spike_flags(S.spike_features(paired(spark, d))).select(*_keys, F.col("flag").cast("double").alias("flag"))


@query("dilate_flags", with_(*_CHAIN, body=f"select {KEYS}, error::double as error from wide"), "error", stamps="datetime")
def dilate_flags_q(spark, d):
    out = S.dilate_flags(S.spike_flags(S.spike_features(paired(spark, d))))
    return out.select(*_keys, F.col("error").cast("double").alias("error"))


@query("fill_spikes", with_(*_CHAIN, body=f"select {KEYS}, corrected from corrected"), "corrected", stamps="datetime")
def fill_spikes_q(spark, d):
    _, every, own, _ = parts(spark, d)
    return S.correct_spikes(own, every, NET).select(*_keys, "corrected")


@query("assemble_clean", with_(*_CHAIN, body='select * from assembled'), "moist T1 T2 T3", stamps="datetime")
def assemble_clean_q(spark, d):
    base, every, own, _ = parts(spark, d)
    return S.assemble_clean(base, S.correct_spikes(own, every, NET))


# The whole way from readings to cleaned readings.
_LO, _HI = dt.date(2024, 1, 1), dt.date(2024, 1, 29)
_BIAS = (CTE["stable"].replace("from dedup d join office", "from masked d join office").format(src="office_rows", step=40.0),
         CTE["offsets"],
         """fixed as (select d.* replace (d."T1" - coalesce(o."T1", 0) as "T1", d."T2" - coalesce(o."T2", 0) as "T2",
            d."T3" - coalesce(o."T3", 0) as "T3") from masked d left join offsets o
            on d.site = o.site and d.tomst_id = o.tomst_id)""")


def _whole(net):
    """Only the network with out-of-field spells corrects sensor bias."""
    return (CTE["readings"], CTE["dedup"], CTE["visits"],
          """masked as (select * exclude (v) replace (case when v = 0 then "T1" end as "T1", case when v = 0 then "T2" end as "T2",
            case when v = 0 then "T3" end as "T3", case when v = 0 then moist end as moist) from (
            select d.*, sum(case when d.datetime = maxdt then 1 else 0 end) over (partition by d.site, tomst_id
            order by datetime rows between 1 preceding and 1 following) as v from dedup d
            join (select site, max(datetime) as maxdt from dedup group by site) using (site)
            where datetime > timestamp '2024-01-01' and datetime < timestamp '2024-01-29'))""",
          CTE["diag"].replace("from dedup", "from masked"), CTE["rules"], CTE["coded"],
          *(_BIAS if net == "oulu" else ("fixed as (select * from masked)",)),
          """outside as (select d.*, c.probl from fixed d join coded c on d.site = c.site and d.tomst_id = c.tomst_id
            and cast(d.datetime as date) = c.date where c.probl <> 2)""",
          """field as (select o.* replace (case when h = 24 then "T1" end as "T1", case when h = 24 then "T2" end as "T2",
            case when h = 24 then "T3" end as "T3", case when h = 24 then moist end as moist) from outside o join (
            select site as s2, cast(datetime as date) as date, count(distinct hour(datetime)) as h from outside group by 1, 2) x
            on o.site = s2 and cast(o.datetime as date) = x.date)""",
          *chain_sql("field", net), limits_sql("assembled", "finished", net))


@query("cleaned_readings", with_(*_whole(NET), body="select * from finished"), "moist T1 T2 T3", stamps="datetime")
def cleaned_readings_q(spark, d):
    return cleaned_readings(dedup(spark, d), rules(spark), NET, (_LO, _HI), spacing=HOURLY, max_step=40.0)


@query("cleaned_readings_roslin", with_(*_whole("roslin"), body="select * from finished"), "moist T1 T2 T3", stamps="datetime")
def cleaned_readings_roslin(spark, d):
    return cleaned_readings(dedup(spark, d), rules(spark), "roslin", (_LO, _HI), spacing=HOURLY, max_step=40.0)
