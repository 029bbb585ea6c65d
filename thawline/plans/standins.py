"""Logger, day, cell and point tables expressed over the shared test tables.

There is no sample data for this domain, so each input table is a projection of a
whole given table. The `*_SQL` strings say the same for the SQL comparison.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Users of a site, minutes of a step, and steps from one reading of a site to its next. Every event is a reading; a
# site has one logger and one reading per stamp, so the readings grow with the events and the sites with the users.
HOURLY = "1 + case when event_id % 37 = 0 then 2 else 0 end"
KINDS = {"readings": (5, 60, HOURLY), "sparse": (2, 60, "1 + case when event_id % 4 = 0 then 1 + event_id % 5 else 0 end"),
         "quarter": (5, 15, "1 + event_id % 3"), "five": (5, 5, "1 + event_id % 5")}
_VALUES = """value / 5.3 - 20 as "T1", value / 8.7 - 15 as "T2", {k} / 2.1 - 20 as "T3", 300 + 40 * {k} as moist,
    cast(event_id % 12 as integer) as probl_seed"""
_K_SQL = "cast(json_extract_string(props, '$.k') as double)"


def _values():
    k = F.get_json_object("props", "$.k").cast("double")
    return [(F.col("value") / 5.3 - 20).alias("T1"), (F.col("value") / 8.7 - 15).alias("T2"), (k / 2.1 - 20).alias("T3"),
            (k * 40 + 300).alias("moist"), (F.col("event_id") % 12).cast("int").alias("probl_seed")]


def readings(spark, sf_dir, kind: str = "readings") -> DataFrame:
    users, minutes, step = KINDS[kind]
    place = F.expr(f"user_id div {users}")
    steps = F.sum(F.expr(step)).over(Window.partitionBy(place).orderBy("event_id"))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(steps * minutes).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), place.cast("string")).alias("site"), (place + 9000).alias("tomst_id"),
        stamp.alias("datetime"), "event_id", *_values())


def readings_sql(kind: str = "readings") -> str:
    users, minutes, step = KINDS[kind]
    return f"""{kind} as (
  select 'S' || cast(user_id // {users} as varchar) as site, cast(9000 + user_id // {users} as bigint) as tomst_id,
    timestamp '2024-01-01' + to_minutes(cast({minutes} * sum({step}) over (partition by user_id // {users} order by event_id) as integer)) as datetime,
    event_id, {_VALUES.format(k=_K_SQL)}
  from events)"""


def arrivals(spark, sf_dir) -> DataFrame:
    """Readings that came more than once: the stamp is the event's hour, and the last arrival counts."""
    place = F.expr("user_id div 5")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), place.cast("string")).alias("site"), (place + 9000).alias("tomst_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"), "event_id", *_values())


ARRIVALS_SQL = f"""arrivals as (
  select 'S' || cast(user_id // 5 as varchar) as site, cast(9000 + user_id // 5 as bigint) as tomst_id,
    date_trunc('hour', ts) as datetime, event_id, {_VALUES.format(k=_K_SQL)} from events)"""

# Ten sites for each hundred suppliers.
_PLACE = "l_suppkey % 10 + l_suppkey {div} 100 * 10"
PLACE_SQL = _PLACE.format(div="//")


def _site():
    return F.concat(F.lit("S"), F.expr(_PLACE.format(div="div")).cast("string"))


def days(spark, sf_dir) -> DataFrame:
    q, air = F.col("l_quantity"), F.col("l_quantity") + 100 * F.col("l_discount")
    return (table(spark, sf_dir, "lineitem")
            .groupBy(_site().alias("site"), F.to_date("l_shipdate").alias("date"))
            .agg((F.avg(q) - 25).alias("T1_mean"), (F.min(q) - 28).alias("T1_min"), (F.max(q) - 22).alias("T1_max"),
                 (F.avg(air) - 30).alias("T3_mean"), (F.min(air) - 35).alias("T3_min"),
                 (F.max(air) - 25).alias("T3_max"), (F.avg("l_tax") * 500).alias("moist")))


DAYS_SQL = f"""days as (
  select 'S' || cast({PLACE_SQL} as varchar) as site, cast(l_shipdate as date) as date,
    avg(l_quantity) - 25 as "T1_mean", min(l_quantity) - 28 as "T1_min", max(l_quantity) - 22 as "T1_max",
    avg(l_quantity + 100 * l_discount) - 30 as "T3_mean", min(l_quantity + 100 * l_discount) - 35 as "T3_min",
    max(l_quantity + 100 * l_discount) - 25 as "T3_max", avg(l_tax) * 500 as moist
  from lineitem group by 1, 2),
hyd as (
  select *, cast(year(date + 122) as integer) as y, cast(month(date) as integer) as m,
    cast(dayofyear(date) as integer) as doy from days)"""


def day_table(spark, sf_dir) -> DataFrame:
    """`days` with the coverage and code columns of a daily aggregate."""
    q, air = F.col("l_quantity"), F.col("l_quantity") + 100 * F.col("l_discount")

    def share(test):
        return F.round(100.0 * F.count_if(test) / F.count(F.lit(1)), 1)

    return (table(spark, sf_dir, "lineitem")
            .groupBy(_site().alias("site"), F.to_date("l_shipdate").alias("date"))
            .agg(share(F.col("l_tax") > 0).alias("T1_prop"), share(F.col("l_discount") > 0).alias("T3_prop"),
                 share(F.col("l_tax") < 0.08).alias("moist_prop"),
                 (F.avg(q) - 25).alias("T1_mean"), (F.min(q) - 28).alias("T1_min"), (F.max(q) - 22).alias("T1_max"),
                 (F.avg(air) - 30).alias("T3_mean"), (F.min(air) - 35).alias("T3_min"),
                 (F.max(air) - 25).alias("T3_max"), (F.avg("l_tax") * 500).alias("moist_mean"),
                 (F.max("l_linenumber") % 7).cast("int").alias("probl")))


DAY_TABLE_SQL = f"""day_table as (
  select 'S' || cast({PLACE_SQL} as varchar) as site, cast(l_shipdate as date) as date,
    round(100.0 * count(*) filter (l_tax > 0) / count(*), 1) as "T1_prop",
    round(100.0 * count(*) filter (l_discount > 0) / count(*), 1) as "T3_prop",
    round(100.0 * count(*) filter (l_tax < 0.08) / count(*), 1) as moist_prop,
    avg(l_quantity) - 25 as "T1_mean", min(l_quantity) - 28 as "T1_min", max(l_quantity) - 22 as "T1_max",
    avg(l_quantity + 100 * l_discount) - 30 as "T3_mean", min(l_quantity + 100 * l_discount) - 35 as "T3_min",
    max(l_quantity + 100 * l_discount) - 25 as "T3_max", avg(l_tax) * 500 as moist_mean,
    cast(max(l_linenumber) % 7 as integer) as probl
  from lineitem group by 1, 2)"""


def cells(spark, sf_dir) -> DataFrame:
    """A grid 50 cells wide with one row per part; `z` is rough ground on a slope."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(key / 50).cast("int").alias("row"), (key % 50).cast("int").alias("col"),
        F.col("p_retailprice").alias("elev"), F.col("p_size").cast("double").alias("ndvi"),
        (F.col("p_retailprice") + 0.2 * F.col("p_size")).alias("z"),
        (F.col("p_type") == "ECONOMY").cast("int").alias("water"), F.col("p_brand").alias("brand"))


CELLS_SQL = """cells as (
  select cast(floor(p_partkey / 50.0) as integer) as row, cast(p_partkey % 50 as integer) as col, p_retailprice as elev,
    cast(p_size as double) as ndvi, p_retailprice + 0.2::double * p_size as z,
    case when p_type = 'ECONOMY' then 1 else 0 end as water, p_brand as brand from part)"""


def points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("site"),
        (F.col("s_acctbal") / 200 + 5).alias("x"), (F.col("s_nationkey") * 1.5 + 2.25).alias("y"))


POINTS_SQL = """points as (select 'S' || s_suppkey as site, s_acctbal / 200 + 5 as x, s_nationkey * 1.5::double + 2.25::double as y from supplier)"""

# A concave ring and a zigzag line, as offsets from each point.
RING = [(-2.3, -1.1), (1.9, -1.7), (0.4, 0.2), (2.1, 2.6), (-1.6, 1.3)]
ZIGZAG = [(0.0, 0.0), (3.1, 1.7), (1.2, -2.3)]


def vertices(spark, sf_dir, shape) -> DataFrame:
    corner = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shape])
    return points(spark, sf_dir).select("site", "x", "y", F.posexplode(corner).alias("seq", "o")).select(
        F.col("site").alias("feature_id"), F.lit(0).alias("part_id"), "seq",
        (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))


def vertices_sql(name: str, shape) -> str:
    return f"{name} as (" + " union all ".join(
        f"select site as feature_id, 0 as part_id, {i} as seq, x + ({dx})::double as x, y + ({dy})::double as y from points"
        for i, (dx, dy) in enumerate(shape)) + ")"


def edges_sql(name: str, src: str, closed: bool) -> str:
    n = {"ring": len(RING), "zig": len(ZIGZAG)}[src]
    nxt = f"(a.seq + 1) % {n}" if closed else "a.seq + 1"
    return (f"{name} as (select a.feature_id, a.part_id, a.seq, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from {src} a "
            f"join {src} b on a.feature_id = b.feature_id and a.part_id = b.part_id and b.seq = {nxt})")


def lidar(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50 + F.col("l_discount") * 9).alias("x"), (F.col("l_suppkey") % 40 + F.col("l_tax") * 10).alias("y"),
        (F.col("l_quantity") / 1.5).alias("z"), (F.col("l_linenumber") % 3).cast("int").alias("class"))


LIDAR_SQL = """lidar as (select l_partkey % 50 + l_discount * 9 as x, l_suppkey % 40 + l_tax * 10 as y, l_quantity / 1.5 as z,
  cast(l_linenumber % 3 as integer) as class from lineitem)"""
