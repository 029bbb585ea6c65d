"""Queries on points, lines, polygons, cells and point clouds."""
import math
import re

from pyspark.sql import functions as F

from thawline.operators import extract as E, grid as G, model as M, tabular as T, terrain as R, vector as V
from thawline.operators.grid import CELL, Grid
from thawline.plans.mapping import map_responses
from thawline.plans.registry import query
from thawline.plans.standins import (
    CELLS_SQL, LIDAR_SQL, POINTS_SQL, RING, ZIGZAG, cells, edges_sql, lidar, points, table, vertices, vertices_sql,
)


def sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([CELLS_SQL, *ctes]) + "\n" + body


def layer(spark, d, name):
    return cells(spark, d).select(*CELL, F.col(name).cast("double").alias("value"))


def grid_of(spark, d) -> Grid:
    """The grid the stand-in cells lie on."""
    return Grid(0.0, 0.0, 1.0, (cells(spark, d).agg(F.max("row")).first()[0] or 0) + 1, 50)


SMALL_TILE = 16  # several tiles even on the small test grid

# --- registry, projection, clipping, shapes ---------------------------------------------------

@query("site_registry", """select case when s_suppkey = 19 then 'SAA019' else 'SAA' || s_suppkey end as site, s_acctbal as x,
  s_nationkey::double as y from supplier where s_nationkey in (select c_nationkey from customer where c_custkey % (select count(*) from supplier) = s_suppkey)""", "x y")
def site_registry_q(spark, d):
    half = table(spark, d, "supplier").select(F.concat(F.lit("saa_"), "s_suppkey").alias("site"), F.col("s_acctbal").alias("x"),
                                              F.col("s_nationkey").cast("double").alias("y"), "s_nationkey", "s_suppkey")
    n = half.count()
    data = (table(spark, d, "customer").withColumn("s_suppkey", F.col("c_custkey") % n)
            .join(half, (F.col("c_nationkey") == F.col("s_nationkey")) & (half.s_suppkey == F.col("c_custkey") % n), "left_semi")
            .select(F.when(F.col("s_suppkey") == 19, "SAA019").otherwise(F.concat(F.lit("SAA"), "s_suppkey")).alias("site")))
    return V.site_registry([half.select("site", "x", "y")], data)


@query("registry_mismatch", """select 'no point' as kind, site from (select distinct 'S' || c_custkey as site from customer)
  where site not in (select 'S' || s_suppkey from supplier) union all select 'no data', site
  from (select distinct 'S' || s_suppkey as site from supplier) where site not in (select 'S' || c_custkey from customer)""")
def registry_mismatch_q(spark, d):
    data = table(spark, d, "customer").select(F.concat(F.lit("S"), "c_custkey").alias("site"))
    a, b = V.registry_mismatch(data, points(spark, d))
    return a.select(F.lit("no point").alias("kind"), "site").unionByName(b.select(F.lit("no data").alias("kind"), "site"))


def _tm_sql():
    f, n = V.WGS84_F, V.WGS84_F / (2 - V.WGS84_F)
    e, rad = math.sqrt(f * (2 - f)), V.WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * V.UTM_K0
    al = V.krueger_alpha(n)
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(al, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(al, 1)]])
    return f"""with p as (select c_custkey, radians(68.5 + c_acctbal / 20000) as phi, radians(c_nationkey / 10.0 + 19.7 - 21) as lam from customer),
  s as (select c_custkey, lam, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) as t from p),
  q as (select c_custkey, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from s)
  select c_custkey, 500000 + {rad!r} * ({x}) as x, {rad!r} * ({y}) as y from q"""


@query("project_points", _tm_sql(), "x y", digits=3)
def project_points(spark, d):
    x, y = V.project_tm(F.col("c_nationkey") / 10.0 + 19.7, F.col("c_acctbal") / 20000 + 68.5)
    return table(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


_BOX = (10.0, 5.0, 40.0, 30.0)
_RINGS = (POINTS_SQL, vertices_sql("ring", RING), edges_sql("edge", "ring", True))
_ZIGS = (POINTS_SQL, vertices_sql("zig", ZIGZAG), edges_sql("seg", "zig", False))


@query("clip_bbox", sql("select * from ring where x between 10 and 40 and y between 5 and 30", *_RINGS), "x y")
def clip_bbox_q(spark, d):
    return V.clip_bbox(vertices(spark, d, RING), _BOX)


@query("clip_lines", sql("""select feature_id, part_id, seq, x1 + t0 * (x2 - x1) as x1, y1 + t0 * (y2 - y1) as y1,
  x1 + t1 * (x2 - x1) as x2, y1 + t1 * (y2 - y1) as y2 from (select *,
    greatest(0, least((10 - x1) / (x2 - x1), (40 - x1) / (x2 - x1)), least((5 - y1) / (y2 - y1), (30 - y1) / (y2 - y1))) as t0,
    least(1, greatest((10 - x1) / (x2 - x1), (40 - x1) / (x2 - x1)), greatest((5 - y1) / (y2 - y1), (30 - y1) / (y2 - y1))) as t1
  from seg) where t0 <= t1""", *_ZIGS), "x1 y1 x2 y2")
def clip_lines_q(spark, d):
    return V.clip_lines(vertices(spark, d, ZIGZAG), _BOX)


# Area under the part of each edge between the box's sides, heights cut to the box: no vertex of the result is needed.
_BOXED = """strips as (select feature_id, x1, y1, x2, y2, (y2 - y1) / (x2 - x1) as k, greatest(10, least(40, x1)) as a, greatest(10, least(40, x2)) as b from edge),
heights as (select *, y1 + (a - x1) * k as ya, y1 + (b - x1) * k as yb from strips where a <> b),
unders as (select feature_id, case when ya = yb then (b - a) * (greatest(5, least(30, ya)) - 5)
  else (b - a) / (yb - ya) * (h(yb) - h(ya)) end as area from heights),
boxed as (select feature_id, abs(sum(area)) as area from unders group by 1)"""
_BOXED = re.sub(r"h\((y[ab])\)", r"(case when \1 < 5 then 0 when \1 > 30 then 312.5 + 25 * (\1 - 30) else (\1 - 5) ** 2 / 2 end)", _BOXED)


@query("clip_polygons", sql("select feature_id, area from boxed where area > 1e-9", *_RINGS, _BOXED), "area")
def clip_polygons_q(spark, d):
    return V.polygon_area(V.clip_polygons(vertices(spark, d, RING), _BOX), 1e-9)


@query("boxes_meeting", sql("""select feature_id from (select feature_id, min(x) as a, min(y) as b, max(x) as c, max(y) as e from ring group by 1)
  where a <= 40 and c >= 10 and b <= 30 and e >= 5""", *_RINGS))
def boxes_meeting_q(spark, d):
    boxes = vertices(spark, d, RING).groupBy("feature_id").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"),
                                                               F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    return V.boxes_meeting(boxes, _BOX).select("feature_id")


@query("polygon_area", sql("""select * from (select feature_id, abs(sum(x1 * y2 - x2 * y1)) / 2 as area from edge group by 1)
  where area > 5""", *_RINGS), "area")
def polygon_area_q(spark, d):
    return V.polygon_area(vertices(spark, d, RING), 5.0)


_INSIDE = """inside as (select distinct row, col from (select c.row, c.col, feature_id, count(*) as n from cells c join edge
  on (y1 <= c.row + 0.5) <> (y2 <= c.row + 0.5) and x1 + (c.row + 0.5 - y1) * (x2 - x1) / (y2 - y1) > c.col + 0.5
  group by 1, 2, 3) where n % 2 = 1)"""
# A segment passes through a cell if the part of it inside the cell's box is not a point.
_LINED = """lined as (select distinct row, col from (select row, col,
  greatest(0, least((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), least((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1))) as t0,
  least(1, greatest((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), greatest((row - y1) / (y2 - y1), (row + 1 - y1) / (y2 - y1))) as t1
  from seg join (select cast(r as integer) as row, cast(c as integer) as col from generate_series(0, (select max(row) from cells)) a(r),
    generate_series(0, 49) b(c)) g on row between floor(least(y1, y2)) and floor(greatest(y1, y2))
    and col between floor(least(x1, x2)) and floor(greatest(x1, x2))) where t0 < t1)"""


@query("mask_polygon", sql("select c.row, c.col, elev from cells c anti join inside i on c.row = i.row and c.col = i.col",
                           *_RINGS, _INSIDE), "elev")
def mask_polygon(spark, d):
    return V.mask_polygons(cells(spark, d), vertices(spark, d, RING), grid_of(spark, d)).select(*CELL, "elev")


@query("clip_polygon_cells", sql("""select row, col from inside where col + 0.5 between 10 and 40 and row + 0.5 between 5 and 30""",
                                  *_RINGS, _INSIDE))
def clip_polygon_cells_q(spark, d):
    return V.polygon_cells(V.clip_polygons(vertices(spark, d, RING), _BOX), grid_of(spark, d)).select(*CELL).distinct()


@query("rasterize", sql("""select c.row, c.col from cells c join (select * from inside union select * from lined) f
  on c.row = f.row and c.col = f.col""", *_RINGS, *_ZIGS[1:], _INSIDE, _LINED))
def rasterize_q(spark, d):
    flagged = V.rasterize(grid_of(spark, d), vertices(spark, d, RING), vertices(spark, d, ZIGZAG))
    return cells(spark, d).select(*CELL).join(flagged, CELL).select(*CELL)


@query("line_cells", sql("select * from lined", *_ZIGS, _LINED))
def line_cells_q(spark, d):
    return V.line_cells(vertices(spark, d, ZIGZAG), grid_of(spark, d)).select(*CELL).distinct()


_PTS = """hits as (select distinct c_custkey from (select c_custkey, feature_id, count(*) as n from
  (select c_custkey, c_acctbal / 200 + 5 as x, c_nationkey * 1.5::double + 2.6::double as y from customer) p
  join edge on (y1 <= y) <> (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x group by 1, 2) where n % 2 = 1)"""


@query("points_in_polygons", sql("select c_custkey from hits", *_RINGS, _PTS))
def points_in_polygons_q(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 200 + 5).alias("x"), (F.col("c_nationkey") * 1.5 + 2.6).alias("y"))
    return V.points_in_polygons(p, vertices(spark, d, RING), "in", "c_custkey").select("c_custkey")


# --- assembling grids -------------------------------------------------------------------------

@query("mosaic", sql("""select row, col, avg(value) as value from (select row, col, elev as value from cells union all
  select row + 7, col + 3, ndvi from cells union all select row - 4, col, z from cells) group by 1, 2""", ), "value")
def mosaic_q(spark, d):
    a, b, c = layer(spark, d, "elev"), layer(spark, d, "ndvi"), layer(spark, d, "z")
    b = b.withColumns({"row": F.col("row") + 7, "col": F.col("col") + 3})
    return G.mosaic(a.unionByName(b).unionByName(c.withColumn("row", F.col("row") - 4)))


@query("crop", sql("select row, col, elev from cells where row between 3 and 30 and col between 10 and 40"), "elev")
def crop_q(spark, d):
    return G.crop(cells(spark, d), (3, 30), (10, 40)).select(*CELL, "elev")


def target_of(spark, d) -> Grid:
    """A finer grid as tall as the cells."""
    return Grid(1.3, 0.7, 0.8, int(grid_of(spark, d).rows / 0.8) + 2, 55)




@query("resample", sql("""select r as row, c as col, sum(w * v) / sum(w) as value from (
  select r, c, (1 - abs(0.7 + (r + 0.5) * 0.8 - 0.5 - row)) * (1 - abs(1.3 + (c + 0.5) * 0.8 - 0.5 - col)) as w, z as v
  from cells, (select unnest(generate_series(0, (select cast(max(row) / 0.8 + 3 as bigint) from cells)))::integer as r),
    (select unnest(generate_series(0, 54))::integer as c)
  where abs(0.7 + (r + 0.5) * 0.8 - 0.5 - row) < 1 and abs(1.3 + (c + 0.5) * 0.8 - 0.5 - col) < 1) group by 1, 2"""), "value")
def resample_q(spark, d):
    return G.resample(layer(spark, d, "z"), grid_of(spark, d), target_of(spark, d))


@query("block_mean", sql("""select cast(floor(row / 5.0) as integer) as row, cast(floor(col / 5.0) as integer) as col, avg(value) as value
  from (select row, col, case when ndvi > 10 then ndvi end as value from cells) group by 1, 2"""), "value")
def block_mean_q(spark, d):
    part = layer(spark, d, "ndvi").withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    return G.block_mean(part, 5)


@query("stack_layers", sql("""select row, col, case when elev <= 1000 then elev end as elev, ndvi, ring from cells left join
  (select row, col, 1.0 as ring from inside) using (row, col)""", *_RINGS, _INSIDE), "elev ndvi ring")
def stack_layers_q(spark, d):
    ring = V.rasterize(grid_of(spark, d), vertices(spark, d, RING)).join(cells(spark, d).select(*CELL), CELL).withColumnRenamed("flag", "value")
    return G.stack_layers({"elev": layer(spark, d, "elev"), "ndvi": layer(spark, d, "ndvi"), "ring": ring}, 1000)


@query("stack_sum", sql("""select row, col, sum(value) as value from (select row, col, elev as value from cells union all
  select row, col, ndvi from cells union all select row, col, z from cells) group by 1, 2"""), "value")
def stack_sum(spark, d):
    return G.stack_stat(layer(spark, d, "elev").unionByName(layer(spark, d, "ndvi")).unionByName(layer(spark, d, "z")))


@query("tile_grid", f"""with {LIDAR_SQL} select cast(floor(x / 7.5) as integer) as tile_col, cast(floor(y / 7.5) as integer) as tile_row,
  count(*) as n from lidar group by 1, 2""")
def tile_grid(spark, d):
    c, r = G.tile_id(F.col("x"), F.col("y"), 7.5)
    return lidar(spark, d).groupBy(c.alias("tile_col"), r.alias("tile_row")).agg(F.count(F.lit(1)).alias("n"))


# --- cell-wise --------------------------------------------------------------------------------

@query("classify", sql("select row, col, case when ndvi > 25 then 1 else 0 end as tall, case when ndvi between 5 and 20 then 1 else 0 end as shrub from cells"))
def classify_q(spark, d):
    c = G.classify(cells(spark, d), F.col("ndvi") > 25, "tall")
    return G.classify(c, F.col("ndvi").between(5, 20), "shrub").select(*CELL, "tall", "shrub")


@query("conditional_overwrite", sql("""select row, col, case when elev > 940 and ndvi < 30 then 0.0 when ndvi < 10 then 0.0
  when elev > 1000 then 0.0 else z end as chm from cells"""), "chm")
def conditional_overwrite(spark, d):
    stack = cells(spark, d).withColumn("chm", F.col("z"))
    rules = [(F.col("elev") > 1000, 0.0), (F.col("ndvi") < 10, 0.0), ((F.col("elev") > 940) & (F.col("ndvi") < 30), 0.0)]
    return G.overwrite(stack, "chm", rules).select(*CELL, "chm")


@query("mask_layer", sql("select row, col, case when water = 0 then elev end as value from cells"), "value")
def mask_layer(spark, d):
    dry = cells(spark, d).select(*CELL, F.when(F.col("water") == 0, 1).alias("value"))
    return G.mask_cells(layer(spark, d, "elev"), dry)


@query("invert_grid", sql("select row, col, (select max(z) + min(z) from cells) - z as value from cells"), "value")
def invert_grid(spark, d):
    return G.invert(layer(spark, d, "z"))


@query("layer_range", sql("select min(z) as min, max(z) as max from cells"), "min max")
def layer_range_q(spark, d):
    return G.layer_range(layer(spark, d, "z"))


_SAMPLE = """samp as (select row, col, elev, ndvi from cells order by md5(row || '_' || col || '_5'), row, col limit 500)"""


@query("cell_sample", sql("select * from samp", _SAMPLE), "elev ndvi")
def cell_sample_q(spark, d):
    return G.cell_sample(cells(spark, d).select(*CELL, "elev", "ndvi"), 500, 5)


@query("residual_layer", sql("""select row, col, round_even(ndvi * 7.3 - ((select regr_slope(ndvi * 7.3, elev) from cells) * elev
  + (select regr_intercept(ndvi * 7.3, elev) from cells)), 0) as residual from cells"""), "residual")
def residual_layer_q(spark, d):
    stack = cells(spark, d).select(*CELL, "elev", (F.col("ndvi") * 7.3).alias("ndvi"))
    return G.residual_layer(stack, "ndvi", "elev", stack).select(*CELL, "residual")


# --- neighbourhoods ---------------------------------------------------------------------------

GAPPY = "gaps as (select row, col, case when water = 0 then z end as value from cells)"


def gappy_layer(spark, d):
    return cells(spark, d).select(*CELL, F.when(F.col("water") == 0, F.col("z")).alias("value"))


_FOCAL = """focal as (select a.row, a.col, a.value, avg(b.value) as mean from gaps a join gaps b
  on b.row between a.row - 4 and a.row + 4 and (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4.5 * 4.5 group by 1, 2, 3)"""


@query("focal_mean", sql("select row, col, case when value is not null then mean end as value from focal", GAPPY, _FOCAL), "value", digits=8)
def focal_mean_q(spark, d):
    return G.focal_mean(gappy_layer(spark, d), 4.5, tile=SMALL_TILE)


@query("tpi", sql("select row, col, value - mean as tpi from focal", GAPPY, _FOCAL), "tpi", digits=8)
def tpi_q(spark, d):
    return G.tpi(gappy_layer(spark, d), 4.5, tile=SMALL_TILE)


_SLOPE = """slopes as (select a.row, a.col, degrees(atan(sqrt(coalesce((e.value - w.value) / 4, (e.value - a.value) / 2, (a.value - w.value) / 2, 0) ** 2
  + coalesce((n.value - s.value) / 4, (n.value - a.value) / 2, (a.value - s.value) / 2, 0) ** 2))) as slope, a.value from gaps a
  left join gaps e on e.row = a.row and e.col = a.col + 1 left join gaps w on w.row = a.row and w.col = a.col - 1
  left join gaps n on n.row = a.row + 1 and n.col = a.col left join gaps s on s.row = a.row - 1 and s.col = a.col)"""


@query("slope", sql("select row, col, case when value is not null then slope end as slope from slopes", GAPPY, _SLOPE), "slope")
def slope_q(spark, d):
    return G.slope(gappy_layer(spark, d), 2.0, tile=SMALL_TILE)


_NEAR = "offs(dr, dc, dist, k) as (values " + ", ".join(f"({dr}, {dc}, {x!r}::double, {k})" for k, (dr, dc, x) in enumerate(R.STEPS)) + ")"


def _d8(src, value):
    return f"""ptr as (select row, col, case when top > 0 then tr end as to_row, case when top > 0 then tc end as to_col,
  case when top > 0 then dist end as dist from (select a.row, a.col, b.row as tr, b.col as tc, dist, (a.{value} - b.{value}) / dist as top,
    row_number() over (partition by a.row, a.col order by (a.{value} - b.{value}) / dist desc nulls last, k) as rn
    from {src} a cross join offs left join {src} b on b.row = a.row + dr and b.col = a.col + dc) where rn = 1)"""


@query("d8_pointer", sql("select row, col, to_row::double as to_row, to_col::double as to_col, dist from ptr", _NEAR, _d8("cells", "z")),
       "to_row to_col dist")
def d8_pointer(spark, d):
    out = R.d8(layer(spark, d, "z"), tile=SMALL_TILE)
    return out.select(*CELL, F.col("to_row").cast("double").alias("to_row"), F.col("to_col").cast("double").alias("to_col"), "dist")


_WALK = """walk as (select row, col, row as r, col as c, 0.0::double as len from ptr union all
  select w.row, w.col, p.to_row, p.to_col, w.len + p.dist from walk w join ptr p on p.row = w.r and p.col = w.c
  where p.to_row is not null and w.len + p.dist <= {cap})"""


def rec(body, *ctes):
    return "with recursive " + ",\n".join([CELLS_SQL, *ctes]) + "\n" + body


@query("d8_distance", rec("""select p.row, p.col, d as water from ptr p left join (select w.row, w.col, min(len) as d from walk w
  join cells x on x.row = w.r and x.col = w.c and x.water = 1 group by 1, 2) h on h.row = p.row and h.col = p.col""",
  _NEAR, _d8("cells", "z"), _WALK.format(cap=6)), "water")
def d8_distance(spark, d):
    c = cells(spark, d)
    return R.downslope_distance(R.d8(layer(spark, d, "z"), tile=SMALL_TILE), c.select(*CELL, "water"), ["water"], 6.0, tile=SMALL_TILE)


_AREA = "area as (select r as row, c as col, count(*)::double as cells from walk group by 1, 2)"


@query("d8_accumulation", rec("select row, col, cells, cells * 2.0 as specific_area from area", _NEAR, _d8("cells", "z"),
                              _WALK.format(cap=1e9), _AREA), "cells specific_area")
def d8_accumulation(spark, d):
    return R.d8_area(R.d8(layer(spark, d, "z"), tile=SMALL_TILE), 2.0, SMALL_TILE)


@query("wetness", rec("""select a.row, a.col, case when tan(radians(slope)) > 0 then ln(cells * 2.0 / tan(radians(slope))) end as twi
  from area a left join slopes s on s.row = a.row and s.col = a.col""", _NEAR, _d8("cells", "z"), _WALK.format(cap=1e9), _AREA,
  "gaps as (select row, col, z as value from cells)", _SLOPE), "twi")
def wetness_q(spark, d):
    z = layer(spark, d, "z")
    return R.wetness(R.d8_area(R.d8(z, tile=SMALL_TILE), 2.0, SMALL_TILE), G.slope(z, 2.0, tile=SMALL_TILE))


_T = R.SNOW_THRESHOLDS


@query("snow_effect", rec(f"""select row, col, (select max(v) + min(v) from summed) - v as snow_effect from summed""",
  "up as (select row, col, (select max(z) + min(z) from cells) - z as z, 140 + 2.5 * ndvi as snow from cells)",
  _NEAR, _d8("up", "z"), _WALK.format(cap=20), f"""hit as (select w.row, w.col, t, min(len) as d from walk w join up x on x.row = w.r and x.col = w.c
    join (select unnest({list(_T)}) as t) on snow >= t group by 1, 2, 3)""",
  f"""summed as (select row, col, sum(case when d = 0 then null else least(coalesce(d, 20), 20) end) as v from
    (select p.row, p.col, x.t, d from ptr p cross join (select unnest({list(_T)}) as t) x
     left join hit h on h.row = p.row and h.col = p.col and h.t = x.t) group by 1, 2)"""), "snow_effect")
def snow_effect_q(spark, d):
    stack = cells(spark, d).select(*CELL, F.col("z").alias("dem"), (140 + 2.5 * F.col("ndvi")).alias("snow"))
    return R.snow_effect(stack, cap=20.0, tile=SMALL_TILE)


@query("proximity", sql("""select a.row, a.col, 2.0 * min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) as distance from cells a
  join cells b on b.brand = 'Brand#7' group by 1, 2"""), "distance")
def proximity_q(spark, d):
    c = cells(spark, d).withColumn("flag", (F.col("brand") == "Brand#7").cast("int"))
    return R.proximity(c, "flag", 2.0)


# Best cost by number of steps; every step costs something, so the cap ends the recursion.
_STEPS = "(values " + ", ".join(f"({dr}, {dc}, {d!r}::double)" for dr, dc, d in R.STEPS) + ") s(dr, dc, d)"


@query("cost_distance", "with recursive " + CELLS_SQL + f""", priced as (select row, col, ndvi as cost, brand = 'Brand#7' as flag from cells),
  reached as (select row, col, 0.0::double as dist from priced where flag and cost is not null union all
    select b.row, b.col, min(r.dist + (a.cost + b.cost) / 2 * d) as dist from reached r join priced a on a.row = r.row and a.col = r.col
    cross join {_STEPS} join priced b on b.row = r.row + dr and b.col = r.col + dc
    where b.cost is not null and r.dist + (a.cost + b.cost) / 2 * d <= 100 group by b.row, b.col),
  best as (select row, col, min(dist) as cost_distance from reached group by row, col)
  select c.row, c.col, cost_distance, 100 - least(coalesce(cost_distance, 100), 100) as effect from cells c
  left join best on best.row = c.row and best.col = c.col""", "cost_distance effect")
def cost_distance_q(spark, d):
    c = cells(spark, d).withColumn("flag", (F.col("brand") == "Brand#7").cast("int"))
    return R.cost_distance(c, "flag", "ndvi", 100.0, 1.0, SMALL_TILE)


# --- extraction, point cloud, mapping ---------------------------------------------------------

def _corner_sql(x, y, r):
    """Area of the disc left of x and below y, the shared closed form."""
    half = lambda t: f"(({t}) * sqrt(greatest({r * r} - ({t}) * ({t}), 0)) + {r * r} * asin(({t}) / {r})) / 2 + {math.pi * r * r / 4!r}"
    cx, cy = f"greatest(least({x}, {r}), -{r})", f"greatest(least({y}, {r}), -{r})"
    up = f"abs({cy})"
    a = f"sqrt(greatest({r * r} - {up} * {up}, 0))"
    above = (f"({half(f'least({cx}, -{a})')} + {up} * (greatest(least({cx}, {a}), -{a}) + {a}) + {half(f'greatest({cx}, {a})')} - ({half(a)}))")
    return f"({half(cx)} + case when {cy} >= 0 then {above} else -{above} end)"


def _extract_sql(r):
    area = " ".join(f"{s} {_corner_sql(x, y, r)}" for s, x, y in (("", "dx + 1", "dy + 1"), ("-", "dx", "dy + 1"), ("-", "dx + 1", "dy"), ("+", "dx", "dy")))
    return f"""near as (select site, c.row, c.col, z, case when water = 0 then ndvi end as ndvi, c.col - x as dx, c.row - y as dy from points
    join cells c on c.col between x - {r} - 1 and x + {r} and c.row between y - {r} - 1 and y + {r}),
  weighed as (select *, {area} as w from near)"""


@query("buffer_extract", sql("""select p.site, sum(w * z) filter (w > 1e-12) / sum(w) filter (w > 1e-12) as z,
  sum(w * ndvi) filter (w > 1e-12) / sum(case when ndvi is not null then w end) filter (w > 1e-12) as ndvi
  from points p left join weighed using (site) group by 1""", POINTS_SQL, _extract_sql(2.5)), "z ndvi", digits=5)
def buffer_extract_q(spark, d):
    stack = cells(spark, d).withColumn("ndvi", F.when(F.col("water") == 0, F.col("ndvi")))
    return E.buffer_extract(points(spark, d), stack, grid_of(spark, d), 2.5, ["z", "ndvi"], digits=None)


@query("canopy_grid", f"""with {LIDAR_SQL}, spread as (select x, unnest(generate_series(cast(floor((y - 2.0) / 13) as integer),
    cast(floor((y + 2.0) / 13) as integer))) as tr from lidar),
  copies as (select tr, unnest(generate_series(cast(floor((x - 2.0) / 13) as integer), cast(floor((x + 2.0) / 13) as integer))) as tc from spread),
  full_tiles as (select tr, tc from copies group by 1, 2 having count(*) > 1500),
  inpoints as (select l.*, cast(floor(y) as integer) as row, cast(floor(x) as integer) as col from lidar l
    semi join full_tiles t on t.tr = floor(l.y / 13) and t.tc = floor(l.x / 13)),
  g as (select row, col, min(z) filter (class = 2) as ground from inpoints group by 1, 2)
  select row, col, round_even(greatest(coalesce(max(z - ground) filter (z - ground <= 25), 0), 0) * 100, 0) as chm
  from inpoints join g using (row, col) group by 1, 2""", "chm")
def canopy_grid(spark, d):
    return E.canopy(lidar(spark, d), 13.0, 2.0, 1.0, 25.0, 1500)


@query("predict_cells")
def predict_cells_q(spark, d):
    stack = cells(spark, d).withColumn("ndvi", F.when(F.col("water") == 0, F.col("ndvi")))
    data = stack.select(*CELL, "z", "elev", "ndvi").na.drop()
    model = M.fit_forest(data, "z", ["elev", "ndvi"])
    return M.predict_cells(model, stack, ["elev", "ndvi"])


@query("fit_all")
def fit_all_q(spark, d):
    data = cells(spark, d).select(F.concat_ws("_", *CELL).alias("site"), "z", "elev", "ndvi", F.col("col").cast("double").alias("east"),
                                  F.col("row").cast("double").alias("north"))
    done = table(spark, d, "nation").filter("n_nationkey = 0").select(F.lit("elev").alias("resp_var"))
    _, importance, _ = M.fit_all(data, ["z", "elev"], ["elev", "ndvi", "east", "north"], done)
    return importance


@query("layer_correlation", sql("""select a.v as var1, b.v as var2, corr(a.x, b.x) as r from l a join l b using (row, col) group by 1, 2""",
  "l as (select row, col, 'elev' as v, elev as x from cells union all select row, col, 'ndvi', ndvi from cells union all select row, col, 'z', z from cells)"), "r")
def layer_correlation(spark, d):
    return T.corr_matrix(cells(spark, d), ["elev", "ndvi", "z"]).select("var1", "var2", "r")


@query("map_responses", sql("""select row, col, 'z' as resp_var from cells where elev is not null and ndvi is not null"""))
def map_responses_q(spark, d):
    """Which cells get a predicted value; the values come from forests and are tested on planted signals."""
    data = cells(spark, d).select(F.concat_ws("_", *CELL).alias("site"), "z", "elev", "ndvi", F.col("col").cast("double").alias("east"))
    stack = cells(spark, d).select(*CELL, "elev", "ndvi", F.col("col").cast("double").alias("east"))
    maps, _, _ = map_responses(data, stack, ["z"], ["elev", "ndvi", "east"])
    return maps["z"].filter("prediction is not null").select(*CELL, F.lit("z").alias("resp_var"))
