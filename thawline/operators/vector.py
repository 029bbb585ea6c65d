"""Points, lines and polygons as vertex rows (feature_id, part_id, seq, x, y).

`seq` counts from 0 without gaps within a part, so the next vertex is found by an
equal join and no ordered pass over a large feature is needed. Rings close by
themselves; holes are further parts of the feature (even-odd rule).
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thawline.functions import conform_site
from thawline.operators.grid import CELL, Grid, ceil_int
from thawline.sources import cut_lineage

PART = ["feature_id", "part_id"]


def site_registry(sources: list[DataFrame], data_sites: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points of all sources under conformed names, those with data only."""
    points = reduce(DataFrame.unionByName, [s.select(conform_site("site").alias("site"), x, y) for s in sources])
    return points.join(data_sites.select("site").distinct(), "site", "left_semi")


def registry_mismatch(data_sites: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites with data but no point, points without data)."""
    a, b = data_sites.select("site").distinct(), points.select("site").distinct()
    return a.join(b, "site", "left_anti"), b.join(a, "site", "left_anti")


# WGS84 ellipsoid and the UTM scale.
WGS84_A, WGS84_F, UTM_K0 = 6378137.0, 1 / 298.257223563, 0.9996


def project_tm(lon, lat, lon0: float = 21.0, false_e: float = 500000.0) -> tuple[Column, Column]:
    """Transverse Mercator (easting, northing) of degrees, Krueger series to the sixth order in n.

    Published coefficients (Karney 2011, eq. 35); the default meridian is zone 34 North.
    """
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = krueger_alpha(n)
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(lon0))
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return false_e + UTM_K0 * radius * east, UTM_K0 * radius * north


def krueger_alpha(n: float) -> list[float]:
    # Published series coefficients.
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]


def clip_bbox(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside (xmin, ymin, xmax, ymax), edges included. Shapes are cut by clip_lines and clip_polygons."""
    return vertices.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def clip_polygons(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings cut to (xmin, ymin, xmax, ymax), `seq` counted anew.

    One half plane after the other: a vertex inside stays, an edge through the border gets a vertex there. Parts
    that leave the box in several pieces keep them joined along its border, which changes neither area nor cells.
    """
    out = vertices.select(*PART, "seq", "x", "y")
    w = W.partitionBy(*PART).orderBy("seq")
    for axis, bound, sign in (("x", box[0], 1), ("x", box[2], -1), ("y", box[1], 1), ("y", box[3], -1)):
        other = "y" if axis == "x" else "x"
        following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
        e = out.withColumns({"_a": following(axis), "_b": following(other)})
        d, dn = sign * (F.col(axis) - bound), sign * (F.col("_a") - bound)
        crossing = F.col(other) + d / F.nullif(d - dn, F.lit(0.0)) * (F.col("_b") - F.col(other))
        corner = lambda u, v: F.struct(u.cast("double").alias(axis), v.cast("double").alias(other))
        kept = F.array(F.when(d >= 0, corner(F.col(axis), F.col(other))),
                       F.when((d >= 0) != (dn >= 0), corner(F.lit(bound), crossing)))
        e = e.select(*PART, "seq", F.posexplode(F.filter(kept, lambda v: v.isNotNull())).alias("_i", "_v"))
        out = e.select(*PART, (F.row_number().over(W.partitionBy(*PART).orderBy("seq", "_i")) - 1).alias("seq"),
                       F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))
    size = F.count(F.lit(1)).over(W.partitionBy(*PART))
    return out.withColumn("_n", size).filter("_n >= 3").drop("_n")


def boxes_meeting(boxes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose (xmin, ymin, xmax, ymax) shares a point with the box."""
    return boxes.filter((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0])
                        & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))


def edges(vertices: DataFrame, closed: bool) -> DataFrame:
    """(feature_id, part_id, seq, x1, y1, x2, y2) of consecutive vertices."""
    ends = vertices.select(*PART, F.col("seq").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    start = vertices.select(*PART, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    if closed:
        size = vertices.groupBy(*PART).agg((F.max("seq") + 1).alias("_size"))
        start = start.join(size, PART).withColumn("_next", (F.col("seq") + 1) % F.col("_size")).drop("_size")
    else:
        start = start.withColumn("_next", F.col("seq") + 1)
    return start.join(ends, [*PART, "_next"]).drop("_next")


def worked_out(df: DataFrame) -> DataFrame:
    """The same rows; what follows reads the columns instead of working out their expressions again wherever they are named."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def clip_lines(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The parts of line segments inside the box, cut at its border."""
    e = edges(vertices, closed=False)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, F.col("x1") - box[0]), (dx, box[2] - F.col("x1")), (-dy, F.col("y1") - box[1]), (dy, box[3] - F.col("y1"))):
        t = F.try_divide(q, p)
        enter = F.when(p < 0, F.greatest(enter, t)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, t)).otherwise(leave)
        outside = outside | ((p == 0) & (q < 0))
    e = worked_out(e.withColumns({"_t0": enter, "_t1": leave, "_out": outside})).filter(~F.col("_out") & (F.col("_t0") <= F.col("_t1")))
    return e.select(*PART, "seq", *[(F.col(f"{c}1") + F.col(t) * d).alias(f"{c}{i}")
                                    for i, t in ((1, "_t0"), (2, "_t1")) for c, d in (("x", dx), ("y", dy))])


def polygon_area(vertices: DataFrame, min_area: float | None = None) -> DataFrame:
    """Area per feature; holes run the other way round than outlines."""
    e = edges(vertices, closed=True)
    out = e.groupBy("feature_id").agg(
        (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))
    return out if min_area is None else out.filter(F.col("area") > min_area)


def polygon_cells(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(feature_id, row, col) of the cells whose centre is inside.

    Each edge is cut by the centre lines of the rows it spans; a row's sorted crossings
    pair up into runs of cells. Work grows with crossings and with the result, and no
    cell is ever tested against an edge.
    """
    e = edges(vertices, closed=True)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(ceil_int((low - grid.y0) / grid.size - 0.5), F.lit(0))
    last = F.least(ceil_int((high - grid.y0) / grid.size - 0.5) - 1, F.lit(grid.rows - 1))
    hits = (e.withColumns({"_a": first, "_b": last}).filter("_a <= _b")
            .withColumn("row", F.explode(F.sequence("_a", "_b"))))
    x = F.col("x1") + (grid.y_of() - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    w = W.partitionBy("feature_id", "row").orderBy("_x")
    runs = (hits.select("feature_id", "row", x.alias("_x"))
            .withColumns({"_n": F.row_number().over(w), "_to": F.lead("_x").over(w)}).filter("_n % 2 = 1"))
    first = F.greatest(ceil_int((F.col("_x") - grid.x0) / grid.size - 0.5), F.lit(0))
    last = F.least(ceil_int((F.col("_to") - grid.x0) / grid.size - 0.5) - 1, F.lit(grid.cols - 1))
    return (runs.withColumns({"_a": first, "_b": last}).filter("_a <= _b")
            .select("feature_id", "row", F.explode(F.sequence("_a", "_b")).alias("col")))


def line_cells(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(feature_id, row, col) of every cell a line passes through.

    Each segment is cut to the grid and then at every row and column border it crosses; a piece between two borders
    lies in one cell, the one of its middle.
    """
    box = (grid.x0, grid.y0, grid.x0 + grid.cols * grid.size, grid.y0 + grid.rows * grid.size)
    e = worked_out(clip_lines(vertices, box))

    def borders(a, b, origin, count):
        low, high = F.least(a, b), F.greatest(a, b)
        first = F.greatest(ceil_int((low - origin) / grid.size), F.lit(0))
        last = F.least(F.floor((high - origin) / grid.size).cast("int"), F.lit(count))
        at = F.when((first <= last) & (a != b), F.sequence(first, F.greatest(first, last)))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda k: F.try_divide(origin + k * grid.size - a, b - a))

    cuts = F.concat(borders(F.col("x1"), F.col("x2"), grid.x0, grid.cols), borders(F.col("y1"), F.col("y2"), grid.y0, grid.rows),
                    F.array(F.lit(0.0), F.lit(1.0)))
    inner = F.filter(cuts, lambda t: t.isNotNull() & (t >= 0) & (t <= 1))
    e = worked_out(e.withColumn("_t", F.array_sort(F.array_distinct(inner))))
    middles = F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: (a + b) / 2)
    m = e.withColumn("_m", F.explode(middles))
    cells = m.select("feature_id", grid.row_of(F.col("y1") + F.col("_m") * (F.col("y2") - F.col("y1"))).alias("row"),
                     grid.col_of(F.col("x1") + F.col("_m") * (F.col("x2") - F.col("x1"))).alias("col"))
    return cells.filter(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1)).distinct()


def rasterize(grid: Grid, polygons: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Flagged cells (row, col, flag) of polygons and lines together."""
    parts = ([polygon_cells(polygons, grid)] if polygons is not None else []) + (
        [line_cells(lines, grid)] if lines is not None else [])
    return reduce(DataFrame.unionByName, parts).select(*CELL).distinct().withColumn("flag", F.lit(1))


def mask_polygons(cells: DataFrame, vertices: DataFrame, grid: Grid, inverse: bool = True) -> DataFrame:
    """Cells outside (inverse) or inside the polygons."""
    inside = polygon_cells(vertices, grid).select(*CELL).distinct()
    return cells.join(inside, CELL, "left_anti" if inverse else "left_semi")


def odd(df: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """The groups with an odd number of rows, or an odd sum of `count`."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_odd")).filter("_odd % 2 = 1").select(*by)


def way_out(grid: Grid) -> Column:
    """How often the way from (x, y) to the right border of its tile, and down it to the tile's corner, crosses an edge."""
    x, y = F.col("x"), F.col("y")
    border, floor_y = grid.x0 + (F.col("col") + 1) * grid.size, grid.y0 + F.col("row") * grid.size
    at = F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    below = F.col("y1") + (border - F.col("x1")) * F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    along = ((F.col("y1") <= y) != (F.col("y2") <= y)) & (at > x) & (at <= border)
    down = ((F.col("x1") <= border) != (F.col("x2") <= border)) & (below > floor_y) & (below <= y)
    return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(down, F.lit(False)).cast("int")


def around(points: DataFrame, by: list[str], tiled: DataFrame, corners: DataFrame, grid: Grid) -> DataFrame:
    """(by, feature_id): the polygons around each point (by, x, y, row, col), from the edges and the corner of its tile."""
    hits = points.join(tiled, CELL).select(*by, "feature_id", way_out(grid).alias("_n")).filter("_n > 0")
    hits = hits.unionByName(points.join(corners, CELL).select(*by, "feature_id", F.lit(1).alias("_n")))
    return odd(hits, [*by, "feature_id"], "_n")


PAIRS = 64  # a tile is cut when points x edges are more than so many for each of its points and edges
CUTS = 8
PARTS = 4  # a tile is cut into so many rows and columns


def points_in_polygons(points: DataFrame, vertices: DataFrame, keep: str = "in", key: str = "site", tile: float = 4.0) -> DataFrame:
    """Points inside any polygon, or outside all of them (keep = 'out').

    A point meets only the edges of its own tile: the way from the point to the right border of its tile and along it
    to the tile's lower corner crosses a polygon once for each of them, and whether the corner is inside is known from
    the rows of corners the polygon covers. All points of a tile that lies within one polygon are inside and meet no edge.
    Other tiles with many points and many edges are cut further; corners of the pieces are points of the tile.
    Points that share a key count together, as crossings: an even number of equal ones is outside.
    """
    # Borders off round coordinates, so that vertices hardly ever lie on them.
    span = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if span["x0"] is None or span["y0"] is None:
        return points
    x0, y0 = span["x0"] - 0.5390817 * tile, span["y0"] - 0.4719263 * tile
    grid = Grid(x0, y0, tile, int((span["y1"] - y0) / tile) + 2, int((span["x1"] - x0) / tile) + 2)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"row": grid.row_of(F.col("y")), "col": grid.col_of(F.col("x"))})

    def in_tiles(e: DataFrame) -> DataFrame:
        ends = F.array(*[F.struct(F.lit(i).alias("seq"), F.col(f"_e.x{i + 1}").alias("x"), F.col(f"_e.y{i + 1}").alias("y")) for i in (0, 1)])
        segments = e.select(F.col("_e").alias("feature_id"), F.lit(0).alias("part_id"), F.inline(ends))
        cells = line_cells(segments, grid).withColumnRenamed("feature_id", "_e")
        return cells.select(*CELL, "_e", F.col("_e.feature_id").alias("feature_id"), *[F.col(f"_e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])

    known = points.filter("x is not null and y is not null").withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    places = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("x", "y")).alias("_a"), F.max(F.struct("x", "y")).alias("_b"))
    single = places.filter("_a = _b and _n % 2 = 1").select(key, "_a.x", "_a.y")
    several = placed(known.join(places.filter("_a <> _b").select(key), key).select(key, "x", "y"))
    # Corners are the cell centres of a grid shifted by half a tile.
    corners = cut_lineage(odd(polygon_cells(vertices, Grid(x0 + tile / 2, y0 - tile / 2, tile, grid.rows, grid.cols)), [*CELL, "feature_id"]))
    ring = edges(vertices, closed=True).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    tiled = cut_lineage(in_tiles(odd(ring.select(F.struct(*PART, "seq", "x1", "y1", "x2", "y2").alias("_e")), ["_e"])))
    inside = around(several, [key], tiled, corners, grid).select(key)
    left = cut_lineage(placed(single.select("x", "y").distinct()))
    for cuts in range(CUTS + 1):
        full = corners.join(tiled, [*CELL, "feature_id"], "left_anti").select(*CELL).distinct()
        within = left.join(full, CELL, "left_semi").select("x", "y")
        left = left.join(full, CELL, "left_anti")
        p, e = F.col("_p"), F.col("_c")
        load = (left.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_p")).join(tiled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_c")), CELL)
                .select(*CELL, ((p * e > PAIRS * (p + e)) & (cuts < CUTS)).alias("heavy")))
        left = left.join(load, CELL)
        found = around(left.filter("not heavy"), ["x", "y"], tiled, corners, grid).select("x", "y")
        inside = inside.unionByName(single.join(cut_lineage(within.unionByName(found).distinct()), ["x", "y"]).select(key))
        left = cut_lineage(left.filter("heavy").drop("heavy"))
        if left.isEmpty():
            break
        whole, grid = grid, Grid(x0, y0, grid.size / PARTS, grid.rows * PARTS, grid.cols * PARTS)
        pieces = cut_lineage(placed(left.select("x", "y")).select(*CELL).distinct())
        as_points = pieces.select(F.col("row").alias("_r"), F.col("col").alias("_k"), F.expr(f"row div {PARTS}").cast("int").alias("row"),
                                  F.expr(f"col div {PARTS}").cast("int").alias("col"), (grid.x0 + (F.col("col") + 1) * grid.size).alias("x"),
                                  (grid.y0 + F.col("row") * grid.size).alias("y"))
        new = around(as_points, ["_r", "_k"], tiled, corners, whole).withColumnsRenamed({"_r": "row", "_k": "col"})
        mine = tiled.join(left.select(*CELL).distinct(), CELL, "left_semi").select("_e").distinct()
        tiled, corners = cut_lineage(in_tiles(mine).join(pieces, CELL, "left_semi")), cut_lineage(new)
        left = placed(left.select("x", "y"))
    return points.join(inside.distinct(), key, "left_semi" if keep == "in" else "left_anti")
