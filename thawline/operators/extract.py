"""Site values from grids, and canopy height from point clouds."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from thawline.functions.joins import salted_join
from thawline.operators.grid import CELL, Grid


def with_disc_area(df: DataFrame, left: Column, low: Column, size: float, r: float, name: str) -> DataFrame:
    """Add the area a disc of radius r around 0 shares with the cell at (left, low).

    The area left of x and below y has a closed form; four corners give the cell's.
    Its pieces are columns of their own, so that none is computed twice.
    """
    def half(c: str) -> Column:  # integral of sqrt(r^2 - t^2) from -r to c
        t = F.col(c)
        return (t * F.sqrt(F.greatest(r * r - t * t, F.lit(0.0))) + r * r * F.asin(t / r)) / 2 + math.pi * r * r / 4

    clamp = lambda c: F.greatest(F.least(c, F.lit(r)), F.lit(-r))
    df = df.withColumns({"_x0": clamp(left), "_x1": clamp(left + size), "_y0": clamp(low), "_y1": clamp(low + size)})
    df = df.withColumns({f"_a{j}": F.sqrt(F.greatest(r * r - F.col(f"_y{j}") * F.col(f"_y{j}"), F.lit(0.0))) for j in (0, 1)})
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    df = df.withColumns({**{f"_m{i}{j}": F.least(f"_x{i}", -F.col(f"_a{j}")) for i, j in corners},
                         **{f"_n{i}{j}": F.greatest(f"_x{i}", f"_a{j}") for i, j in corners}})
    points = [*[f"{k}{i}{j}" for k in "mn" for i, j in corners], "a0", "a1", "x0", "x1"]
    df = df.withColumns({f"_h_{c}": half(f"_{c}") for c in points})

    def corner(i: int, j: int) -> Column:
        a, y = F.col(f"_a{j}"), F.col(f"_y{j}")
        strip = F.abs(y) * (F.greatest(F.least(F.col(f"_x{i}"), a), -a) + a)
        above = F.col(f"_h_m{i}{j}") + strip + F.col(f"_h_n{i}{j}") - F.col(f"_h_a{j}")
        return F.col(f"_h_x{i}") + F.when(y >= 0, above).otherwise(-above)

    df = df.withColumns({f"_g{i}{j}": corner(i, j) for i, j in corners})
    df = df.withColumn(name, F.col("_g11") - F.col("_g01") - F.col("_g10") + F.col("_g00"))
    return df.drop(*[f"_{c}" for c in points], *[f"_h_{c}" for c in points], "_y0", "_y1", *[f"_g{i}{j}" for i, j in corners])


def buffer_extract(sites: DataFrame, cells: DataFrame, grid: Grid, radius: float, layers: list[str], digits: int | None = 0) -> DataFrame:
    """Mean of each layer around each site, cells weighted by their share in the disc.

    A site is joined to the cells its disc touches by equal row and column. Unknown
    cells are left out of a layer's mean; a site without any has null.
    """
    reach = lambda c, o: F.explode(F.sequence(F.floor((F.col(c) - radius - o) / grid.size).cast("int"),
                                              F.floor((F.col(c) + radius - o) / grid.size).cast("int")))
    near = (sites.select("site", "x", "y").withColumn("row", reach("y", grid.y0)).withColumn("col", reach("x", grid.x0)))
    left, low = grid.x0 + F.col("col") * grid.size - F.col("x"), grid.y0 + F.col("row") * grid.size - F.col("y")
    # The gap between the centre and the cell decides whether they meet; a filter on the
    # area itself would be pushed down and repeat its formula.
    gap = lambda c: F.greatest(c, -(c + grid.size), F.lit(0.0))
    near = near.filter(gap(left) * gap(left) + gap(low) * gap(low) < radius * radius)
    near = with_disc_area(near, left, low, grid.size, radius, "_w").drop("x", "y")
    joined = cells.select(*CELL, *layers).join(near, CELL)
    means = {c: F.try_divide(F.sum(F.col("_w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))) for c in layers}
    found = joined.groupBy("site").agg(*[(m if digits is None else F.bround(m, digits)).alias(c) for c, m in means.items()])
    return sites.select("site").join(found, "site", "left")


def canopy(points: DataFrame, tile: float = 3000.0, halo: float = 10.0, res: float = 1.0, max_z: float = 25.0,
           min_points: int = 1000, ground_class: int = 2) -> DataFrame:
    """Vegetation height in cm per cell: highest point above the cell's lowest ground point.

    Points more than `max_z` above ground are dropped, negative and unknown heights
    are 0. Tiles with at most `min_points` points, halo included, are skipped. Equal
    heights within a cell are merged before the shuffle.
    """
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    full = (points.select("x", "y").withColumn("tile_col", span("x")).withColumn("tile_row", span("y"))
            .groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_points)
            .select("tile_row", "tile_col"))
    at = points.select(F.floor(F.col("y") / tile).cast("int").alias("tile_row"), F.floor(F.col("x") / tile).cast("int").alias("tile_col"),
                       F.floor(F.col("y") / res).cast("int").alias("row"), F.floor(F.col("x") / res).cast("int").alias("col"),
                       "z", "class")
    at = salted_join(at, full, ["tile_row", "tile_col"], ["row", "col", "z"], "left_semi")
    heights = at.groupBy(*CELL, "z").agg(F.bool_or(F.col("class") == ground_class).alias("_g"))
    ground = heights.groupBy(*CELL).agg(F.min(F.when(F.col("_g"), F.col("z"))).alias("_ground"))
    above = F.col("z") - F.col("_ground")
    return (heights.join(ground, CELL).groupBy(*CELL)
            .agg(F.max(F.when(above <= max_z, above)).alias("_h"))
            .select(*CELL, F.bround(F.greatest(F.coalesce("_h", F.lit(0.0)), F.lit(0.0)) * 100, 0).alias("chm")))
