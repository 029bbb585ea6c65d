"""Cell tables: one row per (row, col), one column per layer.

Row 0, col 0 is the cell at the grid origin and rows grow with y. Neighbourhood
work cuts the grid into square tiles: a cell goes to its own tile and to those
whose halo it lies in, and one NumPy kernel call handles a tile. The shuffle moves
each cell about once, whatever the radius, and a task holds one tile.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from thawline.functions import finite, if_known
from thawline.operators.tabular import hash_sample

TILE = 256
CELL = ["row", "col"]


@dataclass(frozen=True)
class Grid:
    """Regular grid: lower left corner, cell size, shape."""
    x0: float
    y0: float
    size: float
    rows: int
    cols: int

    def row_of(self, y) -> Column:
        return F.floor((y - self.y0) / self.size).cast("int")

    def col_of(self, x) -> Column:
        return F.floor((x - self.x0) / self.size).cast("int")

    def x_of(self, col="col") -> Column:
        return self.x0 + (F.col(col) + 0.5) * self.size

    def y_of(self, row="row") -> Column:
        return self.y0 + (F.col(row) + 0.5) * self.size


def ceil_int(c: Column) -> Column:
    return F.ceil(c).cast("int")


def with_tiles(df: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Copy each cell to the tiles whose `halo` wide margin holds it."""
    def near(c):
        low, high = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))
    return df.withColumn("_tr", near("row")).withColumn("_tc", near("col"))


def dense(pdf: pd.DataFrame, cols: list[str], r0: int, c0: int, side: int) -> dict[str, np.ndarray]:
    out = {}
    r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
    for name in cols:
        a = np.full((side, side), np.nan)
        a[r, c] = pdf[name].to_numpy(dtype=float)
        out[name] = a
    return out


def map_tiles(cells: DataFrame, cols: list[str], outputs: dict[str, str], halo: int,
              kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], tile: int = TILE) -> DataFrame:
    """Run `kernel` on each tile with its halo; keep the tile's own cells.

    The kernel gets one array per input column, with NaN for unknown or absent cells,
    and returns one array per output of the same shape.
    """
    schema = "row int, col int, " + ", ".join(f"{k} {v}" for k, v in outputs.items())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        own = pdf[(pdf["row"] // tile == key[0]) & (pdf["col"] // tile == key[1])]
        if own.empty:
            return pd.DataFrame({k: [] for k in ["row", "col", *outputs]})
        found = kernel(dense(pdf, cols, r0, c0, tile + 2 * halo))
        r, c = own["row"].to_numpy() - r0, own["col"].to_numpy() - c0
        data = {"row": own["row"].to_numpy(), "col": own["col"].to_numpy()}
        for name, kind in outputs.items():
            v = found[name][r, c]
            data[name] = pd.array(np.where(np.isnan(v), 0, v), dtype="Int32") if kind == "int" else v
            if kind == "int":
                data[name][np.isnan(v)] = pd.NA
        return pd.DataFrame(data)

    work = with_tiles(cells.select(*CELL, *[F.col(c).cast("double").alias(c) for c in cols]), halo, tile)
    out = work.groupBy("_tr", "_tc").applyInPandas(run, schema)
    doubles = [k for k, v in outputs.items() if v == "double"]
    return out.withColumns({k: finite(k) for k in doubles}) if doubles else out


# --- assembling -------------------------------------------------------------------------------

def mosaic(cells: DataFrame, value: str = "value") -> DataFrame:
    """Overlapping tiles to one grid, the mean where they overlap."""
    return cells.groupBy(*CELL).agg(F.avg(value).alias(value))


def crop(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells within the inclusive row and column ranges."""
    return cells.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def resample(cells: DataFrame, src: Grid, dst: Grid, value: str = "value") -> DataFrame:
    """Bilinear values at the centres of another grid.

    Each source cell spreads its weight over the target centres within one source cell
    of its own centre, so one pre-aggregated shuffle does it and no join is needed.
    Unknown source cells are left out and the other weights rescaled.
    """
    def reach(index: str, s0, d0, limit):
        # Target positions whose centre, in source cell units, is less than 1 away.
        low = ((F.col(index) - 0.5) * src.size + s0 - d0) / dst.size - 0.5
        high = ((F.col(index) + 1.5) * src.size + s0 - d0) / dst.size - 0.5
        return (F.greatest(F.floor(low).cast("int"), F.lit(0)), F.least(ceil_int(high), F.lit(limit - 1)))

    r_low, r_high = reach("row", src.y0, dst.y0, dst.rows)
    c_low, c_high = reach("col", src.x0, dst.x0, dst.cols)

    def weight(target: str, index: str, s0, d0):
        at = (d0 + (F.col(target) + 0.5) * dst.size - s0) / src.size - 0.5
        return 1 - F.abs(at - F.col(index))

    spread = (cells.select(*CELL, finite(value).alias("_v")).filter(F.col("_v").isNotNull())
              .filter((r_low <= r_high) & (c_low <= c_high))
              .withColumn("_r", F.explode(F.sequence(r_low, r_high)))
              .withColumn("_c", F.explode(F.sequence(c_low, c_high)))
              .withColumns({"_wr": weight("_r", "row", src.y0, dst.y0), "_wc": weight("_c", "col", src.x0, dst.x0)})
              .filter((F.col("_wr") > 0) & (F.col("_wc") > 0)))
    w = F.col("_wr") * F.col("_wc")
    return (spread.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col"))
            .agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value)))


def block_mean(cells: DataFrame, k: int, value: str = "value") -> DataFrame:
    return (cells.groupBy(F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col"))
            .agg(F.avg(finite(value)).alias(value)))


def stack_layers(layers: dict[str, DataFrame], too_big: float | None = 200000, value: str = "value") -> DataFrame:
    """One column per layer; values above `too_big` are unknown.

    Layers are stacked and reduced in one shuffle instead of joined one by one.
    """
    rows = reduce(DataFrame.unionByName, [
        df.select(*CELL, F.lit(name).alias("_layer"), F.col(value).cast("double").alias("_v")) for name, df in layers.items()])
    if too_big is not None:
        rows = rows.withColumn("_v", F.when(F.col("_v") <= too_big, F.col("_v")))
    return rows.groupBy(*CELL).agg(*[F.max(F.when(F.col("_layer") == n, F.col("_v"))).alias(n) for n in layers])


def stack_stat(cells: DataFrame, agg=F.sum, value: str = "value", name: str = "value") -> DataFrame:
    """Cell-wise statistic over the layers of a long cell table."""
    return cells.groupBy(*CELL).agg(agg(value).alias(name))


def tile_id(x, y, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("int"), F.floor(y / size).cast("int")


# --- cell-wise --------------------------------------------------------------------------------

def classify(cells: DataFrame, cond: Column, name: str = "value", yes=1, no=0) -> DataFrame:
    return cells.withColumn(name, if_known(cond, yes, no))


def overwrite(stack: DataFrame, target: str, rules: list[tuple[Column, float]]) -> DataFrame:
    """Set `target` where a rule holds, in order; an unknown test changes nothing."""
    for cond, value in rules:
        stack = stack.withColumn(target, F.when(cond, F.lit(value)).otherwise(F.col(target)))
    return stack


def mask_cells(cells: DataFrame, by: DataFrame, value: str = "value", by_value: str = "value") -> DataFrame:
    """Null where the mask layer is null or absent."""
    known = by.filter(F.col(by_value).isNotNull()).select(*CELL, F.lit(True).alias("_in"))
    return (cells.join(known, CELL, "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in"))


def layer_range(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.agg(F.min(value).alias("min"), F.max(value).alias("max"))


def invert(cells: DataFrame, value: str = "value") -> DataFrame:
    """max + min - x over the layer."""
    turn = cells.agg((F.max(value) + F.min(value)).alias("_t")).scalar()
    return cells.withColumn(value, turn - F.col(value))


def cell_sample(stack: DataFrame, n: int, seed: int) -> DataFrame:
    """n complete cells, the same ones on every run."""
    return hash_sample(stack.na.drop(), CELL, n, seed)


def residual_layer(stack: DataFrame, y: str, x: str, sample: DataFrame, name: str = "residual") -> DataFrame:
    """round(y - line) with the line of y on x fitted on the sample."""
    fit = sample.agg(F.struct(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"))).scalar()
    line = fit.getField("a") * F.col(x) + fit.getField("b")
    return stack.withColumn(name, F.bround(F.col(y) - line, 0))


# --- neighbourhoods ---------------------------------------------------------------------------

def _disc(radius: float) -> list[tuple[int, int]]:
    """(row offset, half width) of a disc of cells."""
    reach = int(np.floor(radius + 1e-9))
    return [(dy, int(np.floor(np.sqrt(max(radius * radius - dy * dy, 0.0)) + 1e-9))) for dy in range(-reach, reach + 1)]


def focal_mean(cells: DataFrame, radius: float, value: str = "value", name: str = "value", tile: int = TILE) -> DataFrame:
    """Mean of the known cells within `radius` cells; an unknown centre stays unknown."""
    disc, halo = _disc(radius), int(np.floor(radius + 1e-9))

    def kernel(a):
        x = a[value]
        known = ~np.isnan(x)
        side = x.shape[0]
        pad = ((0, 0), (1, 0))
        s = np.pad(np.cumsum(np.where(known, x, 0.0), axis=1), pad)
        k = np.pad(np.cumsum(known, axis=1, dtype=float), pad)
        total, count = np.zeros_like(x), np.zeros_like(x)
        cols = np.arange(side)
        for dy, w in disc:
            lo, hi = np.maximum(cols - w, 0), np.minimum(cols + w, side - 1) + 1
            src = slice(max(dy, 0), side + min(dy, 0))
            dst = slice(max(-dy, 0), side + min(-dy, 0))
            total[dst] += s[src][:, hi] - s[src][:, lo]
            count[dst] += k[src][:, hi] - k[src][:, lo]
        with np.errstate(all="ignore"):
            return {name: np.where(known, total / count, np.nan)}

    return map_tiles(cells, [value], {name: "double"}, halo, kernel, tile)


def tpi(cells: DataFrame, radius: float, value: str = "value", tile: int = TILE) -> DataFrame:
    """Value minus the mean within the radius."""
    mean = focal_mean(cells, radius, value, "_mean", tile)
    return mean.join(cells.select(*CELL, value), CELL).select(*CELL, (F.col(value) - F.col("_mean")).alias("tpi"))


def slope(cells: DataFrame, cell_size: float = 1.0, value: str = "value", tile: int = TILE) -> DataFrame:
    """Slope in degrees from the differences along row and column.

    Central where both neighbours are known, one-sided where one is, 0 where none is.
    """
    def kernel(a):
        x = a[value]

        def gradient(axis):
            ahead, behind = np.full_like(x, np.nan), np.full_like(x, np.nan)
            i, j = (slice(None, -1), slice(1, None))
            if axis == 0:
                ahead[i], behind[j] = x[j], x[i]
            else:
                ahead[:, i], behind[:, j] = x[:, j], x[:, i]
            both = ~np.isnan(ahead) & ~np.isnan(behind)
            out = np.where(both, (ahead - behind) / (2 * cell_size),
                           np.where(~np.isnan(ahead), (ahead - x) / cell_size, (x - behind) / cell_size))
            return np.where(np.isnan(out), 0.0, out)

        g = np.degrees(np.arctan(np.hypot(gradient(0), gradient(1))))
        return {"slope": np.where(np.isnan(x), np.nan, g)}

    return map_tiles(cells, [value], {"slope": "double"}, 1, kernel, tile)
