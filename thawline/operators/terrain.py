"""Distances and flow over the grid: iterative or ordered along paths."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from thawline.functions import finite
from thawline.operators.grid import CELL, TILE, dense, invert, map_tiles, with_tiles
from thawline.sources import cut_lineage

# Neighbours in the order that decides equal slopes: row offset, column offset, distance.
NEIGHBOURS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
STEPS = [(dr, dc, float(np.hypot(dr, dc))) for dr, dc in NEIGHBOURS]
# Snow-day thresholds of the persistence effect, every 7 days.
SNOW_THRESHOLDS = tuple(range(150, 256, 7))


def _nearest(col: np.ndarray, at: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """min over candidates of (col - at)^2 + g2 for sorted col and at.

    The best candidate moves monotonically with col, so columns are settled from the
    coarsest spacing down, each looking only between its settled neighbours' choices.
    """
    n, m = len(col), len(at)
    best, opt = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    s = 1 << max(int(n).bit_length() - 1, 0)
    while s >= 1:
        t = np.arange(s - 1, n, 2 * s)
        lo = np.where(t - s >= 0, opt[np.maximum(t - s, 0)], 0)
        hi = np.where(t + s < n, opt[np.minimum(t + s, n - 1)], m - 1)
        size = hi - lo + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        pick = np.arange(size.sum()) - np.repeat(start - lo, size)
        cost = (np.repeat(col[t], size) - at[pick]) ** 2 + g2[pick]
        low = np.minimum.reduceat(cost, start)
        where = np.flatnonzero(cost == np.repeat(low, size))
        best[t], opt[t] = low, pick[where[np.searchsorted(where, start)]]
        s //= 2
    return best


BAND = 8  # rows of the grid that one task of the row pass looks at


def _band_distance(pdf: pd.DataFrame, spans: pd.DataFrame, first: int, band: int) -> pd.DataFrame:
    """Distances of a band's cells, from the flagged rows before, in and behind the band of every column with a flag."""
    if not len(pdf) or not len(spans):
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "distance": np.full(len(pdf), np.nan)})
    pdf, spans = pdf.sort_values(["row", "col"]), spans.sort_values("_at")
    at, bits = spans["_at"].to_numpy(dtype=float), spans["_bits"].to_numpy(dtype=np.int64)
    rows, col = pdf["row"].to_numpy(), pdf["col"].to_numpy(dtype=float)
    offsets = range(band)
    hit = [(bits >> o) & 1 == 1 for o in offsets]
    under = spans["_behind"].fillna(np.inf).to_numpy(dtype=float)
    behind = {}
    for o in reversed(offsets):
        under = behind[o] = np.where(hit[o], first + o, under)
    above, dist = spans["_before"].fillna(-np.inf).to_numpy(dtype=float), np.empty(len(col))
    for o in offsets:
        above = np.where(hit[o], first + o, above)
        lo, hi = np.searchsorted(rows, [first + o, first + o + 1])
        if hi > lo:
            g = np.minimum(first + o - above, behind[o] - first - o)
            dist[lo:hi] = np.sqrt(_nearest(col[lo:hi], at, g ** 2))
    return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "distance": dist})


def proximity(cells: DataFrame, flag: str = "flag", cell_size: float = 1.0, band: int = BAND) -> DataFrame:
    """Exact straight distance of every cell to the nearest flagged one (null without any). Cells may be absent.

    Two passes: the nearest flagged cell within each column, then the best column for each row. Bands of `band` rows
    (62 at most) meet every column that has a flag anywhere: its last flagged row before the band, its first one behind
    it, and a bit for each row inside, whether or not the column has a cell there. A task holds one band's cells and
    one row per flagged column; columns with flags times bands is what is shuffled beside the cells.
    """
    if not 1 <= band <= 62:
        raise ValueError("a band has 1 to 62 rows")
    work = cells.select(*CELL, flag, F.floor(F.col("row") / band).alias("_band"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("row") - F.col("_band") * band).cast("int"))
    flagged = (work.filter(F.col(flag) == 1).groupBy("col", "_band")
               .agg(F.min("row").alias("_low"), F.max("row").alias("_high"), F.bit_or(bit).alias("_bits")))
    order = W.partitionBy("col").orderBy("_band")
    flagged = flagged.withColumns({"_last": F.lag("_high").over(order), "_next": F.lead("_low").over(order),
                                   "_until": F.lead("_band").over(order)})
    bands = work.select("_band").distinct()
    ends = bands.agg(F.struct(F.min("_band").alias("low"), F.max("_band").alias("high"))).scalar()
    span = lambda of, before, behind, bits: F.struct(of.alias("_of"), before.cast("int").alias("_before"),
                                                     behind.cast("int").alias("_behind"), bits.cast("long").alias("_bits"))
    spread = lambda low, high, *rest: F.when(low <= high, F.transform(F.sequence(low, high), lambda x: span(x, *rest)))
    own, none = F.col("_band"), F.lit(0)
    here = F.array(span(own, F.col("_last"), F.col("_next"), F.col("_bits")))
    later = spread(own + 1, F.coalesce(F.col("_until") - 1, F.col("_ends.high")), F.col("_high"), F.col("_next"), none)
    first = F.when(F.col("_last").isNull(), spread(F.col("_ends.low"), own - 1, F.lit(None), F.col("_low"), none))
    spans = (flagged.withColumn("_ends", ends)
             .select(F.col("col").alias("_at"), F.explode(F.concat(here, *[F.coalesce(x, F.slice(here, 1, 0)) for x in (later, first)])))
             .select("_at", "col.*").join(bands.select(F.col("_band").alias("_of")), "_of", "left_semi"))

    def kernel(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _band_distance(left, right, int(key[0]) * band, band)

    out = (work.select(*CELL, "_band").groupBy("_band").cogroup(spans.groupBy("_of"))
           .applyInPandas(kernel, "row int, col int, distance double"))
    return out.withColumn("distance", finite("distance") * cell_size)


def _relax(a: dict[str, np.ndarray], cap: float) -> dict[str, np.ndarray]:
    """Settle the costs inside a tile, given the costs at its margin."""
    cost, dist = a["cost"], np.where(np.isnan(a["dist"]), np.inf, a["dist"])
    start = dist.copy()
    pad_cost = np.pad(cost, 1, constant_values=np.nan)
    n = cost.shape[0]
    pieces = []
    for dr, dc, d in STEPS:
        near = pad_cost[1 + dr:1 + dr + n, 1 + dc:1 + dc + n]
        pieces.append((dr, dc, np.where(np.isnan(near) | np.isnan(cost), np.inf, (near + cost) / 2 * d)))
    while True:
        pad = np.pad(dist, 1, constant_values=np.inf)
        new = dist
        for dr, dc, move in pieces:
            new = np.minimum(new, pad[1 + dr:1 + dr + n, 1 + dc:1 + dc + n] + move)
        new = np.where(new > cap, dist, new)
        if np.array_equal(new, dist):
            break
        dist = new
    moved = (dist < start).astype(float)
    return {"dist": np.where(np.isinf(dist), np.nan, dist), "moved": moved}


MOST_SENT = 1 << 20  # active tiles, two numbers each, that are broadcast; more are joined by exchange
MERGE_EVERY = 8  # rounds after which the improvements are reduced to one row per cell


def _settled(pdf: pd.DataFrame, tile_row: int, tile_col: int, tile: int, cap: float) -> pd.DataFrame:
    """The own cells of a tile that improve, from its cells' costs and all costs to reach known so far."""
    shape = (tile + 2, tile + 2)
    cost, dist = np.full(shape, np.nan), np.full(shape, np.inf)
    r, c = (pdf[k].to_numpy() - at * tile + 1 for k, at in (("row", tile_row), ("col", tile_col)))
    price, reach = pdf["cost"].to_numpy(dtype=float), pdf["dist"].to_numpy(dtype=float)
    priced, reached = ~np.isnan(price), ~np.isnan(reach)
    cost[r[priced], c[priced]] = price[priced]
    np.minimum.at(dist, (r[reached], c[reached]), reach[reached])
    done = _relax({"cost": cost, "dist": dist}, cap)
    i, j = np.nonzero(done["moved"][1:-1, 1:-1])
    return pd.DataFrame({"row": i + tile_row * tile, "col": j + tile_col * tile, "dist": done["dist"][i + 1, j + 1]})


def cost_distance(cells: DataFrame, flag: str = "flag", cost: str = "cost", cap: float = 100.0, cell_size: float = 1.0,
                  tile: int = TILE, trace: list[int] | None = None) -> DataFrame:
    """Least accumulated cost to a flagged cell, up to `cap`, and its reversed effect.

    A step costs the mean of the two cells' costs times its length. A round settles whole tiles, but only those whose
    margin holds a cell that improved in the round before; the cells of all others stay where they are. It yields the
    improved cells alone, so what moves falls with the frontier, and the number of rounds is the number of tiles the
    longest path crosses. Ends when no cell improves. `trace` gets the number of active tiles of each round.
    """
    key = ["_tr", "_tc"]
    base = cut_lineage(cells.select(*CELL, (F.col(cost) * cell_size).cast("double").alias("cost"),
                                    (F.col(flag) == 1).alias("_start")))
    known = base.filter("_start and cost is not null").select(*CELL, F.lit(0.0).alias("dist"))
    prices = with_tiles(base.filter("cost is not null").select(*CELL, "cost", F.lit(None).cast("double").alias("dist")), 1, tile)
    tiles = cut_lineage(with_tiles(base.filter("cost is not null").select(*CELL), 0, tile).select(*key).distinct())
    front, rounds = with_tiles(known, 1, tile), 0

    def settle(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _settled(pdf, at[0], at[1], tile, cap)

    while True:
        active = cut_lineage(front.select(*key).distinct().join(tiles, key, "left_semi"))
        n = active.count()
        if trace is not None:
            trace.append(n)
        if not n:
            break
        chosen = F.broadcast(active) if n <= MOST_SENT else active
        reached = with_tiles(known.select(*CELL, F.lit(None).cast("double").alias("cost"), "dist"), 1, tile)
        work = prices.join(chosen, key, "left_semi").unionByName(reached.join(chosen, key, "left_semi"))
        better = cut_lineage(work.groupBy(*key).applyInPandas(settle, "row int, col int, dist double"))
        known, rounds = known.unionByName(better), rounds + 1
        if rounds % MERGE_EVERY == 0:
            known = cut_lineage(known.groupBy(*CELL).agg(F.min("dist").alias("dist")))
        own = (F.floor(F.col("row") / tile) == F.col("_tr")) & (F.floor(F.col("col") / tile) == F.col("_tc"))
        front = with_tiles(better, 1, tile).filter(~own)
    least = known.groupBy(*CELL).agg(F.min("dist").alias("dist"))
    return (base.select(*CELL).join(least, CELL, "left")
            .select(*CELL, F.col("dist").alias("cost_distance"),
                    (cap - F.least(F.coalesce("dist", F.lit(cap)), F.lit(cap))).alias("effect")))


def d8(dem: DataFrame, value: str = "value", tile: int = TILE) -> DataFrame:
    """Pointer to the steepest lower neighbour: (row, col, to_row, to_col, dist), null at a pit.

    Equal slopes go to the first neighbour in the fixed order.
    """
    def kernel(a):
        z = a[value]
        n = z.shape[0]
        pad = np.pad(z, 1, constant_values=np.nan)
        with np.errstate(invalid="ignore"):
            drops = np.stack([(z - pad[1 + dr:1 + dr + n, 1 + dc:1 + dc + n]) / d for dr, dc, d in STEPS])
        drops = np.where(np.isnan(drops), -np.inf, drops)
        best = drops.argmax(axis=0)
        top = np.take_along_axis(drops, best[None], axis=0)[0]
        return {"to": np.where(top > 0, best, np.nan)}

    # try_element_at: plain element_at takes a null index for a known one under ANSI.
    table = lambda k: F.try_element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("to") + 1)
    return (map_tiles(dem, [value], {"to": "int"}, 1, kernel, tile)
            .select(*CELL, (F.col("row") + table(0)).cast("int").alias("to_row"),
                    (F.col("col") + table(1)).cast("int").alias("to_col"), table(2).alias("dist")))


def _targets(a: dict[str, np.ndarray]) -> np.ndarray:
    """Flat index each cell points to inside the array, its own index where it does not."""
    n = a["dr"].shape[0]
    r, c = np.indices((n, n))
    r, c = r + a["dr"], c + a["dc"]
    inside = ~np.isnan(r) & (r >= 0) & (r < n) & (c >= 0) & (c < n)
    own = np.arange(n * n).reshape(n, n)
    return np.where(inside, np.nan_to_num(r) * n + np.nan_to_num(c), own).astype(np.int64).ravel()


def _offsets(ptr: DataFrame) -> DataFrame:
    return ptr.withColumns({"dr": (F.col("to_row") - F.col("row")).cast("double"),
                            "dc": (F.col("to_col") - F.col("col")).cast("double")})


def downslope_distance(ptr: DataFrame, flags: DataFrame, layers: list[str], cap: float = 100.0, cell_size: float = 1.0,
                       tile: int = TILE) -> DataFrame:
    """Distance along the pointers to the first flagged cell, for several flag layers at once.

    A path within the cap stays within cap / cell size cells of its start, so a halo of
    that width makes each tile independent: one shuffle and no rounds. A flagged cell
    has distance 0; one that meets none within the cap has null.
    """
    halo = int(np.ceil(cap / cell_size))

    def kernel(a):
        to, shape = _targets(a), a["dr"].shape
        still = to == np.arange(len(to))
        length = np.where(still, np.inf, np.nan_to_num(a["dist"]).ravel() * cell_size)
        best = [np.where(a[c].ravel() == 1, 0.0, np.inf) for c in layers]
        for _ in range(halo.bit_length() + 1):  # 2^k steps known after k rounds
            best = [np.where(np.isinf(b), length + b[to], b) for b in best]
            length, to = length + length[to], to[to]
        return {c: np.where(b <= cap, b, np.nan).reshape(shape) for c, b in zip(layers, best)}

    both = _offsets(ptr).select(*CELL, "dr", "dc", "dist").join(flags.select(*CELL, *layers), CELL, "left")
    return map_tiles(both, ["dr", "dc", "dist", *layers], {c: "double" for c in layers}, halo, kernel, tile)


def snow_effect(cells: DataFrame, dem: str = "dem", snow: str = "snow", thresholds: tuple[int, ...] = SNOW_THRESHOLDS,
                cap: float = 100.0, cell_size: float = 1.0, tile: int = TILE) -> DataFrame:
    """Closeness to long-lying snow uphill, summed over snow-day thresholds and inverted."""
    known = cells.filter(F.col(dem).isNotNull())
    ptr = d8(invert(known.select(*CELL, F.col(dem).alias("value"))), tile=tile)
    names = [f"t{t}" for t in thresholds]
    flags = cells.select(*CELL, *[(F.col(snow) >= t).cast("int").alias(n) for t, n in zip(thresholds, names)])
    dist = downslope_distance(ptr, flags, names, cap, cell_size, tile)
    # Unreached counts as the cap; the snow itself does not count.
    part = {n: F.when(F.coalesce(F.col(n), F.lit(cap)) != 0, F.least(F.coalesce(F.col(n), F.lit(cap)), F.lit(cap))) for n in names}
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in part.values()])
    any_known = F.coalesce(*part.values()).isNotNull()
    summed = dist.select(*CELL, F.when(any_known, total).alias("value"))
    return invert(cut_lineage(summed)).select(*CELL, F.col("value").alias("snow_effect"))


def _drain(to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights upstream of every cell, itself included (pointer doubling)."""
    acc, at = weight.copy(), np.flatnonzero(to != np.arange(len(to)))
    end = to[at]
    stop = to == np.arange(len(to))
    jump = to.copy()
    while len(at):
        inflow = np.bincount(end, weights=acc[at], minlength=len(acc))
        nxt = np.where(stop[jump], -1, jump[jump])
        nxt[stop] = -1
        acc = acc + inflow
        keep = nxt[at] >= 0
        at, end = at[keep], nxt[at[keep]]
        stop, jump = nxt < 0, np.where(nxt < 0, np.arange(len(to)), nxt)
    return acc


def _last_in_tile(to: np.ndarray) -> np.ndarray:
    end = to
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further


def d8_area(ptr: DataFrame, cell_size: float = 1.0, tile: int = TILE) -> DataFrame:
    """Contributing area of every cell, itself included, of a sink-free grid.

    Tiles are drained on their own first. What matters between tiles is only how much
    leaves at which cell and where it leaves the next tile, a graph of border cells
    that is small against the grid; its flows are summed by pointer doubling. A second
    pass drains each tile again with what enters it. An outlet that a third of the grid
    drains to receives sums, never the cells themselves.
    """
    moves = _offsets(ptr).select(*CELL, "dr", "dc", F.floor(F.col("row") / tile).cast("int").alias("_tr"),
                                 F.floor(F.col("col") / tile).cast("int").alias("_tc"))

    def grids(key, pdf, cols):
        r0, c0 = key[0] * tile, key[1] * tile
        return dense(pdf, cols, r0, c0, tile), (pdf["row"].to_numpy() - r0) * tile + pdf["col"].to_numpy() - c0

    def leaving(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Border cells with the cell where their path leaves the tile, and what each exit collects.
        a, at = grids(key, pdf, ["dr", "dc"])
        to = _targets(a)
        last = _last_in_tile(to)
        weight = np.zeros(tile * tile)
        weight[at] = 1.0
        acc = _drain(to, weight)
        r, c = at // tile, at % tile
        border = (r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1)
        dr, dc = a["dr"].ravel(), a["dc"].ravel()
        out = ~np.isnan(dr) & (to == np.arange(len(to)))  # points out of the tile
        b, e = at[border], last[at[border]]
        exits = out[b] & (e == b)
        r0, c0 = key[0] * tile, key[1] * tile
        null = lambda ok, v: pd.array(np.where(ok, np.nan_to_num(v), 0), dtype="Int32").copy()
        frame = pd.DataFrame({"row": b // tile + r0, "col": b % tile + c0, "flow": np.where(exits, acc[b], 0.0), "exits": exits})
        for name, ok, v in (("exit_row", out[e], e // tile + r0), ("exit_col", out[e], e % tile + c0),
                            ("next_row", exits, b // tile + r0 + dr[b]), ("next_col", exits, b % tile + c0 + dc[b])):
            column = null(ok, v)
            column[~ok] = pd.NA
            frame[name] = column
        return frame

    border = cut_lineage(moves.groupBy("_tr", "_tc").applyInPandas(
        leaving, "row int, col int, flow double, exits boolean, exit_row int, exit_col int, next_row int, next_col int"))
    entry = border.select(F.col("row").alias("next_row"), F.col("col").alias("next_col"),
                          F.col("exit_row").alias("to_row"), F.col("exit_col").alias("to_col"))
    exits = border.filter("exits").select(*CELL, "flow", "next_row", "next_col")
    flow = cut_lineage(exits.select(*CELL, "flow"))
    moving = cut_lineage(exits.join(entry, ["next_row", "next_col"]).filter("to_row is not null").select(*CELL, "to_row", "to_col"))
    while moving.limit(1).count():
        inflow = (moving.join(flow, CELL).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col"))
                  .agg(F.sum("flow").alias("_in")))
        ahead = moving.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"),
                              F.col("to_row").alias("_r"), F.col("to_col").alias("_c"))
        flow = cut_lineage(flow.join(inflow, CELL, "left")
                           .select(*CELL, (F.col("flow") + F.coalesce("_in", F.lit(0.0))).alias("flow")))
        moving = cut_lineage(moving.join(ahead, ["to_row", "to_col"])
                             .select(*CELL, F.col("_r").alias("to_row"), F.col("_c").alias("to_col")))
    entering = (exits.drop("flow").join(flow, CELL).groupBy(F.col("next_row").alias("row"), F.col("next_col").alias("col"))
                .agg(F.sum("flow").alias("inflow")))

    def drained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, at = grids(key, pdf, ["dr", "dc", "inflow"])
        weight = np.zeros(tile * tile)
        weight[at] = 1.0 + np.nan_to_num(a["inflow"].ravel()[at])
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "cells": _drain(_targets(a), weight)[at]})

    area = (moves.join(entering, CELL, "left").groupBy("_tr", "_tc")
            .applyInPandas(drained, "row int, col int, cells double"))
    return area.select(*CELL, "cells", (F.col("cells") * cell_size).alias("specific_area"))


def wetness(area: DataFrame, slope: DataFrame, flat_fill: float | None = None) -> DataFrame:
    """ln(specific area / tan(slope)); null on level ground unless a fill slope is given."""
    s = F.coalesce(F.col("slope"), F.lit(flat_fill)) if flat_fill is not None else F.col("slope")
    tan = F.tan(F.radians(s))
    return (area.join(slope, CELL, "left")
            .select(*CELL, F.ln(F.try_divide(F.col("specific_area"), F.when(tan > 0, tan))).alias("twi")))
