"""Grid, terrain and vector operators against brute force on small grids."""
import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thawline.operators import extract as E, grid as G, terrain as R, vector as V
from thawline.operators.grid import CELL, Grid


def table(spark, **layers):
    first = next(iter(layers.values()))
    r, c = np.indices(first.shape)
    pdf = pd.DataFrame({"row": r.ravel(), "col": c.ravel()})
    schema = "row int, col int"
    for name, a in layers.items():
        pdf[name] = a.ravel().astype(float)
        schema += f", {name} double"
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else (int(v) if i < 2 else float(v)) for i, v in enumerate(t))
            for t in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def array(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[col] is not None:
            out[r["row"], r["col"]] = r[col]
    return out


RNG = np.random.default_rng(11)


def test_focal_mean_of_a_constant_and_with_gaps(spark):
    flat = np.full((9, 9), 4.0)
    assert np.allclose(array(G.focal_mean(table(spark, value=flat), 3, tile=4), "value", (9, 9)), 4)
    x = RNG.normal(size=(13, 11))
    x[RNG.random(x.shape) < 0.3] = np.nan
    want = np.full(x.shape, np.nan)
    for i, j in np.ndindex(x.shape):
        if not np.isnan(x[i, j]):
            want[i, j] = np.mean([x[a, b] for a, b in np.ndindex(x.shape) if (a - i) ** 2 + (b - j) ** 2 <= 2.5 ** 2 and not np.isnan(x[a, b])])
    np.testing.assert_allclose(array(G.focal_mean(table(spark, value=x), 2.5, tile=4), "value", x.shape), want)


def test_focal_radius_larger_than_a_tile(spark):
    x = RNG.normal(size=(10, 10))
    np.testing.assert_allclose(array(G.focal_mean(table(spark, value=x), 20, tile=3), "value", x.shape), np.full(x.shape, x.mean()))


def test_slope_of_a_plane_and_of_a_lone_cell(spark):
    r, c = np.indices((6, 7))
    s = array(G.slope(table(spark, value=3.0 * c), 3.0, tile=4), "slope", (6, 7))
    np.testing.assert_allclose(s, 45.0)
    lone = np.full((3, 3), np.nan)
    lone[1, 1] = 5
    assert np.nansum(array(G.slope(table(spark, value=lone)), "slope", (3, 3))) == 0


def dijkstra(flag, cost, cap):
    dist = np.full(flag.shape, np.inf)
    heap = [(0.0, i, j) for i, j in np.argwhere((flag == 1) & ~np.isnan(cost))]
    for _, i, j in heap:
        dist[i, j] = 0
    heapq.heapify(heap)
    while heap:
        d, i, j = heapq.heappop(heap)
        if d > dist[i, j]:
            continue
        for dr, dc, step in R.STEPS:
            a, b = i + dr, j + dc
            if 0 <= a < flag.shape[0] and 0 <= b < flag.shape[1] and not np.isnan(cost[a, b]):
                n = d + (cost[i, j] + cost[a, b]) / 2 * step
                if n < dist[a, b] - 1e-12 and n <= cap:
                    dist[a, b] = n
                    heapq.heappush(heap, (n, a, b))
    return np.where(np.isinf(dist), np.nan, dist)


@pytest.mark.parametrize("tile,cap", [(4, 100.0), (5, 12.0), (64, 100.0)])
def test_cost_distance_equals_dijkstra(spark, tile, cap):
    cost = RNG.uniform(0, 6, (14, 12))
    cost[RNG.random(cost.shape) < 0.15] = np.nan
    cost[3:6, 2:9] = 0  # level ground costs nothing
    flag = (RNG.random(cost.shape) < 0.04).astype(float)
    flag[4, 4] = 1
    out = R.cost_distance(table(spark, flag=flag, cost=cost), cap=cap, tile=tile)
    want = dijkstra(flag, cost, cap)
    np.testing.assert_allclose(array(out, "cost_distance", cost.shape), want, atol=1e-9)
    np.testing.assert_allclose(array(out, "effect", cost.shape), cap - np.where(np.isnan(want), cap, want), atol=1e-9)


def test_cost_distance_moves_only_the_frontier(spark):
    cost = np.ones((4, 48))
    flag = np.zeros(cost.shape)
    flag[0, 0] = 1
    active = []
    out = R.cost_distance(table(spark, flag=flag, cost=cost), cap=60.0, tile=4, trace=active)
    np.testing.assert_allclose(array(out, "cost_distance", cost.shape), dijkstra(flag, cost, 60.0), atol=1e-9)
    # 12 tiles in a row: a round wakes the next tile, and the one behind when its margin improves.
    assert len(active) >= 12 and max(active) <= 9 and sum(active[1:]) < 12 * len(active) / 2
    none = R.cost_distance(table(spark, flag=flag * 0, cost=cost), tile=4).collect()
    assert len(none) == cost.size and all(r.cost_distance is None and r.effect == 0 for r in none)


def test_proximity_equals_brute_force_and_without_flags(spark):
    flag = (RNG.random((17, 23)) < 0.03).astype(float)
    flag[2, 20] = 1
    at = np.argwhere(flag == 1)
    want = np.array([[np.sqrt(((at - (i, j)) ** 2).sum(axis=1).min()) for j in range(23)] for i in range(17)])
    np.testing.assert_allclose(array(R.proximity(table(spark, flag=flag), cell_size=2.0), "distance", flag.shape), 2 * want)
    none = R.proximity(table(spark, flag=np.zeros((3, 3))))
    assert none.filter("distance is not null").count() == 0 and none.count() == 9


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 64, 100])
def test_nearest_candidate_search(n):
    col = np.sort(RNG.choice(300, n, replace=False)).astype(float)
    keep = RNG.random(n) < 0.5
    keep[0] = True
    g2 = RNG.uniform(0, 50, keep.sum()) ** 2
    want = ((col[:, None] - col[keep][None, :]) ** 2 + g2[None, :]).min(axis=1)
    np.testing.assert_allclose(R._nearest(col, col[keep], g2), want)


def walk(z):
    to = {}
    for i, j in np.ndindex(z.shape):
        best, target = 0.0, None
        for dr, dc, d in R.STEPS:
            a, b = i + dr, j + dc
            if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and (z[i, j] - z[a, b]) / d > best:
                best, target = (z[i, j] - z[a, b]) / d, (a, b, d)
        to[i, j] = target
    return to


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_flow_equals_a_plain_walk(spark, tile):
    z = RNG.normal(size=(12, 13)) + np.add.outer(np.arange(12), np.arange(13)) * 0.8
    to = walk(z)
    area, dist = np.zeros(z.shape), np.full(z.shape, np.nan)
    flag = (RNG.random(z.shape) < 0.1).astype(float)
    for start in np.ndindex(z.shape):
        at, length = start, 0.0
        while True:
            area[at] += 1
            if flag[at] == 1 and np.isnan(dist[start]) and length <= 5:
                dist[start] = length
            if to[at] is None:
                break
            length, at = length + to[at][2], to[at][:2]
    ptr = R.d8(table(spark, value=z), tile=tile)
    np.testing.assert_allclose(array(R.d8_area(ptr, tile=tile), "cells", z.shape), area)
    got = R.downslope_distance(ptr, table(spark, flag=flag), ["flag"], 5.0, tile=tile)
    np.testing.assert_allclose(array(got, "flag", z.shape), dist)
    outlets = ptr.filter("to_row is null").join(R.d8_area(ptr, tile=tile), CELL).agg(F.sum("cells")).first()[0]
    assert outlets == z.size  # everything leaves through the outlets


def test_flow_on_level_ground_and_wetness_there(spark):
    flat = table(spark, value=np.full((4, 4), 2.0))
    area = R.d8_area(R.d8(flat, tile=2), tile=2)
    assert {r["cells"] for r in area.collect()} == {1.0}
    assert R.wetness(area, G.slope(flat)).filter("twi is not null").count() == 0


def test_resample_onto_itself_and_linear_field(spark):
    src = Grid(0, 0, 2.0, 6, 5)
    r, c = np.indices((6, 5))
    x = 3.0 * r - 2.0 * c
    same = array(G.resample(table(spark, value=x), src, src), "value", (6, 5))
    np.testing.assert_allclose(same, x)
    dst = Grid(2.0, 2.0, 0.5, 12, 8)
    got = array(G.resample(table(spark, value=x), src, dst), "value", (12, 8))
    i, j = np.indices((12, 8))
    want = 3 * ((2 + (i + .5) * .5) / 2 - .5) - 2 * ((2 + (j + .5) * .5) / 2 - .5)
    np.testing.assert_allclose(got, want)


def test_invert_mask_overwrite_and_unknown_conditions(spark):
    x = np.array([[1.0, np.nan], [3.0, 7.0]])
    np.testing.assert_allclose(array(G.invert(table(spark, value=x)), "value", (2, 2)), [[7, np.nan], [5, 1]])
    out = G.overwrite(table(spark, value=x, other=np.array([[np.nan, 1.0], [1.0, 9.0]])), "value", [(F.col("other") > 0, 0.0)])
    np.testing.assert_allclose(array(out, "value", (2, 2)), [[1, 0], [0, 0]])
    cls = array(G.classify(table(spark, value=x), F.col("value") > 2, "value"), "value", (2, 2))
    np.testing.assert_allclose(cls, [[0, np.nan], [1, 1]])


def ring(spark, parts):
    return spark.createDataFrame([("f", p, i, float(x), float(y)) for p, pts in enumerate(parts) for i, (x, y) in enumerate(pts)],
                                 "feature_id string, part_id int, seq int, x double, y double")


def test_polygon_with_a_hole_and_one_outside_the_grid(spark):
    outer, hole = [(1, 1), (9, 1), (9, 9), (1, 9)], [(3, 3), (3, 6), (6, 6), (6, 3)]
    grid = Grid(0, 0, 1, 10, 10)
    shape = ring(spark, [outer, hole])
    assert V.polygon_area(shape).first()["area"] == 64 - 9
    inside = {(r["row"], r["col"]) for r in V.polygon_cells(shape, grid).collect()}
    assert inside == {(r, c) for r in range(1, 9) for c in range(1, 9)} - {(r, c) for r in range(3, 6) for c in range(3, 6)}
    assert V.polygon_cells(ring(spark, [[(20, 20), (30, 20), (30, 30)]]), grid).count() == 0
    pts = spark.createDataFrame([("a", 2.0, 2.0), ("b", 4.0, 4.0), ("c", 0.5, 5.0)], "site string, x double, y double")
    assert [r["site"] for r in V.points_in_polygons(pts, shape).collect()] == ["a"]
    assert {r["site"] for r in V.points_in_polygons(pts, shape, "out").collect()} == {"b", "c"}


def test_lines_are_cut_at_the_box(spark):
    line = ring(spark, [[(-5, 5), (5, 5), (5, 50), (20, 50)]])
    out = sorted((r["seq"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in V.clip_lines(line, (0, 0, 10, 10)).collect())
    assert out == [(0, 0.0, 5.0, 5.0, 5.0), (1, 5.0, 5.0, 5.0, 10.0)]


def test_disc_weights_add_up_to_its_area(spark):
    pts = spark.createDataFrame([("a", 5.3, 6.1, 2.4), ("b", 5.5, 5.5, 0.2), ("c", 5.0, 5.0, 1.0)], "site string, x double, y double, r double")
    for r in pts.collect():
        cells = spark.range(0, 144).select((F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"))
        w = E.with_disc_area(cells, F.col("col") - F.lit(r["x"]), F.col("row") - F.lit(r["y"]), 1.0, r["r"], "w")
        assert w.agg(F.sum("w")).first()[0] == pytest.approx(math.pi * r["r"] ** 2)
        assert w.agg(F.min("w")).first()[0] > -1e-9


def test_buffer_leaves_unknown_cells_out(spark):
    x = np.arange(25.0).reshape(5, 5)
    x[2, 3] = np.nan
    site = spark.createDataFrame([("a", 2.5, 2.5), ("far", 90.0, 90.0)], "site string, x double, y double")
    out = {r["site"]: r["value"] for r in E.buffer_extract(site, table(spark, value=x), Grid(0, 0, 1, 5, 5), 0.5, ["value"]).collect()}
    assert out == {"a": 12.0, "far": None}
    wide = E.buffer_extract(site, table(spark, value=x), Grid(0, 0, 1, 5, 5), 1.0, ["value"], None).filter("site = 'a'").first()["value"]
    assert wide < 12  # the missing neighbour was above the centre


def test_projection_of_known_points(spark):
    # Central meridian: easting is the false easting; values of the published WGS84 / UTM 34N grid.
    df = spark.createDataFrame([(21.0, 0.0), (21.0, 69.0), (20.8, 69.05)], "lon double, lat double")
    x, y = V.project_tm(F.col("lon"), F.col("lat"))
    out = [(r["x"], r["y"]) for r in df.select(x.alias("x"), y.alias("y")).collect()]
    assert out[0] == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6))
    # Meridian arc from the equator, integrated directly.
    e2 = V.WGS84_F * (2 - V.WGS84_F)
    lat = np.radians(np.linspace(0, 69, 200001))
    m = V.WGS84_A * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    arc = float(np.sum((m[1:] + m[:-1]) / 2 * np.diff(lat)))
    assert out[1] == (pytest.approx(500000.0), pytest.approx(0.9996 * arc, abs=1e-3))
    assert out[2][0] < 500000 and out[2][1] > out[1][1]


def test_canopy_skips_thin_tiles_and_clips(spark):
    rows = [(0.5, 0.5, 100.0, 2), (0.6, 0.5, 103.0, 5), (0.6, 0.6, 140.0, 5), (1.5, 0.5, 100.0, 5), (2.5, 0.5, 99.0, 2), (50.0, 50.0, 5.0, 2)]
    pts = spark.createDataFrame(rows, "x double, y double, z double, class int")
    out = {(r["row"], r["col"]): r["chm"] for r in E.canopy(pts, 10.0, 1.0, 1.0, 25.0, 2).collect()}
    assert out == {(0, 0): 300.0, (0, 1): 0.0, (0, 2): 0.0}


def rings(spark, *parts):
    rows = [("f", p, i, float(x), float(y)) for p, pts in enumerate(parts) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "feature_id string, part_id int, seq int, x double, y double")


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize("box, want", [((-5, -5, 5, 15), 50.0), ((2, 3, 4, 5), 4.0), ((20, 20, 30, 30), None), ((-1, -1, 11, 11), 100.0)])
def test_clip_polygons_cuts_area(spark, box, want):
    out = V.polygon_area(V.clip_polygons(rings(spark, SQUARE), box), 1e-9).collect()
    assert [round(r["area"], 9) for r in out] == ([] if want is None else [want])


def test_clip_polygons_keeps_holes_and_sequence(spark):
    hole = [(4, 4), (4, 6), (6, 6), (6, 4)]
    out = V.clip_polygons(rings(spark, SQUARE, hole), (0, 0, 5, 10))
    assert abs(V.polygon_area(out).first()["area"] - (50 - 2)) < 1e-9
    for part in (0, 1):
        seq = sorted(r["seq"] for r in out.filter(f"part_id = {part}").collect())
        assert seq == list(range(len(seq)))


def test_line_cells_on_a_short_chord(spark):
    grid = Grid(0.0, 0.0, 1.0, 5, 5)
    line = spark.createDataFrame([("f", 0, 0, 0.0, 0.1), ("f", 0, 1, 1.0, 1.08)], "feature_id string, part_id int, seq int, x double, y double")
    got = {(r["row"], r["col"]) for r in V.line_cells(line, grid).collect()}
    assert got == {(0, 0), (1, 0)}


def test_points_in_polygons_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 40))
    reach = rng.uniform(3, 20, 40)
    pts = [(float(r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(angle, reach)]
    shape = rings(spark, pts, [(-1, -1), (1, -1), (1, 1), (-1, 1)])
    probe = rng.uniform(-22, 22, (400, 2))

    def inside(x, y):
        n = 0
        for part in (pts, [(-1, -1), (1, -1), (1, 1), (-1, 1)]):
            for (x1, y1), (x2, y2) in zip(part, part[1:] + part[:1]):
                n += (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x
        return n % 2 == 1

    points = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(probe)], "site string, x double, y double")
    want = {f"p{i}" for i, (x, y) in enumerate(probe) if inside(x, y)}
    assert {r["site"] for r in V.points_in_polygons(points, shape, tile=3.0).collect()} == want
    assert {r["site"] for r in V.points_in_polygons(points, shape, "out").collect()} == {f"p{i}" for i in range(400)} - want


def test_points_in_many_overlapping_polygons(spark, monkeypatch):
    """Cut tiles give what every point against every edge gives; comparisons do not grow with points x edges."""
    from collections import Counter
    rng = np.random.default_rng(6)
    shapes = [[(float(cx + rx * np.cos(a)), float(cy + ry * np.sin(a))) for a in np.arange(0, 6.2, 0.9)]
              for cx, cy, rx, ry in zip(rng.uniform(0, 9, 60), rng.uniform(0, 9, 60), rng.uniform(0.2, 2.5, 60), rng.uniform(0.2, 2.5, 60))]
    rows = [(f"f{i}", 0, j, *v) for i, pts in enumerate(shapes) for j, v in enumerate(pts)]
    rows += [r for r in rows if r[0] in ("f3", "f4")]  # a shape that came twice has each edge an even number of times
    probe = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 11, (900, 2)))]
    probe += probe[:5] + [("p9", 4.0, 4.0), (None, 4.0, 4.0), ("none", None, 4.0)]

    def around(x, y):
        crossings = lambda pts: sum((y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]))
        return {i for i, pts in enumerate(shapes) if i not in (3, 4) and crossings(pts) % 2}

    hits = Counter((k, f) for k, x, y in probe if k and x is not None for f in around(x, y))
    want = {k for (k, _), n in hits.items() if n % 2}
    shape = spark.createDataFrame(rows, "feature_id string, part_id int, seq int, x double, y double")
    points = spark.createDataFrame(probe, "site string, x double, y double")
    for pairs in (64, 1):
        monkeypatch.setattr(V, "PAIRS", pairs)
        monkeypatch.setattr(V, "CUTS", 2)
        assert {r["site"] for r in V.points_in_polygons(points, shape).collect()} == want
    assert sorted(r["site"] or "" for r in V.points_in_polygons(points, shape, "out").collect()) == sorted(k or "" for k, _, _ in probe if k not in want)


@pytest.mark.parametrize("band", [1, 7, 62])
def test_proximity_in_bands(spark, band):
    rng = np.random.default_rng(2)
    flag = (rng.random((60, 5)) < 0.04).astype(float)
    whole = array(R.proximity(table(spark, flag=flag)), "distance", flag.shape)
    cut = array(R.proximity(table(spark, flag=flag), band=band), "distance", flag.shape)
    np.testing.assert_allclose(whole, cut)


@pytest.mark.parametrize("band", [1, 3, 8])
def test_proximity_with_absent_cells(spark, band):
    rng = np.random.default_rng(5)
    for keep, share in [(0.3, 0.1), (0.05, 0.5), (0.6, 0.01)]:
        at = [(int(i) - 9, int(j) - 4) for i, j in np.argwhere(rng.random((40, 31)) < keep)]
        rows = [(i, j, int(rng.random() < share)) for i, j in at]
        marks = np.array([(i, j) for i, j, f in rows if f])
        out = R.proximity(spark.createDataFrame(rows, "row int, col int, flag int"), band=band).collect()
        assert sorted((r.row, r.col) for r in out) == sorted(at)
        for r in out:
            want = np.sqrt(((marks - (r.row, r.col)) ** 2).sum(axis=1).min()) if len(marks) else None
            assert r.distance == pytest.approx(want)
    lone = spark.createDataFrame([(0, 0, 1), (0, 5, 0), (5, 5, 0)], "row int, col int, flag int")
    assert {(r.row, r.col): round(r.distance, 6) for r in R.proximity(lone, band=band).collect()} == {
        (0, 0): 0.0, (0, 5): 5.0, (5, 5): 7.071068}
