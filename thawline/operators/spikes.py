"""Spike detection against the best-correlated other site, and repair.

The three sensors are handled as one long table, so each step is one plan whose
thresholds come from a table, and every window is one (site, month, sensor).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thawline.functions import clock_seconds, if_known, month_index
from thawline.functions.ordered import roll, step
from thawline.functions.tables import (
    SPIKE_HUGE, SPIKE_QUIET, SPIKE_RATIO_RULES, SPIKE_STEP_LIMIT, keep_codes_for,
)
from thawline.operators.filters import supported
from thawline.sources import new_folder, read_part

SENSORS = ("T1", "T2", "T3")
GROUP = ["site", "my", "sensor"]
BLOCK_SITES = 64  # own sites of a month from which on a block of them is divided


def _allowed(stage: str, network: str) -> Column:
    out = F.lit(False)
    for s in SENSORS:
        out = out | ((F.col("sensor") == s) & F.col("probl").isin(*keep_codes_for(stage, network, s)))
    return out


def sensor_rows(readings: DataFrame) -> DataFrame:
    """One row per reading and temperature sensor."""
    return (readings.withColumn("my", month_index("datetime"))
            .select("site", "datetime", "my", "probl", F.posexplode(F.array(*SENSORS)).alias("_i", "value"))
            .withColumn("sensor", F.element_at(F.array(*map(F.lit, SENSORS)), F.col("_i") + 1)).drop("_i"))


def own_rows(rows: DataFrame, network: str) -> DataFrame:
    """Readings that may be screened: usable code and known value."""
    return rows.filter(_allowed("spike_own", network) & F.col("value").isNotNull())


PEERS = "site string, my int, sensor string, peer string, cor double"
BLOCK_READINGS = 1 << 18  # readings of a month in one block of sites
CELLS = 1 << 21  # cells of a (stamp x site) matrix


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of an array column; an unknown value is NaN."""
    lists = table[column].combine_chunks()
    return np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


def _dense(row: np.ndarray, col: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
    """Which (stamp, site) is there, which of them is known, and the known values."""
    at = row * shape[1] + col
    times = np.bincount(at, minlength=shape[0] * shape[1])
    x = np.full(len(times), np.nan)
    if len(times) and times.max() > 1:
        np.fmax.at(x, at, values)
    else:
        x[at] = values
    here, x = (times > 0).reshape(shape), x.reshape(shape)
    known = here & ~np.isnan(x)
    # Centred on the site's mean so that the sums of products keep their digits.
    mean = np.nansum(x, axis=0) / np.maximum(known.sum(axis=0), 1)
    return here, known, np.where(known, x - mean, 0.0)


def _ranked(mine, theirs, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, correlation) of each own site with each peer; no rank where they share no stamp.

    Counts of stamps tell first which pairs have a correlation at all; sums of products are formed for their sites only.
    """
    (a_here, _, a), (b_here, b_known, b) = mine, theirs
    few = a_here.astype(np.float32).T
    n = few @ b_here.astype(np.float32)
    met = (n > 0) & ~same
    open_ = met & (n >= 2) & ~(few @ (b_here & ~b_known).astype(np.float32) > 0)
    cor = np.full(n.shape, np.nan)
    i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if len(i):
        n, a_here, a, b_here, b = n[np.ix_(i, j)].astype(float), a_here[:, i].astype(float), a[:, i], b_here[:, j].astype(float), b[:, j]
        sx, sy, sxy = a.T @ b_here, a_here.T @ b, a.T @ b
        sxx, syy = (a * a).T @ b_here, a_here.T @ (b * b)
        with np.errstate(all="ignore"):
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            # A constant series leaves rounding noise in place of a zero variance.
            flat = (vx <= 1e-12 * np.maximum(n * sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(n * syy, 1e-300))
            found = np.where(flat | ~open_[np.ix_(i, j)], np.nan, (n * sxy - sx * sy) / np.sqrt(vx * vy))
        cor[np.ix_(i, j)] = np.round(found, 12)  # equal correlations must not be told apart by the last bits
    return np.where(met, np.where(np.isnan(cor), -2.0, cor), -np.inf), cor


def _best_peers(my: int, own: pa.Table, blocks) -> pa.Table:
    """Best peer of each own site and sensor of a month among all blocks of peers, by matrix products."""
    sites, sensors = np.array(own["site"].to_pylist(), object), np.array(own["sensor"].to_pylist(), object)
    col, stamp = _flat(own, "stamp")
    values = _flat(own, "value")[1]
    good = ~np.isnan(values)
    stamps, row = np.unique(stamp, return_inverse=True)
    width = max(1, CELLS // max(1, len(stamps)))

    def own_parts():
        for sensor in SENSORS:
            rows = np.flatnonzero(sensors == sensor)
            for k in range(0, len(rows), width):
                part = rows[k:k + width]
                place = np.full(len(sites), -1)
                place[part] = np.arange(len(part))
                mine = good & (place[col] >= 0)
                yield sensor, part, _dense(row[mine], place[col[mine]], values[mine], (len(stamps), len(part)))

    kept = list(own_parts()) if len(stamps) * len(sites) <= 2 * CELLS else None
    best, cor, peer = np.full(len(sites), -np.inf), np.full(len(sites), np.nan), np.full(len(sites), None, object)
    for block in blocks:
        names = np.array(block["site"].to_pylist(), object)
        block = block.take(pa.array(np.argsort(names)))  # the first of equals counts: peers are in name order
        names = np.sort(names)
        peer_col, peer_stamp = _flat(block, "stamp")
        peer_row = np.minimum(np.searchsorted(stamps, peer_stamp), len(stamps) - 1)
        met = stamps[peer_row] == peer_stamp
        theirs = {s: _flat(block, s)[1] for s in SENSORS}
        for k in range(0, len(names), width):
            part = np.flatnonzero(met & (peer_col >= k) & (peer_col < k + width))
            at, few = (peer_row[part], peer_col[part] - k), names[k:k + width]
            dense: dict[str, tuple] = {}
            for sensor, rows, mine in kept or own_parts():
                if sensor not in dense:
                    dense = {sensor: _dense(*at, theirs[sensor][part], (len(stamps), len(few)))}
                rank, r = _ranked(mine, dense[sensor], sites[rows][:, None] == few[None, :])
                first = rank.argmax(axis=1)
                top = rank[np.arange(len(rows)), first]
                better = top > best[rows]
                for i in np.flatnonzero((top == best[rows]) & np.isfinite(top)):
                    better[i] = few[first[i]] < peer[rows[i]]
                i = np.flatnonzero(better)
                best[rows[i]], cor[rows[i]], peer[rows[i]] = top[i], r[i, first[i]], few[first[i]]
    i = np.flatnonzero(np.isfinite(best))
    return pa.table({"site": pa.array(sites[i], pa.string()), "my": pa.array(np.full(len(i), my), pa.int32()), "sensor": pa.array(sensors[i], pa.string()),
                     "peer": pa.array(peer[i], pa.string()), "cor": pa.array(cor[i], pa.float64(), mask=np.isnan(cor[i]))})


def best_peer(own: DataFrame, every: DataFrame, network: str, n_blocks: int | None = None) -> DataFrame:
    """The other site whose readings correlate best, per site, month and sensor.

    `own` holds the sensor rows to screen, `every` the readings of all sites. A pair's
    correlation uses the stamps of the own readings the peer has too and is unknown if
    the peer has an unknown or unusable value there; unknown ones come last, equal ones
    by name. Every site is compared with every other, but no pair of readings is ever
    formed and no reading is copied: a site's month is packed into one row of arrays,
    and all sites' months are written once, by month and block of sites, to the shared
    folder. A task holds one block of own months, reads the blocks of its month one
    after the other, multiplies the (stamp x site) matrices and keeps the best so far.
    """
    spark = every.sparkSession
    cores = spark.sparkContext.defaultParallelism
    my = month_index("datetime").cast("int").alias("my")
    every, own = (df.filter("site is not null and datetime is not null") for df in (every, own))
    sizes = every.groupBy(my).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("site").alias("sites"))
    size = sizes.agg(F.max("n").alias("n"), F.max("sites").alias("sites"), F.count(F.lit(1)).alias("months")).first()
    months = max(1, size["months"])
    if n_blocks is None:
        n_blocks = max(1, -(-(size["n"] or 0) // BLOCK_READINGS))
    n_own = max(n_blocks, min(-(-(size["sites"] or 0) // BLOCK_SITES), 3 * cores))  # small tables keep all cores busy
    codes = {s: keep_codes_for("spike_peer", network, s) for s in SENSORS}
    block = lambda n: F.pmod(F.xxhash64("site"), F.lit(n)).cast("int").alias("_b")
    stamp = clock_seconds("datetime").cast("long").alias("stamp")
    usable = [F.when(F.col("probl").isin(*codes[s]), F.col(s)).cast("double").alias(s) for s in SENSORS]
    folder = new_folder(spark, "peers")
    theirs = every.select(my, block(n_blocks), "site", stamp, *usable).repartition(min(months * n_blocks, 2000), "my", "_b")
    theirs = theirs.groupBy("my", "_b", "site").agg(F.collect_list(F.struct("stamp", *SENSORS)).alias("_r"))
    theirs.select("my", "_b", "site", *[F.col("_r")[c].alias(c) for c in ("stamp", *SENSORS)]).write.partitionBy("my", "_b").parquet(folder)

    def search(key, table):
        month = key[0].as_py()
        found = (read_part(f"{folder}/my={month}/_b={b}") for b in range(n_blocks))
        return _best_peers(month, table, (t for t in found if t is not None))

    mine = own.select(F.col("my").cast("int").alias("my"), block(n_own), "site", "sensor", stamp, F.col("value").cast("double").alias("value"))
    mine = mine.repartition(min(months * n_own, 2000), "my", "_b").groupBy("my", "_b", "site", "sensor").agg(F.collect_list(F.struct("stamp", "value")).alias("_r"))
    mine = mine.select("my", "_b", "site", "sensor", F.col("_r")["stamp"].alias("stamp"), F.col("_r")["value"].alias("value"))
    return mine.groupBy("my", "_b").applyInArrow(search, PEERS)


def with_peer(own: DataFrame, every: DataFrame, peers: DataFrame) -> DataFrame:
    """Own readings with the chosen peer's reading at the same stamp.

    The peer's value is taken as it is: its codes matter for the choice only.
    """
    theirs = every.select(F.col("site").alias("peer"), "sensor", "datetime", F.col("value").alias("peer_value"))
    return (own.join(peers.select(*GROUP, "peer"), GROUP, "left")
            .join(theirs, ["peer", "sensor", "datetime"], "left"))


def trimmed_means(df: DataFrame, cols: dict[str, str], back: int = 71, ahead: int = 72) -> DataFrame:
    """Add, for each input -> output name, a rolling mean that ignores the centre.

    A frame of even length gives its plain mean, one of odd length leaves out its
    five centre rows. Full frames are even; odd ones occur near the ends of a group.
    Groups must have more than 100 rows, as screened ones do, and no null input.

    The frame sum is a difference of running sums, so its cost does not grow with the
    frame. Centres of odd frames lie within `ahead` rows of an end; the five-row sums
    there are collected into one short array per end.
    """
    assert ahead == back + 1
    w = W.partitionBy(*GROUP).orderBy("datetime")
    group = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near, far = ahead // 2, ahead  # an end's possible centres: [near, far) rows from it
    out = df.withColumns({"_p": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(group).cast("int"),
                          **{f"_run_{c}": F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) for c in cols},
                          **{f"_all_{c}": F.sum(c).over(group) for c in cols}})
    window = {}
    for c in cols:
        run = f"_run_{c}"
        window[f"_hi_{c}"] = F.coalesce(F.lead(run, ahead).over(w), F.col(f"_all_{c}"))
        window[f"_lo_{c}"] = F.coalesce(F.lag(run, back + 1).over(w), F.lit(0.0))
        window[f"_five_{c}"] = F.lead(run, 2).over(w) - F.lag(run, 3).over(w)
    out = out.withColumns(window)
    # Both ends are windows of their own, so that the many rows between carry no arrays.
    # In a group shorter than two ends, one window holds all and the ranges adjoin.
    from_end = F.col("_n") - 1 - F.col("_p")
    short = F.col("_n") < 2 * far
    out = out.withColumn("_zone", F.when(short | (F.col("_p") < far), 0).when(from_end < far, 2).otherwise(1))
    zone = W.partitionBy(*GROUP, "_zone").orderBy("datetime").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    centres = F.when(short, (F.col("_p") >= near) & (from_end >= near)).otherwise(
        ((F.col("_zone") == 0) & F.col("_p").between(near, far - 1))
        | ((F.col("_zone") == 2) & from_end.between(near, far - 1)))
    out = out.withColumns({f"_ends_{c}": F.collect_list(F.when(centres, F.col(f"_five_{c}"))).over(zone) for c in cols})
    lo = F.greatest(F.col("_p") - back, F.lit(0))
    hi = F.least(F.col("_p") + ahead, F.col("_n") - 1)
    size, mid = hi - lo + 1, F.floor((lo + hi) / 2).cast("int")
    means = {}
    for c, name in cols.items():
        frame = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        first = F.when(F.col("_zone") == 0, near).otherwise(F.col("_n") - far)
        centre = F.try_element_at(f"_ends_{c}", mid - first + 1)
        means[name] = F.when(size % 2 == 0, frame / size).otherwise((frame - centre) / (size - 5))
    temp = [f"_{k}_{c}" for k in ("run", "all", "five", "hi", "lo", "ends") for c in cols]
    return out.withColumns(means).drop("_p", "_n", "_zone", *temp)


def spike_features(paired: DataFrame) -> DataFrame:
    """Steps of the reading and of its difference to the peer, relative to their rolling means."""
    w = W.partitionBy(*GROUP).orderBy("datetime")
    df = paired.withColumn("me", F.col("value") - F.col("peer_value"))
    size = lambda c, k: F.coalesce(F.abs(step(c, k, w)), F.lit(0.0))
    df = df.withColumns({"step_before": step("value", 1, w), "step_after": step("value", -1, w),
                         "diff": size("me", 1) + size("me", -1), "change": size("value", 1) + size("value", -1)})
    df = trimmed_means(df, {"diff": "_rd", "change": "_rc"})
    floor = F.lit(0.001)
    return df.withColumns({"roll_diff": F.col("_rd") + floor, "roll_change": F.col("_rc") + floor}).withColumns({
        "rel_diff": F.try_divide("diff", "roll_diff"), "rel_change": F.try_divide("change", "roll_change"),
        "rel_before": F.try_divide("step_before", "roll_change"),
        "rel_after": F.try_divide("step_after", "roll_change")}).drop("_rd", "_rc")


def _acting_rules(sensor: str) -> list[tuple]:
    """The ratio rules that can matter: a rule that resets the flag overrides all before it."""
    rules = SPIKE_RATIO_RULES[sensor]
    last = max(i for i, r in enumerate(rules) if r[4])
    return rules[last:]


def spike_flags(features: DataFrame) -> DataFrame:
    """Flag 0 or 1 by the sensor's rules in order; an unknown test makes the flag unknown.

    Every test is a column first, so the chain of choices stays small compiled code.
    """
    def beyond(c: str, bound):
        return F.lit(True) if bound is None else (F.col(c) > bound if bound > 0 else F.col(c) < bound)

    def ratio_test(rule) -> Column:
        diff, change, before, after, _ = rule
        return ((F.col("rel_diff") > diff) & (F.col("rel_change") > change)
                & beyond("rel_before", before) & beyond("rel_after", after))

    def by_sensor(make) -> Column:
        out = F.lit(None)
        for s in SENSORS:
            out = F.when(F.col("sensor") == s, make(s)).otherwise(out)
        return out

    rules = {s: _acting_rules(s) for s in SENSORS}
    count = max(len(r) for r in rules.values())
    limit = by_sensor(lambda s: F.lit(SPIKE_STEP_LIMIT[s]))
    tests = {f"_t{i}": by_sensor(lambda s, i=i: ratio_test(rules[s][i]) if i < len(rules[s]) else F.lit(False)) for i in range(count)}
    tests |= {"_up": (F.col("step_before") > limit) & (F.col("step_after") > limit),
              "_down": (F.col("step_before") < -limit) & (F.col("step_after") < -limit)}
    flag = F.lit(0)
    for name in tests:
        flag = if_known(F.col(name), F.lit(1), flag)
    flag = if_known(F.col("diff") < SPIKE_QUIET, F.lit(0), flag)
    flag = if_known((F.col("diff") > SPIKE_HUGE) | (F.col("change") > SPIKE_HUGE), F.lit(1), flag)
    return features.withColumns(tests).withColumn("flag", flag).drop(*tests)


def dilate_flags(flagged: DataFrame) -> DataFrame:
    """Spread a flag to the four readings after it and the one before; an unknown neighbour gives none."""
    w = W.partitionBy(*GROUP).orderBy("datetime")
    total = F.col("flag") + F.lead("flag", 1).over(w)
    for k in range(1, 5):
        total = total + F.lag("flag", k).over(w)
    # Not least(): it would skip the unknown.
    return flagged.withColumn("error", F.when(total > 1, F.lit(1)).otherwise(total))


def fill_spikes(flagged: DataFrame) -> DataFrame:
    """Replace a flagged reading by the peer's plus the local mean difference of unflagged readings."""
    w = W.partitionBy(*GROUP).orderBy("datetime")
    bad = F.coalesce(F.col("error") == 1, F.lit(False))
    df = flagged.withColumn("_me", F.when(~bad, F.col("me")))
    fill = roll(F.avg, "_me", 5, 5, w) + F.col("peer_value")
    return df.withColumn("corrected", F.when(bad, fill).otherwise(F.col("value"))).drop("_me")


def correct_spikes(own: DataFrame, every: DataFrame, network: str, n_blocks: int | None = None) -> DataFrame:
    """Corrected value per own sensor row, given all sites' readings.

    Groups too small to screen pass unchanged.
    """
    enough = supported(own, GROUP)
    peers = best_peer(enough, every, network, n_blocks)
    screened = fill_spikes(dilate_flags(spike_flags(spike_features(with_peer(enough, sensor_rows(every), peers)))))
    keys = [*GROUP, "datetime"]
    small = own.join(enough.select(*GROUP).distinct(), GROUP, "left_anti")
    return (screened.select(*keys, "corrected")
            .unionByName(small.select(*keys, F.col("value").alias("corrected"))))


def assemble_clean(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """Cleaned readings: moisture and code of the base row, corrected temperatures by stamp."""
    wide = corrected.groupBy("site", "datetime").agg(
        *[F.max(F.when(F.col("sensor") == s, F.col("corrected"))).alias(s) for s in SENSORS])
    return (base.select("site", "datetime", "moist", "probl")
            .join(wide, ["site", "datetime"], "left")
            .select("site", "datetime", "moist", "probl", *SENSORS))
