"""Missing days: matrices, forest completion, hold-out design, error tables."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from thawline.functions import if_known, strict_mean
from thawline.operators.daily import MEASURES, is_usable, usable
from thawline.operators.forest import BINS, BLOCK, BLOCK_ROWS, CELLS, Block, Spec, binned, by_forest, by_run, mixed, scored_from
from thawline.operators.tabular import distinct_values, error_metrics, hash_sample, lengthen, widen
from thawline.sources import cut_lineage


CELLS_A_TASK = 1 << 18  # cells of a matrix in rows that one task makes


def impute_matrix(days: DataFrame, measure: str, stage: str = "impute", sites: list[str] | None = None, wide: bool = True) -> DataFrame:
    """Dates x sites of the usable days of one measure: a column per site or, for any number of sites, (date, site, value)."""
    if not wide:
        kept = usable(days, measure, stage).select(F.lit(0).alias("run"), "date", F.coalesce(F.col("site").cast("string"), F.lit("null")).alias("site"), "value")
        return _every_cell(kept if sites is None else kept.filter(F.col("site").isin(sites))).select("date", "site", "value")
    return widen(usable(days, measure, stage), ["date"], "site", "value", sites)


@dataclass
class Matrix:
    """The sites of a run in order, their cuts, means, variances and known days, and the run's days."""
    sites: list[str]
    edges: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    known: np.ndarray
    days: tuple[int, int, int]  # first, last, number


def _matrices(cells: DataFrame) -> dict[int, Matrix]:
    """One row per run and site reaches the driver. A site without any known day has no prediction and no column."""
    shares = [i / BINS for i in range(1, BINS)]
    stats = cells.groupBy("run", "site").agg(F.avg("value").alias("m"), F.variance("value").alias("v"), F.count("value").alias("n"),
                                             F.percentile_approx("value", shares, 10_000).alias("q")).filter("n > 0")
    days = {r.run: (r.a, r.b, r.n) for r in cells.groupBy("run").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count_distinct("day").alias("n")).collect()}
    by: dict[int, list] = {}
    for r in stats.collect():
        by.setdefault(r.run, []).append(r)
    out = {}
    for run, rows in by.items():
        rows.sort(key=lambda r: r.site)
        first, last, _ = days[run]
        edges = [np.unique(r.q) for r in rows]
        edges += [np.unique(np.linspace(first, last, BINS + 1)[1:-1]), np.linspace(1, 366, BINS + 1)[1:-1]]
        out[run] = Matrix([r.site for r in rows], edges, np.array([r.m for r in rows]), np.array([r.v if r.v is not None else np.nan for r in rows]),
                          np.array([r.n for r in rows]), days[run])
    return out


def _predictors(filled: np.ndarray, days: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    dates = days.astype("datetime64[D]")
    of_year = (dates - dates.astype("datetime64[Y]")).astype(int) + 1
    return binned(np.column_stack([filled, days, of_year]), edges)


def _blocks(cells: DataFrame, matrices: dict[int, Matrix], seeds: dict[int, int], span: int) -> DataFrame:
    """Blocks of `span` days: all sites' known values as responses, all sites' filled values, binned, as predictors."""
    place = {run: {s: i for i, s in enumerate(m.sites)} for run, m in matrices.items()}
    rows = cells.filter(F.col("run").isin(list(matrices))).withColumn("part", F.floor(F.col("day") / span))

    def pack(key, table):
        run = key[0].as_py()
        m = matrices[run]
        days, row = np.unique(table["day"].to_numpy(), return_inverse=True)
        col = np.array([place[run].get(s, -1) for s in table["site"].to_pylist()])
        value = table["value"].to_numpy(zero_copy_only=False).astype(float)
        y = np.full((len(days), len(m.sites)), np.nan)
        good = (col >= 0) & ~np.isnan(value)
        y[row[good], col[good]] = value[good]
        filled = np.where(np.isnan(y), m.mean, y)
        keys = mixed(days.astype(np.int64).view(np.uint64) + np.uint64(seeds[run] << 24))
        folds = (keys >> np.uint64(40)).astype(np.int64) % 10
        block = Block(run, _predictors(filled, days, m.edges), y, folds.astype(np.uint8), keys, days.astype("<i4").tobytes() + filled.tobytes())
        return pa.Table.from_batches([block.batch().append_column("part", pa.array([_part(block, span)], pa.int32()))])

    return rows.groupBy("run", "part").applyInArrow(pack, f"{BLOCK}, part int")


def _opened(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(days, filled values) of a block."""
    n = len(block.keys)
    return np.frombuffer(block.more, "<i4", n), np.frombuffer(block.more, np.float64, offset=4 * n).reshape(block.y.shape)


def _part(block: Block, span: int) -> int:
    """Which block of its run it is, also where days are unknown."""
    return int(_opened(block)[0][0]) // span


def _guesses(state: DataFrame, folder: str, specs: Specs, depth: int, span: int) -> DataFrame:
    """(run, part, target, p): new values of the unknown cells of a site in a block; a forest ends in the task that grew it."""
    def use(k, spec, parts, _):
        for part, _, p in parts:
            yield pa.record_batch({"run": pa.array([spec.run], pa.int32()), "part": pa.array([part], pa.int32()),
                                   "target": pa.array([spec.target], pa.int32()), "p": pa.array([p.tobytes()])})

    gaps = lambda spec, block: np.flatnonzero(np.isnan(block.y[:, spec.target]))
    return by_forest(state.sparkSession, folder, len(specs), specs.__getitem__, depth, gaps, use, "run int, part int, target int, p binary",
                     lambda block: _part(block, span))


def _swept(state: DataFrame, folder: str, specs: Specs, matrices: dict[int, Matrix], depth: int, span: int) -> DataFrame:
    """The blocks with unknown cells predicted anew, and how far they moved."""
    def merge(key, blocks, guesses):
        block = Block.of(blocks.to_batches()[0], 0)
        days, old = _opened(block)
        new = old.copy()
        for target, p in zip(guesses["target"].to_pylist(), guesses["p"].to_pylist()):
            new[np.isnan(block.y[:, target]), target] = np.frombuffer(p)
        moved = size = 0.0
        for target in specs.targets(block.run):
            moved += ((new[:, target] - old[:, target]) ** 2).sum()
            size += (new[:, target] ** 2).sum()
        block.x, block.more = _predictors(new, days, matrices[block.run].edges), days.tobytes() + new.tobytes()
        out = block.batch().append_column("part", pa.array([key[1].as_py()], pa.int32()))
        return pa.Table.from_batches([out.append_column("moved", pa.array([moved])).append_column("size", pa.array([size]))])

    guesses = _guesses(state, folder, specs, depth, span)
    return state.groupBy("run", "part").cogroup(guesses.groupBy("run", "part")).applyInArrow(merge, f"{BLOCK}, part int, moved double, size double")


class Specs:
    """The forests of a sweep, one for each site of `runs` with unknown days, made when they are asked for."""

    def __init__(self, runs: list[int], matrices: dict[int, Matrix], trees: int, seeds: dict[int, int], fold: int = -1):
        self.gappy = {run: np.flatnonzero(matrices[run].known < matrices[run].days[2]) for run in runs}
        self.sites = {run: len(matrices[run].sites) for run in runs}
        self.runs, self.ends = list(runs), np.cumsum([len(self.gappy[run]) for run in runs])
        self.trees, self.seeds, self.fold = trees, {run: seeds[run] for run in runs}, fold

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, k: int) -> Spec:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, "right"))
        run = self.runs[at]
        i = int(self.gappy[run][k - (self.ends[at - 1] if at else 0)])
        p = self.sites[run] + 2
        return Spec(p, round((p - 1) ** 0.5), 5, self.trees, self.seeds[run] + i, run, i, 0, self.fold, i)

    def targets(self, run: int) -> list[int]:
        return self.gappy[run].tolist()


def complete_cells(cells: DataFrame, trees: int = 100, max_sweeps: int = 10, depth: int = 12, seeds: dict[int, int] | None = None,
                   report_error: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Complete the dates x sites matrix of every run: (run, date, site, value); all runs and sites in one pass per sweep.

    `cells` has run, date, site, value (null: unknown). Unknown cells start at the site's mean. A sweep fits every
    site on its known days from the other sites, the date and the day of year, all from the sweep before. A run stops when
    its change grows, with the state before, or after `max_sweeps`. The error table (run, site, nrmse) holds the normalised
    error on the tenth of the known days that a site's forest did not see.
    """
    spark = cells.sparkSession
    kind = cells.schema["site"].dataType.simpleString()
    cells = cut_lineage(cells.select("run", F.unix_date("date").alias("day"), "site", F.col("value").cast("double").alias("value")))
    matrices = _matrices(cells)
    no_error = spark.createDataFrame([], f"run int, site {kind}, nrmse double")
    if not matrices:
        return spark.createDataFrame([], f"run int, date date, site {kind}, value double"), no_error if report_error else None
    seeds = {run: (seeds or {}).get(run, 1) for run in matrices}
    span = max(64, min(BLOCK_ROWS, CELLS // max(len(m.sites) for m in matrices.values())))

    def stored(blocks):
        folder = by_run(blocks)
        return folder, spark.read.parquet(folder)

    folder, state = stored(_blocks(cells, matrices, seeds, span))
    gappy = [run for run, m in matrices.items() if (m.known < m.days[2]).any()]
    active, least = list(gappy), {}
    done = [state.filter(~F.col("run").isin(active))] if len(active) < len(matrices) else []
    for sweep in range(max_sweeps):
        if not active:
            break
        specs = Specs(active, matrices, trees, {run: seeds[run] + 1000 * sweep for run in active})
        folder, new = stored(_swept(state, folder, specs, matrices, depth, span))
        change = {r.run: r.c for r in new.groupBy("run").agg(F.try_divide(F.sum("moved"), F.sum("size")).alias("c")).collect()}
        grew = [run for run in active if run in least and (change[run] or 0.0) > least[run]]
        if grew:
            done.append(state.filter(F.col("run").isin(grew)))
        active = [run for run in active if run not in grew]
        least |= {run: change[run] or 0.0 for run in active}
        state = new.filter(F.col("run").isin(active)).drop("moved", "size") if grew else new.drop("moved", "size")
    if active:
        done.append(state.filter(F.col("run").isin(active)))
    final = reduce(DataFrame.unionByName, done)

    def told(key, table):
        block = Block.of(table.to_batches()[0], 0)
        days, filled = _opened(block)
        sites = pa.array(matrices[block.run].sites)
        n = len(days) * len(sites)
        return pa.table({"run": pa.array(np.full(n, block.run), pa.int32()), "day": pa.array(np.repeat(days, len(sites)), pa.int32()),
                         "site": sites.take(pa.array(np.tile(np.arange(len(sites)), len(days)))), "value": pa.array(filled.ravel())})

    filled = final.groupBy("run", "part").applyInArrow(told, f"run int, day int, site {kind}, value double").select(
        "run", F.date_from_unix_date("day").alias("date"), "site", "value")
    if not report_error:
        return filled, None
    specs = list(Specs(gappy, matrices, trees, {run: seeds[run] + 1000 * max_sweeps for run in gappy}, 0))
    if not specs:
        return filled, no_error
    found = scored_from(spark, by_run(final.filter(F.col("run").isin(gappy))), specs, depth)
    rows = []
    for s, r in zip(specs, found):
        v = matrices[s.run].spread[s.target]
        rows.append((s.run, matrices[s.run].sites[s.target], r["RMSE"] / float(v) ** 0.5 if r["RMSE"] is not None and v > 0 else None))
    return filled, spark.createDataFrame(rows, f"run int, site {kind}, nrmse double")


def impute_forest(wide: DataFrame, trees: int = 100, max_sweeps: int = 10, depth: int = 12, seed: int = 1,
                  report_error: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """`complete_cells` for one matrix of dates x sites: (matrix, error by site)."""
    sites = [c for c in wide.columns if c != "date"]
    filled, error = complete_cells(lengthen(wide, ["date"], sites, "site", "value").withColumn("run", F.lit(0)), trees, max_sweeps, depth, {0: seed}, report_error)
    matrix = widen(filled, ["date"], "site", "value", None)
    kept = set(matrix.columns)
    return matrix.select("date", *[F.col(f"`{s}`") for s in sites if s in kept]), error.select("site", "nrmse") if error is not None and error.take(1) else None


def combine_imputed(matrices: dict[str, DataFrame]) -> DataFrame:
    """One row per site and date with all measures; moisture is unknown below 1 degree of mean T1."""
    rows = [lengthen(m, ["date"], None, "site", "value").withColumn("measure", F.lit(name)) for name, m in matrices.items()]
    wide = widen(reduce(DataFrame.unionByName, rows), ["date", "site"], "measure", "value", list(matrices))
    if "moist_mean" in matrices:
        wide = wide.withColumnRenamed("moist_mean", "moist").withColumn(
            "moist", if_known(F.col("T1_mean") < 1, F.lit(None).cast("double"), F.col("moist")))
    return wide


def combine_cells(cells: DataFrame, measures: list[str]) -> DataFrame:
    """`combine_imputed` of cells (run: place in `measures`, date, site, value) without a matrix: one pivot over the measures."""
    wide = cells.groupBy("date", "site").pivot("run", list(range(len(measures)))).agg(F.first("value", ignorenulls=True))
    wide = wide.select("date", "site", *[F.col(str(i)).alias(m) for i, m in enumerate(measures)])
    if "moist_mean" in measures:
        wide = wide.withColumnRenamed("moist_mean", "moist").withColumn(
            "moist", if_known(F.col("T1_mean") < 1, F.lit(None).cast("double"), F.col("moist")))
    return wide


def measured_cells(days: DataFrame, measures: list[str]) -> DataFrame:
    """(run, date, site, value) of the usable days of each measure, all in one pass over `days`; `run` is its place."""
    values = F.array(*[F.when(is_usable(m), F.struct(F.col(m).cast("double").alias("value"))) for m in measures])
    return (days.select("date", "site", F.posexplode(values).alias("run", "_v")).filter(F.col("_v").isNotNull())
            .select("run", "date", "site", F.col("_v.value").alias("value")))


def dense_cells(cells: DataFrame) -> DataFrame:
    """Every date of a run with every site of the run; an absent cell is unknown, and so is one without a date or a site."""
    named = F.col("date").isNotNull() & F.col("site").isNotNull()
    return _every_cell(cells.select("run", "date", "site", F.when(named, F.col("value")).alias("value")))


def _every_cell(cells: DataFrame) -> DataFrame:
    """Every date of a run with every site of the run, one row each.

    A site meets its run's dates, a calendar, as one array, so no task makes all cells of a run; the number of tasks
    grows with the cells. Rows lie by date and site: what groups by them needs no further exchange.
    """
    cells = cut_lineage(cells)
    dates = cut_lineage(cells.groupBy("run").agg(F.collect_set(F.struct("date")).alias("_dates")))
    sites = cut_lineage(cells.select("run", "site").distinct())
    n = sites.join(F.broadcast(dates), "run").agg(F.sum(F.size("_dates"))).first()[0] or 0
    parts = max(1, -(-n // CELLS_A_TASK))
    keys = sites.repartition(parts, "run", "site").join(F.broadcast(dates), "run").select("run", "site", F.explode("_dates").alias("_d"))
    rows = keys.select("run", F.col("_d.date").alias("date"), "site", F.lit(None).cast(cells.schema["value"].dataType).alias("value"))
    return (rows.unionByName(cells).repartition(parts, "date", "site").groupBy("run", "date", "site")
            .agg(F.first("value", ignorenulls=True).alias("value")))


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"month": F.month("date"), "year": F.year("date")})


def holdout(days: DataFrame, measure: str, n: int = 20, seed: int = 1, stage: str = "impute",
            gate_season: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds n whole site-months chosen by hash, train the rest."""
    keys = ["site", "year", "month"]
    rows = _with_month(usable(days, measure, stage, gate_season))
    months = rows.groupBy(*keys).agg(strict_mean("value").alias("_m")).filter(F.col("_m").isNotNull()).select(*keys)
    chosen = hash_sample(months, keys, n, seed)
    return rows.join(chosen, keys, "left_anti"), rows.join(chosen, keys, "left_semi")


def stack_errors(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack (date, site, month, year, imp, ori) of several measures with their error."""
    rows = [df.withColumn("var", F.lit("moist" if m == "moist_mean" else m)) for m, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("dif", F.col("ori") - F.col("imp"))


def impute_cv(days: DataFrame, measures: tuple[str, ...] = tuple(MEASURES), rounds: int = 10, n: int = 20, **forest) -> DataFrame:
    """Hide n site-months per round, impute them, and return predictions beside the truth; all measures and rounds at once.

    The hidden months of a round are those of `holdout` with the round as seed.
    """
    keys = ["site", "year", "month"]
    rows = reduce(DataFrame.unionByName, [_with_month(usable(days, m)).select("date", "value", *keys, F.lit(i).alias("m")) for i, m in enumerate(measures)])
    rows = cut_lineage(rows)
    every = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r")
    months = rows.groupBy("m", *keys).agg(strict_mean("value").alias("_v")).filter(F.col("_v").isNotNull()).select("m", *keys, every)
    order = W.partitionBy("m", "r").orderBy(F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col("r").cast("string"))), *keys)
    hidden = months.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).select("m", "r", *keys, F.lit(True).alias("hidden"))
    dealt = rows.select("*", every).join(hidden, ["m", "r", *keys], "left").withColumn("run", F.col("m") * rounds + F.col("r"))
    dealt = cut_lineage(dealt)
    train = dealt.filter(F.col("hidden").isNull()).select("run", "date", "site", "value")
    seeds = {m * rounds + r: r for m in range(len(measures)) for r in range(rounds)}
    guess, _ = complete_cells(train, seeds=seeds, **forest)
    found = (dealt.filter("hidden").withColumnRenamed("value", "ori").join(guess.withColumnRenamed("value", "imp"), ["run", "date", "site"])
             .filter(F.col("ori").isNotNull() & F.col("imp").isNotNull()))
    name = F.element_at(F.array(*[F.lit("moist" if m == "moist_mean" else m) for m in measures]), F.col("m") + 1)
    return found.select("date", "site", "month", "year", "imp", "ori", name.alias("var"), (F.col("ori") - F.col("imp")).alias("dif"))


def imputation_report(errors: DataFrame) -> dict[str, DataFrame]:
    """Errors by variable, by variable after averaging site-months, by month without moisture."""
    cell = ["site", "month", "year", "var"]
    return {"by_variable": error_metrics(errors, ["var"]),
            "by_variable_monthly": error_metrics(errors, ["var"], cell),
            "by_month": error_metrics(errors.filter(F.col("var") != "moist"), ["month"], cell)}
