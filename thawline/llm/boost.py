"""Small gradient-boosted trees on labelled rows of any number, grown from histograms of tasks.

Rows are binned once and equal ones are counted. A level of a tree is one job: each task adds up the gradients of its
rows by open node, feature and bin, and the driver adds up these tables of fixed size. Gradients are counted in whole units, so the
trees depend neither on the order of rows nor on how they are dealt.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropping_exchanges, giving_back, stored

BINS = 16
UNIT = 1 << 24  # gradients of one row are whole multiples of 1 / UNIT
TASK_ROWS = 1 << 17  # binned rows of a task, more where that makes over TASKS
TASKS = 256  # so many tables of sums come to the driver at most
KEPT = 8  # rounds until the rows are written with their margins
PIECE = 4096  # rows that are scored at once


class BoostedTrees:
    """Logistic boosting with depth-limited regression trees on binned features.

    A tree is a heap: the children of node i are 2 i + 1 (bins up to `cut`) and 2 i + 2; `feature` is -1 at a leaf.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.edges = 0.0, np.empty((0, BINS - 1))
        nodes = (2 << depth) - 1
        self.feature, self.cut, self.value = np.full((0, nodes), -1), np.zeros((0, nodes), int), np.zeros((0, nodes))

    def fit(self, rows: DataFrame, width: int) -> "BoostedTrees":
        """`rows` (x array<int> of `width` features, y boolean, n long): each stands for `n` equal ones.

        Bins are exact quantiles over all rows; counting them holds the distinct values of a feature, not its rows.
        """
        shares = [i / BINS for i in range(1, BINS)]
        hits = F.sum(F.when(F.col("y"), F.col("n")).otherwise(0))
        with dropping_exchanges(rows.sparkSession):
            first = rows.agg(F.sum("n").alias("n"), hits.alias("hits"),
                             *[F.percentile(F.col("x")[j], shares, F.col("n")).alias(f"q{j}") for j in range(width)]).first()
        share = np.clip(first["hits"] / first["n"], 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = np.full((width, BINS - 1), np.inf)
        for j in range(width):
            e = np.unique(first[f"q{j}"])
            self.edges[j, :len(e)] = e

        def binned(batches):
            for batch in batches:
                b = self.bins(batch.column("x").flatten().to_numpy().reshape(-1, width))
                yield pa.record_batch({"b": pa.array([r.tobytes() for r in b], pa.binary()), "y": batch.column("y"), "n": batch.column("n")})

        counted = rows.mapInArrow(binned, "b binary, y boolean, n long").groupBy("b", "y").agg(F.sum("n").alias("n"))
        work = stored(counted.withColumn("margin", F.lit(self.base)), "tree-rows")
        tasks = min(TASKS, -(-work.count() // TASK_ROWS))
        for done in range(self.rounds):
            if done and done % KEPT == 0:
                work = stored(work.coalesce(tasks).mapInArrow(self._with_margins(done - KEPT, width), work.schema), "tree-rows")
            self._grow(work.coalesce(tasks), done, width)
        return self

    def _grow(self, work: DataFrame, done: int, width: int) -> None:
        """Appends the tree that follows the first `done`; the rows' margins hold those before the last multiple of KEPT."""
        add = lambda a, fill: np.vstack([a, np.full((1, a.shape[1]), fill, a.dtype)])
        self.feature, self.cut, self.value = add(self.feature, -1), add(self.cut, 0), add(self.value, 0)
        for level in range(self.depth):
            first, open_nodes = (1 << level) - 1, 1 << level
            if level and (self.feature[done, (first - 1) // 2:first] < 0).all():
                break
            got = work.mapInArrow(self._sums(done, level, width), "cell int, g long, h long, n long").toArrow()
            table = np.zeros((3, open_nodes * width * BINS), np.int64)
            for t, c in zip(table, "ghn"):
                np.add.at(t, got["cell"].to_numpy(), got[c].to_numpy())
            table = table / np.array([[UNIT], [UNIT], [1]])
            for node, (g, h, n) in enumerate(table.reshape(3, open_nodes, width, BINS).swapaxes(0, 1), first):
                if n.any():
                    self._split(done, node, g, h, n)

    def _split(self, done: int, node: int, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        """Splits a node at the best bin of (feature, bin) sums, if one gains."""
        all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()
        self.value[done, node] = all_g / (all_h + 1)
        if all_n < 2 * self.least:
            return
        gl, hl, nl = (a.cumsum(1)[:, :-1] for a in (g, h, n))
        gain = gl ** 2 / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) - all_g ** 2 / (all_h + 1)
        gain[(nl < self.least) | (all_n - nl < self.least)] = 0
        j, i = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[j, i] > 1e-6:
            self.feature[done, node], self.cut[done, node] = j, i
            self.value[done, 2 * node + 1] = gl[j, i] / (hl[j, i] + 1)
            self.value[done, 2 * node + 2] = (all_g - gl[j, i]) / (all_h - hl[j, i] + 1)

    def _sums(self, done: int, level: int, width: int):
        """The task that adds up gradients by open node of the tree after the first `done`, feature and bin."""
        size, low = (1 << level) * width * BINS, (1 << level) - 1

        def run(batches):
            total = np.zeros((3, size), np.int64)
            for batch in batches:
                b, n = _matrix(batch, width), batch.column("n").to_numpy()
                margin = batch.column("margin").to_numpy() + self._added(b, done - done % KEPT, done)
                p, y = 1 / (1 + np.exp(-margin)), batch.column("y").to_numpy(zero_copy_only=False)
                node = self._nodes(b, done, done + 1, level)[:, 0] - low
                own = node >= 0
                cell = ((node[own, None] * width + np.arange(width)) * BINS + b[own]).ravel()
                for t, c in zip(total, (np.rint((y - p) * UNIT) * n, np.rint((p * (1 - p) + 1e-6) * UNIT) * n, n)):
                    t += np.bincount(cell, np.repeat(c[own], width), size).astype(np.int64)
            cells = np.flatnonzero(total[2])
            yield pa.record_batch({"cell": pa.array(cells, pa.int32())} | {c: pa.array(t[cells], pa.int64()) for c, t in zip("ghn", total)})
        return giving_back(run)

    def _with_margins(self, done: int, width: int):
        """The task that adds the KEPT trees after the first `done` to the rows' margins."""
        def run(batches):
            for batch in batches:
                margin = batch.column("margin").to_numpy() + self._added(_matrix(batch, width), done, done + KEPT)
                yield pa.record_batch({c: batch.column(c) for c in ("b", "y", "n")} | {"margin": pa.array(margin)})
        return giving_back(run)

    def bins(self, x: np.ndarray) -> np.ndarray:
        pieces = [(self.edges < x[s:s + PIECE, :, None]).sum(2) for s in range(0, len(x), PIECE)]
        return np.concatenate(pieces or [np.empty((0, len(self.edges)))]).astype(np.uint8)

    def _nodes(self, bins: np.ndarray, a: int, b: int, depth: int) -> np.ndarray:
        """The node of each row in each of the trees a to b after `depth` steps."""
        tree, rows = np.arange(a, b), np.arange(len(bins))[:, None]
        at = np.zeros((len(bins), b - a), int)
        for _ in range(depth):
            f = self.feature[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, f] > self.cut[tree, at]))
        return at

    def _added(self, bins: np.ndarray, a: int, b: int) -> np.ndarray:
        """What the trees a to b add to the margin of each row."""
        out = np.zeros(len(bins))
        for s in range(0, len(bins), PIECE):
            at = self._nodes(bins[s:s + PIECE], a, b, self.depth)
            out[s:s + PIECE] = self.rate * self.value[np.arange(a, b), at].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.base - self._added(self.bins(x), 0, len(self.value))))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(-1, width)
