"""Near-duplicate vectors: a small-world graph per shard, every vector asked of every shard, links by exact cosine.

Equal vectors are one. Shards are drawn by hash and have at most about SHARD_ROWS vectors. A task takes one shard and
one block of queries, and audits itself: for a sample of its queries it compares all vectors of the shard. Both the
links of the sample and the queries of the sample with all their links must reach the wanted recall, so that a large
group cannot hide what small ones lack. Tasks that fall short run again with wider beams; when the beam is as wide as
the shard, the block is compared with every vector of it, which is exact.
"""
from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import new_folder
from .components import components
from .hnsw import Graph, build, within
from .store import load_arrays, save_arrays

LEAST_SHARDS = 4  # shards even of a small table, so that executors share the work
SHARD_ROWS = 1 << 16
TASKS_A_SHARD = 4  # Spark tasks grow with the shards; each asks several shards one after the other
WIDTH = 32
SLACK = 0.05
AUDIT = 256  # audited queries of a task, and as many of those that found a link
RECALL = 0.98


def usable() -> Column:
    """Not null, not zero, all components finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, safe for very large and very small components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = parent[x]


def every_pair(queries: np.ndarray, exact: np.ndarray, least: float):
    """What `within` yields, from comparing all queries with all vectors."""
    for a in range(0, len(queries), 64):
        r, v = np.nonzero(queries[a:a + 64] @ exact.T >= least - 1e-9)
        yield a, min(64, len(queries) - a), r, v


def audited(truth: np.ndarray, hits: np.ndarray, recall: float = RECALL) -> list[tuple[int, int]]:
    """(wanted, reached) by links and by queries, of the true and the found links of each audited query."""
    some = truth > 0
    whole = hits[some] >= recall * truth[some]
    return [(int(truth.sum()), int(hits.sum())), (int(some.sum()), int(whole.sum()))]


def _ask(folder: str, shard: str, block: str, least: float, width: int, slack: float, recall: float = RECALL):
    """(names, links per query, both ends of spanning links, audits) of one block in one shard."""
    z, mine = load_arrays(folder, shard), load_arrays(folder, block)
    graph, keys, exact, copies = Graph.of(z), z["keys"], z["exact"], z["copies"]
    queries, names = mine["exact"], mine["keys"]
    links = np.zeros(len(queries), np.int64)
    parent = np.arange(len(names) + len(keys))  # queries, then vectors of the shard
    found = []
    whole = width >= len(keys)
    for a, n, r, v in every_pair(queries, exact, least) if whole else within(graph, mine["vectors"], width, least, slack):
        for s in range(0, len(r), 1 << 18):  # exact cosines in bounded pieces
            q, w = a + r[s:s + (1 << 18)], v[s:s + (1 << 18)]
            good = (np.einsum("ed,ed->e", queries[q], exact[w]) >= least) & (names[q] != keys[w])
            q, w = q[good], w[good]
            np.add.at(links, q, copies[w])
            found.append(np.bincount(q, minlength=len(queries)))
            own, first = np.unique(q, return_index=True)
            for i, x in enumerate(own):
                stop = first[i + 1] if i + 1 < len(own) else len(q)
                roots = np.unique(_find(parent, np.concatenate([[x], len(names) + w[first[i]:stop]])))
                parent[roots] = roots[0]
    hits = np.sum(found, axis=0) if found else np.zeros(len(queries), np.int64)
    some = np.flatnonzero(hits)
    spread = lambda n: np.linspace(0, n - 1, min(n, AUDIT)).astype(int)  # noqa: E731  from all parts of the block
    audit = np.unique(np.concatenate([spread(len(queries)), some[spread(len(some))]]))
    truth = np.zeros(len(audit), np.int64)
    for s in range(0, 0 if whole else len(audit), 64):
        rows = audit[s:s + 64]
        close = queries[rows] @ exact.T >= least + 1e-12  # rounding at the border is no miss
        truth[s:s + 64] = (close & (names[rows][:, None] != keys[None, :])).sum(1)
    every = np.concatenate([names, keys])
    roots = _find(parent, np.arange(len(parent)))
    linked = np.flatnonzero(roots != np.arange(len(parent)))
    return names, links, every[linked], every[roots[linked]], audited(truth, np.minimum(hits[audit], truth), recall)


def near_duplicates(vectors: DataFrame, least: float = 0.9, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").withColumn("ok", usable() & F.col("vec_id").isNotNull())
    good = rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sizes = {r.d: r.n for r in good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = {d: max(LEAST_SHARDS, -(-n // shard_rows)) for d, n in sizes.items()}
    folder = new_folder(spark, "vector-graphs")

    def index(key, table):
        d, s = (x.as_py() for x in key)
        table = table.sort_by("rep")
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        exact = unit(flat.reshape(len(table), d))
        graph = build(exact.astype(np.float32))
        save_arrays(folder, f"{d}-{s}", TaskContext.get().taskAttemptId(), exact=exact, keys=table["rep"].to_numpy(),
                    copies=table["copies"].to_numpy(), **graph.arrays())
        return pa.table({"d": pa.array([d], pa.int32()), "s": pa.array([s], pa.int32())})

    made = []
    if shards:
        of = F.create_map(*[x for d, s in shards.items() for x in (F.lit(d), F.lit(s))])
        dim = F.size("embedding").alias("d")
        made = (good.select("*", dim).withColumn("s", F.pmod(F.xxhash64("rep"), of[F.col("d")]).cast("int"))
                .groupBy("d", "s").applyInArrow(index, "d int, s int").collect())
    names = {}
    for r in made:
        names.setdefault(r.d, []).append(r.s)
    layout, total = [], 0  # (first task, dimension, its shards): a task is a shard and a block, by number
    for d, own in sorted(names.items()):
        layout.append((total, d, sorted(own)))
        total += len(own) ** 2
    parts = sum(len(own) for _, _, own in layout) * TASKS_A_SHARD

    def pair(task: int) -> tuple[str, str]:
        first, d, own = layout[bisect_right(layout, task, key=lambda x: x[0]) - 1]
        i, j = divmod(task - first, len(own))
        return f"{d}-{own[i]}", f"{d}-{own[j]}"

    def ask(tasks, width, slack):
        def run(batches):
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    reps, links, a, b, audits = _ask(folder, *pair(i), least, width, slack, recall)
                    parts = [(reps, links, np.full(len(reps), -1), 0, 0), (a, np.zeros(len(a), np.int64), b, 0, 0)]
                    parts += [(np.array([-1]), np.array([0]), np.array([-1]), truth, found) for truth, found in audits]
                    for kind, (x, n, y, t, f) in enumerate(parts):
                        m = len(x)
                        yield pa.record_batch({
                            "task": pa.array(np.full(m, i), pa.int64()), "kind": pa.array(np.full(m, kind), pa.int32()),
                            "rep": pa.array(x, pa.int64()), "links": pa.array(n, pa.int64()), "root": pa.array(y, pa.int64()),
                            "truth": pa.array(np.full(m, t), pa.int64()), "found": pa.array(np.full(m, f), pa.int64())})
        path = new_folder(spark, "vector-links")
        (tasks.mapInArrow(run, "task long, kind int, rep long, links long, root long, truth long, found long").write.parquet(path))
        return spark.read.parquet(path)

    passed, width, slack = [], WIDTH, SLACK
    todo = spark.range(0, total, 1, max(1, min(total, parts))) if total else None
    while todo is not None:
        out = ask(todo, width, slack)
        failed = out.filter("kind >= 2").filter(F.col("found") < recall * F.col("truth")).select("task").distinct()
        passed.append(out.join(failed, "task", "left_anti"))
        again = failed.count()
        todo = failed.select(F.col("task").alias("id")).repartition(min(again, parts), "id") if again else None
        width, slack = 2 * width, slack + 0.05
    if not passed:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    result = passed[0]
    for x in passed[1:]:
        result = result.unionByName(x)
    counts = result.filter("kind = 0").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(result.filter("kind = 1").select("rep", "root"), "rep", "root")
    described = (good.join(counts, "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("embedding", (F.col("links") + F.col("copies") - 1).alias("links"), F.coalesce("label", "rep").alias("component")))
    return (rows.withColumn("embedding", F.when(F.col("ok"), F.col("embedding"))).join(described, "embedding", "left")
            .withColumn("component_id", F.coalesce("component", "vec_id"))
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def op2_vector_near_duplicates(vectors: DataFrame) -> DataFrame:
    """Links, component and keeper of every vector, whatever its label.

    A row without an id is a row of its own that links with nothing. A vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
    different lengths do not link. Equal vectors link with each other. No rows give no rows.
    """
    return near_duplicates(vectors)
