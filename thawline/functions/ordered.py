"""Ordered-row access on long series without one task per series.

A window over a whole site would put every reading of that site in one task.
Instead a series is cut into calendar pieces and the few rows just outside each
piece are copied in, so that lag, lead and short frames are exact while the
largest window partition is one piece (a logger month holds at most 44,640
one-minute stamps after de-duplication).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HALO = "_halo"


def with_halo(df: DataFrame, keys: list[str], order: list[str], piece: str,
              back: int = 1, ahead: int = 1, carry: list[str] | None = None) -> DataFrame:
    """Add to each (keys, piece) the `back` rows before and `ahead` rows after it.

    Copied rows carry ``_halo = true`` and the piece they were copied into, and hold
    the `carry` columns only (all by default). `piece` must grow with `order`. A
    piece shorter than the halo passes on rows of pieces further away.

    Only the piece edges are copied: they are reduced per piece before the shuffle,
    and a series' list of edges has a few rows per piece.
    """
    kept = [c for c in df.columns if c not in keys and c != piece] if carry is None else [
        *order, *[c for c in carry if c not in order]]
    out = df.withColumn(HALO, F.lit(False))
    parts = []
    if back == ahead == 1 or {back, ahead} == {0, 1}:
        # One row on a side: extremes by hash aggregate, no row numbers needed.
        rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
        ends = df.groupBy(*keys, piece).agg(
            *[F.max_by(c, rank).alias(f"_l_{c}") for c in kept if back],
            *[F.min_by(c, rank).alias(f"_f_{c}") for c in kept if ahead])
        w = W.partitionBy(*keys).orderBy(piece)
        if back:
            parts.append(F.lag(F.struct(*[F.col(f"_l_{c}").alias(c) for c in kept])).over(w))
        if ahead:
            parts.append(F.lead(F.struct(*[F.col(f"_f_{c}").alias(c) for c in kept])).over(w))
        copied = ends.select(*keys, piece, F.array(*parts).alias("_e"))
    else:
        row = F.struct(*order, *[c for c in kept if c not in order])
        copied = None
        for n, forward in ((back, True), (ahead, False)):
            if not n:
                continue
            end_first = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
            near = W.partitionBy(*keys, piece).orderBy(*end_first)
            edge = (df.select(*keys, piece, *kept).withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= n)
                    .groupBy(*keys, piece).agg(F.collect_list(row).alias("_e")))
            frame = W.partitionBy(*keys).orderBy(piece).rowsBetween(*((-n, -1) if forward else (1, n)))
            pool = F.array_sort(F.flatten(F.collect_list("_e").over(frame)))
            wanted = F.slice(pool, F.greatest(F.size(pool) - n + 1, F.lit(1)), n) if forward else F.slice(pool, 1, n)
            edge = edge.select(*keys, piece, wanted.alias("_e"))
            copied = edge if copied is None else copied.unionByName(edge)
    rows = (copied.select(*keys, piece, F.explode("_e").alias("_e")).filter(F.col("_e").isNotNull())
            .select(*keys, piece, *[F.col(f"_e.{c}").alias(c) for c in kept], F.lit(True).alias(HALO)))
    return out.unionByName(rows, allowMissingColumns=True)


def home(df: DataFrame) -> DataFrame:
    """Drop the copied rows again."""
    return df.filter(~F.col(HALO)).drop(HALO)


def step(c: str, k: int, w) -> Column:
    """Difference to the row k before (k > 0) or -k after (k < 0)."""
    other = F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    return F.col(c) - other


def roll(agg, c, back: int, ahead: int, w) -> Column:
    return agg(c).over(w.rowsBetween(-back, ahead))


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep, per key, the row with the greatest `order`.

    Written as an aggregate and not a row number, so that copies of one key are
    reduced before the shuffle. `order` must be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    return (df.groupBy(*keys)
            .agg(*[F.max_by(c, order).alias(c) for c in rest], F.max(order).alias(order))
            .select(*df.columns))

