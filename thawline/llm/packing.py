"""Harmonic packing of token sequences.

Class k takes pieces of at most capacity // k ids and puts exactly k of them in a sequence. A document is cut into
full sequences; its rest is cut at the largest class size that fits, at most MOST_CUTS times, so that pieces fill
their class. Every piece gets its rank in its class from prefix sums over (class, partition) counts, and with it its
sequence; workers then fill their sequences alone. The last, incomplete sequence of each class (less than k pieces,
a fixed number in all) is packed anew, first fit by falling size.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import chunks, cut, text_of
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
MOST_CUTS = 3
SLACK = 0.02  # a rest that fills this much less than its class is not cut again


def classes(capacity: int) -> list[int]:
    """Pieces per sequence: every count to 16, then eight steps to each doubling."""
    out, step = list(range(1, 17)), 2
    while out[-1] < capacity:
        out += [m * step for m in range(9, 17)]
        step *= 2
    return [k for k in out if k <= capacity]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of `length` ids."""
    full, rest = divmod(length, capacity)
    out = [(capacity, 1)] * full
    ks = classes(capacity)
    for turn in range(MOST_CUTS):
        if not rest:
            break
        k = max(k for k in ks if rest <= capacity // k)
        size = capacity // k
        if turn == MOST_CUTS - 1 or rest >= (1 - SLACK) * size:
            out.append((rest, k))
            break
        k = min(k for k in ks if capacity // k <= rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, k for each piece of each document."""
    def run(batches):
        enc = encoder(path)
        plan = {n: cuts(n, capacity) for n in range(capacity)}
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in chunks(texts):
                ids, stops = enc.encode(texts[a:b])
                ids = np.insert(ids, stops[1:], end_id).astype("<u4")
                stops = stops + np.arange(len(stops))
                rows = []
                for i, (s, e) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())):
                    at, n = 0, e - s
                    for size, k in [(capacity, 1)] * (n // capacity) + plan[n % capacity]:
                        rows.append((a + i, at, size, zlib.crc32(ids[s + at:s + at + size].tobytes()), n, k))
                        at += size
                cols = list(zip(*rows))
                yield pa.record_batch({"doc_id": keys.take(pa.array(cols[0], pa.int64()))} | {
                    c: pa.array(v, pa.int64()) for c, v in zip(("start", "length", "ids_crc32", "doc_tokens", "k"), cols[1:])})

    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, k long")


def fill(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each size, first fit by falling size."""
    room, out = np.empty(0, np.int64), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = np.flatnonzero(room >= sizes[i])
        if len(fits) == 0:
            room = np.append(room, capacity)
            fits = [len(room) - 1]
        out[i] = (int(fits[0]), int(capacity - room[fits[0]]))
        room[fits[0]] -= sizes[i]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with length and class k) and their sequence_id and offset."""
    spark = pieces.sparkSession
    # Fixed rows: ranks are counted over the same partitions twice.
    rows = cut(pieces.withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))
    counts = rows.groupBy("_p", "k").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_p", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r.k: r.n for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row per class
    first, at = {}, 0
    for k in sorted(totals):
        first[k] = at
        at += totals[k] // k
    if not totals:
        return rows.drop("_m", "_p").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    lookup = lambda d: F.create_map(*[F.lit(int(x)).cast("long") for kv in sorted(d.items()) for x in kv])[F.col("k")]
    local = Window.partitionBy("_p", "k").orderBy("_m")
    ranked = (rows.join(bases, ["_p", "k"])
              .withColumn("_r", F.col("base") + F.row_number().over(local) - 1)
              .withColumn("_b", F.floor(F.col("_r") / F.col("k")))
              .withColumn("_whole", F.col("_b") < lookup({k: n // k for k, n in totals.items()})))
    inside = Window.partitionBy("k", "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranked.filter("_whole").withColumn("sequence_id", lookup(first) + F.col("_b"))
              .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))))
    # Less than k pieces of each class are left: a number fixed by the classes, whatever the input.
    left = ranked.filter(~F.col("_whole"))
    small = sorted((r.k, r._r, r.length) for r in left.select("k", "_r", "length").collect())
    spots = [(k, r, at + s, o) for (k, r, _), (s, o) in zip(small, fill([x[2] for x in small], capacity))]
    homes = spark.createDataFrame(spots, "k long, _r long, sequence_id long, offset long")
    columns = [*pieces.columns, "sequence_id", "offset"]
    return placed.select(*columns).unionByName(left.join(F.broadcast(homes), ["k", "_r"]).select(*columns))


def op5_harmonic_packing(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Null text is empty and has the end id alone. Repeated rows are documents of their own. No rows give no rows.
    """
    pieces = pieces_of(docs, path or vocabulary_path("word_bpe_49k.json"), end_id, capacity)
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
