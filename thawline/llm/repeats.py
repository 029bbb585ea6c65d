"""Removal of repeated passages: a difference-cover suffix order, distributed and cut off at the passage length.

Equal texts are one text, owned by the smallest id. Suffixes need an order only up to their first LENGTH bytes. Suffixes
at the positions of a difference cover modulo PERIOD are the sample: of any two equal passages some pair of positions,
equally far from their starts and by less than PERIOD, lies in the sample. A sampled suffix is named by its first
SAMPLED bytes, as triples of 8-byte symbols whose names form triples again. Sorting the sampled names tells which
occur in two documents; only passages that start up to PERIOD - 1 bytes before such a one can repeat. These remaining
suffixes are named by all LENGTH bytes, merged and sorted, and each is compared with its neighbours in the order: equal
neighbours are one passage, and it goes from every document but the smallest that has it.

Texts stand in chunks. A chunk gives each name once, with the smallest document that has it, so a passage of very many
copies costs a row per chunk, and names travel in packed arrays by range. Answers come back as one bit per name.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_of

LENGTH, PERIOD, COVER = 50, 13, (0, 1, 3, 9)
SAMPLED = LENGTH - PERIOD + 1
CHUNK = 1 << 21  # bytes of a chunk, and of the slices a longer text is worked in
PER_RANGE = 1 << 21  # names of a range, on average
PARTS = 2  # passages are named in so many parts, a power of two, so that only one part is under way at a time
SLOTS = 20  # log2 of the table in which a slice finds equal names
NOBODY = np.int64(2**63 - 1)  # owner of a text without any id: above all ids
_ODD = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9],
                 [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]], np.uint64)


def triple(x: np.ndarray, y: np.ndarray, z: np.ndarray, family: int) -> np.ndarray:
    """Names of triples of names."""
    a, b, c = _ODD[family]
    h = x * a
    h ^= h >> np.uint64(29)
    h += y
    h *= b
    h ^= h >> np.uint64(32)
    h += z
    h *= c
    return h ^ (h >> np.uint64(29))


def symbols(blob: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on."""
    return np.ndarray((max(0, len(blob) - 7),), "<u8", np.ascontiguousarray(blob), 0, (1,))


def sampled_names(w: np.ndarray, at: np.ndarray, family: int = 0) -> np.ndarray:
    """Names of the SAMPLED bytes from each position on."""
    first = triple(w[at], w[at + 8], w[at + 16], family)
    return triple(first, w[at + 24], w[at + SAMPLED - 8], family)


def passage_names(w: np.ndarray, at: np.ndarray, family: int) -> np.ndarray:
    """Names of the LENGTH bytes from each position on."""
    first = triple(w[at], w[at + 8], w[at + 16], family)
    second = triple(w[at + 24], w[at + 32], w[at + 40], family)
    return triple(first, second, w[at + LENGTH - 8], family)


def owner_of(text_id: Column) -> Column:
    return F.coalesce(text_id.cast("long"), F.lit(int(NOBODY)))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, texts (SHA-256 of each), owners, sizes, blob: distinct texts in chunks, by owner; a longer text is a chunk by itself."""
    rows = (docs.groupBy(F.unhex(F.sha2(F.col("text"), 256)).alias("text_id"))
            .agg(F.any_value("text").cast("binary").alias("text"), F.min(owner_of(F.col("doc_id"))).alias("owner")))

    def run(batches):
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def packed():
            held.sort(key=lambda r: r[0])
            owners, texts, blobs = zip(*held)
            return pa.record_batch({
                "chunk": pa.array([(part << 32) + made], pa.int64()), "texts": pa.array([b"".join(texts)], pa.binary()),
                "owners": pa.array([np.array(owners, "<i8").tobytes()], pa.binary()),
                "sizes": pa.array([np.array(list(map(len, blobs)), "<i8").tobytes()], pa.binary()),
                "blob": pa.array([b"".join(blobs)], pa.binary()), "n_bytes": pa.array([sum(map(len, blobs))], pa.int64())})

        for batch in batches:
            for x in range(batch.num_rows):
                own = [batch.column(c)[x].as_py() for c in ("owner", "text_id", "text")]
                if held and size + len(own[2]) > CHUNK:
                    yield packed()
                    held, size, made = [], 0, made + 1
                held.append(own)
                size += len(own[2])
        if held:
            yield packed()

    return rows.mapInArrow(run, "chunk long, texts binary, owners binary, sizes binary, blob binary, n_bytes long")


class Slice:
    """Start positions first..last of a chunk, with the documents they lie in."""

    def __init__(self, number: int, blob: np.ndarray, stops: np.ndarray, first: int, last: int):
        self.number, self.first, self.last, self.stops = number, first, last, stops
        self.symbols = symbols(blob[first:last + LENGTH + PERIOD])

    def _within(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which `length` bytes lie in one document, and the documents."""
        doc = np.repeat(np.arange(len(self.stops)), np.diff(np.searchsorted(at, self.stops), prepend=0))
        at = at[:len(doc)]
        whole = at + length <= self.stops[doc]
        return at[whole], doc[whole]

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their names."""
        a, z = self.first // PERIOD, -(-(self.last + PERIOD) // PERIOD)
        at = (np.arange(a, z)[:, None] * PERIOD + np.array(COVER)).ravel()
        at, _ = self._within(at[(at >= self.first) & (at < self.last + PERIOD - 1)], SAMPLED)
        return at, sampled_names(self.symbols, at - self.first)

    def remaining(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions that have a shared sampled position less than PERIOD ahead, and their documents."""
        marks = np.zeros(self.last - self.first + 2 * PERIOD, np.int32)
        marks[shared - self.first + 1] = 1
        ahead = np.cumsum(marks)
        n = self.last - self.first
        return self._within(self.first + np.flatnonzero(ahead[PERIOD:PERIOD + n] > ahead[:n]), LENGTH)


def slices(blob: np.ndarray, stops: np.ndarray):
    for number, first in enumerate(range(0, len(blob), CHUNK)):
        yield Slice(number, blob, stops, first, min(first + CHUNK, len(blob)))


def opened(batch: pa.RecordBatch, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blob, owners, ends of the texts) of a chunk."""
    data = {c: batch.column(c)[x].as_buffer() for c in ("blob", "owners", "sizes")}
    return (np.frombuffer(data["blob"], np.uint8), np.frombuffer(data["owners"], "<i8"), np.cumsum(np.frombuffer(data["sizes"], "<i8")))


def leaders(names: np.ndarray) -> np.ndarray:
    """For each name a place of the same name, the first one unless another name took its slot; equal names need be sent once."""
    here = np.arange(len(names), dtype=np.int32)
    slot = (names & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
    table = np.zeros(1 << SLOTS, np.int32)
    table[slot[::-1]] = here[::-1]
    lead = table[slot]
    return np.where(names[lead] == names, lead, here)


class Sending:
    """The names of a slice that are sent, in order of their range (the upper `bits` of a name) and then of position."""

    def __init__(self, names: np.ndarray, bits: int):
        self.lead = leaders(names)
        own = np.flatnonzero(self.lead == np.arange(len(names)))
        home = (names[own] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(own), np.uint16)
        order = np.argsort(home, kind="stable")
        self.places, self.home = own[order], home[order]

    def ranges(self):
        """(range, start, stop) of what is sent."""
        cuts = np.flatnonzero(np.diff(self.home, prepend=self.home[:1] + 1)) if len(self.home) else np.empty(0, int)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(self.home)).tolist()):
            yield int(self.home[a]), a, b

    def told(self, answers: list[dict] | None, number: int) -> np.ndarray:
        """The answer to each name of the slice; equal names share it."""
        got = np.zeros(len(self.places), bool)
        for a in answers or []:
            if a["slice"] == number:
                got[a["first"]:a["first"] + a["n"]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"])
        out = np.zeros(len(self.lead), bool)
        out[self.places] = got
        return out[self.lead]


SENT = "range long, chunk long, slice int, first long, names binary, also binary, owners binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch({c.split()[0]: pa.array(v, k) for c, v, k in zip(SENT.split(", "), cols, kinds)})


def sampled(chunked: DataFrame, bits: int) -> DataFrame:
    """32 further bits of the sampled names of each slice by range; `also` marks those that the slice has twice."""
    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                blob, _, stops = opened(batch, x)
                for s in slices(blob, stops):
                    _, names = s.sample()
                    out = Sending(names, bits)
                    twice = np.zeros(len(names), bool)
                    twice[out.lead[out.lead != np.arange(len(names))]] = True
                    low, twice = (names[out.places] >> np.uint64(32 - bits)).astype("<u4"), twice[out.places]
                    yield _sent([(r, batch.column("chunk")[x].as_py(), s.number, a, low[a:b].tobytes(), np.packbits(twice[a:b]).tobytes(), b"")
                                 for r, a, b in out.ranges()])

    return chunked.select("chunk", "blob", "owners", "sizes").mapInArrow(run, SENT)


def _joined(rows: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows.column(column)])


def _owner_runs(owners: np.ndarray) -> bytes:
    starts = np.flatnonzero(np.diff(owners, prepend=owners[:1] - 1))
    return np.stack([owners[starts], np.diff(np.append(starts, len(owners)))]).astype("<i8").tobytes()


def _repeating(rows: pa.Table, sizes: list[int]) -> np.ndarray:
    """Sampled names of a range that two slices have, or one slice twice."""
    names = _joined(rows, "names", "<u4")
    keyed = np.sort(names.astype(np.uint64) << np.uint64(32) | np.arange(len(names), dtype=np.uint64))
    order, names = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64), keyed >> np.uint64(32)
    twice = np.concatenate([np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=n) for v, n in zip(rows.column("also"), sizes)])
    same = names[1:] == names[:-1]
    out = np.empty(len(names), bool)
    out[order] = twice[order].astype(bool) | np.append(same, False) | np.append(False, same)
    return out


def _later(rows: pa.Table) -> np.ndarray:
    """Passages of a range that a smaller document has: the order's neighbours compared."""
    first, second = _joined(rows, "names", "<u8"), _joined(rows, "also", "<u4")
    runs = [np.frombuffer(v.as_buffer(), "<i8").reshape(2, -1) for v in rows.column("owners")]
    owners = np.concatenate([np.repeat(own, n) for own, n in runs])
    order = np.argsort(first)
    same = first[order][1:] == first[order][:-1]
    if (same & (second[order][1:] != second[order][:-1])).any():  # the first 64 bits are not all
        order = np.lexsort([second, first])
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    starts = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(owners[order], starts)
    out = np.empty(len(first), bool)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(first)))) < owners[order]
    return out


def answered(sent: DataFrame, passages: bool) -> DataFrame:
    """For each name of a slice whether it repeats, as bits; ranges of a slice without any repeat are left out."""
    def run(rows: pa.Table) -> pa.Table:
        sizes = [len(v.as_buffer()) // (8 if passages else 4) for v in rows.column("names")]
        parts = np.split(_later(rows) if passages else _repeating(rows, sizes), np.cumsum(sizes)[:-1])
        kept = [x for x, p in enumerate(parts) if p.any()]
        out = rows.select(["chunk", "slice", "first"]).take(pa.array(kept, pa.int64()))
        return (out.append_column("n", pa.array([len(parts[x]) for x in kept], pa.int32()))
                .append_column("bits", pa.array([np.packbits(parts[x]).tobytes() for x in kept], pa.binary()))
                .append_column("k", pa.array([int(parts[x].sum()) for x in kept], pa.int64())))

    return sent.groupBy("range").applyInArrow(run, "chunk long, slice int, first long, n int, bits binary, k long")


def by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("slice", "first", "n", "bits")).alias(name))


def candidates(s: Slice, bits: int, ranges: int, answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sending]:
    """Positions, documents and names of the remaining suffixes of a slice, and which of them are sent."""
    at, names = s.sample()
    out = Sending(names, bits)
    shared = out.told(answers, s.number) | (out.lead != np.arange(len(names)))
    at, doc = s.remaining(at[shared])
    names = passage_names(s.symbols, at - s.first, 0)
    return at, doc, names, Sending(names, ranges)


def remaining(chunked: DataFrame, bits: int, ranges: int, part: int) -> DataFrame:
    """Names of the remaining suffixes of each slice by range, with their documents; of one part of the ranges."""
    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                blob, owners, stops = opened(batch, x)
                answers = batch.column("shared")[x].as_py()
                for s in slices(blob, stops):
                    at, doc, names, out = candidates(s, bits, ranges, answers)
                    rows = []
                    for r, a, b in out.ranges():
                        if r % PARTS == part:
                            own = out.places[a:b]
                            rows.append((r, batch.column("chunk")[x].as_py(), s.number, a, names[own].astype("<u8").tobytes(),
                                         passage_names(s.symbols, at[own] - s.first, 1).astype("<u4").tobytes(), _owner_runs(owners[doc[own]])))
                    yield _sent(rows)

    return chunked.select("chunk", "blob", "owners", "sizes", "shared").mapInArrow(run, SENT)


def cleaned(chunked: DataFrame, bits: int, ranges: int) -> DataFrame:
    """text_id, owner, n_removed, n_spans, kept_sha256 (null: nothing goes) of each distinct text."""
    def run(batches):
        for batch in batches:
            for x in range(batch.num_rows):
                blob, owners, stops = opened(batch, x)
                shared, repeats = (batch.column(c)[x].as_py() for c in ("shared", "repeats"))
                edges = np.zeros(len(blob) + 1, np.int32)
                for s in slices(blob, stops):
                    at, doc, _, out = candidates(s, bits, ranges, shared)
                    goes = at[out.told(repeats, s.number) | (owners[doc] > owners[doc[out.lead]])]
                    edges[goes] += 1
                    edges[goes + LENGTH] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                starts = np.append(0, stops[:-1])
                held = starts[starts < len(blob)]
                begins = gone & ~np.append(False, gone[:-1])
                begins[held] = gone[held]
                sums = [np.append(0, np.cumsum(v))[stops] - np.append(0, np.cumsum(v))[starts] for v in (gone, begins)]
                kept = [hashlib.sha256(blob[a:b][~gone[a:b]].tobytes()).hexdigest() if k else None
                        for a, b, k in zip(starts.tolist(), stops.tolist(), sums[0].tolist())]
                ids = batch.column("texts")[x].as_py()
                yield pa.record_batch({
                    "text_id": pa.array([ids[i:i + 32] for i in range(0, len(ids), 32)], pa.binary()), "owner": pa.array(owners, pa.int64()),
                    "n_removed": pa.array(sums[0], pa.int64()), "n_spans": pa.array(sums[1], pa.int64()), "kept": pa.array(kept, pa.string())})

    return chunked.mapInArrow(run, "text_id binary, owner long, n_removed long, n_spans long, kept string")


def range_bits(names: int) -> int:
    return min(24, (names // PER_RANGE).bit_length())


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (doc_id, text)."""
    chunked = stored(chunks(docs), "repeat-chunks", compression="zstd")
    bits = range_bits(chunked.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] * len(COVER) // PERIOD)
    answers = stored(answered(sampled(chunked, bits), False), "repeat-sample")
    shared = answers.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    ranges = max(PARTS.bit_length() - 1, range_bits(shared * PERIOD // len(COVER)))
    per_chunk = stored(by_chunk(answers, "shared"), "repeat-shared")
    known = chunked.join(per_chunk, "chunk", "left")
    repeats = None
    for part in range(PARTS):
        found = stored(answered(remaining(known, bits, ranges, part), True), "repeat-passages")
        repeats = found if repeats is None else repeats.unionByName(found)
    known = known.join(by_chunk(repeats, "repeats"), "chunk", "left")
    per_text = stored(cleaned(known.select("texts", "owners", "sizes", "blob", "shared", "repeats"), bits, ranges), "repeat-texts")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = rows.withColumn("text_id", F.unhex("sha")).join(per_text, "text_id")
    copy = (owner_of(F.col("doc_id")) > F.col("owner")) & (F.col("n_bytes") >= LENGTH)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
                       F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
                       F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op13_repeated_passages(docs: DataFrame) -> DataFrame:
    """What is left of every document without passages that a document with a smaller id has.

    A null text is empty; texts of less than LENGTH bytes keep all. Rows that share an id do not remove from each other, and
    a null id is above all ids. Equal rows give equal rows, one for each. No rows give no rows.
    """
    return removed(docs.select("doc_id", text_of().alias("text")))
