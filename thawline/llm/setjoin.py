"""Exact Jaccard self-join of word-shingle sets by index lists and set relations.

Equal sets are one set. Shingles have one global order, rare ones first; two sets over the threshold share a shingle
among the first few of each (their prefixes). An index list holds the sets with a shingle in their prefix, in blocks
by set size, and a set looks only at the blocks its size allows; a position too far back rules a pair out as well.

A block has a pivot, and every set in it is compared with the pivot first. The answers of a set near the pivot then
follow from the pivot's: two sets linked to it are connected and need no comparison, and if their distances to it
differ by more than the threshold's distance they cannot link (Jaccard distance is a metric). Blocks whose sets are
all connected are skipped. The sets that remain open around a pivot are compared in lots of bounded size: a task holds
two lots, counts all overlaps at once and returns only the links that join them, never their pairs.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, dropping_exchanges, giving_back, stored, text_of
from .components import components
from .words import shingle_set, shingles

RARE_PART = 4  # (a power of two) frequencies are counted for shingles whose hash is 0 modulo this; these come first in the order
FREQUENT = 24  # from so many documents on a shingle counts as frequent
TABLE_BITS, MOST_BITS = 18, 22  # least and most places of the table of frequent shingles, as powers of two
FREE = 16  # places of that table for each taken one, at least: a shingle in a taken place passes for frequent
FILTER_BITS = 24
LOT = 512  # open sets of a lot
LOT_MEMBERS = 1 << 22  # members of the open sets of a lot, as dealt by hash
COUNTED = 1 << 20  # members that are counted at once
SLICE = 4096  # members of sets that one product counts


def _level_key(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """0: counted and not frequent; 1: not counted; above: frequent, by the log of its documents."""
    key = np.ones(len(h), np.uint8)
    own = counted(h)
    level = table[(h[own] >> np.uint64(65 - len(table).bit_length())).astype(np.int64)]
    key[own] = level + (level > 0)
    return key


def counted(h: np.ndarray) -> np.ndarray:
    return h & np.uint64(RARE_PART - 1) == 0


def global_order(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of sorted hashes in the global order: by level, then by hash. Small whole keys sort in linear time."""
    return np.argsort(_level_key(h, table), kind="stable")


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """`level_table` of all documents."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 22):
                own = [shingles(t, k) for t in texts[a:b]]
                h, n = np.unique(np.concatenate([np.unique(h[counted(h)]) for h in own]), return_counts=True)
                yield pa.record_batch({"h": pa.array(h.view(np.int64), pa.int64()), "n": pa.array(n, pa.int32())})

    place = F.shiftrightunsigned("h", 64 - MOST_BITS)
    with dropping_exchanges(docs.sparkSession):  # a table made before this line would keep its exchanges
        got = (docs.mapInArrow(giving_back(run), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
               .groupBy(place.cast("int").alias("p")).agg(F.max(F.log2("n")).cast("int").alias("level"))).toArrow()
    return level_table(got["p"].to_numpy(), got["level"].to_numpy())


def level_table(place: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log2 of the documents of frequent shingles by the first bits of their hashes, 0 for others; `place` is of MOST_BITS.

    The table grows with the number of frequent shingles, so that few others share a place with one. Where the largest
    is too small, the least frequent ones are left out.
    """
    table = np.zeros(1 << MOST_BITS, np.uint8)
    table[place] = level
    above = np.append(np.bincount(level, minlength=1)[::-1].cumsum()[::-1], 0)  # places of at least this level
    table[table < np.argmax(above <= len(table) // FREE)] = 0
    taken, bits = np.count_nonzero(table), TABLE_BITS
    while bits < MOST_BITS and taken * FREE > 1 << bits:
        bits += 1
    return table.reshape(1 << bits, -1).max(1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Least common shingles of two linked sets."""
    return F.ceil((na + nb) * percent / (100.0 + percent) - 1e-9)


def sets(docs: DataFrame, k: int, percent: int, table: np.ndarray) -> DataFrame:
    """doc_id, n, sid (name of the set), prefix: its first shingles in the global order.

    A task gives the prefix of a set once, however many copies it meets.
    """
    def run(batches):
        met: set = set()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            sizes, names, prefixes = [], [], []
            for t in texts:
                h = shingle_set(t, k)
                n = len(h)
                sid = xxhash.xxh3_64_intdigest(h.tobytes()) >> 1 if n else None
                sizes.append(n)
                names.append(sid)
                if sid is None or sid in met:
                    prefixes.append(None)
                    continue
                if len(met) > 200_000:
                    met.clear()
                met.add(sid)
                order = global_order(h, table)[:prefix_length(n, percent)]
                prefixes.append(h[order].view(np.int64))
            yield pa.record_batch({"doc_id": ids, "n": pa.array(sizes, pa.int64()), "sid": pa.array(names, pa.int64()),
                                   "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(giving_back(run), f"doc_id {kind}, n long, sid long, prefix array<long>")


def blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(token, block, sid, n, room, home): members of each index list by size block.

    Linked sets lie in one size block or in neighbouring ones, so a set is at home in its block and visits the one
    below. `room` is the number of shingles behind the shared one. Lists of a single set are left out.
    """
    posts = rows.filter("prefix is not null").select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("token")
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    posts = posts.join(shared, "token").select("token", "sid", "n", (F.col("n") - F.col("pos") - 1).alias("room"), size.alias("size"))
    spots = F.array(F.struct(F.col("size").alias("block"), F.lit(True).alias("home")),
                    F.struct((F.col("size") - 1).alias("block"), F.lit(False).alias("home")))
    return posts.select("token", "sid", "n", "room", F.inline(spots)).distinct()


def _far(percent: int) -> float:
    """The distance of the threshold."""
    return 1 - percent / 100 + 1e-9


def _possible(x: str, y: str, percent: int) -> Column:
    """Size and position allow a link at this shared shingle."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    return ((F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny))
            & (F.least(F.col(f"{x}room"), F.col(f"{y}room")) + 1 >= needed(nx, ny, percent)))


def star(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pivot of each block, candidate pairs of a set and the pivot). The pivot is the home set with the least name."""
    pivots = (members.groupBy("token", "block")
              .agg(F.min(F.when(F.col("home"), F.col("sid"))).alias("p"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))
              .filter("p is not null and lo < hi").select("token", "block", "p"))
    own = members.filter("home").select("token", "block", F.col("sid").alias("p"), F.col("n").alias("p_n"), F.col("room").alias("p_room"))
    pivots = pivots.join(own, ["token", "block", "p"])
    pairs = (members.join(pivots, ["token", "block"]).filter(F.col("sid") != F.col("p"))
             .withColumnsRenamed({"n": "s_n", "room": "s_room"}).filter(_possible("s_", "p_", percent))
             .select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct())
    return pivots, pairs


def with_texts(work: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`work` (sid and more) with the text of one document of each set, in one exchange of texts.

    A fixed-size bitmap of the wanted documents keeps most other texts from the exchange. Another row with the same
    document id may come along; its text names another set.
    """
    carrier = rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    wanted = work.join(carrier, "sid")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int")
    bits = np.zeros(1 << FILTER_BITS, bool)
    with dropping_exchanges(docs.sparkSession):
        bits[wanted.select(place.alias("p")).distinct().toArrow()["p"].to_numpy()] = True
    bits = np.packbits(bits)

    def keep(batches):
        for batch in batches:
            p = batch.column("p").to_numpy()
            batch = batch.filter(pa.array((bits[p >> 3] >> (7 - (p & 7)) & 1).astype(bool)))
            yield batch.select(["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = (docs.select("doc_id", "text", place.alias("p")).filter("doc_id is not null")
             .mapInArrow(giving_back(keep), f"doc_id {kind}, text string"))
    return texts.join(wanted, "doc_id").drop("doc_id")


def name_of(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) >> 1


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(a, b, na, nb, common) of candidate pairs of sets. Pairs are dealt by `a` in lots of bounded size."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).alias("lots"))
    dealt = pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).alias("lot"))
    lead = dealt.select("a", "lot", F.col("a").alias("sid")).distinct()
    rest = dealt.select("a", "lot", F.col("b").alias("sid"))
    work = (with_texts(lead.unionByName(rest), docs, rows)
            .repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("sid") != F.col("a")))

    def compare(batches):
        key, own = None, None
        for batch in batches:
            out = []
            for a, lot, sid, text in zip(*(batch.column(c).to_pylist() for c in ("a", "lot", "sid", "text"))):
                h = shingle_set(text, k)
                if not len(h) or name_of(h) != sid:
                    continue
                if sid == a:
                    key, own = (a, lot), h
                elif key == (a, lot):
                    out.append((a, sid, len(own), len(h), len(np.intersect1d(own, h, assume_unique=True))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "na", "nb", "common"), cols)})

    return work.select("a", "lot", "sid", "text").mapInArrow(giving_back(compare), "a long, b long, na long, nb long, common long").dropDuplicates(["a", "b"])


def overlaps(own: list[np.ndarray]) -> np.ndarray:
    """Common members of every two sorted sets, range of hashes by range of hashes."""
    out = np.zeros((len(own), len(own)), np.float32)
    ranges = max(1, -(-sum(map(len, own)) // COUNTED))
    cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    places = [[0, *np.searchsorted(h, cuts).tolist(), len(h)] for h in own]
    for r in range(ranges):
        _add_overlaps(out, [h[p[r]:p[r + 1]] for h, p in zip(own, places)])
    return out


def _add_overlaps(out: np.ndarray, own: list[np.ndarray]) -> None:
    """Members of a single set are left out and the rest taken in slices."""
    owner = np.repeat(np.arange(len(own)), list(map(len, own)))
    _, member, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = n[member] > 1
    owner, member = owner[shared], np.unique(member[shared], return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    wide = int(member[-1]) + 1 if len(member) else 0
    for s in range(0, wide, SLICE):
        a, b = np.searchsorted(member, [s, s + SLICE])
        m = np.zeros((len(own), min(SLICE, wide - s)), np.float32)
        m[owner[a:b], member[a:b] - s] = 1
        out += m @ m.T


def joining_links(names: list[int], own: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (node, smallest node it is connected to) that connect what the sets' links connect."""
    n = np.array(list(map(len, own)), np.float64)
    common = overlaps(own).astype(np.float64)
    close = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    label = np.arange(len(own))
    while True:
        new = np.where(close, label[None, :], len(own)).min(1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return [(names[i], names[j]) for i, j in enumerate(label) if i != j]
        label = new


def compare_open(open_rows: DataFrame, docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect the open sets (p, sid, n) around each pivot `p`.

    A lot meets each other lot of its pivot once; lots are bounded by their sets and by their sets' members.
    """
    lots = F.greatest(F.ceil(F.count(F.lit(1)) / LOT), F.ceil(F.sum("n") / LOT_MEMBERS)).cast("int")
    sizes = open_rows.groupBy("p").agg(F.count(F.lit(1)).alias("sets"), lots.alias("lots")).filter("sets > 1")
    members = open_rows.join(sizes.select("p", "lots"), "p")
    mine = F.pmod(F.xxhash64("sid"), F.col("lots")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    dealt = members.select("p", "sid", F.inline(meets))
    work = (with_texts(dealt, docs, rows)
            .repartition("p", "i", "j").sortWithinPartitions("p", "i", "j"))

    def compare(batches):
        key, names, own = None, [], []

        def done():
            links = joining_links(names, own, percent) if len(own) > 1 else []
            return pa.record_batch({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("ab")})

        for batch in batches:
            for *at, sid, text in zip(*(batch.column(c).to_pylist() for c in ("p", "i", "j", "sid", "text"))):
                if at != key:
                    yield done()
                    key, names, own = at, [], []
                h = shingle_set(text, k)
                if len(h) and name_of(h) == sid:
                    names.append(sid)
                    own.append(h)
        yield done()

    return work.select("p", "i", "j", "sid", "text").mapInArrow(giving_back(compare), "a long, b long").distinct()


def linked(percent: int) -> Column:
    return F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))


def open_sets(members: DataFrame, pivots: DataFrame, checked: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(p, sid, n): the sets around each pivot that may link with another of its block and are not yet connected to it.

    low and high bound a set's distance to the pivot: the distance itself where it was counted, else what sizes say.
    """
    far = _far(percent)
    rows = (members.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left")
            .withColumn("label", F.coalesce("label", "sid")))
    mixed = (rows.groupBy("token", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
             .filter("l0 < l1").select("token", "block"))
    d = (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d")
    both = checked.select(F.col("a").alias("sid"), F.col("b").alias("p"), d).unionByName(
        checked.select(F.col("b").alias("sid"), F.col("a").alias("p"), d))
    rows = (rows.join(mixed, ["token", "block"]).join(pivots, ["token", "block"]).filter(F.col("sid") != F.col("p"))
            .join(both, ["sid", "p"], "left")
            .withColumn("low", F.coalesce("d", 1 - F.least("n", "p_n") / F.greatest("n", "p_n")))
            .withColumn("high", F.coalesce("d", F.lit(1.0))))
    near = F.col("high") <= far
    state = rows.groupBy("token", "block").agg(F.max(F.when(near, F.col("high"))).alias("edge"), F.min(F.when(~near, F.col("low"))).alias("closest"),
                                               F.count(F.when(~near, 1)).alias("outs"))
    # Sets near the pivot are connected; one matters only to a set outside that is close enough to it.
    return (rows.join(state, ["token", "block"])
            .filter(~near & ((F.col("outs") > 1) | (F.col("low") - F.col("edge") <= far)) | near & (F.col("closest") - F.col("high") <= far))
            .select("p", "sid", "n").distinct())


def join(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text)."""
    rows = stored(sets(docs, k, percent, frequent(docs, k)), "shingle-sets")
    members = stored(blocks(rows, percent), "index-lists")
    pivots, pairs = star(members, percent)
    checked = stored(verify(stored(pairs, "pairs"), docs, rows, k), "checked")
    links = checked.filter(linked(percent)).select("a", "b")
    labels = components(links)
    open_rows = stored(open_sets(members, pivots, checked, labels, percent), "open-sets")
    more = stored(compare_open(open_rows, docs, rows, k, percent), "open-links")
    # Components of what is connected already and the new links.
    ends = labels.select("node", "label")
    known = lambda c: more.join(ends.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
    more = known("a")
    more = known("b").filter("a <> b")
    merged = components(more)
    names = rows.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"))
    names = names.join(ends.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    names = names.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("sid", "low", F.coalesce("top", "label").alias("label"))
    firsts = names.groupBy("label").agg(F.min("low").alias("component_id"))
    homes = names.join(firsts, "label").select("sid", "component_id")
    return (rows.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(homes, "sid", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op10_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Shingle-set size and component of every document.

    A null or blank text has no shingles and links with nothing. Equal rows are rows of their own; rows that share a
    doc_id name one document, for which the text of any of them stands. A null doc_id keeps its row; its component is
    that of its set, null if no copy has an id. No rows give no rows.
    """
    return join(docs.select("doc_id", text_of().alias("text")), k, percent)
