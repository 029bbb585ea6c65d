"""Merkle manifest of a dataset: trees of three over the rows of each source, and one tree over the sources.

Nodes of a level stand in blocks of 3^BLOCK_LEVELS consecutive ones. A block keeps each of its levels as one string of
hex digests, so three siblings are a substring of fixed width, its hash is their parent, and what flanks a node in that
substring are its siblings. The roots of the blocks are the next nodes, until each source has one root; the roots of
the sources, in order, are nodes again. On the way back each block tells its members the siblings above them, so
no row ever meets another source's or block's rows and a hot source is many blocks like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, HEX, BLOCK_LEVELS = 3, 64, 5
BLOCK = FANOUT ** BLOCK_LEVELS
RUN = FANOUT * HEX
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[c]) for c in FIELDS]), 256)


def group_key(source: Column) -> Column:
    """A string that sorts as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `pos` (from 0) and `n` (rows) within their key; numbers come from counts per range of rows.

    Equal rows are told apart by the place they were read from, so many of them spread over ranges too.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = stored(tied.repartitionByRange(key, *order, "_tie").withColumn("_part", F.spark_partition_id()), "manifest-ranges")
    counts = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(key).orderBy("_part")  # one row per range
    bases = counts.select(key, "_part", (F.sum("_c").over(before) - F.col("_c")).alias("_base"),
                          F.sum("_c").over(W.partitionBy(key)).alias("n"))
    here = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order, "_tie"))
    return (ranged.withColumn("_here", here).join(bases, [key, "_part"])
            .withColumn("pos", F.col("_base") + F.col("_here") - 1).drop("_tie", "_part", "_base", "_here"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * RUN + 1, F.lit(RUN)), 256)), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, block, n, members in order, levels, node) of nodes (key, pos, n, node, own).

    Blocks of a key with several are hashed BLOCK_LEVELS times; a single block until one node is left, its key's root.
    """
    found = (nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"), "n")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "own"))).alias("members")))
    several = F.col("n") > BLOCK
    first = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))
    climb = lambda acc, _: F.when(several | (F.length(acc[F.size(acc) - 1]) > HEX),
                                  F.concat(acc, F.array(_parents(acc[F.size(acc) - 1])))).otherwise(acc)
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), first, climb)
    return (found.withColumn("_all", levels)
            .select("key", "block", "n", F.transform("members", lambda m: m["own"]).alias("members"),
                    F.slice("_all", 1, F.size("_all") - 1).alias("levels"), F.element_at("_all", -1).alias("node")))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each height, up to the one where every key has a single block."""
    heights = []
    while True:
        heights.append(stored(blocks(nodes), "manifest-blocks"))
        more = heights[-1].filter(F.col("n") > BLOCK)
        if more.isEmpty():
            return heights
        nodes = more.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "node",
                            F.struct(F.col("block")).alias("own"))


def roots(heights: list[DataFrame]) -> DataFrame:
    """(key, node): the root of each key."""
    tops = [h.filter(F.col("n") <= BLOCK).select("key", "node") for h in heights]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _flanks(levels: Column, place: Column) -> Column:
    """The siblings of the member at `place`, level by level."""
    width = F.array(*[F.lit(FANOUT ** k) for k in range(BLOCK_LEVELS)])

    def at(level, k):
        p = F.floor(place / width[k])
        run = level.substr((F.floor(p / FANOUT) * RUN + 1).cast("int"), F.lit(RUN))
        own = ((p % FANOUT) * HEX).cast("int")
        return F.struct(run.substr(F.lit(1), own).alias("left"), run.substr(own + HEX + 1, F.lit(RUN)).alias("right"))

    return F.transform(levels, at)


def descended(heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """(own fields, key, path, and more of `above`) for the first nodes; `above` has (key, path, more) of each key's root."""
    more = [c for c in above.columns if c not in ("key", "path")]
    told = None
    for h in reversed(heights):
        known = above.join(h.filter(F.col("n") <= BLOCK).select("key", "block"), "key").select("key", "block", "path", *more)
        told = known if told is None else known.unionByName(told)
        members = F.transform("members", lambda m, i: F.struct(m.alias("own"), F.concat(_flanks(F.col("levels"), i), F.col("path")).alias("path")))
        rows = h.drop("node").join(told, ["key", "block"]).select("key", *more, F.inline(members))
        told = rows.select("key", "own.*", "path", *more)
    return told


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, altered, leaf, altered_leaf, subroot, root, path (siblings from leaf to root) of every row.

    A document is altered, for the test of the manifest, where 2 divides the checksum of its id: its line ends go.
    Nulls are leaves' fields of their own kind; a null id comes first in its source and is not altered. Rows that share
    a source and an id stand in order of their leaves; equal rows are leaves of their own. No rows give no rows.
    """
    own = {c: F.col(c) for c in FIELDS}
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    bare = own | {"text": F.translate("text", "\n", "")}
    leaves = docs.select("doc_id", group_key(F.col("source")).alias("key"), leaf_of(own).alias("node"),
                         F.when(altered & F.contains("text", F.lit("\n")), leaf_of(bare)).alias("bare"), altered.alias("altered"))
    leaves = stored(leaves.withColumn("bare", F.coalesce("bare", "node")), "manifest-leaves")
    placed = numbered(leaves, "key", ["doc_id", "node"])
    per_source = climbed(placed.select("key", "pos", "n", "node", F.struct("doc_id", "altered", F.col("node").alias("leaf"), "bare").alias("own")))
    subroots = roots(per_source).select(F.lit("").alias("all"), F.col("key").alias("source"), "node")
    placed = numbered(subroots, "all", ["source"])
    over_all = climbed(placed.select(F.col("all").alias("key"), "pos", "n", "node", F.struct("source", F.col("node").alias("subroot")).alias("own")))
    top = roots(over_all).select("key", F.array().cast(f"array<{STEP}>").alias("path"), F.col("node").alias("root"))
    above = stored(descended(over_all, top).select(F.col("source").alias("key"), "path", "subroot", "root"), "manifest-sources")
    return descended(per_source, above).select("doc_id", "altered", "leaf", F.col("bare").alias("altered_leaf"), "subroot", "root", "path")


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, digest of the proof, and the root folded from the altered leaf, of every document; see `manifest`."""
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("altered_leaf"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    rows = manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
