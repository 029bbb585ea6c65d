"""Exact ranked search: prefix trees of documents, searched by branch and bound.

A document is its terms that some item asks for, most frequent first, so documents share the front of their vectors and
meet in a tree of prefixes. A node knows, for each term below it, the largest count and with it the smallest length
measure of its documents; the score these would give is a bound for all of them. Per item the tree is walked depth first,
best child first, and a branch whose bound is below the item's tenth score so far is left. A task builds
trees of bounded size one after the other and keeps its tenth scores from tree to tree.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

BREAKS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes(0x20 if c in BREAKS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SLICE = 1 << 22  # bytes of a text that are cut into terms at once
BLOCK_TERMS = 1 << 18  # terms of the items that share one pass over the documents, on average
TREE_ENTRIES = 1 << 20  # (document, term) pairs of a tree


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, a slice at a time."""
    b = (text or "").encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while len(b) - at > SLICE:
        stop = b.rfind(b" ", at + 1, at + SLICE)  # the slice may begin with a break
        stop = b.find(b" ", at + SLICE) if stop < 0 else stop  # a term longer than a slice
        if stop < 0:
            break
        yield b[at:stop].split()
        at = stop
    yield b[at:].split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct), n_terms of every row of `items`."""
    def run(batches):
        for batch in batches:
            own = [sorted({w for part in terms_of(t) for w in part}) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"item_id": batch.column("item_id"), "terms": pa.array(own, pa.list_(pa.binary())),
                                   "n_terms": pa.array(map(len, own), pa.int64())})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>, n_terms long")


def vectors(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs: places and counts of the asked terms, of every row of `docs`."""
    def run(batches):
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                n, places, tfs = 0, np.empty(0, np.int32), np.empty(0, np.int64)
                for words in terms_of(text):
                    n += len(words)
                    got = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                    got, k = np.unique(got[got >= 0], return_counts=True)
                    if len(places):
                        got, home = np.unique(np.concatenate([places, got]), return_inverse=True)
                        k = np.bincount(home, np.concatenate([tfs, k])).astype(np.int64)
                    places, tfs = got, k
                sizes.append(n)
                terms.append(places)
                counts.append(tfs)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                                   "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(counts, pa.list_(pa.int64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gain(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the score: grows with tf and falls with m, so maxima and minima bound it."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Tree:
    """Prefix tree of document vectors without single-child nodes.

    Nodes are numbered children first; a leaf stands for the documents with one vector and measure. Per node the children
    and, child after child, their terms and the gains that bound them, exact for leaves.
    """

    def __init__(self, vecs: list[tuple[np.ndarray, np.ndarray]], measures: list[int], ids: list, weights: np.ndarray, keep: int):
        # Terms are numbered by falling frequency; sorted, vectors stand in the order of a walk over the tree.
        merged: dict[tuple, list] = {}
        for (t, f), m, i in zip(vecs, measures, ids):
            merged.setdefault((t.astype(">u4").tobytes(), f.tobytes(), m), []).append(i)
        leaves = sorted(merged)
        # Of documents with equal scores whatever the item only the first `keep` ids can be among the answers.
        self.ids = [sorted(merged[k], key=lambda i: (i is None, i))[:keep] for k in leaves]
        self.children: list[list[int]] = [[] for _ in leaves]
        terms = [np.frombuffer(k[0], ">u4").astype(np.int64) for k in leaves]
        tops = [np.frombuffer(k[1], np.int64) for k in leaves]
        low = [k[2] for k in leaves]
        stack: list[tuple[int, list[int]]] = [(0, [])]  # (depth, children) of the open nodes

        def closed(depth: int) -> None:
            """Close open nodes deeper than `depth`; their node becomes a child of the one above."""
            while stack[-1][0] > depth:
                d, own = stack.pop()
                if stack[-1][0] < depth:
                    stack.append((depth, []))
                t = np.concatenate([terms[c] for c in own])
                f = np.concatenate([tops[c] for c in own])
                order = np.lexsort([f, t])
                t, f = t[order], f[order]
                last = np.append(t[1:] != t[:-1], True)
                terms.append(t[last])
                tops.append(f[last])
                low.append(min(low[c] for c in own))
                self.children.append(own)
                self.ids.append([])
                stack[-1][1].append(len(terms) - 1)

        for x, t in enumerate(terms[:len(leaves)]):
            shared = 0
            if x + 1 < len(leaves):
                nxt = terms[x + 1]
                k = min(len(t), len(nxt))
                differ = np.flatnonzero(t[:k] != nxt[:k])
                shared = int(differ[0]) if len(differ) else k
            if stack[-1][0] < shared:
                stack.append((shared, []))
            stack[-1][1].append(x)
            closed(shared)
        self.root = stack[0][1]
        bounds = [gain(weights[t], f, np.int64(m)) for t, f, m in zip(terms, tops, low)]
        self.below = {}
        for node, own in [*enumerate(self.children), (-1, self.root)]:
            if own:
                starts = np.cumsum([0] + [len(terms[c]) for c in own[:-1]])
                self.below[node] = (own, np.concatenate([terms[c] for c in own]), np.concatenate([bounds[c] for c in own]), starts)

    def search(self, asked: np.ndarray, best: list[tuple], keep: int) -> list[tuple]:
        """`best` (score, id), highest first, brought up to date; `asked` marks the item's terms."""
        rank = lambda e: (-e[0], e[1] is None, e[1])
        todo = [(0, -1)]
        while todo:
            bound, node = todo.pop()
            least = best[-1][0] if len(best) == keep else 1
            if node >= 0 and bound < least:
                continue
            if node in self.below:
                own, terms, gains, starts = self.below[node]
                sums = np.add.reduceat(gains * asked[terms], starts)
                good = np.flatnonzero(sums >= least)
                todo += [(int(sums[c]), own[c]) for c in good[np.argsort(sums[good], kind="stable")]]
            elif node >= 0:
                best = sorted(best + [(bound, i) for i in self.ids[node]], key=rank)[:keep]
        return best


def answers(vecs: DataFrame, asked: list[list[int]], order: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, keep: int) -> DataFrame:
    """(item, doc_id, score): each task's `keep` best documents of every item of the block.

    `order` numbers terms by falling frequency, `asked` and `weights` go by those numbers.
    """
    kind = vecs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        marks = []
        for own in asked:
            marks.append(np.zeros(len(order), bool))
            marks[-1][own] = True
        best = [[] for _ in asked]
        held, entries, id_type = ([], [], []), 0, None

        def searched():
            tree = Tree(*held, weights, keep)
            for i, mark in enumerate(marks):
                best[i] = tree.search(mark, best[i], keep)

        for batch in batches:
            id_type = batch.column("doc_id").type
            flat, stops = [batch.column(c).flatten().to_numpy() for c in ("terms", "tfs")], batch.column("terms").offsets.to_numpy()
            for x, (i, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist())):
                a, b = stops[x] - stops[0], stops[x + 1] - stops[0]
                t = order[flat[0][a:b]]
                by = np.argsort(t)
                held[0].append((t[by], flat[1][a:b][by]))
                held[1].append(10 + 90 * n * n_docs // n_terms)
                held[2].append(i)
                entries += b - a
                if entries >= TREE_ENTRIES:
                    searched()
                    held, entries = ([], [], []), 0
        if held[0]:
            searched()
        rows = [(x, i, s) for x, own in enumerate(best) for s, i in own]
        if rows:
            items, ids, scores = zip(*rows)
            yield pa.record_batch({"item": pa.array(items, pa.int32()), "doc_id": pa.array(ids, id_type), "score": pa.array(scores, pa.int64())})

    return vecs.filter(F.size("terms") > 0).mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, keep: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the `keep` best documents of every row of `items`.

    Rows of items are taken in blocks by hash, each with one pass over the documents. Null and empty texts have no terms: such an
    item has no answers, such a document is none. Repeated rows are items, and documents, of their own; of equal scores the
    smaller id comes first and a null id last. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    listed = stored(item_terms(items).filter("n_terms > 0").withColumn("row", F.monotonically_increasing_id()), "search-items")
    blocks = -(-(listed.agg(F.sum("n_terms")).first()[0] or 0) // BLOCK_TERMS)
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id"))}
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    for block in range(blocks):
        mine = listed.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("item_id", "terms").collect()
        place: dict[bytes, int] = {}
        asked = [[place.setdefault(bytes(w), len(place)) for w in r.terms] for r in mine]
        vecs = stored(vectors(docs, place), "search-vectors")
        n_docs, n_terms = vecs.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not asked:
            continue
        df = np.zeros(len(place), np.int64)
        for r in vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k")).collect():
            df[r.t] = r.k
        order = np.empty(len(place), np.int64)
        falling = np.argsort(-df, kind="stable")
        order[falling] = np.arange(len(place))
        weights = np.array([weight(n_docs, k) for k in df[falling].tolist()], np.int64)
        found = answers(vecs, [order[own].tolist() for own in asked], order, weights, n_docs, n_terms, keep)
        names = spark.createDataFrame([(x, r.item_id) for x, r in enumerate(mine)], f"item int, item_id {kinds['item_id']}")
        best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item; nulls, empty texts, ties and repeated rows as in `search`."""
    return search(docs, items)
