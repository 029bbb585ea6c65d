"""Hierarchical navigable small-world graphs, built and searched in blocks of vectors.

All searches of a block advance together, a few expansions at a time, so a step is a handful of array operations.
"""
from __future__ import annotations

import numpy as np

LINKS = 16  # per vector on upper layers; twice as many on the lowest
BLOCK = 256
SPREAD = 4  # expansions of a search per step


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], homes: list[np.ndarray], entry: int):
        """vectors: unit rows, float32. layers[l]: links of the layer's vectors, -1 where none; homes[l]: row of each
        vector in layers[l], -1 where it is not in the layer."""
        self.vectors, self.layers, self.homes, self.entry = vectors, layers, homes, entry

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"vectors": self.vectors, "entry": np.array(self.entry), "depth": np.array(len(self.layers))}
        for i, (links, home) in enumerate(zip(self.layers, self.homes)):
            out[f"links{i}"], out[f"home{i}"] = links, home
        return out

    @classmethod
    def of(cls, z: dict[str, np.ndarray]) -> "Graph":
        depth = int(z["depth"])
        return cls(z["vectors"], [z[f"links{i}"] for i in range(depth)], [z[f"home{i}"] for i in range(depth)], int(z["entry"]))

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the `width` best per query found from the top layer down, best first; -1 pads."""
        at = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = _search(self, layer, queries, at, 4)[0][:, :1]
        return _search(self, 0, queries, at, width)


def _unique_rows(ids: np.ndarray) -> np.ndarray:
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _search(graph: Graph, layer: int, queries: np.ndarray, entries: np.ndarray, width: int):
    links, home, vectors = graph.layers[layer], graph.homes[layer], graph.vectors
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    ids = np.full((n, width), -1)
    sims = np.full((n, width), -np.inf, np.float32)
    todo = np.zeros((n, width), bool)
    first = min(width, entries.shape[1])
    ids[:, :first] = entries[:, :first]
    sims[:, :first] = np.where(ids[:, :first] >= 0, np.einsum("qd,qed->qe", queries, vectors[ids[:, :first]]), -np.inf)
    todo[:, :first] = ids[:, :first] >= 0
    seen[rows, ids[:, :first]] = True
    while True:
        rank = np.where(todo, sims, -np.inf)
        e = min(SPREAD, width)
        pick = np.argpartition(-rank, e - 1, axis=1)[:, :e] if width > e else np.argsort(-rank, axis=1)
        good = np.take_along_axis(todo, pick, 1)
        if not good.any():
            break
        nodes = np.where(good, np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(todo, pick, False, 1)
        near = np.where((nodes >= 0)[:, :, None], links[home[nodes]], -1).reshape(n, -1)
        near = np.where(seen[rows, near], -1, near)
        near = _unique_rows(near)
        near = near[:, (near >= 0).any(0)]
        if near.shape[1] == 0:
            continue
        seen[rows, near] = True
        s = np.where(near >= 0, np.einsum("qd,qed->qe", queries, vectors[near]), -np.inf)
        ids, sims = np.concatenate([ids, near], 1), np.concatenate([sims, s], 1)
        todo = np.concatenate([todo, near >= 0], 1)
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, todo = (np.take_along_axis(x, best, 1) for x in (ids, sims, todo))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` links per row, best first: a candidate closer to a chosen link than to the row is passed over,
    so that links lead in different directions; room left goes to the best of those passed over."""
    n, c = ids.shape
    if c == 0:
        return np.full((n, most), -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[ids]
    between = np.einsum("qcd,qed->qce", v, v)
    chosen = np.zeros((n, c), bool)
    for j in range(c):
        closest = np.where(chosen, between[:, j, :], -np.inf).max(1)
        chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > closest) & (chosen.sum(1) < most)
    rank = np.where(ids < 0, 2 * c, np.arange(c) + np.where(chosen, 0, c))
    keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, keep, 1)
    return out if c >= most else np.concatenate([out, np.full((n, most - c), -1)], 1)


def build(vectors: np.ndarray, width: int = 32, seed: int = 11) -> Graph:
    """Insert in blocks that grow with the graph; vectors of one block see each other by direct comparison."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
    depth = int(level.max()) + 1 if n else 1
    order = rng.permutation(n)
    layers, homes = [], []
    for l in range(depth):
        members = np.flatnonzero(level >= l)
        home = np.full(n, -1)
        home[members] = np.arange(len(members))
        layers.append(np.full((len(members), LINKS * (2 if l == 0 else 1)), -1))
        homes.append(home)
    graph = Graph(vectors, layers, homes, int(order[np.argmax(level[order])]) if n else -1)
    entry_first = order[order != graph.entry]
    order = np.concatenate([[graph.entry], entry_first]) if n else order
    done = min(1, n)
    while done < n:
        new = order[done:done + max(16, min(BLOCK, done))]
        for l in range(depth):
            own = new[level[new] >= l]
            if not len(own):
                continue
            q = vectors[own]
            at = np.full((len(own), 1), graph.entry)
            for up in range(depth - 1, l, -1):
                at = _search(graph, up, q, at, 4)[0][:, :1]
            ids, sims = _search(graph, l, q, at, width)
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            m = min(width, len(own) - 1)
            if m:
                top = np.argpartition(-mates, m - 1, axis=1)[:, :m]
                ids = np.concatenate([ids, own[top]], 1)
                sims = np.concatenate([sims, np.take_along_axis(mates, top, 1)], 1)
            links, home = graph.layers[l], graph.homes[l]
            chosen = _choose(vectors, ids, sims, LINKS)
            links[home[own], :LINKS] = chosen
            _link_back(graph, l, own, chosen)
        done += len(new)
    return graph


def _link_back(graph: Graph, layer: int, own: np.ndarray, chosen: np.ndarray) -> None:
    """Add the reverse links; a full row keeps the best spread of its old and new links."""
    links, home, vectors = graph.layers[layer], graph.homes[layer], graph.vectors
    src, dst = np.repeat(own, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    most = links.shape[1]
    slots = np.arange(len(dst)) - np.repeat(first, counts)
    for a in range(0, len(targets), BLOCK):
        t = targets[a:a + BLOCK]
        wide = int(counts[a:a + BLOCK].max())
        add = np.full((len(t), wide), -1)
        inside = (np.searchsorted(targets, dst) >= a) & (np.searchsorted(targets, dst) < a + BLOCK)
        add[np.searchsorted(t, dst[inside]), slots[inside]] = src[inside]
        ids = _unique_rows(np.concatenate([links[home[t]], add], 1))
        sims = np.where(ids >= 0, np.einsum("qd,qed->qe", vectors[t], vectors[ids]), -np.inf)
        if ids.shape[1] > 2 * most:
            best = np.argpartition(-sims, 2 * most - 1, axis=1)[:, :2 * most]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        links[home[t]] = _choose(vectors, ids, sims, most)


def within(graph: Graph, queries: np.ndarray, width: int, least: float, slack: float):
    """Yield (first query, offsets, ids): for each block of queries the found ids with similarity >= least - slack.

    A beam finds the neighbourhood; where it meets the range it widens to all that links reach inside the range.
    """
    floor = least - slack
    lowest, home = graph.layers[0], graph.homes[0]
    n = len(graph.vectors)
    for a in range(0, len(queries), BLOCK):
        q = queries[a:a + BLOCK]
        ids, sims = graph.beam(q, min(width, n))
        rows, cols = np.nonzero(sims >= floor)
        parts = []
        hit = np.unique(rows)
        for b in range(0, len(hit), 16):
            own = hit[b:b + 16]
            inside = np.isin(rows, own)
            r, v = np.searchsorted(own, rows[inside]), ids[rows[inside], cols[inside]]
            member = np.zeros((len(own), n + 1), bool)
            seen = np.zeros((len(own), n + 1), bool)
            seen[:, -1] = True
            member[r, v] = seen[r, v] = True
            while len(r):
                near = lowest[home[v]]
                flat = np.unique(np.repeat(r, near.shape[1]) * (n + 1) + np.where(near < 0, n, near).ravel())
                r, v = np.divmod(flat, n + 1)
                fresh = ~seen[r, v]
                r, v = r[fresh], v[fresh]
                seen[r, v] = True
                good = np.einsum("ed,ed->e", q[own[r]], graph.vectors[v]) >= floor
                r, v = r[good], v[good]
                member[r, v] = True
            r, v = np.nonzero(member)
            parts.append((own[r], v))
        if parts:
            r, v = (np.concatenate(x) for x in zip(*parts))
        else:
            r, v = np.empty(0, int), np.empty(0, int)
        yield a, len(q), r, v
