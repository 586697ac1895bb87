"""Hierarchical navigable small-world graph over unit vectors, searched in batches.

Nodes are numbered by falling level, so layer l is the first ``sizes[l]`` nodes and the
neighbours of a layer are one matrix. Many queries walk in lock-step: each step expands
the best open node of every beam with a few array operations.
"""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 12
BUILD_BEAM = 32
SHRINK = 16  # a layer has about one node in so many of the layer below
STEP = 256  # queries that walk together
NUMBERS = 1 << 22  # of candidates' vectors that are held at a time


def levels_of(keys: np.ndarray) -> np.ndarray:
    """A level for each key: 0 mostly, one more with odds 1 in ``SHRINK`` each time."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    share = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum((-np.log(share) / np.log(SHRINK)).astype(np.int64), 6)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found per query and their cosines, best first; -1 where there are fewer.

    ``entry`` holds start nodes per query. Nodes from ``limit`` on do not exist yet.
    """
    count, total = len(queries), limit or len(vectors)
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -2.0, np.float32)
    open_ = np.zeros((count, beam), bool)
    seen = np.zeros((count, total), bool)
    rows = np.arange(count)
    width = min(entry.shape[1], beam)
    first = entry[:, :width]
    found = np.einsum("qkd,qd->qk", vectors[first], queries)
    repeat = np.zeros_like(first, bool)
    for k in range(1, width):
        repeat[:, k] = (first[:, :k] == first[:, k : k + 1]).any(axis=1)
    ids[:, :width], near[:, :width], open_[:, :width] = np.where(repeat, -1, first), np.where(repeat, -2, found), ~repeat
    seen[rows[:, None], first] = True
    active = rows
    while len(active):
        best = np.where(open_[active], near[active], -3).argmax(axis=1)
        going = open_[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        open_[active, best] = False
        near_by = links[ids[active, best]]
        new = (near_by >= 0) & (near_by < total)
        near_by = np.where(new, near_by, 0)
        new &= ~seen[active[:, None], near_by]
        seen[active[:, None], near_by] |= new
        cosine = np.einsum("qkd,qd->qk", vectors[near_by], queries[active])
        merged = np.concatenate([near[active], np.where(new, cosine, -2).astype(np.float32)], axis=1)
        kept = np.argpartition(-merged, beam - 1, axis=1)[:, :beam] if merged.shape[1] > beam else np.tile(np.arange(merged.shape[1]), (len(active), 1))
        near[active] = np.take_along_axis(merged, kept, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near_by, -1)], axis=1), kept, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), kept, 1) & (near[active] > -2)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def choose(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` diverse neighbours of each node from candidates, best first.

    A candidate is kept if it is nearer to the node than to any kept one; free places go to the
    best of the others. Without this, a tight cluster would link to itself alone.
    """
    step = max(1, NUMBERS // max(1, ids.shape[1] * vectors.shape[1]))
    if len(ids) > step:
        return np.concatenate([choose(vectors, ids[at : at + step], near[at : at + step], most) for at in range(0, len(ids), step)])
    near = np.where(ids < 0, -2, near)
    held = vectors[np.maximum(ids, 0)]
    between = held @ held.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        close = np.where(kept, between[:, j, :], -2).max(axis=1)
        kept[:, j] = (near[:, j] > -2) & (near[:, j] > close) & (kept.sum(axis=1) < most)
    rank = np.argsort(np.where(kept, -10, 0) - near, axis=1, kind="stable")[:, :most]
    out = np.full((len(ids), most), -1, np.int64)
    out[:, : rank.shape[1]] = np.where(np.take_along_axis(near, rank, 1) > -2, np.take_along_axis(ids, rank, 1), -1)
    return out


class Graph:
    """Layers of links over ``vectors`` (unit, 32-bit), nodes by falling level."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM) -> None:
        self.vectors = vectors
        self.layers: list[np.ndarray] = []
        for level in range(int(levels.max(initial=0)), -1, -1):
            size = int((levels >= level).sum())
            if size:
                self.layers.append(self._layer(size, neighbours * (2 if level == 0 else 1), beam))

    def entries(self, queries: np.ndarray, layers: int, limit: int, width: int = 4) -> np.ndarray:
        """Start nodes for the layer below the first ``layers`` ones."""
        entry = np.zeros((len(queries), 1), np.int64)
        for links in self.layers[:layers]:
            ids, _ = beam_search(self.vectors, links, queries, entry, width, min(limit, len(links)))
            entry = np.where(ids >= 0, ids, ids[:, :1])
        return entry

    def _layer(self, size: int, most: int, beam: int) -> np.ndarray:
        """Insert nodes in batches that at most double the layer; a batch also meets itself."""
        links = np.full((size, most), -1, np.int32)
        done = 0
        while done < size:
            to = min(size, done + max(64, min(done, STEP)))
            batch = self.vectors[done:to]
            inside = batch @ batch.T
            np.fill_diagonal(inside, -2)
            top = np.argsort(-inside, axis=1)[:, : min(most, to - done)]
            ids, near = top + done, np.take_along_axis(inside, top, 1)
            ids = np.where(near > -2, ids, -1)
            if done:
                before, cosine = beam_search(self.vectors, links, batch, self.entries(batch, len(self.layers), done), beam, done)
                ids, near = np.concatenate([before, ids], axis=1), np.concatenate([cosine, near], axis=1)
                order = np.argsort(-near, axis=1, kind="stable")[:, : beam + most]
                ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            links[done:to] = choose(self.vectors, ids, near, most)
            self._link_back(links, np.arange(done, to), most)
            done = to
        return links

    def _link_back(self, links: np.ndarray, nodes: np.ndarray, most: int) -> None:
        """Offer the new nodes to their neighbours, which keep the best of old and new."""
        target, source = links[nodes].ravel().astype(np.int64), np.repeat(nodes, links.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        near = np.einsum("kd,kd->k", self.vectors[target], self.vectors[source])
        order = np.lexsort((-near, target))
        target, source = target[order], source[order]
        owners, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        offered = np.full((len(owners), most), -1, np.int64)
        fits = place < most
        offered[np.repeat(np.arange(len(owners)), counts)[fits], place[fits]] = source[fits]
        ids = np.concatenate([links[owners].astype(np.int64), offered], axis=1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        step = max(1, NUMBERS // max(1, ids.shape[1] * self.vectors.shape[1]))
        for at in range(0, len(owners), step):
            own, mine = owners[at : at + step], ids[at : at + step]
            near = np.where(mine >= 0, np.einsum("qkd,qd->qk", self.vectors[np.maximum(mine, 0)], self.vectors[own]), -2)
            order = np.argsort(-near, axis=1, kind="stable")
            links[own] = choose(self.vectors, np.take_along_axis(mine, order, 1), np.take_along_axis(near, order, 1), most)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.entries(queries, len(self.layers) - 1, len(self.vectors))
        return beam_search(self.vectors, self.layers[-1], queries, entry, beam)
