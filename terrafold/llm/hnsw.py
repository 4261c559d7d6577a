"""A hierarchical navigable small-world graph over unit vectors, built and searched a batch of vectors at a time."""

from __future__ import annotations

import numpy as np

from .common import ship

#: Neighbours of a node on the upper layers and on the lowest, and beam while building.
M_UP, M_LOW, EF_BUILD = 12, 24, 48
#: One node in so many reaches the next layer.
SHRINK = 16
#: Vectors inserted at a time, queries searched at a time, and nodes expanded by each query in a step.
WAVE, BLOCK, STEP = 512, 256, 3


class Graph:
    """layers[0] has every node. A layer is (nodes, neighbours): neighbours are node numbers, -1 where there is none."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        draw = np.random.default_rng(7).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(SHRINK)).astype(int), 8)
        self.levels = level
        self.near = [np.full((n, M_LOW if k == 0 else M_UP), -1, np.int32) for k in range(level.max() + 1 if n else 1)]
        self.entry = np.zeros(0, np.int64)
        done = 0
        while done < n:
            self._insert(np.arange(done, min(n, done + min(WAVE, max(128, done)))))
            done = min(n, done + min(WAVE, max(128, done)))

    def _insert(self, wave: np.ndarray) -> None:
        old, among = wave[0], self.unit[wave] @ self.unit[wave].T
        np.fill_diagonal(among, -2)
        starts = self._starts(self.unit[wave], 0) if old else None
        for k in range(len(self.near) - 1, -1, -1):
            on = self.levels[wave] >= k
            if not on.any():
                continue
            nodes, peers = wave[on], among[np.ix_(on, on)]
            take = min(EF_BUILD // 2, len(nodes))
            mine = np.argpartition(-peers, take - 1, 1)[:, :take]
            found = np.where(np.take_along_axis(peers, mine, 1) > -2, nodes[mine], -1)
            if old and (self.levels[:old] >= k).any():
                first = self._starts(self.unit[nodes], k) if k else starts[on]
                found = np.hstack([self._beam(self.unit[nodes], first, EF_BUILD, k)[0], found])
            chosen = self._select(self.unit[nodes], found, self.near[k].shape[1])
            self.near[k][nodes] = chosen
            self._link_back(nodes, chosen, k)
        if len(self.entry) == 0 or self.levels[wave].max() > self.levels[self.entry].max():
            top = self.levels[: wave[-1] + 1]
            self.entry = np.flatnonzero(top == top.max())[:1]

    def _select(self, q: np.ndarray, found: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the found nodes: nearest first, skipping those nearer to a chosen one than to q; the rest fill up."""
        sims = np.where(found >= 0, np.einsum("qd,qkd->qk", q, self.unit[found]), -3)
        order = np.argsort(-sims, 1, kind="stable")
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.unit[found]
        between = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(found.shape, bool)
        for k in range(found.shape[1]):
            rival = np.where(taken, between[:, k], -3).max(1)
            taken[:, k] = (found[:, k] >= 0) & (rival < sims[:, k]) & (taken.sum(1) < m)
        rank = np.argsort(np.where(taken, 0, 1) + np.where(found >= 0, 0, 2), 1, kind="stable")[:, :m]
        out = np.take_along_axis(found, rank, 1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, k: int) -> None:
        m = self.near[k].shape[1]
        target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        ok = target >= 0
        target, source = target[ok], source[ok]
        sims = np.einsum("kd,kd->k", self.unit[target], self.unit[source])
        order = np.lexsort((-sims, target))
        target, source = target[order], source[order]
        hit, first, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(hit), WAVE):
            h, f, c = hit[at : at + WAVE], first[at : at + WAVE], np.minimum(counts[at : at + WAVE], m)
            fresh = np.full((len(h), c.max()), -1, np.int64)
            for j in range(c.max()):
                fresh[c > j, j] = source[f[c > j] + j]
            both = np.hstack([self.near[k][h].astype(np.int64), fresh])
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            self.near[k][h] = self._select(self.unit[h], both, m)

    def _starts(self, q: np.ndarray, layer: int) -> np.ndarray:
        at = np.repeat(self.entry[:1], len(q))
        for k in range(len(self.near) - 1, layer, -1):
            if self.levels[self.entry[0]] >= k:
                at = self._beam(q, at, 1, k)[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, first: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes that a beam of that width meets, and their cosines (-1 and -3 where there are fewer)."""
        if len(q) > BLOCK:
            parts = [self._beam(q[at : at + BLOCK], first[at : at + BLOCK], ef, layer) for at in range(0, len(q), BLOCK)]
            return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(self.unit) + 1), bool)
        ids = np.full((len(q), ef), -1, np.int64)
        sims = np.full((len(q), ef), -3, np.float32)
        open_ = np.zeros((len(q), ef), bool)
        first = first.reshape(len(q), -1)[:, :ef]
        for k in range(first.shape[1]):
            new = ~seen[rows, first[:, k]]
            ids[new, k], sims[new, k], open_[new, k] = first[new, k], np.einsum("qd,qd->q", q[new], self.unit[first[new, k]]), True
            seen[rows, first[:, k]] = True
        step = min(STEP, ef)
        while len(live := np.flatnonzero(open_.any(1))):
            best = np.argpartition(-np.where(open_[live], sims[live], -4), step - 1, 1)[:, :step]
            real = np.take_along_axis(open_[live], best, 1)
            np.put_along_axis(sub := open_[live], best, False, 1)
            open_[live] = sub
            fresh = np.where(real[:, :, None], self.near[layer][np.take_along_axis(ids[live], best, 1)], -1).reshape(len(live), -1)
            fresh = np.where(seen[live[:, None], fresh], -1, fresh)
            fresh.sort(1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[live[:, None], np.where(fresh >= 0, fresh, len(self.unit))] = True
            seen[:, -1] = False
            near = np.where(fresh >= 0, np.einsum("qd,qkd->qk", q[live], self.unit[fresh]), -3)
            all_s, all_i = np.hstack([sims[live], near]), np.hstack([ids[live], fresh])
            all_o = np.hstack([open_[live], fresh >= 0])
            keep = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (all_i, all_s, all_o))
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Search from the upper layers' best node, and from a node of each query's own where these are given."""
        first = self._starts(q, 0)
        return self._beam(q, first if also is None else np.stack([first, also], 1), min(ef, len(self.unit)), 0)


class Union:
    """Groups of numbers, named by their smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent[x]]
            if (up == self.parent[x]).all():
                return up
            self.parent[x] = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root(a), self.root(b)
            if (differ := x != y).sum() == 0:
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


ship(__name__)
