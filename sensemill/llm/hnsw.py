"""A hierarchical navigable small-world graph as flat neighbour arrays, built and searched for many points at once.

Points are numbered so that those of higher levels come first: layer l holds the points 0..n_l-1,
and its graph is one array of n_l rows of neighbours, filled with -1. Searches of a whole batch go
forward together, each step one gather and one product over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, BUILD_BEAM, BATCH, STEP = 16, 48, 256, 4


@dataclass
class Graph:
    x: np.ndarray  # points x dimensions, float32
    layers: list[np.ndarray]  # from layer 0 upwards: neighbours of each point of the layer

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query up to `beam` points, nearest first (-1 where there are fewer), and their distances."""
        ids = [np.zeros((0, beam), np.int64)]
        far = [np.zeros((0, beam), np.float32)]
        sq = np.einsum("nd,nd->n", self.x, self.x)
        for a in range(0, len(q), BATCH):
            part = q[a : a + BATCH]
            at = np.zeros((len(part), 1), np.int64)
            for layer in self.layers[:0:-1]:
                at = _beam(self.x, sq, layer, part, at, 1 if len(layer) > 64 else 4)[0][:, :1]
            i, d = _beam(self.x, sq, self.layers[0], part, at, beam)
            ids.append(i)
            far.append(d)
        return np.concatenate(ids), np.concatenate(far)


def _beam(x: np.ndarray, sq: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer from the given points, for all queries together. Distances lack the query's own square."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(links) + 1), bool)  # the last column is for -1
    seen[:, -1] = True
    k = min(at.shape[1], beam)
    ids[:, :k], done[:, :k] = at[:, :k], at[:, :k] < 0
    far[:, :k] = np.where(at[:, :k] < 0, np.inf, sq[at[:, :k]] - 2 * np.matmul(x[at[:, :k]], q[:, :, None])[:, :, 0])
    seen[rows, at[:, :k]] = True
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live], np.inf, far[live])
        width = min(STEP, beam)
        pick = np.argpartition(open_, width - 1, axis=1)[:, :width]
        ok = np.isfinite(np.take_along_axis(open_, pick, 1))
        on = ok.any(1)
        live, pick, ok = live[on], pick[on], ok[on]
        if not len(live):
            break
        r = live[:, None]
        done[r, pick] = True
        near = np.where(ok[:, :, None], links[np.where(ok, ids[r, pick], 0)], -1).reshape(len(live), -1).astype(np.int64)
        near.sort(axis=1)
        new = ~seen[r, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[r, near] = True
        d = np.full(near.shape, np.inf, np.float32)
        ri, ci = np.nonzero(new)
        p = near[ri, ci]
        d[ri, ci] = sq[p] - 2 * np.einsum("nd,nd->n", x[p], q[live[ri]])
        d_all = np.concatenate([far[live], d], 1)
        order = np.argpartition(d_all, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d_all, order, 1), axis=1, kind="stable"), 1)
        far[live] = np.take_along_axis(d_all, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~np.isfinite(d)], 1), order, 1)
    ids[~np.isfinite(far)] = -1
    return ids, far


def _diverse(x: np.ndarray, base: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), up to `most`: first those nearer to the base than to any chosen one, then the nearest rest."""
    d = np.where(cand < 0, np.inf, ((x[cand] - x[base][:, None]) ** 2).sum(2))
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[cand]
    sq = np.einsum("bcd,bcd->bc", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        clash = (chosen[:, :j] & (between[:, j, :j] <= d[:, j, None])).any(1)
        chosen[:, j] = ~clash & np.isfinite(d[:, j]) & (chosen[:, :j].sum(1) < most)
    rank = np.where(chosen, 0, 1) + np.where(np.isfinite(d), 0, 2)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(np.isfinite(d), cand, -1), order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds source to each target's neighbours; where there are too many, the diverse ones stay."""
    width = links.shape[1]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    node, first, n = np.unique(target, return_index=True, return_counts=True)
    most = int(n.max(initial=0))
    for a in range(0, len(node), BATCH):
        part, f, c = node[a : a + BATCH], first[a : a + BATCH], n[a : a + BATCH]
        cols = np.arange(min(most, int(c.max())))
        new = np.where(cols < c[:, None], source[np.minimum(f[:, None] + cols, len(source) - 1)], -1)
        both = np.concatenate([links[part], new], 1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        used = (both >= 0).sum(1)
        fits = used <= width
        links[part[fits]] = both[fits, :width] if both.shape[1] >= width else np.pad(both[fits], ((0, 0), (0, width - both.shape[1])), constant_values=-1)
        if not fits.all():
            over = both[~fits, : int(used.max())]
            if over.shape[1] > 3 * width:  # only the nearest come into question
                d = np.where(over < 0, np.inf, ((x[over] - x[part[~fits]][:, None]) ** 2).sum(2))
                over = np.take_along_axis(over, np.argsort(d, axis=1, kind="stable")[:, : 3 * width], 1)
            links[part[~fits]] = _diverse(x, part[~fits], over, width)


def levels(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A level for each point: l or more with probability width**-l."""
    u = ((hashes >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.floor(-np.log(u) / np.log(width)).astype(np.int64)


def build(x: np.ndarray, level: np.ndarray, width: int = WIDTH, beam: int = BUILD_BEAM) -> Graph:
    """x in the order of falling level. Layers are built from the top; in each, batches of points find
    their neighbours among the points before them and in their own batch."""
    sq = np.einsum("nd,nd->n", x, x)
    done: list[np.ndarray] = []
    for l in range(int(level[0]) if len(level) else 0, -1, -1):
        n = int(np.searchsorted(-level, -l, "right"))
        links = np.full((n, width * (2 if l == 0 else 1)), -1, np.int32)
        a = 0
        while a < n:
            b = min(n, a + min(BATCH, max(16, a)))
            part = np.arange(a, b)
            own = sq[None, a:b] - 2 * x[a:b] @ x[a:b].T
            np.fill_diagonal(own, np.inf)
            k = min(b - a - 1, width)
            near = np.argpartition(own, max(k - 1, 0), axis=1)[:, :k] + a if k else np.zeros((b - a, 0), np.int64)
            if a:
                at = np.zeros((b - a, 1), np.int64)
                for upper in reversed(done):
                    at = _beam(x, sq, upper, x[a:b], at, 4)[0][:, :1]
                near = np.concatenate([_beam(x, sq, links[:a], x[a:b], np.where(at < a, at, 0), beam)[0], near], 1)
            if near.shape[1]:
                chosen = _diverse(x, part, near, width)
                links[a:b, :width] = chosen
                source = np.repeat(part, width)[chosen.ravel() >= 0]
                _link_back(x, links, source, chosen.ravel()[chosen.ravel() >= 0])
            a = b
        done.insert(0, links)
    return Graph(x, done or [np.full((0, 2 * width), -1, np.int32)])
