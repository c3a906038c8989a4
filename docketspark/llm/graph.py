"""A robust-pruned flat graph over the vectors of one shard, and searches on it in lockstep.

Vectors are unit rows of floats; nearness is cosine. Every array here is bounded by the shard's size and by a block of
``QUERIES`` searches.
"""

from __future__ import annotations

import numpy as np

QUERIES = 128
_NONE = np.float32(-2)  # below any cosine


def medoid(x: np.ndarray) -> int:
    """The row nearest to the mean of all."""
    return int((x @ x.mean(0)).argmax())


def candidates(x: np.ndarray, near: int, far: int, rng: np.random.Generator) -> np.ndarray:
    """Per row its nearest rows and some random ones, the nearest first; -1 where there are fewer."""
    n = len(x)
    near, far = min(near, n - 1), min(far, max(0, n - 1))
    out = np.full((n, near + far), -1, np.int32)
    for i in range(0, n, 512):
        rows = np.arange(i, min(i + 512, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = _NONE
        picked = np.concatenate([np.argpartition(-sims, near - 1, 1)[:, :near], rng.integers(0, n, (len(rows), far))], 1)
        value = np.take_along_axis(sims, picked, 1)
        order = np.argsort(-value, 1, kind="stable")
        picked, value = np.take_along_axis(picked, order, 1), np.take_along_axis(value, order, 1)
        again = np.zeros(picked.shape, bool)
        again[:, 1:] = (picked[:, 1:] == picked[:, :-1]) & (value[:, 1:] == value[:, :-1])
        out[rows] = np.where(again | (value <= _NONE), -1, picked)
    return out


def robust_prune(x: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Per row at most ``degree`` of its candidates (nearest first): each taken one drops those that are nearer to it, by ``alpha``."""
    n, width = cand.shape
    links = np.full((n, degree), -1, np.int32)
    for i in range(0, n, 256):
        own = cand[i : i + 256]
        vectors = x[own]
        from_row = 1 - np.einsum("ncd,nd->nc", vectors, x[i : i + 256])
        alive = own >= 0
        rows = np.arange(len(own))
        for k in range(min(degree, width)):
            first = alive.argmax(1)
            there = alive[rows, first]
            if not there.any():
                break
            links[i : i + 256][there, k] = own[rows, first][there]
            from_taken = 1 - np.einsum("ncd,nd->nc", vectors, vectors[rows, first])
            alive &= (alpha * from_taken > from_row) | ~there[:, None]
            alive[rows, first] = False
    return links


def packed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The links a -> b as one padded row for each of ``n`` rows."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, int(place.max(initial=-1)) + 1), -1, np.int32)
    out[a, place] = b
    return out


class FlatGraph:
    def __init__(self, x: np.ndarray, links: np.ndarray, entry: int):
        self.x, self.links, self.entry = x, links, entry

    @classmethod
    def build(cls, x: np.ndarray, degree: int = 24, near: int = 32, far: int = 16, alpha: float = 1.2, seed: int = 5) -> FlatGraph:
        """Prunes near and random candidates, adds the links' way back, prunes again, and joins what the medoid does not reach."""
        entry = medoid(x)
        if len(x) == 1:
            return cls(x, np.full((1, 1), -1, np.int32), entry)
        links = robust_prune(x, candidates(x, near, far, np.random.default_rng(seed)), degree, alpha)
        a, k = np.nonzero(links >= 0)
        b = links[a, k]
        order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), b))
        a, b = a[order], b[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        back = np.full((len(x), degree), -1, np.int32)
        back[b[place < degree], place[place < degree]] = a[place < degree]
        both = np.concatenate([links, back], 1)
        sims = np.where(both >= 0, np.einsum("ncd,nd->nc", x[both], x), _NONE)
        order = np.argsort(-sims, 1, kind="stable")
        both = np.take_along_axis(both, order, 1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = both[:, 1:] == both[:, :-1]
        both[again] = -1
        links = robust_prune(x, both, degree, alpha)
        return cls(x, cls._connected(x, np.concatenate([links, cls._ways_in(x, links)], 1), entry), entry)

    @staticmethod
    def _ways_in(x: np.ndarray, links: np.ndarray, ways: int = 2, fan: int = 8) -> np.ndarray:
        """More links, so that every row is reached from its nearest ones: in a dense group pruning leaves some that none points to.

        A row that is nearest to many passes them on: the first ``fan`` it links itself, each of these the next ``fan``, and so on.
        """
        ends = links[:, :ways]
        child, k = np.nonzero(ends >= 0)
        root = ends[child, k]
        order = np.lexsort((child, -np.einsum("nd,nd->n", x[child], x[root]), root))
        child, root = child[order], root[order]
        first = np.searchsorted(root, root)
        place = np.arange(len(root)) - first
        parent = np.where(place < fan, root, child[first + np.maximum(place - fan, 0) // fan])
        return packed(parent, child, len(x))

    @staticmethod
    def _connected(x: np.ndarray, links: np.ndarray, entry: int) -> np.ndarray:
        """With links added so that every row is reached from ``entry``."""
        reached = np.zeros(len(x), bool)
        reached[entry] = True
        front = np.array([entry])
        best, by = np.full(len(x), _NONE), np.zeros(len(x), np.int64)
        extra: list[tuple[int, int]] = []
        pending = front
        while True:
            while len(front):
                front = np.unique(links[front])
                front = front[front >= 0]
                front = front[~reached[front]]
                reached[front] = True
                pending = np.concatenate([pending, front])
            left = np.flatnonzero(~reached)
            if not len(left):
                break
            for i in range(0, len(pending), 1024):  # each row is compared with what is left once
                sims = x[left] @ x[pending[i : i + 1024]].T
                top = sims.argmax(1)
                value = sims[np.arange(len(left)), top]
                better = value > best[left]
                best[left[better]], by[left[better]] = value[better], pending[i : i + 1024][top[better]]
            one = int(left[best[left].argmax()])
            extra.append((int(by[one]), one))
            reached[one] = True
            front = pending = np.array([one])
        return np.concatenate([links, packed(*np.array(extra).T, len(x))], 1) if extra else links

    def search(self, q: np.ndarray, beam: int, least: float | None = None, starts: tuple[np.ndarray, np.ndarray] | None = None, width: int = 4, most_open: int = 24) -> np.ndarray:
        """Similarities [query, row], -2 where a search did not come: greedy from the medoid (and from ``starts``: query, row).

        A row is expanded if it is among the ``beam`` nearest found so far. With ``least`` the search goes on beyond the beam
        through every row of at least that similarity, until none is left that has not been expanded.
        """
        m, n = len(q), len(self.x)
        sims, expanded = np.full((m, n), _NONE, np.float32), np.zeros((m, n), bool)

        def visit(fresh: np.ndarray) -> None:
            rows, nodes = np.nonzero(fresh & (sims <= _NONE))
            for i in range(0, len(rows), 1 << 15):
                r, c = rows[i : i + (1 << 15)], nodes[i : i + (1 << 15)]
                sims[r, c] = np.einsum("nd,nd->n", q[r], self.x[c])

        fresh = np.zeros((m, n), bool)
        fresh[:, self.entry] = True
        if starts is not None:
            fresh[starts] = True
        visit(fresh)
        active = np.arange(m)
        beam, most_open, width = min(beam, n), min(most_open, n), min(width, n)
        while len(active):
            own = sims[active]
            floor = np.partition(own, n - beam, 1)[:, n - beam]
            own[expanded[active]] = _NONE
            top = np.argpartition(-own, most_open - 1, 1)[:, :most_open]
            value = np.take_along_axis(own, top, 1)
            order = np.argsort(-value, 1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            goes = (value > _NONE) & (value >= floor[:, None])
            goes[:, width:] = False
            if least is not None:
                goes |= value >= least
            rows, at = np.nonzero(goes)
            if not len(rows):
                break
            nodes, rows = top[rows, at], active[rows]
            expanded[rows, nodes] = True
            active = np.unique(rows)
            ends = self.links[nodes]
            there = ends >= 0
            fresh = np.zeros((m, n), bool)
            fresh[np.repeat(rows, there.sum(1)), ends[there]] = True
            visit(fresh)
        return sims
