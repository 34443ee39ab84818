"""Small numpy helpers that run inside Spark tasks on bounded blocks of rows."""

from __future__ import annotations

import numpy as np


def matrix(buffer: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.float64).reshape(-1, dims)


def longs(buffer: bytes) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.int64)


def sq_distances(a: np.ndarray, b: np.ndarray, cuts: tuple[float, ...] = ()) -> np.ndarray:
    """Squared distances; cells close to a cut-off are recomputed by plain differences."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    twice = a @ b.T
    twice *= 2.0
    d2 = na[:, None] + nb[None, :]  # the same for (a, b) and (b, a), as equal weights are told apart by ids
    d2 -= twice
    np.maximum(d2, 0.0, out=d2)
    slack = 1e-9 * (na.max(initial=0.0) + nb.max(initial=0.0))
    for cut in cuts:
        wide = slack + 1e-9 * cut * cut
        inside, upto = d2 < cut * cut - wide, d2 <= cut * cut + wide
        if np.count_nonzero(inside) != np.count_nonzero(upto):
            i, j = np.nonzero(upto & ~inside)
            d2[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return d2


def roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root``, the smallest vertex of each vertex's component, after edges (u, v) have joined some."""
    root = root.copy()
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def connect(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (u, v) in order, and the smallest one of each one's component."""
    names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    return names, names[roots(np.arange(len(names)), code[:len(u)], code[len(u):])]


def components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each row of a boolean adjacency matrix."""
    return roots(np.arange(len(adjacent)), *np.nonzero(adjacent))
