"""Clustering, projections and topology. Fits see a bounded sample where the method is quadratic or worse; extended and assigned give every row a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import density, neighbours

#: Points that quadratic operators (densities, homology) take at most.
MAX_POINTS = 5_000


def sample(df: DataFrame, id_col: str, vec: str, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the n rows with the smallest keyed hashes."""
    if n > MAX_POINTS:
        raise ValueError(f"at most {MAX_POINTS} points")
    rows = df.select(id_col, vec).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def distances(x: np.ndarray) -> np.ndarray:
    s = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * x @ x.T, 0))


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """(n - 1, 3) of i, j, length, by Prim's method, sorted by length."""
    n = len(d)
    best, near, out = np.full(n, np.inf), np.zeros(n, int), []
    free = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        free[at] = False
        closer = free & (d[at] < best)
        best[closer], near[closer] = d[at][closer], at
        at = int(np.argmin(np.where(free, best, np.inf)))
        out.append((near[at], at, best[at]))
    return np.array(sorted(out, key=lambda e: e[2])).reshape(-1, 3)


@dataclass
class DensityFit:
    """Density clusters of a sample: its points, their labels (-1: noise) and core distances, and each cluster's reach, the distance at which it parts from its surroundings."""

    points: np.ndarray
    label: np.ndarray
    core: np.ndarray
    reach: np.ndarray


def density_clusters(x: np.ndarray, min_size: int = 10, min_samples: int = 5) -> np.ndarray:
    """The labels of density_fit."""
    return density_fit(x, min_size, min_samples).label


def density_fit(x: np.ndarray, min_size: int = 10, min_samples: int = 5) -> DensityFit:
    """Hierarchical density clusters by excess of mass: mutual reachability, spanning tree, condensed tree, stable clusters, numbered by their first points. Under two points all is noise."""
    if len(x) < 2:
        return DensityFit(x, np.full(len(x), -1), np.zeros(len(x)), np.zeros(0))
    d = np.round(neighbours.distances(x, x), 9)
    n = len(x)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    tree = spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None])))
    c = density.Condenser(min_size)
    for i, j, w in tree:
        c.merge(int(i), 1, int(j), 1, w)
    node = [c.moved(i)[2] for i in range(n)]
    of_cluster, reach = c.finish()
    raw = np.array([-1 if x is None else of_cluster[c.cluster(x)] for x in node])
    # numbered by their first points
    first = {x: k for k, x in enumerate(dict.fromkeys(raw[raw >= 0].tolist()))}
    label = np.array([first.get(x, -1) for x in raw.tolist()])
    return DensityFit(x, label, core, reach[list(first)] if first else np.zeros(0))


def _by_batch(df: DataFrame, id_col: str, vec: str, of: Callable[[np.ndarray], np.ndarray], names: list[str], kind: str) -> DataFrame:
    """(id_col, names) of of(vectors), a column of each row's result by name; a matrix product per batch, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.iloc[lo : lo + 512]
                y = of(np.stack(part["vec"].to_numpy()).astype(float))
                yield pd.DataFrame({id_col: part["id"].to_numpy(), **{n: y[:, j] for j, n in enumerate(names)}})

    rows = df.select(df[id_col].alias("id"), df[vec].alias("vec"))
    return rows.mapInPandas(run, f"`{id_col}` long, {', '.join(f'{n} {kind}' for n in names)}")


def squared_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def assigned(df: DataFrame, fit: DensityFit, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(id_col, cluster) of all rows: a row takes the label of the sample point that it reaches first (by the larger of their distance and the point's core distance), if that is within the cluster's reach, else -1. A sample point keeps its own."""
    shared = df.sparkSession.sparkContext.broadcast(fit)

    def of(y: np.ndarray) -> np.ndarray:
        f = shared.value
        d = np.sqrt(squared_between(y, f.points))
        own = d.min(axis=1) < 1e-7 * (1 + np.sqrt((y**2).sum(axis=1)))
        near = np.where(own, d.argmin(axis=1), np.maximum(d, f.core).argmin(axis=1))
        at = np.arange(len(y))
        label = f.label[near]
        limit = np.append(f.reach, -1.0)[label]
        return np.where(own | (np.maximum(d[at, near], f.core[near]) <= limit), label, -1)[:, None]

    return _by_batch(df, id_col, vec, of, ["cluster"], "int")


def principal(cov: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components as rows) in falling order; the largest entry of each component is positive."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(w)[::-1][:n]
    v = v[:, order].T
    sign = np.sign(v[np.arange(len(v)), np.argmax(np.abs(v), axis=1)])
    return w[order], v * sign[:, None]


@dataclass
class DiffusionFit:
    """A diffusion map of landmarks: eigenvalues, right eigenvectors, the kernel's width and the landmarks' degrees."""

    points: np.ndarray
    lam: np.ndarray
    phi: np.ndarray
    epsilon: float
    alpha: float
    degree: np.ndarray

    def extend(self, y: np.ndarray) -> np.ndarray:
        """Coordinates of rows by Nystroem's formula; a landmark gets its own."""
        k = np.exp(-squared_between(y, self.points) / self.epsilon)
        k = k / np.maximum(np.outer(k.sum(axis=1), self.degree) ** self.alpha, 1e-300)
        return k / np.maximum(k.sum(axis=1, keepdims=True), 1e-300) @ self.phi


def diffusion_fit(x: np.ndarray, n: int, epsilon: float | None = None, alpha: float = 0.5) -> DiffusionFit:
    """The diffusion operator of x, solved through its symmetric conjugate. epsilon: by default the median squared distance."""
    d2 = distances(x) ** 2
    epsilon = float(epsilon or np.median(d2))
    k = np.exp(-d2 / epsilon)
    q = k.sum(axis=1)
    k = k / np.outer(q, q) ** alpha
    s = k.sum(axis=1)
    lam, u = np.linalg.eigh(k / np.sqrt(np.outer(s, s)))
    order = np.argsort(lam)[::-1][:n]
    u = u[:, order]
    sign = np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])
    return DiffusionFit(x, lam[order], u * sign / np.sqrt(s)[:, None], epsilon, alpha, q)


def diffusion_map(x: np.ndarray, n: int, epsilon: float | None = None, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, coordinates) of x."""
    fit = diffusion_fit(x, n, epsilon, alpha)
    return fit.lam, fit.phi * fit.lam


def extended(df: DataFrame, fit: DiffusionFit, id_col: str = "vec_id", vec: str = "vec", project: np.ndarray | None = None, centre: np.ndarray | None = None) -> DataFrame:
    """(id_col, d1, d2, ...) of all rows, without the constant first coordinate; project and centre: principal components (rows) that the fit was made on."""
    shared = df.sparkSession.sparkContext.broadcast((fit, project, centre))

    def of(y: np.ndarray) -> np.ndarray:
        f, p, c = shared.value
        return f.extend(y if p is None else (y - c) @ p.T)[:, 1:]

    return _by_batch(df, id_col, vec, of, [f"d{j}" for j in range(1, len(fit.lam))], "double")


def persistence(x: np.ndarray, max_dim: int = 1, max_edge: float | None = None) -> list[tuple[int, float, float]]:
    """(dimension, birth, death) of the finite Vietoris-Rips classes of all points of x, up to max_dim (2 at most), by reduction of the boundary matrix over two elements.

    A column is one whole number whose bits are faces. Simplices with an edge over max_edge are left out. Dimension 1 takes
    triangles, dimension 2 tetrahedra: of n points n ** 3 / 6 and n ** 4 / 24.
    """
    d = distances(x)
    n, limit = len(x), np.inf if max_edge is None else max_edge
    out = [(0, 0.0, float(w)) for _, _, w in spanning_tree(d) if w <= limit] if n > 1 else []
    tree = len(out)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= limit)
    faces, open_faces = {(i, j): k for k, (_, i, j) in enumerate(edges)}, len(edges) - tree
    birth = [e[0] for e in edges]
    for dim in range(1, max_dim + 1):
        simplices = sorted((max(birth[faces[f]] for f in combinations(s, dim + 1)), s) for s in combinations(range(n), dim + 2) if all(f in faces for f in combinations(s, dim + 1)))
        pivots: dict[int, int] = {}
        for death, s in simplices:
            if len(pivots) == open_faces:
                break  # every class has died: all further columns are sums of those before
            column = 0
            for f in combinations(s, dim + 1):
                column ^= 1 << faces[f]
            while column and (low := column.bit_length() - 1) in pivots:
                column ^= pivots[low]
            if column:
                pivots[low] = column
                if death > birth[low] + 1e-12:
                    out.append((dim, float(birth[low]), float(death)))
        open_faces = len(simplices) - len(pivots)
        faces, birth = {s: k for k, (_, s) in enumerate(simplices)}, [w for w, _ in simplices]
    return out


def persistence_significance(x: np.ndarray, dim: int = 1, shuffles: int = 20, least: float = 0.1, seed: int = 0) -> tuple[int, float, float]:
    """(observed, mean of the null, p-value) of the number of classes of dim that live longer than least, against x with each column dealt anew on its own; edges up to the 95 % quantile of distances."""
    rng = np.random.default_rng(seed)

    def count(y: np.ndarray) -> int:
        edge = np.quantile(distances(y)[np.triu_indices(len(y), 1)], 0.95)
        return sum(k == dim and death - birth > least for k, birth, death in persistence(y, dim, float(edge)))

    seen = count(x)
    null = [count(np.stack([rng.permutation(c) for c in x.T], axis=1)) for _ in range(shuffles)]
    return seen, float(np.mean(null)), float(np.mean([m >= seen for m in null]))
