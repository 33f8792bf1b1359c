"""Markov-model algebra on small matrices, which aggregates of any amount of rows lead to. All functions take numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Matrices of more states aren't collected.
MAX_STATES = 2_000


def dense(counts: DataFrame, value: str = "n") -> tuple[list[int], np.ndarray]:
    """(states, matrix) of a table (i, j, value); fails beyond MAX_STATES states."""
    states = sorted(r[0] for r in counts.select("i").union(counts.select("j")).distinct().limit(MAX_STATES + 1).collect())
    if len(states) > MAX_STATES:
        raise ValueError(f"over {MAX_STATES} states")
    at = {s: k for k, s in enumerate(states)}
    out = np.zeros((len(states), len(states)))
    for i, j, x in counts.select("i", "j", value).collect():
        out[at[i], at[j]] = x
    return states, out


def row_normalise(c: np.ndarray) -> np.ndarray:
    """Rows of sum 1; rows without counts stay zero."""
    return c / np.maximum(c.sum(axis=1, keepdims=True), 1e-10)


def matrix_check(p: np.ndarray) -> dict:
    """n_states, n_absorbing (rows of zeros), square, and deviation: how far the other rows are from adding up to 1. Rows with negative entries count as off by those."""
    total = p.sum(axis=1)
    rows = total > 0
    off = np.maximum(np.abs(total - 1), np.maximum(-p.min(axis=1), 0)) if p.size else np.zeros(0)
    return {"n_states": len(p), "n_absorbing": int((~rows).sum()), "square": p.shape[0] == p.shape[1], "deviation": float(off[rows].max(initial=0.0))}


def stationary(p: np.ndarray, steps: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Power iteration from the uniform distribution, normalised at each step; at convergence the iterate before."""
    x = np.full(len(p), 1 / len(p))
    for _ in range(steps):
        y = x @ p
        y = y / y.sum() if y.sum() > 0 else y
        if np.abs(y - x).max() < tol:
            break
        x = y
    return x


def eigenvalues(p: np.ndarray) -> np.ndarray:
    return np.sort(np.linalg.eigvals(p).real)[::-1]


def timescales(p: np.ndarray, lag: int, n: int | None = None) -> np.ndarray:
    """-lag / ln(eigenvalue) of all but the first; infinite outside (0, 1)."""
    lam = eigenvalues(p)[1:][: n or min(len(p) - 1, 10)]
    with np.errstate(all="ignore"):
        return np.where((lam > 0) & (lam < 1), -lag / np.log(np.clip(lam, 1e-300, 1 - 1e-16)), np.inf)


def chapman_kolmogorov(by_lag: dict[int, np.ndarray], lag: int, limit: float = 0.2) -> list[tuple[int, float, bool]]:
    """(k, rmse, passed) of P(lag)**k against P(k lag) for the multiples that by_lag has."""
    p = by_lag[lag]
    out = []
    for other, q in sorted(by_lag.items()):
        if other % lag == 0:
            rmse = float(np.sqrt(np.mean((np.linalg.matrix_power(p, other // lag) - q) ** 2)))
            out.append((other // lag, rmse, rmse < limit))
    return out


def first_passage(p: np.ndarray, pi: np.ndarray, lag: int = 1) -> np.ndarray:
    """Mean first-passage times from the fundamental matrix; zero on the diagonal."""
    z = np.linalg.inv(np.eye(len(p)) - p + pi[None, :])
    m = (np.diag(z)[None, :] - z) / np.maximum(pi[None, :], 1e-300) * lag
    np.fill_diagonal(m, 0)
    return m


def vamp2(c00: np.ndarray, c0t: np.ndarray, ctt: np.ndarray, floor: float = 1e-10) -> float:
    """Sum of squared singular values of the whitened cross-covariance, eigenvalues floored."""

    def whiten(c: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(c)
        return v @ np.diag(np.maximum(w, floor) ** -0.5) @ v.T

    s = np.linalg.svd(whiten(c00) @ c0t @ whiten(ctt), compute_uv=False)
    return float((s**2).sum())


def tica(c0: np.ndarray, ct: np.ndarray, n: int | None = None, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of the symmetrised problem ct x = lam (c0 + eps) x, in falling order."""
    c0 = (c0 + c0.T) / 2 + eps * np.eye(len(c0))
    w, v = np.linalg.eigh(c0)
    half = v @ np.diag(np.maximum(w, 1e-12) ** -0.5)
    lam, u = np.linalg.eigh(half.T @ ((ct + ct.T) / 2) @ half)
    order = np.argsort(lam)[::-1][:n]
    return lam[order], half @ u[:, order]


def committor(p: np.ndarray, a: list[int], b: list[int]) -> np.ndarray:
    """Probability of reaching b before a."""
    m = p - np.eye(len(p))
    rhs = np.zeros(len(p))
    for s in [*a, *b]:
        m[s] = 0
        m[s, s] = 1
    rhs[b] = 1
    return np.clip(np.linalg.lstsq(m, rhs, rcond=None)[0], 0, 1)


def transition_paths(p: np.ndarray, pi: np.ndarray, a: list[int], b: list[int]) -> dict:
    """Committors, gross and net flux, total flux, rate and mean first-passage time between two sets."""
    forward = committor(p, a, b)
    back = pi[None, :] * p.T / np.maximum(pi[:, None], 1e-300)
    backward = 1 - committor(back / np.maximum(back.sum(axis=1, keepdims=True), 1e-10), a, b)
    gross = pi[:, None] * backward[:, None] * p * forward[None, :]
    np.fill_diagonal(gross, 0)
    net = np.maximum(gross - gross.T, 0)
    outside = [i for i in range(len(p)) if i not in a]
    total = float(net[np.ix_(a, outside)].sum())
    rate = total / max(float((pi * backward).sum()), 1e-300)
    return {"forward": forward, "backward": backward, "gross": gross, "net": net, "flux": total, "rate": rate, "mfpt": 1 / rate if rate > 0 else float("inf")}


def pathways(net: np.ndarray, a: list[int], b: list[int], share: float = 0.99, limit: int = 100) -> list[tuple[list[int], float]]:
    """(states, flux) of the strongest paths, peeled off one by one by their bottlenecks until share of the flux is told."""
    net, out = net.copy(), []
    total = sum(net[i, j] for i in a for j in range(len(net)) if j not in a)
    told = 0.0
    while told < share * total - 1e-15 and len(out) < limit:
        width = np.full(len(net), 0.0)
        width[a], before, open_ = np.inf, {}, set(range(len(net)))
        while open_:
            i = max(open_, key=lambda s: width[s])
            open_.discard(i)
            if width[i] <= 0:
                break
            for j in open_:
                if min(width[i], net[i, j]) > width[j]:
                    width[j], before[j] = min(width[i], net[i, j]), i
        end = max(b, key=lambda s: width[s])
        if width[end] <= 0:
            break
        path = [end]
        while path[-1] not in a:
            path.append(before[path[-1]])
        path = path[::-1]
        for i, j in zip(path[:-1], path[1:], strict=True):
            net[i, j] -= width[end]
        out.append((path, float(width[end])))
        told += width[end]
    return out


def kmeans_rows(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Labels of the rows of a small matrix; farthest-first start."""
    first = int(np.random.default_rng(seed).integers(len(x)))
    centres = [x[first]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(d))])
    c = np.array(centres)
    label = np.full(len(x), -1)
    for _ in range(rounds):
        new = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
        if (new == label).all():
            break
        label = new
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(axis=0)
    return label


def metastable(p: np.ndarray, k: int) -> np.ndarray:
    """Hard macrostates: rows of the k leading right eigenvectors, normalised and clustered."""
    lam, v = np.linalg.eig(p)
    x = v[:, np.argsort(-np.abs(lam))[:k]].real
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return kmeans_rows(x, k)


def memberships(p: np.ndarray, k: int) -> np.ndarray:
    """Soft memberships (states, k), rows of sum 1: the k leading right eigenvectors map the states near to a simplex; its corners are the states farthest apart, and a state's membership is where it lies between them (0 and 1 at most).

    k below 2 or above the number of states raises ValueError; where the corners don't span, memberships are those of metastable.
    """
    if not 2 <= k <= len(p):
        raise ValueError(f"{k} macrostates of {len(p)} states")
    lam, v = np.linalg.eig(p)
    x = v[:, np.argsort(-np.abs(lam), kind="stable")[:k]].real
    x[:, 0] = 1.0
    corners = [int(np.argmax((x**2).sum(axis=1)))]
    rest = x - x[corners[0]]
    for _ in range(k - 1):
        size = (rest**2).sum(axis=1)
        corners.append(int(np.argmax(size)))
        unit = rest[corners[-1]] / max(np.sqrt(size.max()), 1e-300)
        rest = rest - np.outer(rest @ unit, unit)
    if abs(np.linalg.det(x[corners])) < 1e-12:
        return np.eye(k)[metastable(p, k)]
    m = np.clip(x @ np.linalg.inv(x[corners]), 0, 1)
    return m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)


def membership_entropy(m: np.ndarray) -> float:
    """The mean entropy of rows of memberships, with 1e-10 added and rows normalised."""
    q = (m + 1e-10) / (m + 1e-10).sum(axis=1, keepdims=True)
    return float(-(q * np.log(q)).sum(axis=1).mean())


def coarse(p: np.ndarray, pi: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Macrostate matrix of memberships (states, macrostates)."""
    t = member.T @ (pi[:, None] * p) @ member
    return row_normalise(t)


def elbow(k: np.ndarray, score: np.ndarray, method: str = "distance") -> int:
    """Index of saturation of a score over k: farthest from the chord, first gradient below a tenth of the largest (the last but one, if none is), or strongest bend; under 3 points the best score."""
    if len(k) < 3:
        return int(np.argmax(score))
    x = (k - k.min()) / max(k.max() - k.min(), 1e-12)
    y = (score - score.min()) / max(score.max() - score.min(), 1e-12)
    if method == "distance":
        return int(np.argmax(np.abs((y[-1] - y[0]) * x - (x[-1] - x[0]) * y + x[-1] * y[0] - y[-1] * x[0])))
    g = np.diff(y) / np.diff(x)
    if method == "gradient":
        low = np.flatnonzero(np.abs(g) < 0.1 * np.abs(g).max())
        return int(low[0]) if len(low) else len(k) - 2
    return int(np.argmin(np.diff(g))) + 1


def spectrum_check(lam: np.ndarray, gap: float = 0.05, lead: float = 0.8) -> tuple[float, bool]:
    """(gap of the first two, valid): gap and first value large enough, none clearly negative, two at least."""
    lam = np.sort(np.asarray(lam))[::-1]
    if len(lam) < 2:
        return 0.0, False
    g = float(lam[0] - lam[1])
    return g, bool(g >= gap and lam[0] >= lead and lam.min() >= -1e-10)
