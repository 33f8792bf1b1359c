"""A residual board network in numpy: forward passes over batches of planes, with taps on the blocks' outputs.

The layers are those of sources.weights. A batch of boards is one matrix product per convolution, in a task's worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-5


def convolve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(n, in, h, w) by (out, in, k, k), zeros outside: (n, out, h, w)."""
    n, c, h, wide = x.shape
    k = w.shape[2]
    padded = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    parts = np.stack([padded[:, :, a : a + h, b : b + wide] for a in range(k) for b in range(k)], axis=2)
    return np.einsum("ncphw,ocp->nohw", parts, w.reshape(len(w), c, k * k), optimize=True)


def normalised(x: np.ndarray, p: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Convolution, then batch normalisation without scale; the stored bias is over the deviation, and is added after it."""
    y = convolve(x, p[f"{name}.weight"])
    scale = np.sqrt(p[f"{name}.var"] + EPS)
    side = lambda v: v[None, :, None, None]
    return (y - side(p[f"{name}.mean"])) / side(scale) + side(p[f"{name}.bias"] / scale)


def forward(planes: np.ndarray, p: dict[str, np.ndarray], taps: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(policy logits (n, points + 1), value (n,), outputs of the tapped blocks) of planes (n, 18, 19, 19)."""
    relu = lambda v: np.maximum(v, 0)
    x = relu(normalised(planes, p, "input"))
    seen, block = {}, 0
    while f"block{block}.1.weight" in p:
        x = relu(x + normalised(relu(normalised(x, p, f"block{block}.1")), p, f"block{block}.2"))
        if block in taps:
            seen[block] = x
        block += 1
    flat = lambda v: v.reshape(len(v), -1)
    policy = flat(relu(normalised(x, p, "policy"))) @ p["policy_out.weight"].T + p["policy_out.bias"]
    hidden = relu(flat(relu(normalised(x, p, "value"))) @ p["value_hidden.weight"].T + p["value_hidden.bias"])
    return policy, np.tanh(hidden @ p["value_out.weight"].T + p["value_out.bias"])[:, 0], seen


def shuffled(p: dict[str, np.ndarray], seed: int = 0) -> dict[str, np.ndarray]:
    """The network with the entries of each tensor dealt anew: a control that keeps each tensor's distribution."""
    rng = np.random.default_rng(seed)
    return {name: rng.permutation(x.ravel()).reshape(x.shape) for name, x in p.items()}


def evaluate(positions: DataFrame, p: dict[str, np.ndarray], tap: int, id_cols: list[str], size: int = 19) -> DataFrame:
    """(id_cols, value, best, policy, pooled) of positions (id_cols, planes as arrays of points): the value, the best move (the last index is a pass), the policy's logits, and the tapped block's channel means."""
    shared = positions.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64]
                x = np.zeros((len(part), 18, size * size))
                for i, r in enumerate(part["planes"]):
                    for k, p in enumerate(r):
                        x[i, k, np.asarray(p, int)] = 1
                x = x.reshape(len(part), -1, size, size)
                policy, value, seen = forward(x, shared.value, (tap,))
                yield part[id_cols].assign(value=value, best=policy.argmax(axis=1), policy=list(policy), pooled=list(seen[tap].mean(axis=(2, 3))))

    ids = positions.select(*id_cols).schema.simpleString()[7:-1].replace(":", " ")
    return positions.select(*id_cols, F.col("planes")).mapInPandas(run, f"{ids}, value double, best int, policy array<double>, pooled array<double>")
