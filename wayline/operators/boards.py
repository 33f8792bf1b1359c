"""Labels of board points. A board is at most 361 points, so one row holds it; batches of boards are labelled together with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 19


def geometry(r: Column, c: Column, n: int = N) -> dict[str, Column]:
    """Masks of a point by its place."""
    end, mid = n - 1, n // 2
    near = lambda x: (x < 4) | (x > end - 4)
    star = (r.isin(3, 9, 15) & c.isin(3, 9, 15)) if n == 19 else F.lit(False)
    return {"is_edge": (r == 0) | (c == 0) | (r == end) | (c == end), "is_corner": near(r) & near(c), "is_centre": (F.abs(r - mid) <= 2) & (F.abs(c - mid) <= 2), "is_star": star}


def neighbours(points: DataFrame, offsets: tuple[tuple[int, int], ...] = ((-1, 0), (1, 0), (0, -1), (0, 1))) -> DataFrame:
    """(board_id, r, c, stone, nr, nc): a row per neighbour place on the board; joins on it are equi-joins."""
    o = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))
    x = points.select("board_id", "r", "c", "stone", F.explode(o).alias("o"))
    x = x.select("board_id", "r", "c", "stone", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc"))
    return x.where(f"nr between 0 and {N - 1} and nc between 0 and {N - 1}")


def _shift(x: np.ndarray, dr: int, dc: int, fill: int) -> np.ndarray:
    """What stands at (r + dr, c + dc), fill outside."""
    out = np.full_like(x, fill)
    n = x.shape[1]
    out[:, max(0, -dr) : n - max(0, dr), max(0, -dc) : n - max(0, dc)] = x[:, max(0, dr) : n - max(0, -dr), max(0, dc) : n - max(0, -dc)]
    return out


_ORTH, _DIAG = ((-1, 0), (1, 0), (0, -1), (0, 1)), ((-1, -1), (-1, 1), (1, -1), (1, 1))


def regions(board: np.ndarray) -> np.ndarray:
    """The smallest point number of each point's region of equal points; minima spread, with jumps to the region's current root."""
    b, n, _ = board.shape
    label = np.broadcast_to(np.arange(n * n).reshape(n, n), board.shape).copy()
    same = [(_shift(board, dr, dc, -1) == board, dr, dc) for dr, dc in _ORTH]
    while True:
        new = label.copy()
        for ok, dr, dc in same:
            new = np.where(ok, np.minimum(new, _shift(label, dr, dc, n * n)), new)
        flat = new.reshape(b, -1)
        new = np.take_along_axis(flat, flat, axis=1).reshape(new.shape)
        if (new == label).all():
            return label
        label = new


def label_boards(board: np.ndarray) -> dict[str, np.ndarray]:
    """All labels of (boards, n, n) arrays of 0 empty, 1 black, 2 white, each of the same shape."""
    b, n, _ = board.shape
    root = regions(board)
    key = root + n * n * np.arange(b)[:, None, None]
    size = np.bincount(key.ravel(), minlength=b * n * n)[key]
    around = np.stack([_shift(board, dr, dc, -1) for dr, dc in _ORTH])
    roots = np.stack([_shift(root, dr, dc, -1) for dr, dc in _ORTH])
    # each empty point counts once for each region of stones next to it
    pairs = [np.zeros(0, np.int64)]
    empty = board == 0
    where, at = np.nonzero(empty.reshape(b, -1))
    for k in range(4):
        ok = around[k][empty] > 0
        pairs.append((where[ok] * n * n + roots[k][empty][ok]) * (n * n) + at[ok])
    liberties = np.bincount(np.unique(np.concatenate(pairs)) // (n * n), minlength=b * n * n)[key]
    touches = {}
    for stone in (1, 2):
        hit = ((around == stone).any(axis=0) & empty).ravel()
        touches[stone] = (np.bincount(key.ravel()[hit], minlength=b * n * n) > 0)[key] & empty
    edge = np.zeros((n, n), bool)
    edge[0], edge[-1], edge[:, 0], edge[:, -1] = True, True, True, True
    diag = np.stack([_shift(board, dr, dc, -1) for dr, dc in _DIAG])
    out = {"group_id": np.where(board > 0, root, -1), "group_size": np.where(board > 0, size, 0), "liberties": np.where(board > 0, liberties, 0)}
    for name, own, other in (("black", 1, 2), ("white", 2, 1)):
        out[f"is_{name}"] = board == own
        out[f"{name}_territory"] = empty & touches[own] & ~touches[other]
        all_own = ((around == own) | (around == -1)).all(axis=0)
        out[f"{name}_eye"] = empty & all_own & ((diag == other).sum(axis=0) <= np.where(edge, 0, 1))
        mine = np.where(around == own, roots, -1)
        groups = sum((mine[k] >= 0) & ~np.any([mine[k] == mine[m] for m in range(k)], axis=0) if k else mine[k] >= 0 for k in range(4))
        out[f"{name}_cutting"] = empty & (groups >= 2)
        out[f"{name}_contact"] = (board == own) & (around == other).any(axis=0)
    stones = board > 0
    out["is_atari"] = stones & (out["liberties"] == 1)
    out["is_low_liberty"] = stones & (out["liberties"] < 3)
    out["is_large_group"] = stones & (out["group_size"] >= 5)
    return out


_INTS = ("group_id", "group_size", "liberties")


def board_labels(stones: DataFrame) -> DataFrame:
    """(board_id, point, stone, labels...): a row for each of the points of each board in stones (board_id, r, c, stone)."""
    rows = stones.groupBy("board_id").agg(F.collect_list((F.col("r") * N + F.col("c")).cast("int")).alias("p"), F.collect_list(F.col("stone").cast("int")).alias("s"))
    names = list(label_boards(np.zeros((1, N, N), np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                board = np.zeros((len(part), N * N), np.int64)
                for i, (p, s) in enumerate(zip(part["p"], part["s"], strict=True)):
                    board[i, np.asarray(p, np.int64)] = s
                labels = label_boards(board.reshape(-1, N, N))
                out = {"board_id": np.repeat(part["board_id"].to_numpy(), N * N), "point": np.tile(np.arange(N * N), len(part)), "stone": board.ravel()}
                yield pd.DataFrame(out | {k: x.ravel() for k, x in labels.items()})

    return rows.mapInPandas(run, "board_id long, point int, stone int, " + ", ".join(f"{k} {'int' if k in _INTS else 'boolean'}" for k in names))


def points(board: Column, stone: Column | int) -> Column:
    """The points of a board (an array of 0, 1, 2) that have a stone of a colour, ascending."""
    return F.filter(F.transform(board, lambda x, i: F.when(x == stone, i)), lambda i: i.isNotNull())


def planes(black: list[Column], white: list[Column], mover: Column) -> Column:
    """18 arrays of the points that are set: own stones of the board and of up to 7 boards before it (newest first), then the other side's, all seen by the current mover; then all points if black, and all if white is to move. A board that isn't there is null and gives none."""
    none = F.array().cast("array<int>")
    pick = lambda own, other: [F.coalesce(F.when(mover == 1, a).otherwise(b), none) for a, b in zip(own, other, strict=True)]
    side = [F.when(mover == s, F.sequence(F.lit(0), F.lit(N * N - 1))).otherwise(none) for s in (1, 2)]
    return F.array(*pick(black, white), *pick(white, black), *side)


def stones_of(planes: Column) -> tuple[Column, Column]:
    """(black's points, white's points) that planes show: those of planes 0 and 8, or the other way round where plane 16 is empty."""
    at = lambda k: F.get(planes, F.lit(k))
    black = F.size(at(16)) > 0
    return F.when(black, at(0)).otherwise(at(8)), F.when(black, at(8)).otherwise(at(0))


def planes_of(board: np.ndarray, history: list[np.ndarray], mover: int) -> np.ndarray:
    """(18, n, n): own and opposing stones of the current board and up to 7 before it, seen by the current mover, and which side that is."""
    n = board.shape[0]
    out = np.zeros((18, n, n), np.float32)
    for t, b in enumerate([board, *history[:7]]):
        out[t], out[8 + t] = b == mover, b == 3 - mover
    out[16 if mover == 1 else 17] = 1
    return out


def _group(board: np.ndarray, r: int, c: int) -> tuple[list[tuple[int, int]], bool]:
    """The stones connected with the one at (r, c), and whether they have a liberty; the walk ends at the first liberty it meets."""
    n, stone = board.shape[0], board[r, c]
    seen, open_ = {(r, c)}, [(r, c)]
    while open_:
        y, x = open_.pop()
        for dy, dx in _ORTH:
            p = (y + dy, x + dx)
            if 0 <= p[0] < n and 0 <= p[1] < n and p not in seen:
                if board[p] == 0:
                    return list(seen), True
                if board[p] == stone:
                    seen.add(p)
                    open_.append(p)
    return list(seen), False


def play(board: np.ndarray, r: int, c: int, stone: int) -> np.ndarray | None:
    """The board after a stone and its captures; None for a move on a stone or off the board, or one that leaves its own group without liberty. Only groups next to the move are looked at."""
    n = board.shape[0]
    if not (0 <= r < n and 0 <= c < n) or board[r, c]:
        return None
    new = board.copy()
    new[r, c] = stone
    for dr, dc in _ORTH:
        y, x = r + dr, c + dc
        if 0 <= y < n and 0 <= x < n and new[y, x] == 3 - stone:
            dead, alive = _group(new, y, x)
            if not alive:
                for p in dead:
                    new[p] = 0
    return new if _group(new, r, c)[1] else None
