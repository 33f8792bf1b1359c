"""How many rows a batch and how many partitions a shuffle should have, from sizes that are known."""

from __future__ import annotations


def batch_rows(row_bytes: int, memory: int, share: float = 0.5, least: int = 1, most: int = 10_000) -> int:
    """Rows that fit into a share of the memory of a task, between least and most."""
    return max(least, min(most, int(memory * share) // max(row_bytes, 1)))


def partitions(total_bytes: int, cores: int, target: int = 134_217_728) -> int:
    """Partitions of about target bytes, a multiple of the cores, so that the last round of tasks is full."""
    rounds = max(1, -(-total_bytes // (target * cores)))
    return rounds * cores
