"""Connected components of a small group, inside a task."""

from __future__ import annotations

import numpy as np


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected with, given links a-b."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    return np.array([top(i) for i in range(n)], np.int64)
