"""Connected components: over a cluster (shared with the rest of the library) and within a task.

Edges to oneself and repeated edges change nothing; no edges leave every node its own root.
"""

from __future__ import annotations

import numpy as np
from tilewright.operators.components import components  # noqa: F401


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each of n rows' component under the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root
