"""Statistics of one set of rows, as the replicates of ``resample`` have them by counts."""

from __future__ import annotations

import numpy as np

from ..params import DEFAULT


def rank_biserial(d: np.ndarray) -> float:
    """(T+ - T-) / (T+ + T-) of differences without zeros; 0 of none."""
    d = d[d != 0]
    if not d.size:
        return 0.0
    _, inverse, n = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return float((rank[d > 0].sum() - rank[d < 0].sum()) / rank.sum())


def trapezoid_aurc(score: np.ndarray, correct: np.ndarray) -> float:
    """Area under the risk curve on the grid of coverages; ties keep their order."""
    n = len(score)
    hits = np.cumsum(correct[np.argsort(score, kind="stable")])
    cover = np.round(1.0 - DEFAULT.grid_step * np.arange(DEFAULT.grid_steps), 2)
    k = np.maximum(1, np.ceil(cover * n)).astype(int)
    risk = 1 - hits[k - 1] / k
    return float(((risk[1:] + risk[:-1]) / 2 * -np.diff(cover)).sum())
