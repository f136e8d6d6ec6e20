"""Ragged arrays in numpy: many short runs in one flat array."""

from __future__ import annotations

import numpy as np


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... (lengths[0] of them), then those of the next run, and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
