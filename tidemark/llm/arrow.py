"""Small helpers for kernels that read sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(cols: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any column (nulls are equal to nulls); the first row does."""
    n = len(cols[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for c in cols:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            out[1:] |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def numbers(c: pa.Array) -> np.ndarray:
    """A column without nulls as an array."""
    return c.to_numpy(zero_copy_only=False)
