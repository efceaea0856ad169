"""Runs of an Arrow array whose values are held as Python objects at a time."""
from __future__ import annotations

SLICE_BYTES = 1 << 20


def runs(values, limit: int | None = None) -> list[tuple[int, int]]:
    """(from, to) of successive rows with about ``limit`` bytes of text or
    bytes each (SLICE_BYTES), or one row that is longer."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // (limit or SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
