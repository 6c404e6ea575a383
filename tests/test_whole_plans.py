"""Rows that earlier forms of the plans left out."""

import numpy as np
import pandas as pd

from visitlens.plans.grid import nearest_in_rings


def test_nearest_at_any_distance(spark):
    """Far places, corners that a place straight ahead beats, ties and negative coordinates."""
    rng = np.random.default_rng(3)
    a = np.unique(np.concatenate([rng.integers(-900, 900, (40, 2)), [[0, 0], [5000, 5000]]]), axis=0)
    b = np.concatenate([rng.integers(-900, -700, (30, 2)), rng.integers(600, 640, (30, 2)), [[103, 103], [0, 105], [105, 0]]])
    frame = lambda x, names: spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = {(r.row, r.col): (r.nearest, r.distance) for r in nearest_in_rings(frame(a, ["row", "col"]), frame(b, ["r", "c"]), width=8).collect()}
    want = {}
    for row, col in a.tolist():
        d2, r, c = min(((r - row) ** 2 + (c - col) ** 2, r, c) for r, c in b.tolist())
        want[row, col] = (f"{r}_{c}", round(d2**0.5, 4))
    assert got == want
