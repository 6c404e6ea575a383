"""Concave outlines of places: the boundary of the triangles between neighbours whose circumcircles are small."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of places whose discs are looked into at a time.
_STEP = 2048


def _open_places(x: np.ndarray, y: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
    """Home places near which a disc of the radius may be empty: it would hold a whole square of 0.7 radii."""
    side = 0.7 * radius
    a, b = np.floor((x - x.min()) / side).astype(int) + 4, np.floor((y - y.min()) / side).astype(int) + 4
    taken = np.zeros((a.max() + 5, b.max() + 5), np.int64)
    taken[a, b] = 1
    sums = np.pad(taken.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = a[home], b[home]
    full = sums[i + 4, j + 4] - sums[i - 3, j + 4] - sums[i + 4, j - 3] + sums[i - 3, j - 3]
    return home[full < 49]


def boundary_pairs(x: np.ndarray, y: np.ndarray, home: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """(i, j) with i of home, directed so that what is inside lies to the left: pairs of distinct places, one of whose two discs
    of the radius is empty and the other is not. All places within two radii of home must be given.

    The discs through two places that hold no other have their centres between those of the two circumcircles at the pair.
    One of radius `radius` is among them on one side alone just where the triangle of the other side is the only smaller one.
    """
    out = []
    for i in _open_places(x, y, home, radius).tolist():
        near = np.flatnonzero((x - x[i]) ** 2 + (y - y[i]) ** 2 < 4 * radius * radius)
        px, py = x[near] - x[i], y[near] - y[i]
        half2 = (px * px + py * py) / 4
        # Each pair is told once, by the place that comes first in x, then y.
        after = np.flatnonzero((half2 > 0) & ((px > 0) | ((px == 0) & (py > 0))))
        for at in range(0, len(after), _STEP):
            q = after[at : at + _STEP]
            qx, qy, lift = px[q], py[q], np.sqrt(radius * radius / half2[q] - 1) / 2
            empty = []
            for sign in (1, -1):  # the disc to the left of the way from i to j, then that to its right
                cx, cy = qx / 2 - sign * lift * qy, qy / 2 + sign * lift * qx
                inside = (px[None] - cx[:, None]) ** 2 + (py[None] - cy[:, None]) ** 2 < (radius * (1 - 1e-9)) ** 2
                inside[np.arange(len(q)), q] = False
                inside[:, half2 == 0] = False
                empty.append(~inside.any(1))
            left, right = empty
            out += [(i, int(near[j])) if r else (int(near[j]), i) for j, le, r in zip(q, left, right, strict=True) if le != r]
    return out


def concave_edges(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, x1, y1, x2, y2): directed edges around the union of a key's triangles between neighbouring places (key, x, y) whose
    circumcircles are smaller than `radius`, the inside to the left.

    Places are dealt to tiles of two radii, each with those of the eight around it, which is as far as an edge of the tile can
    depend on; a key is as many tasks as it has tiles. Equal places are one. Places apart from all triangles have no edges.
    """
    places = points.select(key, "x", "y").distinct()
    tile = lambda c: F.floor(F.col(c) / (2 * radius)).cast("bigint")
    around = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    spread = places.select(key, "x", "y", tile("x").alias("i"), tile("y").alias("j"))
    spread = spread.select("*", F.explode(F.transform(around, lambda d: F.col("i") + d)).alias("a")).select("*", F.explode(F.transform(around, lambda d: F.col("j") + d)).alias("b"))
    kind = points.schema[key].dataType.simpleString()

    def edges(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        home = np.flatnonzero((g["i"] == g["a"]) & (g["j"] == g["b"]))
        pairs = np.array(boundary_pairs(x, y, home, radius) if len(home) else [], np.int64).reshape(-1, 2)
        a, b = pairs.T
        return pd.DataFrame({key: np.repeat(g[key].iloc[:1].to_numpy(), len(a)), "x1": x[a], "y1": y[a], "x2": x[b], "y2": y[b]})

    return spread.groupBy(key, "a", "b").applyInPandas(edges, f"{key} {kind}, x1 double, y1 double, x2 double, y2 double")
