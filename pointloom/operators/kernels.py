"""Small geometry kernels for one group at a time, and their grouped forms.

Spark deals the groups (a polygon, a contour pair, a cost matrix) to tasks; a kernel sees one group's arrays and
nothing else. A group has to fit a task: a polygon's vertices, a matrix's cells, and for triangulated() all points of
a label, which grow with the table (see the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Vertices counter-clockwise from the leftmost, without collinear ones (monotone chains)."""
    p = [tuple(x) for x in np.unique(points, axis=0)]
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)
    halves = []
    for order in (p, p[::-1]):
        chain: list = []
        for x in order:
            while len(chain) > 1 and _cross(chain[-2], chain[-1], x) <= 0:
                chain.pop()
            chain.append(x)
        halves += chain[:-1]
    return np.array(halves)


def area(ring: np.ndarray) -> float:
    """Signed; counter-clockwise is positive."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a convex ring inside another (both counter-clockwise), half-plane by half-plane."""
    out = [tuple(x) for x in subject]
    for a, b in zip(clip, np.roll(clip, -1, 0)):
        if not out:
            break
        side = [_cross(a, b, x) for x in out]
        new = []
        for i, x in enumerate(out):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                new.append(x)
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                new.append((x[0] + t * (out[j][0] - x[0]), x[1] + t * (out[j][1] - x[1])))
        out = new
    return np.array(out).reshape(-1, 2)


def ear_clipped(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (vertex positions) of a simple ring: two less than its vertices. Where no ear is found (the ring crosses
    itself) the rest is not covered, and there are fewer."""
    left = list(range(len(ring)))
    if area(ring) < 0:
        left.reverse()
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if _cross(ring[a], ring[b], ring[c]) <= 0:
                continue
            others = ring[[i for i in left if i not in (a, b, c)]]
            inside = np.ones(len(others), bool)
            for p, q in ((a, b), (b, c), (c, a)):
                d = ring[q] - ring[p]
                inside &= d[0] * (others[:, 1] - ring[p][1]) - d[1] * (others[:, 0] - ring[p][0]) >= 0
            if not inside.any():
                out.append((a, b, c))
                left.pop(k)
                break
        else:
            return out
    if len(left) == 3:
        out.append(tuple(left))
    return out


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles by insertion: those whose circumcircle holds the new point go, and the hole's rim is joined to it.
    Repeated points take part once."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    low, high = points.min(0), points.max(0)
    mid, span = (low + high) / 2, max((high - low).max(), 1e-9) * 1e3
    p = np.vstack([points, [mid + [-span, -span], mid + [span, -span], mid + [0.0, span]]])
    tri = np.array([[n, n + 1, n + 2]])
    centre, r2 = _circles(p, tri)
    seen = set()
    for i in np.lexsort((points[:, 1], points[:, 0])):
        if (key := tuple(points[i])) in seen:
            continue
        seen.add(key)
        bad = ((centre - p[i]) ** 2).sum(1) < r2 * (1 + 1e-12)
        gone = tri[bad]
        sides = np.sort(np.vstack([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]]), 1)
        rim, count = np.unique(sides, axis=0, return_counts=True)
        rim = rim[count == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        c, q = _circles(p, new)
        tri, centre, r2 = np.vstack([tri[~bad], new]), np.vstack([centre[~bad], c]), np.append(r2[~bad], q)
    return np.sort(tri[(tri < n).all(1)], 1)


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    d = np.where(d == 0, 1e-300, d)
    b2, c2 = (b * b).sum(1), (c * c).sum(1)
    u = np.column_stack([(c[:, 1] * b2 - b[:, 1] * c2) / d, (b[:, 0] * c2 - c[:, 0] * b2) / d])
    return u + a, (u * u).sum(1)


def warped_cost(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping between two series of points, Euclidean. A line of the table at a time: what comes along the
    line is a running least of what comes from above, less the sum of the line so far."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    row = np.cumsum(d[0])
    for line in d[1:]:
        so_far = np.cumsum(line)
        before = np.minimum(row, np.append(np.inf, row[:-1]))
        row = so_far + np.minimum.accumulate(before - (so_far - line))
    return float(row[-1])


def assigned(cost: np.ndarray) -> np.ndarray:
    """Column for each row with the least total cost (rows <= columns). Rows come in one by one: what it costs to reach
    each column, over columns whose rows move on to others, is relaxed until it settles; the cheapest free column is
    taken, and the rows on the way move."""
    n, m = cost.shape
    holder = np.full(m, -1)
    for row in range(n):
        reach, over = cost[row].astype(float), np.full(m, -1)
        held = np.flatnonzero(holder >= 0)
        while len(held):
            moved = (reach[held] - cost[holder[held], held])[:, None] + cost[holder[held]]
            best = moved.argmin(0)
            value = moved[best, np.arange(m)]
            nearer = value < reach - 1e-12 * (1 + np.abs(reach))
            if not nearer.any():
                break
            reach[nearer], over[nearer] = value[nearer], held[best[nearer]]
        free = np.flatnonzero(holder < 0)
        column = int(free[reach[free].argmin()])
        while column >= 0:
            before = int(over[column])
            holder[column] = row if before < 0 else holder[before]
            column = before
    out = np.full(n, -1)
    taken = np.flatnonzero(holder >= 0)
    out[holder[taken]] = taken
    return out


def fitted_affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 2 x 3 map from a to b with the least squared error; points correspond in proportion to their positions."""
    at = np.round(np.linspace(0, len(b) - 1, len(a))).astype(int)
    x = np.column_stack([a, np.ones(len(a))])
    return np.linalg.lstsq(x, b[at], rcond=None)[0].T


def hulls(points: DataFrame) -> DataFrame:
    """polygon_id, pos, x, y of the hull of each label's points. Points inside cannot be on a hull of all, so each
    part of a label first gives its own hull: large labels are never one task's whole."""

    def some(keys: list[str]):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            h = convex_hull(part[["x", "y"]].to_numpy())
            return pd.DataFrame({"label": part["label"].iloc[0], "pos": np.arange(1, len(h) + 1, dtype=np.int64), "x": h[:, 0], "y": h[:, 1]})

        return run

    from pyspark.sql import functions as F

    schema = f"label {dict(points.dtypes)['label']}, pos long, x double, y double"
    dealt = points.select("label", "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(16)).alias("part"))
    first = dealt.groupBy("label", "part").applyInPandas(some(["label", "part"]), schema)
    return first.groupBy("label").applyInPandas(some(["label"]), schema)


def triangulated(points: DataFrame) -> DataFrame:
    """label, a, b, c: the Delaunay triangles of each label's points, by ids."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids = part["id"].to_numpy()
        t = ids[delaunay(part[["x", "y"]].to_numpy())]
        t = np.sort(t.reshape(-1, 3), 1)
        return pd.DataFrame({"label": np.full(len(t), part["label"].iloc[0]), "a": t[:, 0], "b": t[:, 1], "c": t[:, 2]})

    return points.select("id", "x", "y", "label").groupBy("label").applyInPandas(run, f"label {dict(points.dtypes)['label']}, a long, b long, c long")
