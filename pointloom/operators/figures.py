"""Kernels over one figure, which has to fit a task: smoothing, alignment, circle fits, flows, thinning, tracing, offset polygons."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np


def smoothed(values: np.ndarray, rounds: int, rate: float, closed: bool) -> np.ndarray:
    """Relaxation in place: each value moves towards the mean of its neighbours, in order, so later ones see earlier
    moves. Open ends stay."""
    v = np.array(values, float)
    n = len(v)
    for _ in range(rounds):
        for i in range(0 if closed else 1, n if closed else n - 1):
            v[i] += rate * ((v[i - 1] + v[(i + 1) % n]) / 2 - v[i])
    return v


def alignment_cost(a: list, b: list, skip: float, differ: float) -> float:
    """Least cost of turning one code sequence into the other: skips on either side, and replacements. A line of the
    table at a time; skips along the line are a running least."""
    other, steps = np.asarray(b), skip * np.arange(len(b) + 1)
    row = steps.astype(float)
    for i, x in enumerate(a, 1):
        above = row + skip
        above[0] = i * skip
        above[1:] = np.minimum(above[1:], row[:-1] + np.where(other == x, 0.0, differ))
        row = np.minimum.accumulate(above - steps) + steps
    return float(row[-1])


def fitted_circle(points: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Centre and radius with the least squared distance to the circle, by damped least squares from the mean. (The
    objective is the geometric one; the difference of squared radii, which weighs far points more, is not offered.)"""
    cx, cy = points.mean(0)
    r = float(np.hypot(*(points - (cx, cy)).T).mean())
    damp = 1e-3
    cost = np.inf
    for _ in range(rounds):
        d = points - (cx, cy)
        dist = np.maximum(1e-12, np.hypot(*d.T))
        e = dist - r
        now = float((e * e).sum())
        if now > cost:
            cx, cy, r = last
            damp *= 10
            if damp > 1e8:
                break
            continue
        if cost - now < 1e-15:
            break
        last, cost, damp = (cx, cy, r), now, damp / 3
        j = np.column_stack([-d / dist[:, None], -np.ones(len(d))])
        a = j.T @ j
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), -j.T @ e)
        cx, cy, r = cx + step[0], cy + step[1], r + step[2]
    return float(cx), float(cy), float(r)


def max_flow(edges: list[tuple[int, int, float]], source: int, sink: int) -> tuple[float, set[int]]:
    """Greatest flow, by shortest augmenting paths; and the source's side of a least cut."""
    room: dict = defaultdict(lambda: defaultdict(float))
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += 0.0
    total = 0.0
    while True:
        came = {source: source}
        todo = deque([source])
        while todo and sink not in came:
            a = todo.popleft()
            for b, c in room[a].items():
                if c > 1e-12 and b not in came:
                    came[b] = a
                    todo.append(b)
        if sink not in came:
            return total, set(came)
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow
        total += flow


def thinned(cells: np.ndarray) -> np.ndarray:
    """A foreground mask without cells that its shape does not need, in two directions until nothing changes: a cell goes
    if it has two to six neighbours in one run and is on the side of the pass. All cells of a pass go at once, so the
    result does not depend on the order of the cells. (A rule that looks for three cells in a row around each cell, in
    raster order and in place, gives other skeletons; it is not offered.)"""
    m = np.pad(cells.astype(bool), 1)
    while True:
        before = m.sum()
        for half in (0, 1):
            n = [np.roll(np.roll(m, -dy, 0), -dx, 1) for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
            count = sum(x.astype(int) for x in n)
            rises = sum((~a & b).astype(int) for a, b in zip(n, n[1:] + n[:1]))
            up, right, down, left = n[0], n[2], n[4], n[6]
            sides = ~(up & right & down) & ~(right & down & left) if half == 0 else ~(up & right & left) & ~(up & down & left)
            m &= ~(m & (count >= 2) & (count <= 6) & (rises == 1) & sides)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def traced(mask: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """Paths (x, y) through a thin mask: from ends first, then from what is left; shorter ones go."""
    left = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask))}
    near = lambda p: [(p[0] + i, p[1] + j) for i, j in ((0, -1), (1, 0), (0, 1), (-1, 0), (1, -1), (1, 1), (-1, 1), (-1, -1)) if (p[0] + i, p[1] + j) in left]
    out = []
    ends = sorted(p for p in left if len(near(p)) == 1)
    for start in ends + sorted(left):
        if start not in left:
            continue
        path, p = [], start
        while p is not None:
            path.append(p)
            left.discard(p)
            p = next(iter(near(p)), None)
        if len(path) >= least:
            out.append(path)
    return out


def shrunk(ring: np.ndarray, until: float) -> list[tuple[float, np.ndarray]]:
    """A convex ring's sides move inwards at one speed; events are vanishing sides. Returns (time, ring after it),
    the start included; the last has less than three vertices, or is the ring at `until`."""
    x = np.asarray(ring, float)
    area = (x[:, 0] * np.roll(x[:, 1], -1) - np.roll(x[:, 0], -1) * x[:, 1]).sum() / 2
    x = x if area > 0 else x[::-1]
    d = np.roll(x, -1, 0) - x
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / np.hypot(*d.T)[:, None]
    lines = [(n, float(n @ p)) for n, p in zip(normal, x)]
    now, out = 0.0, [(0.0, x)]
    while len(lines) >= 3:
        corners = _corners(lines, 0.0)
        speed = _corners(lines, 1.0) - corners
        # a side vanishes when its ends meet
        gaps, rates = np.roll(corners, -1, 0) - corners, np.roll(speed, -1, 0) - speed
        along = np.array([[n[1], -n[0]] for n, _ in lines])
        length, rate = (gaps * along).sum(1), (rates * along).sum(1)
        t = np.where(rate < -1e-12, -length / np.minimum(rate, -1e-12), np.inf)
        t = np.where(t < now + 1e-12, np.where(np.abs(t - now) < 1e-9, now, np.inf), t)
        k = int(t.argmin())
        if not np.isfinite(t[k]) or t[k] > until:
            if np.isfinite(until):
                out.append((until, _corners(lines, until)))
            return out
        now = float(t[k])
        lines.pop(k)
        out.append((now, _corners(lines, now) if len(lines) >= 3 else np.zeros((0, 2))))
    return out


def _corners(lines: list, t: float) -> np.ndarray:
    """Where each side meets the one before it, at time t."""
    out = []
    for i in range(len(lines)):
        (n, c), (m, e) = lines[i - 1], lines[i]
        det = n[0] * m[1] - n[1] * m[0]
        det = det if abs(det) > 1e-12 else 1e-12
        out.append((((c + t) * m[1] - (e + t) * n[1]) / det, ((e + t) * n[0] - (c + t) * m[0]) / det))
    return np.array(out)


def merged_by_fitness(area: dict[int, float], sides: list[tuple[int, int, float]], least: float) -> dict[int, int]:
    """Regions merged greedily: the pair with the greatest shared side over the root of the smaller area goes first,
    while that is over `least`. sides: region, region, shared length. Returns each region's group (its least id)."""
    area, shared = dict(area), defaultdict(lambda: defaultdict(float))
    for a, b, w in sides:
        shared[a][b] += w
        shared[b][a] += w
    group = {a: {a} for a in area}
    fit = lambda a, b: shared[a][b] / max(1e-12, min(area[a], area[b]) ** 0.5)
    heap = [(-fit(a, b), a, b) for a in shared for b in shared[a] if a < b]
    heapq.heapify(heap)
    while heap:
        f, a, b = heapq.heappop(heap)
        if -f <= least:
            break
        if a not in group or b not in group or abs(fit(a, b) + f) > 1e-12:
            continue
        group[a] |= group.pop(b)
        area[a] += area.pop(b)
        for c, w in shared.pop(b).items():
            shared[c].pop(b, None)
            if c != a:
                shared[a][c] += w
                shared[c][a] = shared[a][c]
        for c in shared[a]:
            heapq.heappush(heap, (-fit(a, c), min(a, c), max(a, c)))
    return {m: min(ms) for ms in group.values() for m in ms}
