"""Queries that must do the whole job: brute force on small tables that a cut or a row filter would change."""

import math

import numpy as np
import pytest

from pointloom.jobs import registry
from pointloom.operators import kernels
from pointloom.sources import fixtures


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))


def placed(spark, path, points):
    """points: id, x, y, label."""
    stored(spark, path, "embeddings", [(i, [x, y], k) for i, x, y, k in points], "vec_id long, embedding array<double>, label int")


LINES = [(1, 96, 10.0, 2), (2, 1, 49.0, 1), (3, 4, 5.0, 3), (4, 3, 50.0, 1), (3, 97, 1.0, 1), (7, 97, 30.0, 4), (5, 10, 46.0, 2), (85, 10, 46.0, 1), (45, 10, 2.0, 1), (6, 10, 3.0, 7)]


def lines(spark, path):
    stored(spark, path, "lineitem", [(s, p, q, n) for s, p, q, n in LINES], "l_suppkey long, l_partkey long, l_quantity double, l_linenumber int")
    return str(path)


def test_strong_components_of_all_lines(spark, tmp_path):
    to = {}
    for s, p, _, _ in LINES:
        to.setdefault(s, set()).add((p + s) % 97)
        to.setdefault((p + s) % 97, set())
    reach = {}
    for a in to:
        reach[a], front = {a}, [a]
        while front:
            new = to[front.pop()] - reach[a]
            reach[a] |= new
            front += new
    alone = {a for a in to if to[a] <= {a} and not any(a in to[b] for b in to if b != a)}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in to if a not in alone}
    assert {r["node"]: r["root"] for r in registry.QUERIES["strong_components"](spark, lines(spark, tmp_path)).collect()} == want


def test_members_of_all_lines(spark, tmp_path):
    want = {}
    for s, p, _, _ in LINES:
        want.setdefault(s, set()).add(p % 40)
    got = registry.QUERIES["distinct_members"](spark, lines(spark, tmp_path)).collect()
    assert {r["a"]: (r["grp"], r["members"], r["n"]) for r in got} == {s: (s % 7, sorted(m), len(m)) for s, m in want.items()}


def depths(rings):
    """Ranks by all vertices inside (or on) and the greater area, of convex counter-clockwise rings."""

    def holds(a, b):
        if abs(kernels.area(a)) <= abs(kernels.area(b)):
            return False
        return all(kernels._cross(p, q, x) >= 0 for x in b for p, q in zip(a, np.roll(a, -1, 0)))

    rank = dict.fromkeys(rings, 0)
    for _ in rings:
        for a in rings:
            for b in rings:
                if a != b and holds(rings[a], rings[b]):
                    rank[b] = max(rank[b], rank[a] + 1)
    return rank


def quantile(v, f):
    return sorted(v)[max(math.ceil(f * len(v)) - 1, 0)]


def test_containment_of_polygons_of_all_points(spark, tmp_path):
    square = lambda k, m, at, n: [(n + i, at[0] + x * m, at[1] + y * m, k) for i, (x, y) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1), (0, 0.1), (0.1, 0)])]
    points = square(1, 8.0, (0, 0), 1) + square(2, 4.0, (1, 0), 11) + square(3, 1.0, (0.5, 0.5), 21)
    points += [(31, -3.0, -3.0, 4), (32, 3.0, -3.0, 4), (33, -3.0, 3.0, 4), (41, 2.0, 2.0, 5), (42, 2.5, 2.0, 5), (43, 2.0, 2.6, 5)]  # 5: in the box of 4, not in 4
    placed(spark, tmp_path, points)
    rings = {}
    for k in {p[3] for p in points}:
        own = np.array([p[1:3] for p in points if p[3] == k])
        rings[k] = kernels.convex_hull(own)
        (x1, x2), (y1, y2) = ([quantile(own[:, c], f) for f in (0.2, 0.8)] for c in (0, 1))
        rings[k + 100] = np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])
    want = depths(rings)
    assert max(want.values()) >= 3
    assert {r["box"]: r["rank"] for r in registry.QUERIES["containment_ranks"](spark, str(tmp_path)).collect()} == want


def test_all_pairs_of_all_suppliers(spark, tmp_path):
    n = 20  # a chain of nations: paths of up to 19 edges, and suppliers over 96
    stored(spark, tmp_path, "supplier", [(90 + i, i, float(i * i % 7)) for i in range(n)], "s_suppkey long, s_nationkey int, s_acctbal double")
    stored(spark, tmp_path, "customer", [(i + 1, i, float(i % 5)) for i in range(n)], "c_custkey long, c_nationkey int, c_acctbal double")
    links = [(i, i + 1) for i in range(n - 1)] + [(5, 2), (0, 0)]
    stored(spark, tmp_path, "orders", [(k, b + 1) for k, (_, b) in enumerate(links)], "o_orderkey long, o_custkey long")
    stored(spark, tmp_path, "lineitem", [(k, 90 + a) for k, (a, _) in enumerate(links)], "l_orderkey long, l_suppkey long")
    d = {(a, a): 0.0 for a in range(n)}
    for a, b in links:
        d[a, b] = min(d.get((a, b), math.inf), abs(a * a % 7 - b % 5))
    for k in range(n):
        for a in range(n):
            for b in range(n):
                if (a, k) in d and (k, b) in d:
                    d[a, b] = min(d.get((a, b), math.inf), d[a, k] + d[k, b])
    assert (0, n - 1) in d
    assert {(r["a"], r["b"]): r["d"] for r in registry.QUERIES["all_pairs_paths"](spark, str(tmp_path)).collect()} == d


def test_peeling_goes_on_to_the_end(spark, sf):
    from collections import Counter

    xy = {r["id"]: (r["x"], r["y"]) for r in fixtures.points(spark, sf).collect()}
    live, rounds = {}, {}
    for r in kernels.triangulated(fixtures.points(spark, sf)).collect():
        live.setdefault(r["label"], set()).add((r["a"], r["b"], r["c"]))
    sides = lambda t: ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))
    size = lambda ts: sum(abs(kernels.area(np.array([xy[i] for i in t]))) for t in ts)
    want = {}
    for k, ts in live.items():
        whole, rounds[k] = size(ts), 0
        while True:
            faces = Counter(s for t in ts for s in sides(t))
            gone = {t for t in ts if any(faces[s] == 1 and math.dist(xy[s[0]], xy[s[1]]) > 0.1 for s in sides(t))}
            if not gone:
                break
            ts, rounds[k] = ts - gone, rounds[k] + 1
        want[k] = size(ts) / whole
    assert max(rounds.values()) > 8
    assert {r["label"]: r["convexity"] for r in registry.QUERIES["convexity"](spark, sf).collect()} == pytest.approx(want, abs=1e-5)


def test_overlaps_of_all_hulls(spark, sf, tmp_path):
    import itertools

    r = np.random.default_rng(9)
    apart = [(n, float(x), float(y), k) for n, (k, x, y) in enumerate((k, *(at + s)) for k, at in enumerate([(0, 0), (9, 9), (0.4, 0.3), (9.2, 9), (-5, 0)]) for s in r.random((12, 2)))]
    placed(spark, tmp_path, apart)
    for at in (sf, str(tmp_path)):
        own = {}
        for q in fixtures.points(spark, at).collect():
            own.setdefault(q["label"], []).append((q["x"], q["y"]))
        hull = {k: kernels.convex_hull(np.array(p)) for k, p in own.items()}
        want = {(a, b): kernels.area(kernels.clip_convex(hull[a], hull[b])) for a, b in itertools.combinations(sorted(hull), 2)}
        got = registry.QUERIES["hull_overlaps"](spark, at).collect()
        assert len({(q["a"], q["b"]) for q in got}) == len(got)
        assert {(q["a"], q["b"]): q["shared"] for q in got} == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=1e-6)
