"""Operators that SQL does not say: against small brute-force versions and invariants; and odd input."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import clustering, graph, kernels, pairs, raster
from pointloom.sources import fixtures


def frame(spark, rows, schema="id long, x double, y double"):
    return spark.createDataFrame(rows, schema)


# --- pairs ------------------------------------------------------------------


def test_pairs_match_brute_force(spark):
    r = np.random.default_rng(1)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(0, 1, (150, 2)))]
    p += [(200, 0.0, 0.0), (201, 0.0, 0.0), (202, None, 1.0)]
    assert pairs.within(frame(spark, p), 0.2, parts=4).count() == pairs.within(frame(spark, p), 0.2).count()
    got = {(r["a"], r["b"]) for r in pairs.within(frame(spark, p), 0.2).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(p, 2) if None not in (a[1], b[1]) and math.dist(a[1:], b[1:]) <= 0.2}
    assert got == want and (200, 201) in got


def test_pairs_of_nothing(spark):
    none = frame(spark, [])
    assert pairs.within(none, 1.0).count() == 0
    assert clustering.single_linkage(none, 1.0).count() == 0
    assert clustering.single_linkage(frame(spark, [(1, 0.0, 0.0)]), 1.0).collect()[0]["cluster"] == 1


def test_nearest_centre_ties(spark):
    got = pairs.nearest_centre(frame(spark, [(1, 0.0, 0.0)]), [(0, 1.0, 0.0), (1, -1.0, 0.0)]).collect()[0]
    assert got["k"] == 0 and got["dist"] == 1.0


# --- graphs -----------------------------------------------------------------


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def test_shortest_paths_and_parents(spark):
    e = edges(spark, [(1, 2, 4.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, -1.0), (5, 6, 1.0)])
    got = {r["node"]: (r["dist"], r["parent"]) for r in graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long"), 10).collect()}
    assert got == {1: (0.0, None), 3: (1.0, 1), 2: (2.0, 3), 4: (1.0, 2)}


def test_paths_of_any_length(spark, tmp_path):
    import heapq

    from pointloom.jobs import clusters

    line = [(i, i, 1.0) for i in range(1, 9)] + [(i + 1, i, 1.0) for i in range(1, 9)] + [(6, 1, 40.0), (9, 20, 3.0)]
    spark.createDataFrame(line, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 10)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    near = {}
    for p, q, w in line:
        near.setdefault(p, []).append((-q, w))
        near.setdefault(-q, []).append((p, w))
    for name, cost in (("shortest_paths", lambda w: w), ("breadth_first", lambda w: 1)):
        want, heap = {}, [(0, 1)]
        while heap:
            d, a = heapq.heappop(heap)
            if a not in want:
                want[a] = d
                for b, w in near[a]:
                    heapq.heappush(heap, (d + cost(w), b))
        assert max(want.values()) > 8
        assert {r[0]: r[1] for r in clusters.QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_loops_end_empty_or_raise(spark):
    one = spark.createDataFrame([(0,)], "node long")
    line = edges(spark, [(i, i + 1, 1.0) for i in range(9)] + [(0, 9, 50.0)])
    assert {r["node"]: r["dist"] for r in graph.shortest_paths(line, one).collect()} == {i: i for i in range(10)}
    assert {r["node"]: r["hops"] for r in graph.breadth_first(line.where("w < 50"), one).collect()} == {i: i for i in range(10)}
    with pytest.raises(ValueError):
        graph.shortest_paths(line, one, 4)
    with pytest.raises(ValueError):
        graph.shortest_paths(edges(spark, [(0, 1, 1.0), (1, 0, -2.0)]), one)
    up = spark.createDataFrame([(i, i + 1) for i in range(5)], "child long, parent long")
    assert graph.traced(up).count() == 15
    with pytest.raises(ValueError):
        graph.traced(up, 2)
    with pytest.raises(ValueError):
        graph.traced(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"))


def kruskal(rows):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    total, n = 0.0, 0
    for s, d, w in sorted(rows, key=lambda e: e[2]):
        if find(s) != find(d):
            root[find(s)] = find(d)
            total, n = total + w, n + 1
    return total, n


def test_spanning_forest(spark, sf):
    e = fixtures.edges(spark, sf)
    got = graph.spanning_forest(e).collect()
    total, n = kruskal([(r["src"], r["dst"], r["w"]) for r in e.collect()])
    assert len(got) == n and sum(r["w"] for r in got) == pytest.approx(total)


def test_cycles_are_refused(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)])
    with pytest.raises(ValueError):
        graph.longest_ranks(e.select("src", "dst"))


def test_strong_components(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 4, 1.0), (6, 6, 1.0)])
    got = {r["node"]: r["root"] for r in graph.strong_components(e).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(7, 7)], "a long, b long")
    assert {r["root"] for r in graph.components(e).collect()} == {0}


# --- clustering -------------------------------------------------------------


def test_kmeans_drops_empty_centres(spark):
    p = frame(spark, [(i, float(i % 2) * 10, 0.0) for i in range(10)])
    centres, got = clustering.kmeans(p, [(0, 0), (10, 0), (99, 99)], 5)
    assert [c[1:] for c in centres] == [(0.0, 0.0), (10.0, 0.0)]
    assert {r["id"] % 2: r["k"] for r in got.collect()} == {0: 0, 1: 1}


# --- rasters ----------------------------------------------------------------


def test_distance_transforms(spark):
    r = np.random.default_rng(3)
    on = r.random((9, 12)) > 0.85
    cells = spark.createDataFrame([(x, y, int(on[y, x])) for y in range(9) for x in range(12)], "x long, y long, val long")
    ys, xs = np.nonzero(on)
    square = {(q["x"], q["y"]): q["d2"] for q in raster.distance_transform(cells, F.col("val") > 0, 12, 9).collect()}
    block = {(q["x"], q["y"]): q["d"] for q in raster.city_block(cells, F.col("val") > 0).collect()}
    for y in range(9):
        for x in range(12):
            assert square[x, y] == ((xs - x) ** 2 + (ys - y) ** 2).min()
            assert block[x, y] == (abs(xs - x) + abs(ys - y)).min()


def test_convolution_sums(spark):
    cells = spark.createDataFrame([(x, y, float(x == 2 and y == 2)) for x in range(5) for y in range(5)], "x long, y long, val double")
    taps = raster.gaussian(1.0, 2)
    got = raster.separable(cells, taps).collect()
    assert sum(r["out"] for r in got) == pytest.approx(1.0)
    assert {(r["x"], r["y"]): r["out"] for r in got}[2, 2] == pytest.approx(taps[2] ** 2)


# --- kernels ----------------------------------------------------------------


def test_hull_holds_all_points():
    p = np.random.default_rng(4).normal(0, 1, (200, 2))
    h = kernels.convex_hull(p)
    assert kernels.area(h) > 0
    for a, b in zip(h, np.roll(h, -1, 0)):
        d = b - a
        assert (d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0]) >= -1e-12).all()
    assert len(kernels.convex_hull(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 2


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(5).random((80, 2))
    t = kernels.delaunay(p)
    centre, r2 = kernels._circles(p, t)
    for c, r in zip(centre, r2):
        assert (((p - c) ** 2).sum(1) >= r * (1 - 1e-9)).all()
    assert sum(abs(kernels.area(p[x])) for x in t) == pytest.approx(kernels.area(kernels.convex_hull(p)), rel=1e-3)
    twice = np.vstack([p[:10], p[:10]])
    assert len(kernels.delaunay(twice)) == len(kernels.delaunay(p[:10]))
    assert len(kernels.delaunay(p[:2])) == 0


def test_ears_cover_the_polygon():
    ell = np.array([[0.0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3]])
    for ring in (ell, ell[::-1]):
        t = kernels.ear_clipped(ring)
        assert len(t) == 4 and sum(abs(kernels.area(ring[list(x)])) for x in t) == pytest.approx(5.0)


def test_clipping():
    a = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    assert kernels.area(kernels.clip_convex(a, a + 1)) == pytest.approx(1.0)
    assert len(kernels.clip_convex(a, a + 5)) == 0


def test_assignment_is_optimal():
    r = np.random.default_rng(6)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        c = r.random((n, m))
        to = kernels.assigned(c)
        best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(to)) == n and c[np.arange(n), to].sum() == pytest.approx(best)


def test_warping():
    a = np.random.default_rng(7).random((20, 2))
    assert kernels.warped_cost(a, a) == 0
    assert kernels.warped_cost(a, np.repeat(a, 2, 0)) == pytest.approx(0)
    assert kernels.warped_cost(a, a + 1) == pytest.approx(kernels.warped_cost(a + 1, a))


def test_affine_fit():
    a = np.random.default_rng(8).random((30, 2))
    m = np.array([[1.0, 0.5, 3], [-0.2, 2, 1]])
    assert kernels.fitted_affine(a, a @ m[:, :2].T + m[:, 2]) == pytest.approx(m)


def test_grouped_hulls_equal_whole_hulls(spark, sf):
    p = fixtures.points(spark, sf)
    got = kernels.hulls(p).toPandas()
    for label, own in p.toPandas().groupby("label"):
        want = kernels.convex_hull(own[["x", "y"]].to_numpy())
        assert np.allclose(got[got.label == label].sort_values("pos")[["x", "y"]].to_numpy(), want)


def test_sign_of_the_visual_angle(spark):
    """Hand-worked: from (0, 0), (0, 1) lies counter-clockwise of (1, 0), and (0, -1) clockwise of it."""
    from pointloom.functions import geometry as g

    rows = [(1.0, 0.0, 0.0, 1.0, -math.pi / 2), (1.0, 0.0, 0.0, -1.0, math.pi / 2), (1.0, 0.0, -2.0, 0.0, math.pi), (1.0, 0.0, 3.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, want double")
    c = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    for r in d.select("want", g.signed_visual_angle(*c, F.lit(0.0), F.lit(0.0)).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 1e-6
