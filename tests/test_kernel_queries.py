"""Every query without SQL runs, with the invariants that its result must have."""

import math
from collections import Counter

import pytest

from pointloom.jobs import registry
from pointloom.sources import fixtures

WITHOUT = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.fixture(scope="module")
def found(spark, sf):
    return {name: registry.QUERIES[name](spark, sf).collect() for name in WITHOUT}


def test_all_give_rows(found):
    assert [name for name, rows in found.items() if not rows] == []


def test_mesh_edges_are_those_of_the_triangles(spark, sf, found):
    """Sides of triangles with their number of faces; of each label, vertices - edges + faces = 1."""
    sides = Counter((r["label"], u, v) for r in found["delaunay_triangles"] for u, v in ((r["a"], r["b"]), (r["b"], r["c"]), (r["a"], r["c"])))
    assert {(r["label"], r["u"], r["v"]): r["faces"] for r in found["mesh_edges"]} == sides
    assert all((r["kind"] == "boundary") == (r["faces"] == 1) and r["faces"] <= 2 for r in found["mesh_edges"])
    xy = {r["id"]: (r["x"], r["y"]) for r in fixtures.points(spark, sf).collect()}
    assert all(abs(r["length"] - math.dist(xy[r["u"]], xy[r["v"]])) < 1e-5 for r in found["mesh_edges"])
    for label in {r["label"] for r in found["delaunay_triangles"]}:
        faces = [r for r in found["delaunay_triangles"] if r["label"] == label]
        vertices = {r[c] for r in faces for c in "abc"}
        assert len(vertices) - sum(k[0] == label for k in sides) + len(faces) == 1


def test_triangles_cover_the_polygons(spark, sf, found):
    rings = {}
    for r in fixtures.polygons(spark, sf).orderBy("polygon_id", "pos").collect():
        rings.setdefault(r["polygon_id"], []).append((r["x"], r["y"]))
    for k, ring in rings.items():
        own = [r for r in found["polygon_triangles"] if r["polygon_id"] == k]
        whole = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
        if own and own[0]["complete"]:
            assert len(own) == len(ring) - 2 and abs(sum(r["area"] for r in own) - whole) < 1e-4


def test_assignment_is_one_to_one(found):
    rows = found["label_assignment"]
    assert len({r["a"] for r in rows}) == len({r["b"] for r in rows}) == len(rows)


def test_motion_groups_have_their_least_point_as_root(spark, sf):
    rows = {r["id"]: r["motion"] for r in registry.QUERIES["motion_groups"](spark, sf).collect()}
    least = {}
    for i, root in rows.items():
        least[root] = min(i, least.get(root, i))
    assert all(root == k for root, k in least.items())


def test_convexity_is_a_share(found):
    assert all(0 <= r["convexity"] <= 1 for r in found["convexity"])
