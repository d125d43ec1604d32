"""Agglomeration against the sequential rule over all pairs; splits against numpy; lists and outlines against walks."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import fields, growth, linkage, lists, mesh, splitting
from pointloom.sources import fixtures


def sequential(rows, t):
    """(id, x, y, z) -> id: cluster, by looking at all pairs before every merge."""
    live, of = {}, {}
    for i, *p in rows:
        same = next((c for c, (_, q, _) in live.items() if q == tuple(p)), None)
        if same is None:
            live[i] = (1, tuple(p), [i])
        else:
            n, q, m = live.pop(same)
            live[min(i, same)] = (n + 1, q, [*m, i])
    while True:
        best = min(((math.dist(live[a][1], live[b][1]), a, b) for a in live for b in live if a < b), default=None)
        if best is None or best[0] >= t:
            break
        _, a, b = best
        (n, p, m), (k, q, o) = live[a], live.pop(b)
        live[a] = (n + k, tuple((n * u + k * v) / (n + k) for u, v in zip(p, q)), m + o)
    for c, (_, _, m) in live.items():
        of |= dict.fromkeys(m, c)
    return of


@pytest.mark.parametrize(("seed", "island"), [(1, 20_000), (2, 32)])
def test_agglomeration_equals_the_sequential_order(spark, seed, island):
    """With islands of any size, and with islands so small that the distance grows in steps."""
    r = random.Random(seed)
    rows = [(i, r.random(), r.random(), r.choice([0.0, 0.02, r.random() * 0.05])) for i in range(70)]
    rows += [(100 + i, *rows[i][1:]) for i in range(0, 40, 8)]  # copies
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {x["id"]: x["cluster"] for x in linkage.centroid_linkage(df.repartition(3), 0.14, island=island).collect()}
    assert got == sequential(rows, 0.14)


def test_agglomeration_of_a_crowd_writes_few_tables(spark, monkeypatch):
    """160 points, all within reach of many: as the sequential rule in one cell and in several, and few tables on the way."""
    r, made, write = random.Random(3), [], linkage.written
    rows = [(i, r.gauss(0, 0.1), r.gauss(0, 0.1), 0.0) for i in range(160)]
    df, want = spark.createDataFrame(rows, "id long, x double, y double, z double"), sequential(rows, 0.08)
    monkeypatch.setattr(linkage, "written", lambda df, name="table": made.append(name) or write(df, name))
    for island, most in ((20_000, 6), (60, 30)):
        made.clear()
        assert {x["id"]: x["cluster"] for x in linkage.centroid_linkage(df, 0.08, island=island).collect()} == want
        assert len(made) <= most


def test_agglomeration_of_a_crowd_in_cells(spark, monkeypatch):
    """3,000 points, a threshold of many spacings: cells are as wide as all only when few clusters are left."""
    r, kernel, seen = np.random.default_rng(4), linkage._kernel, spark.sparkContext.accumulator(0)
    rows = [(i, *map(float, p)) for i, p in enumerate(np.c_[r.uniform(0, 1, (3000, 2)), r.uniform(0, 0.02, 3000)])]

    def counted(*args):
        run = kernel(*args)

        def counting(key, batch):
            seen.add(int(batch.num_rows > 1200))
            return run(key, batch)

        return counting

    monkeypatch.setattr(linkage, "_kernel", counted)
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {x["id"]: x["cluster"] for x in linkage.centroid_linkage(df, 0.06, island=300).collect()}
    gone, left = linkage.merged([(i, 1, *p) for i, *p in rows], 0.06)
    to = dict(gone)

    def root(i):
        while i in to:
            i = to[i]
        return i

    assert got == {i: root(i) for i, *_ in rows} and len(left) > 50
    assert seen.value == 0


def test_levels_join_islands_that_meet():
    """One level for all, and many small ones: as one list, with extents that grow each time that islands are joined."""
    r = np.random.default_rng(9)
    rows = sorted((i, int(n), *map(float, p)) for i, (n, p) in enumerate(zip(r.integers(1, 5, 400), r.uniform(0, 1, (400, 3)) * (1, 1, 0.1))))
    want = {(x[0], x[1]) for x in linkage.merged(rows, 0.06)[1]}
    for steps in (1, 12):
        state, times = [np.array(c) for c in zip(*[x[:2] for x in rows])] + [np.array([x[2:] for x in rows])], 0
        for k in range(steps):
            *state, _, extents = linkage._level(*state, 0.06 * (k + 1) / steps)
            assert extents == sorted(extents)
            times = max(times, len(extents))
        assert set(zip(state[0].tolist(), state[1].tolist())) == want and times > 1


def test_agglomeration_of_odd_input(spark):
    schema = "id long, x double, y double, z double"
    assert linkage.centroid_linkage(spark.createDataFrame([], schema), 1.0).count() == 0
    rows = [(i, 0.5, 0.5, 0.0) for i in range(500)] + [(1000, None, 1.0, 0.0), (1001, float("nan"), 1.0, 0.0), (1002, 9.0, 9.0, 0.0)]
    got = linkage.centroid_linkage(spark.createDataFrame(rows, schema), 1.0, least=2).collect()
    assert len(got) == 500 and {(x["cluster"], x["n"]) for x in got} == {(0, 500)}


def test_a_merge_that_brings_a_third_one_near(spark):
    """The middle of two is nearer to a third than either: centroids are not monotone."""
    rows = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.5, 0.9, 0.0), (3, 5.0, 5.0, 0.0), (4, 5.6, 5.0, 0.0)]
    assert math.dist(rows[0][1:], rows[2][1:]) > 1.01
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    assert {x["id"]: x["cluster"] for x in linkage.centroid_linkage(df, 1.01).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


# --- splits -------------------------------------------------------------------


def normal(p):
    m = p.mean(0)
    return m, (p - m).T @ (p - m) / len(p)


def plain_cost(p):
    if len(p) <= 6 or np.linalg.det(normal(p)[1]) <= splitting.FLAT:
        return math.inf
    m, s = normal(p)
    d = p - m
    logs = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(s))
    return -logs.sum() + 5 + 30 / (len(p) - 6)


def pdf(p, m, s):
    d, det = p - m, np.linalg.det(s)
    return np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / (2 * math.pi * math.sqrt(det)) if det > 0 else np.zeros(len(p))


def halves(p, updates, tolerance):
    m, s = normal(p)
    theta = math.atan2(2 * s[0, 1], s[0, 0] - s[1, 1]) / 2
    step = math.sqrt(max(np.linalg.eigvalsh(s)[1], 0)) * np.array([math.cos(theta), math.sin(theta)])
    c = [m - step, m + step]
    for _ in range(100):
        second = ((p - c[1]) ** 2).sum(1) < ((p - c[0]) ** 2).sum(1)
        new = [p[~second].mean(0) if (~second).any() else c[0], p[second].mean(0) if second.any() else c[1]]
        moved = sum(np.linalg.norm(a - b) for a, b in zip(c, new))
        c = new
        if moved <= tolerance:
            break
    second = ((p - c[1]) ** 2).sum(1) < ((p - c[0]) ** 2).sum(1)
    model = [normal(p[~second]), normal(p[second])]
    for _ in range(updates):
        a, b = (pdf(p, *x) for x in model)
        w = np.divide(b, a + b, out=np.zeros(len(p)), where=a + b > 0)
        model = []
        for v in (np.divide(a, a + b, out=np.zeros(len(p)), where=a + b > 0), w):
            mu = (v[:, None] * p).sum(0) / v.sum()
            model.append((mu, (v[:, None] * (p - mu)).T @ (p - mu) / v.sum()))
    a, b = (pdf(p, *x) for x in model)
    return b > a


def plain_split(ids, p, path, out):
    if len(p) >= 10 and plain_cost(p) < math.inf:
        h = halves(p, 2, 1e-4)
        if plain_cost(p) > plain_cost(p[~h]) + plain_cost(p[h]):
            plain_split(ids[~h], p[~h], path + "0", out)
            plain_split(ids[h], p[h], path + "1", out)
            return
    out.update(dict.fromkeys(ids.tolist(), path))


def test_recursive_splits(spark):
    r = np.random.default_rng(5)
    groups = {1: np.concatenate([r.normal(m, s, (60, 2)) for m, s in (((0, 0), 0.3), ((4, 0), 0.5), ((2, 5), 0.2))]), 2: r.normal(0, 1, (40, 2)), 3: r.normal(0, 1, (7, 2)), 4: np.repeat([[1.0, 2.0]], 30, 0)}
    rows, want, n = [], {}, 0
    for k, p in groups.items():
        ids = np.arange(n, n + len(p))
        n += len(p)
        rows += [(k, int(i), float(x), float(y)) for i, (x, y) in zip(ids, p)]
        plain_split(ids, p, "", want)
    df = spark.createDataFrame(rows, "grp long, id long, x double, y double")
    got = {x["id"]: x["path"] for x in splitting.recursive_split(df, tolerance=1e-4).collect()}
    assert got == want and len({p for i, p in want.items() if i < 180}) >= 3
    once = {x["id"]: x["path"] for x in splitting.elongation_split(df, tolerance=1e-4).collect()}
    for k, p in groups.items():
        ids = [x[1] for x in rows if x[0] == k]
        ev = np.linalg.eigvalsh(normal(p)[1])
        split = len(p) >= 10 and ev[0] > 0 and ev[1] / ev[0] < 8
        assert [once[i] for i in ids] == [str(int(h)) for h in halves(p, 2, 1e-4)] if split else {once[i] for i in ids} == {""}
    assert splitting.recursive_split(df.limit(0)).count() == 0


def test_a_split_computes_its_points_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(n):
        made.add(1)
        return n

    r = np.random.default_rng(6)
    rows = [(1, i, *map(float, r.normal(0, 1, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "grp long, id long, x double, y double").withColumn("id", F.udf(seen, "long")("id"))
    assert splitting.elongation_split(df, tolerance=1e-4).count() == 60
    assert made.value == 60


# --- lists, outlines, growth, radii --------------------------------------------


def test_lists_against_walks(spark):
    r = random.Random(2)
    ring, chain = r.sample(range(1000), 700), r.sample(range(2000, 3000), 500)
    rows = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]])] + [(a, b) for a, b in zip(chain, [*chain[1:], None])] + [(5000, 5000), (5001, None), (5002, 9999)]
    got = {x["node"]: (x["list"], x["pos"], x["closed"]) for x in lists.ranked(spark.createDataFrame(rows, "node long, next long")).collect()}
    k = ring.index(min(ring))
    want = {ring[(k + i) % 700]: (min(ring), i, True) for i in range(700)} | {c: (chain[0], i, False) for i, c in enumerate(chain)}
    assert got == want | {5000: (5000, 0, True), 5001: (5001, 0, False), 5002: (5002, 0, False)}
    assert lists.ranked(spark.createDataFrame([], "node long, next long")).count() == 0


@pytest.mark.parametrize("ranges", [1000, 60, 7])
def test_lists_over_several_ranges(spark, monkeypatch, ranges):
    """Names in the order of the lists and against it: rings and lists of several parts in a range, and of several ranges."""
    monkeypatch.setattr(lists, "RANGE", ranges)
    r = random.Random(7)
    names = [*range(100, 160), *range(400, 340, -1), *(r.randrange(1000, 2000) for _ in range(30))]
    names = list(dict.fromkeys(names))
    r.shuffle(cuts := [k for k in range(10, len(names), 10)])
    rows, want, at = [], {}, 0
    for k, to in enumerate(sorted([*cuts, len(names)])):
        part, at = names[at:to], to
        if k % 4 == 3:
            r.shuffle(part)
        ring = k % 2 == 0
        rows += list(zip(part, [*part[1:], part[0] if ring else None]))
        if ring:
            i = part.index(min(part))
            part = part[i:] + part[:i]
        want |= {n: (part[0], p, ring) for p, n in enumerate(part)}
    long = list(range(3000, 3200))
    r.shuffle(long)
    rows += list(zip(long, [*long[1:], 9999]))
    want |= {n: (long[0], p, False) for p, n in enumerate(long)}
    wide = list(range(5000, 5100, 2)) + list(range(5099, 5000, -2))
    rows += list(zip(wide, [*wide[1:], wide[0]]))
    want |= {n: (5000, p, True) for p, n in enumerate(wide)}
    r.shuffle(rows)
    got = {x["node"]: (x["list"], x["pos"], x["closed"]) for x in lists.ranked(spark.createDataFrame(rows, "node long, next long")).collect()}
    assert got == want


def test_outlines_write_boundary_edges_only(spark, sf, monkeypatch):
    """No table on the way has more rows than the boundary has edges; in ranges of a few edges, the same rings."""
    seen, write = [], lists.written

    def counted(df, name="table"):
        table = write(df, name)
        seen.append(table.count())
        return table

    want = {tuple(x) for x in mesh.outlines(fixtures.mesh(spark, sf)).collect()}
    monkeypatch.setattr(lists, "written", counted)
    assert {tuple(x) for x in mesh.outlines(fixtures.mesh(spark, sf)).collect()} == want
    assert max(seen) <= len(want) < 3 * fixtures.mesh(spark, sf).count() / 2
    monkeypatch.setattr(lists, "RANGE", 200)
    assert {tuple(x) for x in mesh.outlines(fixtures.mesh(spark, sf), 5).collect()} == want
    assert max(seen) <= len(want)


def test_outlines_against_a_walk(spark, sf):
    faces = fixtures.mesh(spark, sf).collect()
    half = {}
    for f in faces:
        v = (f["v1"], f["v2"], f["v3"])
        for i in range(3):
            half[v[i], v[(i + 1) % 3]] = (v[(i + 1) % 3], v[(i + 2) % 3])
    border = {h for h in half if (h[1], h[0]) not in half}

    def follow(h):
        n = half[h]
        while n not in border:
            n = half[n[1], n[0]]
        return n

    want, left = {}, set(border)
    while left:
        start = min(left)
        h, pos = start, 0
        while h in left:
            left.discard(h)
            want[h] = (start, pos)
            h, pos = follow(h), pos + 1
    got = {(x["vertex"], x["to"]): ((x["ring"] >> 32, x["ring"] & (2**32 - 1)), x["pos"]) for x in mesh.outlines(fixtures.mesh(spark, sf)).collect()}
    assert got == want


def test_growth_against_a_walk(spark):
    r = random.Random(8)
    links = {(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(130)) if a != b}
    height = {i: r.randrange(9) for i in range(60)}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    sources = [(r.randrange(60), s) for s in (1, 2, 3)]

    def walk(starts):
        found, front, time = {n: (None, 0) for n in starts}, set(starts), 0
        while front:
            time += 1
            sent = defaultdict(set)
            for u in front:
                for v in near[u] - found.keys():
                    if all(height[q] <= height[u] for q in near[v] | {v}):
                        sent[v].add(u)
            found |= {v: (min(u), time) for v, u in sent.items()}
            front = set(sent)
        return found

    l_, n_ = spark.createDataFrame(list(links), "a long, b long"), spark.createDataFrame(list(height.items()), "node long, height long")
    s_ = spark.createDataFrame(sources, "node long, source long")
    got = {(x["source"], x["node"]): (x["parent"], x["time"]) for x in growth.grown(l_, n_, s_).collect()}
    assert got == {(s, v): t for n, s in sources for v, t in walk([n]).items()}
    shared = {x["node"]: (x["parent"], x["time"]) for x in growth.grown(l_, n_, s_, apart=False).collect()}
    assert shared == walk({n for n, _ in sources})


def test_radii_of_many_orders(spark):
    r = random.Random(4)
    left = [(i, r.random(), r.random(), 10 ** r.uniform(-4, 0)) for i in range(120)] + [(500, 0.5, 0.5, 0.0), (501, None, 0.5, 1.0), (502, 0.5, 0.5, None)]
    right = [(i, r.random(), r.random()) for i in range(150)] + [(900, None, 0.1), (901, left[0][1], left[0][2])]
    a, b = spark.createDataFrame(left, "id long, x double, y double, radius double"), spark.createDataFrame(right, "id long, x double, y double")
    got = sorted((x["id"], x["r_id"]) for x in fields.within_radius(a, b).collect())
    assert got == sorted((i, j) for i, x, y, d in left if None not in (x, y, d) and d > 0 for j, u, v in right if u is not None and math.dist((x, y), (u, v)) <= d)
    assert fields.within_radius(a.limit(0), b).count() == 0


def test_a_chain_takes_few_rounds(spark):
    from pointloom.operators import graph

    up = spark.range(1, 600).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = graph.traced(up, rounds=10)
    assert got.count() == 599 * 600 // 2 and got.where("child - ancestor <> steps").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        graph.traced(up.unionByName(spark.range(1).selectExpr("0L AS child", "599L AS parent")))


def test_sweeps_against_a_sequential_one(spark):
    """Alternating sweeps over ends by angle: distances, the sweeps that settle them, excluded ends, and the paths' costs."""
    from pointloom.operators import angular

    r = random.Random(6)
    ends = [(2 * f + k, f, *(c + r.gauss(0, 0.4) for c in p)) for f in range(14) for p in [(r.uniform(-3, 3), r.uniform(-3, 3))] for k in (0, 1)]
    df = spark.createDataFrame(ends, "node long, fragment long, x double, y double")
    out = {4, 9}
    moves = angular.steps(angular.turned(df, 0.0, 0.0, 0), 2.5, 1.2, spark.createDataFrame([(i,) for i in out], "node long"))
    got = {x["node"]: (x["dist"], x["parent"], x["sweep"]) for x in angular.swept(moves, 0).collect()}
    at = {n: (f, x, y) for n, f, x, y in ends}
    turn = {n: (math.atan2(y, x) - math.atan2(ends[0][3], ends[0][2])) % (2 * math.pi) for n, _, x, y in ends}

    def cost(a, b):
        (f, *p), (g, *q) = at[a], at[b]
        return 0.0 if f == g else math.dist(p, q) ** 2

    links = [(a, b) for a in at for b in at if a != b and not {a, b} & out and abs(turn[a] - turn[b]) < 1.2 and (at[a][0] == at[b][0] or math.dist(at[a][1:], at[b][1:]) <= 2.5)]
    best, quiet, k = {0: (0.0, 0)}, 0, 0
    while quiet < 2:
        k += 1
        changed, moved = False, True
        while moved:
            moved = False
            for a, b in links:
                if (turn[a] < turn[b]) == (k % 2 == 1) and a in best and best[a][0] + cost(a, b) < best.get(b, (math.inf,))[0] - 1e-12:
                    best[b] = (best[a][0] + cost(a, b), k)
                    moved = changed = True
        quiet = 0 if changed else quiet + 1
    assert got.keys() == best.keys() and len(got) > 10
    for n, (d, parent, s) in got.items():
        assert abs(d - best[n][0]) < 1e-9 and s == best[n][1]
        assert n == 0 or ((parent, n) in links and abs(got[parent][0] + cost(parent, n) - d) < 1e-9)
