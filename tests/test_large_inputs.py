"""Results that only larger or other tables show, against DuckDB on the same tables, and operators against plain loops."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointloom.jobs import motion, registry, triples
from pointloom.operators import blocks, clustering, graph, growth, mesh, tables
from pointloom.sources import fixtures


def agrees(spark, folder, name):
    """The rows of a query, which must be those of its SQL."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, str(folder))
    want = c.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(x) for x in df.columns]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    return got


@pytest.mark.parametrize("name", ["city_block_transform", "distance_transform"])
def test_distances_without_a_foreground(name, spark, tmp_path):
    even = [(x, y) for x in range(64) for y in range(64)]
    pq.write_table(pa.table({"l_partkey": [x for x, _ in even], "l_suppkey": [y for _, y in even]}), tmp_path / "lineitem.parquet")
    assert agrees(spark, tmp_path, name) == []


def embedded(folder, places, labels=None):
    """Embeddings that begin with the given places."""
    columns = {"vec_id": pa.array(range(len(places)), pa.int64()), "embedding": pa.array([list(p) for p in places], pa.list_(pa.float32())), "label": pa.array(labels or [4] * len(places), pa.int32())}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")


def test_triples_with_straight_and_short_arms(spark, tmp_path):
    """Arms that are opposite but for 5e-6, and arms shorter than 1e-5."""
    embedded(tmp_path, [(0.0, 0.0), (-0.01, 0.0), (0.01, 5e-8), (0.001, 0.004), (0.2, 0.2), (0.199999, 0.200004), (0.2003, 0.2), (0.2005, 0.2002)])
    got = agrees(spark, tmp_path, "met_by_first")
    assert got


def test_labels_of_a_crowd(spark, tmp_path, monkeypatch):
    """Points in blocks of a few; what supports a triple comes out of blocks, and no pairs of points are joined."""
    monkeypatch.setattr(blocks, "BLOCK", 9)
    places = np.random.default_rng(12).normal(0, 0.03, (90, 2)).astype(np.float32).tolist()
    embedded(tmp_path, places + places[:3])
    assert len({x[-1] for x in agrees(spark, tmp_path, "triple_labels")}) > 20
    t = tables.written(triples.triples(fixtures.points(spark, str(tmp_path))))
    plan = triples.supporters(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroups") == 1 and "sqrt" not in plan.lower()


def test_labels_keep_no_supporters(spark, tmp_path, monkeypatch):
    """200 points near each other: supporters from the front are many times the triples, and no table holds them."""
    embedded(tmp_path, np.random.default_rng(13).uniform(0, 0.03, (200, 2)).astype(np.float32).tolist())
    seen, write = [], triples.written

    def counted(df, name="table"):
        table = write(df, name)
        seen.append(table.count())
        return table

    monkeypatch.setattr(triples, "written", counted)
    assert len({x["prob"] for x in registry.QUERIES["triple_labels"](spark, str(tmp_path)).collect()}) > 20
    t = triples.triples(fixtures.points(spark, str(tmp_path)))
    assert max(seen) <= t.count() + 200 < triples.supporters(t).count() / 5


def test_sums_of_velocities_that_all_agree(spark, tmp_path):
    """A crowd in a few cells, with some points far out: sums over powers of velocities are those of one pair at a time."""
    rng = np.random.default_rng(14)
    places = np.concatenate([rng.normal(0, 0.02, (500, 2)), rng.uniform(-0.15, 0.15, (120, 2))]).astype(np.float32).tolist()
    embedded(tmp_path, places + places[:3], rng.integers(0, 10, 623).tolist())
    c = motion.candidates(spark, str(tmp_path))
    c = c.withColumn("prob", F.rand(3) + 0.1)
    c = tables.written(c)
    got, want = ({(x["a"], x["b"]): (x["s"], x["dx"], x["dy"]) for x in f(c).collect()} for f in (motion.sums, motion.supported))
    assert got.keys() == want.keys() and len(got) > 5000
    assert all(abs(u - v) <= 1e-12 * w[0] for k, w in want.items() for u, v in zip(got[k], w))
    longest = {x["a"]: x["v"] for x in c.groupBy("a").agg(F.max(F.hypot("vx", "vy")).alias("v")).collect()}
    assert 100 < sum(v < motion.SIGMA / 2**0.5 for v in longest.values()) < len(longest) - 100
    assert agrees(spark, tmp_path, "velocity_relaxation")


@pytest.fixture
def crowd():
    """Points in few cells, with copies, and two without a place."""
    rng = np.random.default_rng(5)
    p = [(n, float(x), float(y)) for n, (x, y) in enumerate(rng.uniform(0, 0.5, (120, 2)))]
    return p + [(n + 500, x, y) for n, x, y in p[:9]] + [(900, None, 0.1), (901, float("nan"), 0.1)]


def test_blocks_against_loops(spark, crowd, monkeypatch):
    """In blocks of at most seven points, what all pairs give."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    df, t = spark.createDataFrame(crowd, "id long, x double, y double"), 0.06
    at = {n: (x, y) for n, x, y in crowd if n < 900}
    near = {a: sorted((math.dist(at[a], at[b]), b) for b in at if b != a and math.dist(at[a], at[b]) <= t) for a in at}
    got = {}
    for x in blocks.nearest(df, t, 3).orderBy("a", "rank").collect():
        got.setdefault(x["a"], []).append(x["b"])
    assert got == {a: [b for _, b in v[:3]] for a, v in near.items() if v}
    assert {x["node"]: x["height"] for x in blocks.neighbours(df, t).collect()} == {a: len(v) for a, v in near.items()}
    two = {a: {b for _, b in v} | {c for _, b in v for _, c in near[b]} - {a} for a, v in near.items()}
    assert {x["id"]: x["n"] for x in blocks.two_steps(df, t).collect()} == {a: len(v) for a, v in two.items() if v}
    held = df.withColumn("height", F.col("id") % 10)
    best = {a: max(((b % 10, -b) for _, b in v if b % 10 > a % 10), default=None) for a, v in near.items()}
    assert {x["node"]: x["parent"] for x in blocks.highest(held, t).collect()} == {a: -m[1] for a, m in best.items() if m}


def test_links_that_a_block_keeps(spark, monkeypatch):
    """300 points within reach of each other are joined by fewer rows than pairs, and are one cluster."""
    monkeypatch.setattr(blocks, "BLOCK", 60)
    df = spark.createDataFrame([(n, n / 1e5, 0.0) for n in range(300)], "id long, x double, y double")
    assert blocks.linked(df, 0.03).count() < 3000  # of 44,850
    assert {x["cluster"] for x in clustering.single_linkage(df, 0.03).collect()} == {0}


def test_pair_degrees_against_loops(spark, crowd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    t, at = 0.06, {n: (x, y) for n, x, y in crowd if n < 900}
    near = {a: {b for b in at if math.dist(at[a], at[b]) <= t} for a in at}  # with itself
    links = {(a, b) for a in at for b in near[a] if a < b}
    want = {(a, b): len({(min(c, d), max(c, d)) for c in near[a] for d in near[b] if (min(c, d), max(c, d)) in links} - {(a, b)}) for a, b in links}
    df = spark.createDataFrame(crowd, "id long, x double, y double")
    assert {(x["a"], x["b"]): x["n"] for x in blocks.pair_degrees(df, t).collect()} == {p: n for p, n in want.items() if n}


def test_blocks_are_dealt_over_many_tasks(spark, crowd):
    """Blocks take different times: each shuffle partition's share goes to several tasks (one task each before)."""
    df = spark.createDataFrame(crowd, "id long, x double, y double")
    assert all(f(df, 0.06).rdd.getNumPartitions() >= 16 for f in (blocks.pair_degrees, blocks.neighbours, lambda p, t: blocks.pair_cores(p, t, 0.8, 0.5)))


def core_or_not(at, t, parallel, across, some):
    """Of some pairs (a < b) whether they are cores, by looks at all pairs. at: places by id."""
    ids = sorted(at)
    p = np.array([at[n] for n in ids])
    near = np.array([[math.dist(u, v) <= t for v in p] for u in p])
    c, d = np.nonzero(np.triu(near, 1))
    turn, size = np.arctan2(*(p[d] - p[c]).T[::-1]), np.array([math.dist(p[i], p[j]) for i, j in zip(c, d)])
    middle = (p[c] + p[d]) / 2
    found = {}
    for a, b in some:
        i, j = ids.index(a), ids.index(b)
        on = (near[i, c] & near[j, d]) | (near[i, d] & near[j, c])
        on &= ~((c == i) & (d == j))
        theta = np.arctan2(*(p[j] - p[i])[::-1])
        way = middle - (p[i] + p[j]) / 2
        far = np.hypot(*way.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            sine = (math.cos(theta) * way[:, 1] - math.sin(theta) * way[:, 0]) / far
        on &= (far > 0) & (np.abs(np.cos(theta - turn)) > parallel) & (np.abs(sine) > across)
        found[a, b] = bool((sine[on] > 0).any() and (sine[on] < 0).any() and not (size[on] > math.dist(p[i], p[j])).any())
    return found


def test_pair_cores_against_loops(spark, crowd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    t, at = 0.06, {n: (x, y) for n, x, y in crowd if n < 900}
    links = [(a, b) for a in at for b in at if a < b and math.dist(at[a], at[b]) <= t]
    want = {p for p, core in core_or_not(at, t, 0.8, 0.5, links).items() if core}
    found = blocks.pair_cores(spark.createDataFrame(crowd, "id long, x double, y double"), t, 0.8, 0.5)
    assert {(x["a"], x["b"]) for x in found.collect()} == want and want
    linked = blocks.linked_pairs(found.withColumn("id", F.col("a") * (1 << 31) + F.col("b")), t)
    near = lambda u, v: math.dist(at[u], at[v]) <= t
    touch = {(p, q) for p in want for q in want if p != q and ((near(p[0], q[0]) and near(p[1], q[1])) or (near(p[0], q[1]) and near(p[1], q[0])))}
    got = {tuple((x[c] >> 31, x[c] & (2**31 - 1)) for c in "ab") for x in linked.collect()}
    assert got <= touch

    def parts(links):
        of = {p: p for p in want}
        for _ in want:
            for p, q in links:
                of[p] = of[q] = min(of[p], of[q])
        return of

    assert parts(got) == parts(touch)


@pytest.mark.parametrize("name", ["pair_cores", "core_groups"])
def test_cores_of_a_crowd(name, spark, tmp_path):
    """400 points within reach of each other: 79,800 pairs, all of them neighbours, so 6.4 billion pairs of pairs."""
    rng = np.random.default_rng(8)
    places = rng.uniform(0, 0.02, (400, 2)).astype(np.float32)
    embedded(tmp_path, places.tolist())
    at = dict(enumerate(places.astype(float)))
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "core_groups":
        assert len(got) == 1 and got[0]["n"] >= 1
        return
    got = {(x["a"], x["b"]) for x in got}
    some = [*got, *((a, b) for a in range(0, 400, 40) for b in range(a + 1, 400, 37))]
    assert got and core_or_not(at, 0.03, 0.8, 0.5, some) == {p: p in got for p in some}


def test_lattice_tasks_grow_with_the_line_items(spark, sf, monkeypatch):
    """The tasks that count cells, and all that is made of them there, are as many as the line items ask for."""
    _, cells = fixtures.lattice(spark, sf)
    want = sorted(tuple(r) for r in cells.collect())
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(fixtures, "TASK", n // 9)
    _, cells = fixtures.lattice(spark, sf)
    assert cells.rdd.getNumPartitions() >= 9  # of 4 otherwise
    assert sorted(tuple(r) for r in cells.collect()) == want


def test_textures_at_the_borders_of_tiles(spark, tmp_path):
    """Cells at the borders and corners of tiles, and few others; each cell is shuffled to its tiles only."""
    rng = np.random.default_rng(3)
    edge = [(x, y) for x in (0, 1, 61, 62, 63, 64, 65, 66, 127) for y in (0, 2, 62, 63, 64, 65, 127)]
    rows = edge * 5 + [tuple(map(int, p)) for p in rng.integers(0, 128, (16500, 2))]
    pq.write_table(pa.table({"l_partkey": [x for x, _ in rows], "l_suppkey": [y for _, y in rows]}), tmp_path / "lineitem.parquet")
    assert agrees(spark, tmp_path, "texture_bands")
    plan = registry.QUERIES["texture_bands"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the cells


@pytest.mark.parametrize("name", ["triples_of_points", "pair_metrics", "ordered_pairs"])
def test_pairs_are_unpacked_where_they_are(name, spark, tmp_path, monkeypatch):
    """Points in blocks and pieces of a few; between the blocks and the rows nothing is joined, sorted or shuffled."""
    monkeypatch.setattr(blocks, "BLOCK", 9)
    monkeypatch.setattr(blocks, "PIECE", 20)
    rng = np.random.default_rng(11)
    places = rng.normal(0, 0.03, (90, 2)).astype(np.float32).tolist()
    embedded(tmp_path, places + places[:3])
    assert len(agrees(spark, tmp_path, name)) > 500
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapGroups")
    assert len(above) == 2 and not any(x in above[0] for x in ("Join", "Sort", "Repartition", "Aggregate"))


def test_path_searches_make_their_edges_once(spark, monkeypatch):
    """A line of 12 nodes takes 12 rounds; its edges are computed once, and read from several buckets."""
    monkeypatch.setattr(tables, "BUCKET", 4)
    made = spark.sparkContext.accumulator(0)

    def seen(n):
        made.add(1)
        return n

    line = spark.range(1, 12).select("id").repartition(2).select(F.udf(seen, "long")("id").alias("src"), (F.col("id") + 1).alias("dst"))
    source = spark.createDataFrame([(1,)], "node long")
    assert {r["node"]: r["hops"] for r in graph.breadth_first(line, source).collect()} == {n: n - 1 for n in range(1, 13)}
    assert made.value == 11


def counted(spark, df, key):
    """df, and how often its rows are computed."""
    made = spark.sparkContext.accumulator(0)

    def seen(n):
        made.add(1)
        return n

    return df.withColumn(key, F.udf(seen, "long")(key)), made


def test_growth_joins_links_with_heights_once(spark):
    links, made = counted(spark, spark.createDataFrame([(n, n + 1) for n in range(8)], "a long, b long"), "a")
    nodes = spark.createDataFrame([(n, h) for n, h in enumerate((5, 5, 3, 2, 1, 2, 4, 4, 4))], "node long, height long")
    around = growth.surveyed(links.repartition(2), nodes)
    n = made.value
    top = growth.peaks(links, nodes, around)
    assert {(r["node"], r["source"]) for r in top.collect()} == {(0, 0), (1, 0), (6, 6), (7, 6), (8, 6)}
    found = growth.grown(links, nodes, top, apart=False, around=around).collect()
    assert {(r["node"], r["source"], r["time"]) for r in found if r["time"]} == {(2, 0, 1), (3, 0, 2), (5, 6, 1), (4, 6, 2)}
    assert made.value == n


def test_similar_faces_read_the_mesh_twice(spark):
    """Two faces on a long diagonal, and one beside them: once for the sides, once for the faces returned."""
    faces = [(0, 1, 0.0, 0.0, 2, 1.0, 0.0, 3, 1.0, 1.0), (1, 1, 0.0, 0.0, 3, 1.0, 1.0, 4, 0.0, 1.0), (5, 2, 1.0, 0.0, 5, 2.0, 0.0, 3, 1.0, 1.0)]
    columns = "face long, " + ", ".join(f"v{n} long, x{n} double, y{n} double" for n in (1, 2, 3))
    df, made = counted(spark, spark.createDataFrame(faces, columns), "face")
    assert {(r["face"], r["label"]) for r in mesh.similar(df, 0.8).collect()} == {(0, 0), (1, 0), (5, 5)}
    assert made.value == 6
