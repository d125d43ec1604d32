"""Figure kernels, sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import figures, kernels
from pointloom.sources import fixtures, io
from pointloom.streaming import running


def test_smoothing():
    line = np.arange(10.0)
    assert figures.smoothed(line, 5, 0.5, False) == pytest.approx(line)
    v = figures.smoothed(np.array([0.0, 1, 0, 1, 0]), 200, 0.5, True)
    assert np.ptp(v) < 1e-3


def test_alignment():
    assert figures.alignment_cost([1, 2, 3], [1, 2, 3], 1, 1.5) == 0
    assert figures.alignment_cost([1, 2, 3], [1, 3], 1, 1.5) == 1
    assert figures.alignment_cost([], [1, 2], 1, 1.5) == 2


def test_circle_fit():
    t = np.linspace(0, 5, 40)
    got = figures.fitted_circle(np.column_stack([3 + 2 * np.cos(t), -1 + 2 * np.sin(t)]))
    assert got == pytest.approx((3, -1, 2), abs=1e-5)


def test_flow_equals_cut():
    edges = [(0, 1, 3.0), (0, 2, 2.0), (1, 2, 5.0), (1, 3, 2.0), (2, 3, 3.0)]
    flow, side = figures.max_flow(edges, 0, 3)
    assert flow == 5 and flow == sum(c for a, b, c in edges if a in side and b not in side)
    assert figures.max_flow([(0, 1, 1.0)], 0, 9)[0] == 0


def test_flows_equal_cuts(spark, sf):
    from pointloom.jobs.figures import order_flows

    for r in order_flows(spark, sf).collect():
        assert r["flow"] == pytest.approx(r["cut"])


def test_thinning_and_tracing():
    m = np.zeros((20, 30), bool)
    m[8:12, 3:27] = True
    t = figures.thinned(m)
    assert t.sum() < m.sum() / 3 and not (t & ~m).any()
    paths = figures.traced(t, 5)
    assert len(paths) == 1 and len(paths[0]) == t.sum()
    assert figures.traced(np.zeros((3, 3), bool), 1) == []


def test_square_shrinks_to_its_middle():
    steps = figures.shrunk(np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]]), np.inf)
    assert steps[-1][0] == pytest.approx(1.0) and len(steps[-1][1]) == 0
    half = figures.shrunk(np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]]), 0.5)
    assert kernels.area(half[-1][1]) == pytest.approx(1.0)
    three = figures.shrunk(np.array([[0.0, 0], [3, 0], [0, 4]]), np.inf)
    assert three[-1][0] == pytest.approx(1.0)  # the inner circle's radius
    for (t0, a), (t1, b) in zip(steps, steps[1:]):
        assert t0 <= t1 and (len(b) == 0 or kernels.area(b) <= kernels.area(a))


def test_regions_merge():
    got = figures.merged_by_fitness({0: 1.0, 1: 1.0, 2: 1.0}, [(0, 1, 5.0), (1, 2, 0.1)], 1.0)
    assert got == {0: 0, 1: 0, 2: 2}


# --- sources ----------------------------------------------------------------


def test_graph_text(spark, tmp_path):
    (tmp_path / "g.txt").write_text("3\n10 20 30\n2\n10 20 1.5\n20 30 2\n")
    v, e = io.read_graph(spark, str(tmp_path / "g.txt"))
    assert {r["key"] for r in v.collect()} == {"10", "20", "30"}
    assert {tuple(r) for r in e.collect()} == {("10", "20", 1.5), ("20", "30", 2.0)}
    (tmp_path / "bad.txt").write_text("1\n10\n1\n10 99 1\n")
    with pytest.raises(Exception, match="unknown vertex"):
        io.read_graph(spark, str(tmp_path / "bad.txt"))[1].collect()


def test_zero_based(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert tuple(io.zero_based(e, "src", "dst").first()) == (0, 1)
    with pytest.raises(Exception, match="below 1"):
        io.zero_based(spark.createDataFrame([(0, 2)], "src long, dst long"), "src", "dst").collect()


def test_point_and_image_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# 2\n1 2\n3 4\n5 6\n")
    assert [(r["x"], r["y"]) for r in io.read_point_file(spark, str(tmp_path / "p.txt")).orderBy("pos").collect()] == [(2.0, 1.0), (4.0, 3.0)]
    cells = spark.createDataFrame([(x, y, x + 3 * y) for x in range(3) for y in range(2)], "x long, y long, val long")
    text = io.grey_text(cells, 3, 2).first()["text"]
    assert text == "P2\n3 2\n255\n0 51 102\n153 204 255\n"
    (tmp_path / "i.pgm").write_text(text)
    assert {(r["x"], r["y"]): r["val"] for r in io.read_grey(spark, str(tmp_path / "i.pgm")).collect()}[2, 1] == 255


def test_points_of_any_table(spark, tmp_path):
    spark.createDataFrame([(1, 2, "z")], "u int, v int, w string").write.parquet(str(tmp_path / "t"))
    assert tuple(io.read_points(spark, str(tmp_path / "t")).select("x", "y").first()) == (1.0, 2.0)


# --- streams ----------------------------------------------------------------


def test_running_lengths(spark, sf, tmp_path):
    e = fixtures.table(spark, sf, "events").select(F.col("user_id").alias("contour_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("y"))
    half = e.agg(F.percentile_approx("ts", 0.5)).first()[0]
    e.where(F.col("ts") <= half).coalesce(1).write.parquet(str(tmp_path / "in"))
    e.where(F.col("ts") > half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running.running_lengths(stream).writeStream.format("memory").queryName("lengths").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["contour_id"]: r for r in spark.sql("SELECT contour_id, max(steps) AS steps, max(length) AS length FROM lengths GROUP BY 1").collect()}
    from pointloom.jobs.aggregates import arc_lengths

    for r in arc_lengths(spark, sf).collect():
        if r["steps"]:
            assert got[r["contour_id"]]["steps"] == r["steps"] and got[r["contour_id"]]["length"] == pytest.approx(r["length"], abs=1e-3)


def test_windowed_moments(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.col("user_id").alias("contour_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"))
    got = running.windowed_moments(e, "1 day")  # the same plan, on a table
    assert got.agg(F.sum("n")).first()[0] == e.count()
