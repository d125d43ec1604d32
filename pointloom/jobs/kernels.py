"""Queries of the geometry kernels, with SQL where it can say them; tests/test_kernel_queries.py has the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..sources import fixtures
from .support import Registry, r, rs, with_sql

reg = Registry()


@reg.query(f"""{with_sql('points')}, e AS (SELECT p.label, p.x, p.y FROM points p JOIN points o ON p.label = o.label AND p.id <> o.id
 WHERE NOT EXISTS (SELECT 1 FROM points r WHERE r.label = p.label AND (o.x-p.x)*(r.y-p.y)-(o.y-p.y)*(r.x-p.x) < 0)),
m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM e GROUP BY label), a AS (SELECT e.label, x, y, atan2(y-cy, x-cx) AS t FROM e JOIN m ON e.label = m.label),
b AS (SELECT *, first_value(t) OVER (PARTITION BY label ORDER BY x, y) AS t0 FROM a)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN t >= t0 THEN t - t0 ELSE t - t0 + 2*pi() END) AS pos, {rs('x')} AS x, {rs('y')} AS y FROM b""")
def convex_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull vertices of each label's points, counter-clockwise."""
    return kernels.hulls(fixtures.points(spark, sf_dir)).select("label", "pos", r("x").alias("x"), r("y").alias("y"))


@reg.query(f"""{with_sql('points')} SELECT a.label, a.id FROM points a WHERE EXISTS (SELECT 1 FROM range(720) t(k) WHERE a.x*cos(k*pi()/360)+a.y*sin(k*pi()/360) >= (SELECT max(b.x*cos(k*pi()/360)+b.y*sin(k*pi()/360)) FROM points b WHERE b.label = a.label))""")
def extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that lie farthest in one of 720 directions, of each label."""
    p = fixtures.points(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(719))).alias("k")
    d = p.select("label", "id", "x", "y", k).withColumn("v", F.col("x") * F.cos(F.col("k") * np.pi / 360) + F.col("y") * F.sin(F.col("k") * np.pi / 360))
    best = d.groupBy("label", "k").agg(F.max_by("id", "v").alias("id"))
    return best.select("label", "id").distinct()


@reg.query()
def delaunay_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.triangulated(fixtures.points(spark, sf_dir))


@reg.query()
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique edges of the triangulations with their faces and kinds, and lengths."""
    p = fixtures.points(spark, sf_dir)
    t = kernels.triangulated(p)
    side = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")))).alias("e")
    e = t.select("label", side).groupBy("label", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count("*").alias("faces"))
    e = e.join(p.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(p.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    return e.select("label", "u", "v", "faces", F.when(F.col("faces") == 1, "boundary").otherwise("inside").alias("kind"), r(F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))).alias("length"))


@reg.query()
def polygon_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ear clipping: triangles of each polygon by vertex positions, with their areas, and whether they cover all of it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        ring = part[["x", "y"]].to_numpy()
        found = kernels.ear_clipped(ring)
        rows = [(part["polygon_id"].iloc[0], a + 1, b + 1, c + 1, abs(kernels.area(ring[[a, b, c]])), len(found) == len(ring) - 2) for a, b, c in found]
        return pd.DataFrame(rows, columns=["polygon_id", "a", "b", "c", "area", "complete"])

    return fixtures.polygons(spark, sf_dir).groupBy("polygon_id").applyInPandas(run, "polygon_id int, a long, b long, c long, area double, complete boolean").withColumn("area", r("area"))


@reg.query()
def hull_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that the hulls of any two labels share, where they do. Hulls meet in the grid cells of their boxes; the cell
    of the lower corner of what two boxes share has the pair."""
    h = kernels.hulls(fixtures.points(spark, sf_dir)).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("ring"))  # a hull's vertices
    bounds = [F.expr(f"array_{f}(transform(ring, v -> v.{c}))").alias(f"{c}{k}") for c in "xy" for f, k in (("min", 1), ("max", 2))]
    cell = lambda c: F.floor(c * 4)
    span = lambda c: F.explode(F.sequence(cell(F.col(f"{c}1")), cell(F.col(f"{c}2"))))
    box = h.select("label", *bounds).withColumn("i", span("x")).withColumn("j", span("y"))
    two = box.select(F.col("label").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x1", "x2", "y1", "y2")], "i", "j")
    near = box.join(two, ["i", "j"]).where("label < other AND x1 <= ox2 AND ox1 <= x2 AND y1 <= oy2 AND oy1 <= y2")
    near = near.where((F.col("i") == cell(F.greatest("x1", "ox1"))) & (F.col("j") == cell(F.greatest("y1", "oy1")))).select("label", "other")
    pairs = near.join(h, "label").join(h.select(F.col("label").alias("other"), F.col("ring").alias("ring2")), "other")

    def run(batches):
        for b in batches:
            rows = []
            for label, other, one, two in zip(b["label"], b["other"], b["ring"], b["ring2"]):
                p, q = (np.array([(v["x"], v["y"]) for v in ring]) for ring in (one, two))
                rows.append((label, other, kernels.area(kernels.clip_convex(p, q)), kernels.area(p), kernels.area(q)))
            yield pd.DataFrame(rows, columns=["a", "b", "shared", "area_a", "area_b"])

    return pairs.mapInPandas(run, "a int, b int, shared double, area_a double, area_b double").where("shared > 0").select("a", "b", *[r(c).alias(c) for c in ("shared", "area_a", "area_b")])


def _pairs_of_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring contours, each as an array of its points in order."""
    c = fixtures.contours(spark, sf_dir).groupBy("contour_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return c.join(c.select((F.col("contour_id") - 1).alias("contour_id"), F.col("contour_id").alias("other"), F.col("p").alias("q")), "contour_id")


@reg.query()
def warped_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic time warping of neighbouring contours."""

    def run(batches):
        for b in batches:
            rows = [(i, j, kernels.warped_cost(*(np.array([(v["x"], v["y"]) for v in s]) for s in (p, q)))) for i, j, p, q in zip(b["contour_id"], b["other"], b["p"], b["q"])]
            yield pd.DataFrame(rows, columns=["a", "b", "cost"])

    return _pairs_of_contours(spark, sf_dir).mapInPandas(run, "a long, b long, cost double").select("a", "b", r("cost", 4).alias("cost"))


@reg.query()
def affine_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affine maps between neighbouring contours."""

    def run(batches):
        for b in batches:
            rows = []
            for i, j, p, q in zip(b["contour_id"], b["other"], b["p"], b["q"]):
                m = kernels.fitted_affine(*(np.array([(v["x"], v["y"]) for v in s]) for s in (p, q)))
                rows.append((i, j, *m.ravel()))
            yield pd.DataFrame(rows, columns=["a", "b", "m11", "m12", "m13", "m21", "m22", "m23"])

    got = _pairs_of_contours(spark, sf_dir).mapInPandas(run, "a long, b long, m11 double, m12 double, m13 double, m21 double, m22 double, m23 double")
    return got.select("a", "b", *[r(f"m{i}{j}", 4).alias(f"m{i}{j}") for i in (1, 2) for j in (1, 2, 3)])


@reg.query()
def label_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the even points matched to centroids of the odd ones, with the least total distance."""
    p = fixtures.points(spark, sf_dir)
    c = p.groupBy("label", (F.col("id") % 2).alias("half")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    a, b = c.where("half = 0").select(F.lit(0).alias("problem"), F.col("label").alias("a"), "x", "y"), c.where("half = 1").select(F.lit(0).alias("problem"), F.col("label").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    costs = a.join(b, "problem").withColumn("cost", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = part.pivot(index="a", columns="b", values="cost").fillna(1e9)
        turned = m.shape[0] > m.shape[1]
        to = kernels.assigned((m.T if turned else m).to_numpy())
        rows = [(m.index[j], m.columns[i], m.iat[j, i]) if turned else (m.index[i], m.columns[j], m.iat[i, j]) for i, j in enumerate(to)]
        return pd.DataFrame(rows, columns=["a", "b", "cost"])

    return costs.groupBy("problem").applyInPandas(run, "a int, b int, cost double").select("a", "b", r("cost").alias("cost"))


@reg.query(f"""{with_sql('contours')}, s AS (SELECT contour_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy FROM contours GROUP BY contour_id)
SELECT contour_id, {rs('(n*sxy-sx*sy)/(n*sxx-sx*sx)', 5)} AS slope, {rs('(sy-(n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n', 4)} AS level FROM s WHERE n*sxx-sx*sx > 0""")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares through each contour: normal equations from sums, solved in the expression."""
    s = fixtures.contours(spark, sf_dir).groupBy("contour_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    s = s.where("n*sxx-sx*sx > 0").withColumn("k", F.expr("(n*sxy-sx*sy)/(n*sxx-sx*sx)"))
    return s.select("contour_id", r("k", 5).alias("slope"), r(F.expr("(sy-k*sx)/n"), 4).alias("level"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
