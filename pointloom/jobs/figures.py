"""Queries of the figure kernels; each group (a contour, a polygon, a nation's graph, a raster)
is a task's, and has to fit one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import figures, kernels
from ..sources import fixtures
from .sequences import chain_codes
from .support import Registry, r

reg = Registry()


@reg.query()
def smoothed_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of relaxation in place along each contour."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        return pd.DataFrame({"contour_id": part["contour_id"], "pos": part["pos"], "y": figures.smoothed(part["y"].to_numpy(), 10, 0.5, False)})

    c = fixtures.contours(spark, sf_dir).select("contour_id", F.col("pos").cast("long").alias("pos"), "y")
    return c.groupBy("contour_id").applyInPandas(run, "contour_id long, pos long, y double").withColumn("y", r("y"))


@reg.query()
def aligned_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment costs of the step codes of neighbouring contours."""
    c = chain_codes(spark, sf_dir).groupBy("contour_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("p"))
    j = c.join(c.select((F.col("contour_id") - 1).alias("contour_id"), F.col("contour_id").alias("b"), F.col("p").alias("q")), "contour_id")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"a": b["contour_id"], "b": b["b"], "cost": [figures.alignment_cost(list(p), list(q), 1.0, 1.5) for p, q in zip(b["p"], b["q"])]})

    return j.mapInPandas(run, "a long, b long, cost double")


@reg.query()
def geometric_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles with the least squared distance to each polygon's vertices."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y, radius = figures.fitted_circle(part[["x", "y"]].to_numpy())
        return pd.DataFrame({"polygon_id": [part["polygon_id"].iloc[0]], "cx": [x], "cy": [y], "radius": [radius]})

    p = fixtures.polygons(spark, sf_dir).select("polygon_id", "x", "y")
    return p.groupBy("polygon_id").applyInPandas(run, "polygon_id int, cx double, cy double, radius double").select("polygon_id", *[r(c, 4).alias(c) for c in ("cx", "cy", "radius")])


@reg.query()
def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest flow from nations to months through segments, for each order status: capacities are order counts."""
    o, c = (fixtures.table(spark, sf_dir, t) for t in ("orders", "customer"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    e = j.groupBy("o_orderstatus", "c_nationkey", "c_mktsegment", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        segments = {s: 100 + i for i, s in enumerate(sorted(part["c_mktsegment"].unique()))}
        edges = []
        for (nation, segment), g in part.groupby(["c_nationkey", "c_mktsegment"]):
            edges.append((int(nation), segments[segment], float(g["n"].sum())))
        for (segment, m), g in part.groupby(["c_mktsegment", "m"]):
            edges.append((segments[segment], 200 + int(m), 0.5 * float(g["n"].sum())))
        for nation in part["c_nationkey"].unique():
            edges.append((-1, int(nation), 1e9))
        for m in part["m"].unique():
            edges.append((200 + int(m), 999, 1e9))
        flow, side = figures.max_flow(edges, -1, 999)
        cut = sum(w for a, b, w in edges if a in side and b not in side)
        return pd.DataFrame({"o_orderstatus": [part["o_orderstatus"].iloc[0]], "flow": [flow], "cut": [cut]})

    return e.groupBy("o_orderstatus").applyInPandas(run, "o_orderstatus string, flow double, cut double")


@reg.query()
def thinned_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground cells, thinned and traced into paths of three cells or more. The raster is one object of fixed size."""
    p = fixtures.pixels(spark, sf_dir)
    level = float(p.agg(F.avg("val") * 1.1).first()[0] or 0.0)
    p = p.withColumns({"on": F.col("val") > level, "image": F.lit(0)})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((fixtures.GRID, fixtures.GRID), bool)
        m[part["y"], part["x"]] = part["on"]
        rows = [(k, i, x, y) for k, path in enumerate(figures.traced(figures.thinned(m), 3)) for i, (x, y) in enumerate(path)]
        return pd.DataFrame(rows, columns=["path", "pos", "x", "y"])

    return p.select("image", "x", "y", "on").groupBy("image").applyInPandas(run, "path long, pos long, x long, y long")


@reg.query()
def offset_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hulls of labels, shrunk until they vanish: time, vertices and area after each vanishing side."""
    h = kernels.hulls(fixtures.points(spark, sf_dir))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ring = part.sort_values("pos")[["x", "y"]].to_numpy()
        rows = [(part["label"].iloc[0], k, t, len(s), abs(kernels.area(s))) for k, (t, s) in enumerate(figures.shrunk(ring, np.inf))]
        return pd.DataFrame(rows, columns=["label", "step", "time", "vertices", "area"])

    return h.groupBy("label").applyInPandas(run, "label int, step long, time double, vertices long, area double").select("label", "step", r("time").alias("time"), "vertices", r("area").alias("area"))


@reg.query()
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each label's mesh, merged greedily along their longest shared sides."""
    t = kernels.triangulated(fixtures.points(spark, sf_dir))
    p = fixtures.points(spark, sf_dir)
    for c in ("a", "b", "c"):
        t = t.join(p.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["a", "b", "c"]).reset_index(drop=True)
        at = {v: (x, y) for k in "abc" for v, x, y in zip(part[k], part[f"{k}x"], part[f"{k}y"])}
        tri = [tuple(x) for x in part[["a", "b", "c"]].to_numpy()]
        area = {i: abs(kernels.area(np.array([at[v] for v in x]))) for i, x in enumerate(tri)}
        faces: dict = {}
        for i, (a, b, c) in enumerate(tri):
            for e in ((a, b), (b, c), (a, c)):
                faces.setdefault(tuple(sorted(e)), []).append(i)
        sides = [(f[0], f[1], float(np.hypot(*(np.array(at[e[0]]) - at[e[1]])))) for e, f in faces.items() if len(f) == 2]
        group = figures.merged_by_fitness(area, sides, 2.5)
        return pd.DataFrame([(part["label"].iloc[0], *map(int, x), group[i]) for i, x in enumerate(tri)], columns=["label", "a", "b", "c", "region"])

    return t.groupBy("label").applyInPandas(run, "label int, a long, b long, c long, region long")


QUERIES, ORACLE_SQL = reg.queries, reg.sql
