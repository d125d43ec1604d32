"""Least paths over the ends of contour fragments that are ordered by angle about a point.

An end can be followed by another one no farther than a reach away and than an angle on, at a cost of the squared gap;
the two ends of a fragment join for nothing if they lie within the angle. A sweep relaxes all steps in one direction of
turning until nothing changes, which is what one pass over the ends in angular order does; sweeps alternate in direction
until one changes nothing. Excluded ends take no part. (Gaps of any length, as between all pairs of ends, are not
offered: steps come from a join by cells of the reach.)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graph, pairs
from .tables import let_go, written


def turned(ends: DataFrame, x: float, y: float, source: int) -> DataFrame:
    """ends with angle: how far each lies on from the source, about (x, y), from 0 to two pi. ends: node, fragment, x, y."""
    d = ends.withColumn("direction", g.direction(F.col("x"), F.col("y"), F.lit(x), F.lit(y)))
    start = d.where(F.col("node") == source).select(F.col("direction").alias("d0")).limit(1)
    return d.join(F.broadcast(start)).withColumn("angle", F.pmod(F.col("direction") - F.col("d0"), F.lit(2 * math.pi))).drop("direction", "d0")  # one row


def steps(ends: DataFrame, reach: float, angle: float, excluded: DataFrame | None = None) -> DataFrame:
    """src, dst, w, on (whether the step turns on, or stays) for steps in both directions. excluded: node."""
    e = ends if excluded is None else ends.join(excluded.select("node"), "node", "left_anti")
    near = pairs.within(e.select(F.col("node").alias("id"), "x", "y"), reach).select("a", "b", "dist")
    other = e.select(F.col("node").alias("b"), F.col("fragment").alias("f2"))
    own = e.select(F.col("node").alias("a"), F.col("fragment").alias("f1")).join(e.select(F.col("node").alias("b"), F.col("fragment").alias("f1")), "f1").where("a < b").select("a", "b", F.lit(0.0).alias("w"))
    gaps = near.join(e.select(F.col("node").alias("a"), F.col("fragment").alias("f1")), "a").join(other, "b").where("f1 <> f2").select("a", "b", (F.col("dist") * F.col("dist")).alias("w"))
    both = own.unionByName(gaps)
    both = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    at = lambda n, c: e.select(F.col("node").alias(n), F.col("angle").alias(c))
    both = both.join(at("src", "a1"), "src").join(at("dst", "a2"), "dst").where(F.abs(F.col("a2") - F.col("a1")) < angle)
    return both.select("src", "dst", "w", (F.col("a1") < F.col("a2")).alias("on"))


def swept(moves: DataFrame, source: int, sweeps: int = 1000) -> DataFrame:
    """node, dist, parent, sweep: least costs from the source, the end before, and the sweep (from 1) that settled it; 0 for
    the source. moves: as `steps` gives them."""
    spark = moves.sparkSession
    moves = written(moves, "moves")
    best = written(spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("sweep")), "swept")
    quiet = 0
    for k in range(1, sweeps + 1):
        turn = moves.where("on" if k % 2 else "NOT on").drop("on")
        found = graph.relaxed(turn, best.select("node", "dist", "parent"))
        old = best.select("node", F.col("dist").alias("d"), F.col("parent").alias("p"), F.col("sweep").alias("s"))
        same = F.col("d").isNotNull() & (F.col("dist") >= F.col("d"))
        new = written(found.join(old, "node", "left").select("node", "dist", F.when(same, F.col("p")).otherwise(F.col("parent")).alias("parent"), F.when(same, F.col("s")).otherwise(k).alias("sweep")), "swept")
        changed = not new.where(F.col("sweep") == k).isEmpty()
        let_go(best)
        best, quiet = new, 0 if changed else quiet + 1
        if quiet == 2:
            return best
    raise RuntimeError("the sweeps did not settle")
