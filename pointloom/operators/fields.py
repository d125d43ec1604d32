"""Joins whose reach is a column, and sums of decaying fields over them.

Each left row searches cells of its own size: the power of two at or above its radius. A right row stands in its cell of
every size that occurs, which is one row for each binary order of magnitude between the least and the greatest radius.
Nothing farther than a cell away is ever paired, however much the radii differ. Dense cells are skewed keys of an inner
join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Radii below this many binary orders of magnitude of the greatest share one cell size.
ORDERS = 40


def _levels(left: DataFrame, radius: str) -> list[int]:
    """The binary orders of magnitude that occur; one aggregate."""
    level = F.ceil(F.log2(radius)).cast("int")
    found = [r[0] for r in left.where(F.col(radius) > 0).select(level.alias("l")).distinct().collect() if r[0] is not None]  # as many as orders
    return sorted({max(x, max(found) - ORDERS) for x in found})


def within_radius(left: DataFrame, right: DataFrame, radius: str = "radius", strict: bool = False) -> DataFrame:
    """Pairs of a left row (id, x, y, radius, ...) and a right one (id, x, y, ...) no farther than the left one's radius:
    left columns as they are, right ones with r_, and dist. Rows without a position or a positive radius pair with
    nothing. strict: nearer than the radius."""
    levels = _levels(left, radius)
    low = levels[0] if levels else 0
    step = lambda level: F.pow(F.lit(2.0), level)
    a = left.where(F.col(radius) > 0).withColumn("_l", F.greatest(F.ceil(F.log2(radius)).cast("int"), F.lit(low)))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.withColumn("_o", around).withColumns({"_i": F.floor(F.col("x") / step(F.col("_l"))) + F.col("_o.i"), "_j": F.floor(F.col("y") / step(F.col("_l"))) + F.col("_o.j")}).drop("_o")
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels or [0]])))
    b = b.withColumns({"_i": F.floor(F.col("r_x") / step(F.col("_l"))), "_j": F.floor(F.col("r_y") / step(F.col("_l")))})
    met = a.join(b, ["_l", "_i", "_j"]).drop("_l", "_i", "_j").withColumn("dist", g.distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y")))
    return met.where((F.col("dist") < F.col(radius)) if strict else (F.col("dist") <= F.col(radius)))


def dipole(mag: Column, theta: Column, sigma: Column, dx: Column, dy: Column, beta: float) -> Column:
    """A dipole's field at (dx, dy) from it: strongest along theta, falling off with the angle and the distance."""
    s = F.sin(F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(dy, dx)) - theta)
    return mag * F.exp(-beta * s * s - (dx * dx + dy * dy) / (2 * sigma * sigma))


def beside_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Pairs of a point (id, x, y) and a segment (segment, ax, ay, bx, by) no farther apart than reach, where the foot of
    the point falls on the segment: id, segment, dist, side (above 0: left of a to b). A segment stands in the cells of
    size reach that it comes near; it is cut into parts of that length for it, so its cells follow its length."""
    cell = lambda c: F.floor(c / reach).cast("long")
    length = g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    s = segments.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(length / reach).cast("int"))))
    part = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("_k") * reach, length), F.lit(0.0)))
    s = s.withColumns({"_x": F.col("ax") + part * (F.col("bx") - F.col("ax")), "_y": F.col("ay") + part * (F.col("by") - F.col("ay"))})
    # A point near the segment is within 1.5 reach of one of these places: two cells around are enough.
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    s = s.withColumn("_o", around).withColumns({"_i": cell(F.col("_x")) + F.col("_o.i"), "_j": cell(F.col("_y")) + F.col("_o.j")}).drop("_o", "_k", "_x", "_y").distinct()
    p = points.select("id", "x", "y", cell(F.col("x")).alias("_i"), cell(F.col("y")).alias("_j"))
    t = g.line_parameter(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
    d = g.line_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
    side = g.cross(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
    met = p.join(s, ["_i", "_j"]).where((t >= 0) & (t <= 1)).withColumns({"dist": d, "side": F.signum(side)})
    return met.where(F.col("dist") <= reach).drop("_i", "_j")


def votes(pairs: DataFrame, step: tuple[float, float, float], sigma: tuple[float, float, float], reach: float = 3.0) -> DataFrame:
    """i, j, k, vote: Gaussian votes of (mx, my, z) on a grid of the given steps, each cut off at reach deviations along
    every axis. A pair sends to the grid places in its box only, a stated number at most."""
    grid = pairs
    for c, n, h, s in zip(("mx", "my", "z"), ("i", "j", "k"), step, sigma):
        span = F.sequence(F.ceil((F.col(c) - reach * s) / h).cast("long"), F.floor((F.col(c) + reach * s) / h).cast("long"))
        grid = grid.withColumn(n, F.explode(span))
    power = sum(((F.col(n) * h - F.col(c)) * (F.col(n) * h - F.col(c)) / (2 * s * s) for c, n, h, s in zip(("mx", "my", "z"), ("i", "j", "k"), step, sigma)), F.lit(0.0))
    return grid.groupBy("i", "j", "k").agg(F.sum(F.exp(-power)).alias("vote"))
