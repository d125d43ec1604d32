"""Rasters in long form (x, y, val): neighbourhood operators are joins on shifted cells, and explode only what they
read. Cells can be missing; the border rules say what stands for them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .tables import written

EIGHT = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
FOUR = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def sent(cells: DataFrame, offsets: list[tuple[int, int]], *columns: str) -> DataFrame:
    """Each cell's columns, sent to the cells around it: a row (x, y, dx, dy, n_<column>) at each receiver, where
    (dx, dy) is where the sender stands from there."""
    o = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in offsets])
    s = cells.select("x", "y", *columns, F.explode(o).alias("o"))
    return s.select((F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), *[F.col(c).alias(f"n_{c}") for c in columns])


def around(cells: DataFrame, offsets: list[tuple[int, int]], value: str, *aggregates: Column) -> DataFrame:
    """Aggregates over each existing cell's neighbours (n_<value>); cells without any keep nulls. One shuffle: what is
    sent is summed up where it arrives, with the cells themselves."""
    got = sent(cells, offsets, value).groupBy("x", "y").agg(*aggregates)
    return cells.join(got, ["x", "y"], "left")


def convolved(cells: DataFrame, kernel: dict[tuple[int, int], float], value: str = "val") -> DataFrame:
    """Zero border: what is missing adds nothing. kernel: weights by offset of the sender."""
    weights = F.create_map(*[v for (i, j), w in kernel.items() for v in (F.lit(f"{i},{j}"), F.lit(float(w)))])
    got = sent(cells, list(kernel), value)
    w = F.try_element_at(weights, F.concat_ws(",", F.col("dx").cast("string"), F.col("dy").cast("string")))
    sums = got.groupBy("x", "y").agg(F.sum(w * F.col(f"n_{value}")).alias("out"))
    return cells.join(sums, ["x", "y"], "left").select(*cells.columns, F.coalesce("out", F.lit(0.0)).alias("out"))


def gaussian(sigma: float, reach: int) -> list[float]:
    g = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [v / sum(g) for v in g]


def separable(cells: DataFrame, taps: list[float], value: str = "val") -> DataFrame:
    """Two passes of one kernel, along x and along y."""
    reach = len(taps) // 2
    first = convolved(cells, {(k - reach, 0): w for k, w in enumerate(taps)}, value).select("x", "y", F.col("out").alias("row"))
    return convolved(first, {(0, k - reach): w for k, w in enumerate(taps)}, "row").select("x", "y", "out")


def local_maxima(cells: DataFrame, strict: bool = True) -> DataFrame:
    """Cells above all (strict), or below none, of their eight neighbours."""
    m = around(cells, EIGHT, "val", F.max("n_val").alias("m"))
    keep = F.col("m").isNull() | ((F.col("val") > F.col("m")) if strict else (F.col("val") >= F.col("m")))
    return m.where(keep).select(*cells.columns)


def components_above(cells: DataFrame, threshold: float, width: int, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """x, y, component (the least index of its cells) of cells over the threshold, joined by their neighbours."""
    on = cells.where(F.col("val") > threshold).select("x", "y", (F.col("y") * width + F.col("x")).alias("i"))
    edges = sent(on, offsets or EIGHT, "i").join(on, ["x", "y"]).select(F.col("i").alias("a"), F.col("n_i").alias("b"))
    roots = graph.components(edges)
    return on.join(roots, on["i"] == roots["node"], "left").select("x", "y", F.coalesce("root", "i").alias("component"))


def lowest(at: np.ndarray, value: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each place, the least over all others of their value and the squared distance: the lower envelope of
    parabolas, in one pass over the places that have a value (at ascending), and a search. NaN without any."""
    known = ~np.isnan(value)
    q, f = at[known].astype(float), value[known]
    if not len(q):
        return np.full(len(to), np.nan)
    best, begin = [0], [-np.inf]
    for i in range(1, len(q)):
        while True:
            j = best[-1]
            meet = ((f[i] + q[i] * q[i]) - (f[j] + q[j] * q[j])) / (2 * (q[i] - q[j]))
            if meet > begin[-1]:
                break
            best.pop()
            begin.pop()
        best.append(i)
        begin.append(meet)
    k = np.array(best)[np.searchsorted(begin, to, "right") - 1]
    return f[k] + (to - q[k]) ** 2


def _along(cells: DataFrame, line: str, along: str, value: str, out: str) -> DataFrame:
    """line, along, out: `lowest` of each line of the raster, which is a task's; a line is bounded by width or height."""

    def run(batch):
        import pyarrow as pa

        x, v = batch.column(along).to_numpy(), batch.column(value).to_numpy(zero_copy_only=False).astype(float)
        order = np.argsort(x, kind="stable")
        found = lowest(x[order], v[order], x)
        return pa.table({line: batch.column(line), along: batch.column(along), out: pa.array(found, from_pandas=True)})

    kinds = dict(cells.dtypes)
    slim = cells.select(line, along, F.col(value).cast("double").alias(value))
    return slim.groupBy(line).applyInArrow(run, f"{line} {kinds[line]}, {along} {kinds[along]}, {out} double")


def distance_transform(cells: DataFrame, on: Column, width: int, height: int) -> DataFrame:
    """x, y, d2: squared Euclidean distance to the nearest cell of `on`, exactly, in two passes: along rows by the
    nearest set cell on either side (windows), then along columns by the lower envelope, in time linear in the cells."""
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy("x")
    left = F.last(F.when(on, F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(F.when(on, F.col("x")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    g = F.least(F.col("x") - left, right - F.col("x"))
    row = cells.select("x", "y", (g * g).alias("g2"))
    return _along(row, "x", "y", "g2", "d2").select("x", "y", F.round("d2").cast("long").alias("d2"))


def seeded_distance(cells: DataFrame) -> DataFrame:
    """x, y, d2: the least, over all cells with a seed, of the seed and the squared distance to it; null without any.
    cells: x, y, seed (null where there is none). Exact in two passes, rows then columns, each by a lower envelope."""
    return _along(_along(cells, "y", "x", "seed", "row"), "x", "y", "row", "d2").select("x", "y", "d2")


def city_block(cells: DataFrame, on: Column) -> DataFrame:
    """x, y, d: city-block distance to the nearest cell of `on`, by windows alone: along rows, then along columns with
    the least of g - y before and of g + y after."""
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy("x")
    left = F.last(F.when(on, F.col("x")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(F.when(on, F.col("x")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    row = cells.select("x", "y", F.least(F.col("x") - left, right - F.col("x")).alias("g"))
    c = Window.partitionBy("x").orderBy("y")
    up = F.min(F.col("g") - F.col("y")).over(c.rowsBetween(Window.unboundedPreceding, 0)) + F.col("y")
    down = F.min(F.col("g") + F.col("y")).over(c.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    return row.select("x", "y", F.least(up, down).alias("d"))


def normalised(cells: DataFrame) -> DataFrame:
    """z-scores and range scaling; the four numbers of one aggregation become literals."""
    s = cells.agg(F.avg("val").alias("mean"), F.stddev_pop("val").alias("sd"), F.min("val").alias("lo"), F.max("val").alias("hi")).first()
    n = {k: F.lit(None if s[k] is None else float(s[k])) for k in ("mean", "sd", "lo", "hi")}
    return cells.select("x", "y", F.try_divide(F.col("val") - n["mean"], n["sd"]).alias("z"), F.coalesce(F.try_divide(F.col("val") - n["lo"], n["hi"] - n["lo"]), F.lit(0.0)).alias("scaled"))
