"""Clusters split in two by a mixture of two normals, as long as a criterion gains by it. All clusters that are open are
fitted together: an iteration is one aggregation keyed by cluster, so that neither many small nor one huge cluster is a
special case. Cluster models are rows of a table, joined to the points; of the points only sums leave the tasks.

points: grp, id, x, y. A cluster is a group and a path of halves ('0' or '1' for each split).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .tables import Growing, let_go, written

#: Parameters of a normal in the plane; the size up to which a part is no cluster; determinants below are flat.
PARAMETERS, TOO_FEW, FLAT = 5, 6, 1e-18
KEY = ["grp", "path"]


def _moments(weight: Column, tag: str) -> list[Column]:
    parts = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    return [F.sum(weight * e).alias(f"{tag}_{c}") for c, e in parts.items()]


def _normal(tag: str) -> list[Column]:
    """Mean and population covariance out of the sums; null where there is no weight."""
    n, x, y, xx, xy, yy = (F.col(f"{tag}_{c}") for c in ("n", "x", "y", "xx", "xy", "yy"))
    mx, my = F.try_divide(x, n), F.try_divide(y, n)
    out = {"mx": mx, "my": my, "xx": F.try_divide(xx, n) - mx * mx, "xy": F.try_divide(xy, n) - mx * my, "yy": F.try_divide(yy, n) - my * my}
    return [e.alias(f"{tag}{c}") for c, e in out.items()]


def _density(tag: str) -> Column:
    c = {k: F.col(f"{tag}{k}") for k in ("mx", "my", "xx", "xy", "yy")}
    return F.coalesce(g.gaussian_pdf2(F.col("x") - c["mx"], F.col("y") - c["my"], c["xx"], c["xy"], c["yy"]), F.lit(0.0))


def cost(tag: str) -> Column:
    """Corrected information criterion of a normal fitted to its own points, by its covariance; infinite for few points
    or none, and where they lie on a line."""
    n, det = F.col(f"{tag}_n"), F.col(f"{tag}xx") * F.col(f"{tag}yy") - F.col(f"{tag}xy") * F.col(f"{tag}xy")
    fit = n / 2 * (2 * math.log(2 * math.pi) + F.log(det) + 2)
    k = PARAMETERS
    return F.when((F.coalesce(n, F.lit(0.0)) <= TOO_FEW) | (F.coalesce(det, F.lit(0.0)) <= FLAT), F.lit(math.inf)).otherwise(fit + k + k * (k + 1) / (n - k - 1))


def elongation(tag: str) -> Column:
    """The larger eigenvalue of the covariance by the smaller; infinite on a line."""
    big, small = g.eigen2(F.col(f"{tag}xx"), F.col(f"{tag}xy"), F.col(f"{tag}yy"))
    return F.when(small <= 0, F.lit(math.inf)).otherwise(F.try_divide(big, small))


def _halved(points: DataFrame, nodes: DataFrame, updates: int, tolerance: float, most: int) -> DataFrame:
    """points of the nodes with half (0 or 1), as a written table. k-means from two seeds, a deviation to either side
    along the main axis of the cluster, until the centres move by no more than the tolerance in all (of at most `most`
    rounds); then `updates` rounds of expectation and maximisation."""
    theta = F.atan2(2 * F.col("wxy"), F.col("wxx") - F.col("wyy")) / 2
    spread = F.sqrt(F.greatest(g.eigen2(F.col("wxx"), F.col("wxy"), F.col("wyy"))[0], F.lit(0.0)))
    centres = nodes.select(*KEY, *[(F.col(f"wm{c}") + s * spread * f(theta)).alias(f"{k}m{c}") for k, s in (("a", -1), ("b", 1)) for c, f in (("x", F.cos), ("y", F.sin))], F.lit(False).alias("still"))
    centres = written(centres, "centres")
    nearer = lambda k: (F.col("x") - F.col(f"{k}mx")) ** 2 + (F.col("y") - F.col(f"{k}my")) ** 2
    second = F.coalesce(nearer("b"), F.lit(math.inf)) < F.coalesce(nearer("a"), F.lit(math.inf))
    for _ in range(most):
        half = points.join(centres.where("NOT still").select(*KEY, "amx", "amy", "bmx", "bmy"), KEY)
        sums = half.groupBy(*KEY).agg(*[m for k, w in (("a", ~second), ("b", second)) for m in _moments(w.cast("double"), k)[:3]])
        moved = sums.select(*KEY, *[F.try_divide(F.col(f"{k}_{c}"), F.col(f"{k}_n")).alias(f"n{k}{c}") for k in "ab" for c in "xy"])
        step = sum((F.coalesce(g.distance(F.col(f"{k}mx"), F.col(f"{k}my"), F.col(f"n{k}x"), F.col(f"n{k}y")), F.lit(0.0)) for k in "ab"), F.lit(0.0))
        new = centres.join(moved, KEY, "left").select(*KEY, *[F.coalesce(f"n{k}{c}", f"{k}m{c}").alias(f"{k}m{c}") for k in "ab" for c in "xy"], (F.col("still") | (step <= tolerance)).alias("still"))
        new = written(new, "centres")
        let_go(centres)
        centres = new
        if centres.where("NOT still").isEmpty():
            break
    near = points.join(centres, KEY)
    weights = {"a": (~second).cast("double"), "b": second.cast("double")}
    models = written(near.groupBy(*KEY).agg(*_moments(weights["a"], "a"), *_moments(weights["b"], "b")).select(*KEY, *_normal("a"), *_normal("b")), "models")
    for _ in range(updates):
        near = points.join(models, KEY).withColumns({"pa": _density("a"), "pb": _density("b")})
        share = lambda k: F.coalesce(F.try_divide(F.col(f"p{k}"), F.col("pa") + F.col("pb")), F.lit(0.0))
        new = written(near.groupBy(*KEY).agg(*_moments(share("a"), "a"), *_moments(share("b"), "b")).select(*KEY, *_normal("a"), *_normal("b")), "models")
        let_go(models)
        models = new
    half = F.when(_density("b") > _density("a"), "1").otherwise("0")
    return written(points.join(models, KEY).select(*KEY, "id", "x", "y", half.alias("half")), "halves")


def _fitted(points: DataFrame) -> DataFrame:
    """grp, path and the normal (w...) of each cluster."""
    return points.groupBy(*KEY).agg(*_moments(F.lit(1.0), "w")).select(*KEY, "w_n", *_normal("w"))


def recursive_split(points: DataFrame, min_size: int = 10, updates: int = 2, tolerance: float = 0.1, most: int = 100) -> DataFrame:
    """grp, path, id, x, y: clusters of min_size points or more are split in two while the halves' criteria add up to
    less than their own. Levels of the tree are rounds."""
    live = written(points.select("grp", F.lit("").alias("path"), "id", "x", "y"), "open")
    done = Growing(live.limit(0), "closed")
    while not live.isEmpty():
        nodes = written(_fitted(live), "nodes")
        wide = nodes.where((F.col("w_n") >= min_size) & (cost("w") < math.inf))
        open_ = written(live.join(wide.select(*KEY), KEY, "left_semi"), "wide")
        halves = _halved(open_, wide, updates, tolerance, most)
        let_go(open_)
        parts = halves.groupBy(*KEY).agg(*[m for k in "ab" for m in _moments((F.col("half") == ("0" if k == "a" else "1")).cast("double"), k)])
        parts = parts.select(*KEY, "a_n", "b_n", *_normal("a"), *_normal("b")).join(nodes, KEY)
        gain = written(parts.where(cost("w") > cost("a") + cost("b")).select(*KEY), "gain")
        done.add(live.join(gain, KEY, "left_anti"))
        new = written(halves.join(gain, KEY).select("grp", F.concat("path", "half").alias("path"), "id", "x", "y"), "open")
        let_go(live, nodes, halves, gain)
        live = new
    return done.table()


def elongation_split(points: DataFrame, min_size: int = 10, t: float = 8.0, updates: int = 2, tolerance: float = 0.1, most: int = 100) -> DataFrame:
    """grp, path, id, x, y: clusters of min_size points or more that are less elongated than t are split once."""
    live = written(points.select("grp", F.lit("").alias("path"), "id", "x", "y"), "open")
    round_ = written(_fitted(live).where((F.col("w_n") >= min_size) & (elongation("w") < t)), "nodes")
    wide = written(live.join(round_.select(*KEY), KEY, "left_semi"), "wide")
    halves = _halved(wide, round_, updates, tolerance, most)
    let_go(wide)
    return live.join(round_.select(*KEY), KEY, "left_anti").unionByName(halves.select("grp", F.col("half").alias("path"), "id", "x", "y"))


def main_axes(points: DataFrame) -> DataFrame:
    """grp, path, n, x1, y1, x2, y2: a deviation to either side of the mean along the main axis of each cluster."""
    theta = F.atan2(2 * F.col("wxy"), F.col("wxx") - F.col("wyy")) / 2
    spread = F.sqrt(F.greatest(g.eigen2(F.col("wxx"), F.col("wxy"), F.col("wyy"))[0], F.lit(0.0)))
    ends = [(F.col(f"wm{c}") + s * spread * f(theta)).alias(f"{c}{k}") for k, s in ((1, -1), (2, 1)) for c, f in (("x", F.cos), ("y", F.sin))]
    return _fitted(points).select(*KEY, F.col("w_n").cast("long").alias("n"), *ends)
