"""Image operators on the raster of line items: rotation, polar gradients, oriented filters, suppression, clustering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from ..sources import fixtures
from .support import Registry, big, r, rs, with_sql

reg = Registry()
G = fixtures.GRID
ANGLE = 0.3
_C, _S = math.cos(ANGLE), math.sin(ANGLE)


@reg.query(f"""{with_sql('pixels')}, m AS (SELECT x, y, 31.5 + (x-31.5)*{_C!r} + (y-31.5)*{_S!r} AS u, 31.5 - (x-31.5)*{_S!r} + (y-31.5)*{_C!r} AS v FROM pixels),
n AS (SELECT x, y, CAST(floor(u) AS BIGINT) AS i, CAST(floor(v) AS BIGINT) AS j, u - floor(u) AS a, v - floor(v) AS b FROM m)
SELECT n.x, n.y, {rs('sum(p.val * CASE WHEN p.x = i THEN 1 - a ELSE a END * CASE WHEN p.y = j THEN 1 - b ELSE b END)', 5)} AS val
FROM n JOIN pixels p ON p.x IN (i, i + 1) AND p.y IN (j, j + 1) GROUP BY n.x, n.y HAVING count(*) = 4""")
def rotated_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned about the middle, bilinear; cells that would reach outside are left out."""
    p = fixtures.pixels(spark, sf_dir)
    h = (G - 1) / 2
    u = h + (F.col("x") - h) * _C + (F.col("y") - h) * _S
    v = h - (F.col("x") - h) * _S + (F.col("y") - h) * _C
    m = p.select(F.col("x").alias("tx"), F.col("y").alias("ty"), u.alias("u"), v.alias("v"))
    i, j, a, b = F.floor("u"), F.floor("v"), F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    four = F.array(*[F.struct((i + di).cast("long").alias("x"), (j + dj).cast("long").alias("y"), ((a if di else 1 - a) * (b if dj else 1 - b)).alias("w")) for di in (0, 1) for dj in (0, 1)])
    want = m.select("tx", "ty", F.explode(four).alias("s")).select("tx", "ty", "s.x", "s.y", "s.w")
    got = want.join(p, ["x", "y"]).groupBy("tx", "ty").agg(F.sum(F.col("w") * F.col("val")).alias("val"), F.count("*").alias("n"))
    return got.where("n = 4").select(F.col("tx").alias("x"), F.col("ty").alias("y"), r("val", 5).alias("val"))


_GRAD = """g AS (SELECT a.x, a.y, coalesce(sum(b.val * (b.x - a.x)), 0) / 6.0 AS gx, coalesce(sum(b.val * (b.y - a.y)), 0) / 6.0 AS gy FROM pixels a LEFT JOIN pixels b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.x, a.y)"""


def gradients(p: DataFrame) -> DataFrame:
    got = raster.sent(p, raster.EIGHT, "val").groupBy("x", "y").agg(*[(F.sum(F.col("n_val") * F.col(d)) / 6.0).alias(n) for d, n in (("dx", "gx"), ("dy", "gy"))])
    return p.join(got, ["x", "y"], "left").select("x", "y", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("gx", "gy")])


@reg.query(f"{with_sql('pixels')}, {_GRAD} SELECT x, y, {rs('sqrt(gx*gx+gy*gy)')} AS magnitude, {rs('CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE atan2(gy, gx) END')} AS theta FROM g")
def polar_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = gradients(fixtures.pixels(spark, sf_dir))
    gx, gy = F.col("gx"), F.col("gy")
    return q.select("x", "y", r(F.sqrt(gx * gx + gy * gy)).alias("magnitude"), r(F.when((gx == 0) & (gy == 0), 0.0).otherwise(F.atan2(gy, gx))).alias("theta"))


@reg.query(f"""{with_sql('pixels')}, {_GRAD}, m AS (SELECT x, y, sqrt(gx*gx+gy*gy) AS m, CAST(CASE WHEN abs(gx) >= 2*abs(gy) THEN 1 WHEN abs(gy) >= 2*abs(gx) THEN 0 ELSE sign(gx) END AS BIGINT) AS ux,
 CAST(CASE WHEN abs(gx) >= 2*abs(gy) THEN 0 WHEN abs(gy) >= 2*abs(gx) THEN 1 ELSE sign(gy) END AS BIGINT) AS uy FROM g)
SELECT m.x, m.y, {rs('m.m')} AS magnitude FROM m LEFT JOIN m a ON a.x = m.x + m.ux AND a.y = m.y + m.uy LEFT JOIN m b ON b.x = m.x - m.ux AND b.y = m.y - m.uy
WHERE round(m.m, 9) > coalesce(round(a.m, 9), -1) AND round(m.m, 9) >= coalesce(round(b.m, 9), -1) AND m.m > 0""")
def suppressed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose gradient is the greatest along its direction, of eight."""
    q = gradients(fixtures.pixels(spark, sf_dir))
    gx, gy = F.col("gx"), F.col("gy")
    flat, steep = F.abs(gx) >= 2 * F.abs(gy), F.abs(gy) >= 2 * F.abs(gx)
    m = q.select("x", "y", F.sqrt(gx * gx + gy * gy).alias("m"), big(F.when(flat, 1).when(steep, 0).otherwise(F.signum(gx))).alias("ux"), big(F.when(flat, 0).when(steep, 1).otherwise(F.signum(gy))).alias("uy"))
    got = raster.sent(m.select("x", "y", "m"), raster.EIGHT, "m").join(m, ["x", "y"])
    got = got.groupBy("x", "y", "m").agg(F.max(F.when((F.col("dx") == F.col("ux")) & (F.col("dy") == F.col("uy")), F.col("n_m"))).alias("a"), F.max(F.when((F.col("dx") == -F.col("ux")) & (F.col("dy") == -F.col("uy")), F.col("n_m"))).alias("b"))
    c = lambda k: F.coalesce(F.round(k, 9), F.lit(-1.0))
    return got.where((c("m") > c("a")) & (c("m") >= c("b")) & (F.col("m") > 0)).select("x", "y", r("m").alias("magnitude"))


def _marr(sigma: float, reach: int) -> dict[tuple[int, int], float]:
    """Laplacian of a Gaussian on a square."""
    return {(i, j): ((i * i + j * j) / sigma**2 - 2) / sigma**2 * math.exp(-(i * i + j * j) / (2 * sigma**2)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}


_LOG = _marr(1.2, 3)
_LOGV = "(VALUES " + ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for (i, j), w in _LOG.items()) + ") k(i, j, w)"


@reg.query(f"{with_sql('pixels')}, k AS (SELECT * FROM {_LOGV}) SELECT a.x, a.y, {rs('sum(b.val * k.w)')} AS log FROM pixels a JOIN k ON true JOIN pixels b ON b.x = a.x + k.i AND b.y = a.y + k.j GROUP BY a.x, a.y")
def laplacian_of_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.convolved(fixtures.pixels(spark, sf_dir), _LOG).select("x", "y", r("out").alias("log"))


def _fuzzy_sql(rounds: int) -> str:
    sql = with_sql("pixels") + ", c0 AS (SELECT * FROM (VALUES (0, 2::DOUBLE), (1, 12::DOUBLE), (2, 25::DOUBLE)) v(k, c))"
    for i in range(rounds):
        sql += f", u{i} AS (SELECT x, y, val, k, 1/(power(val-c, 2)+1e-6) AS u FROM pixels CROSS JOIN c{i}), m{i} AS (SELECT *, u/sum(u) OVER (PARTITION BY x, y) AS m FROM u{i}), c{i + 1} AS (SELECT k, sum(m*m*val)/sum(m*m) AS c FROM m{i} GROUP BY k)"
    return sql + f" SELECT CAST(k AS BIGINT) AS k, {rs('c', 4)} AS centre FROM c{rounds}"


@reg.query(_fuzzy_sql(3))
def fuzzy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of fuzzy c-means of cell values with exponent 2: memberships are expressions, sums one aggregation."""
    p, centres = fixtures.pixels(spark, sf_dir), [2.0, 12.0, 25.0]
    for _ in range(3):
        inverse = [1 / ((F.col("val") - c) * (F.col("val") - c) + 1e-6) for c in centres]
        whole = sum(inverse[1:], inverse[0])
        w = [(u / whole) * (u / whole) for u in inverse]
        s = p.agg(*[F.sum(m * F.col("val")).alias(f"a{k}") for k, m in enumerate(w)], *[F.sum(m).alias(f"b{k}") for k, m in enumerate(w)]).first()
        centres = [s[f"a{k}"] / s[f"b{k}"] if s[f"b{k}"] else c for k, c in enumerate(centres)]
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(centres)], "k long, c double").select("k", r("c", 4).alias("centre"))


@reg.query(f"""{with_sql('pixels')}, u AS (SELECT a.x, a.y, b.x AS bx, b.y AS by_, row_number() OVER (PARTITION BY a.x, a.y ORDER BY b.val DESC, b.y, b.x) AS k FROM pixels a JOIN pixels b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND b.val > a.val)
SELECT p.x, p.y, u.bx AS to_x, u.by_ AS to_y FROM pixels p LEFT JOIN u ON u.x = p.x AND u.y = p.y AND u.k = 1""")
def steepest_ascent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's highest neighbour above it (ties: the first in raster order)."""
    p = fixtures.pixels(spark, sf_dir)
    got = raster.sent(p, raster.EIGHT, "val").join(p, ["x", "y"]).where("n_val > val")
    best = got.groupBy("x", "y").agg(F.max(F.struct("n_val", (-(F.col("y") + F.col("dy"))).alias("ny"), (-(F.col("x") + F.col("dx"))).alias("nx"))).alias("b"))
    return p.select("x", "y").join(best, ["x", "y"], "left").select("x", "y", (-F.col("b.nx")).alias("to_x"), (-F.col("b.ny")).alias("to_y"))


@reg.query(f"""{with_sql('points')}, s AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.id = a.id + 1),
n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x2-x1), abs(y2-y1))*200)) AS BIGINT) AS n FROM s)
SELECT DISTINCT id, CAST(round((x1+(x2-x1)*k/n)*200) AS BIGINT) AS x, CAST(round((y1+(y2-y1)*k/n)*200) AS BIGINT) AS y FROM n JOIN range(401) t(k) ON k <= n""")
def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the lines between points that follow each other."""
    p = fixtures.points(spark, sf_dir)
    s = p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) * 200)).cast("long")
    s = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, b: big(F.round((F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")) * 200))
    return s.select("id", at("x1", "x2").alias("x"), at("y1", "y2").alias("y")).distinct()


QUERIES, ORACLE_SQL = reg.queries, reg.sql
