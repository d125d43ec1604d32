"""Range joins with a radius of each row, and sums of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fields, graph
from ..sources import fixtures
from .predicates import _PAIRS, features
from .scalars import _RING_SQL, ring
from .support import Registry, big, r, rs, with_sql

reg = Registry()
#: A maximum reaches so far for each line item; the least count of a maximum.
RATIO, LEAST = 0.6, 6
#: Of the dipoles: fall-off by angle, deviations at which fields end.
BETA, CUT = 2.0, 3.0
#: Reach of sides; steps and deviations of votes.
REACH, STEP, SIGMA = 0.01, (0.01, 0.01, 0.004), (0.005, 0.005, 0.003)

_MAXIMA = f"""maxima AS MATERIALIZED (SELECT a.y * w + a.x AS id, CAST(a.x AS DOUBLE) AS x, CAST(a.y AS DOUBLE) AS y, a.val, {RATIO} * a.val AS radius
 FROM lattice a CROSS JOIN width LEFT JOIN lattice b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND (a.x, a.y) <> (b.x, b.y) WHERE a.val >= {LEAST} GROUP BY a.x, a.y, a.val, w HAVING a.val >= coalesce(max(b.val), 0))"""


def maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, val, radius: cells of the lattice below none of their neighbours."""
    from ..operators import raster

    width, cells = fixtures.lattice(spark, sf_dir)
    top = raster.local_maxima(cells, strict=False).where(F.col("val") >= LEAST)
    return top.select((F.col("y") * width + F.col("x")).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "val", (RATIO * F.col("val")).alias("radius"))


@reg.query(f"""{with_sql('lattice', recursive=True)}, {_MAXIMA},
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM maxima a JOIN maxima b ON a.id <> b.id AND abs(a.x-b.x) < a.radius AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < a.radius),
ways AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
joined(node, low) USING KEY (node) AS (SELECT id, id FROM maxima UNION SELECT l.node, l.low FROM (SELECT e.b AS node, min(x.low) AS low FROM joined x JOIN ways e ON e.a = x.node GROUP BY e.b) l JOIN recurring.joined o ON o.node = l.node WHERE l.low < o.low)
SELECT node AS id, low AS cluster FROM joined""")
def maxima_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima joined where one lies within the other's own reach."""
    top = maxima(spark, sf_dir)
    near = fields.within_radius(top.select("id", "x", "y", "radius"), top.select("id", "x", "y"), strict=True)
    roots = graph.components(near.select(F.col("id").alias("a"), F.col("r_id").alias("b")))
    return top.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))


@reg.query(f"""{with_sql('lattice')}, {_MAXIMA}, d AS (SELECT id, x, y, val, (id % 16) * pi() / 16 AS theta, 0.2 * val AS sigma FROM maxima),
v AS (SELECT t.x, t.y, d.theta, d.val * exp(-{BETA} * power(sin(CASE WHEN t.x = d.x AND t.y = d.y THEN 0 ELSE atan2(t.y - d.y, t.x - d.x) END - d.theta), 2) - ((t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y)) / (2*d.sigma*d.sigma)) AS v
 FROM lattice t JOIN d ON sqrt((t.x-d.x)*(t.x-d.x)+(t.y-d.y)*(t.y-d.y)) <= {CUT} * d.sigma)
SELECT x, y, count(*) AS n, {rs('sum(v)')} AS field, {rs('sum(v * cos(theta))')} AS fx, {rs('sum(v * sin(theta))')} AS fy FROM v GROUP BY x, y""")
def dipole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the lattice of the fields of dipoles, whose reach is their own; fields end at three deviations."""
    import math

    d = maxima(spark, sf_dir).select("id", "x", "y", "val", (F.col("id") % 16 * math.pi / 16).alias("theta"), (0.2 * F.col("val")).alias("sigma"))
    cells = fixtures.lattice(spark, sf_dir)[1].select("x", "y")
    met = fields.within_radius(d.withColumn("radius", CUT * F.col("sigma")), cells)
    v = fields.dipole(F.col("val"), F.col("theta"), F.col("sigma"), F.col("r_x") - F.col("x"), F.col("r_y") - F.col("y"), BETA)
    sums = met.withColumn("v", v).groupBy(F.col("r_x").alias("x"), F.col("r_y").alias("y"))
    return sums.agg(F.count("*").alias("n"), r(F.sum("v")).alias("field"), r(F.sum(F.col("v") * F.cos("theta"))).alias("fx"), r(F.sum(F.col("v") * F.sin("theta"))).alias("fy"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}, s AS (SELECT polygon_id, pos, x AS ax, y AS ay, x2 AS cx, y2 AS cy, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS len FROM ring WHERE x <> x2 OR y <> y2),
d AS (SELECT p.id, ((p.x-ax)*(cx-ax)+(p.y-ay)*(cy-ay)) / (len*len) AS t, ((cx-ax)*(p.y-ay)-(cy-ay)*(p.x-ax)) / len AS h
 FROM points p JOIN s ON p.x BETWEEN least(ax, cx) - {REACH} AND greatest(ax, cx) + {REACH} AND p.y BETWEEN least(ay, cy) - {REACH} AND greatest(ay, cy) + {REACH})
SELECT id, count(*) AS n, {rs(f'sum({REACH} - h)')} AS energy FROM d WHERE t > 1e-9 AND t < 1 - 1e-9 AND h > 1e-9 AND h <= {REACH} GROUP BY id""")
def boundary_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each point, what is left of the reach when the sides of outlines that move inwards at unit speed come to it."""
    s = ring(fixtures.polygons(spark, sf_dir).drop("id")).select(F.concat_ws("-", "polygon_id", "pos").alias("segment"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")).where("ax <> bx OR ay <> by")
    met = fields.beside_segments(fixtures.points(spark, sf_dir), s, REACH)
    t = g.line_parameter(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
    met = met.where((F.col("side") > 0) & (F.col("dist") > 1e-9) & (t > 1e-9) & (t < 1 - 1e-9))
    return met.groupBy("id").agg(F.count("*").alias("n"), r(F.sum(REACH - F.col("dist"))).alias("energy"))



@reg.query(f"""{with_sql('points')}, {_PAIRS}, a AS (SELECT *, unnest(range(CAST(ceil((mx - {3 * SIGMA[0]}) / {STEP[0]}) AS BIGINT), CAST(floor((mx + {3 * SIGMA[0]}) / {STEP[0]}) AS BIGINT) + 1)) AS i FROM f),
b AS (SELECT *, unnest(range(CAST(ceil((my - {3 * SIGMA[1]}) / {STEP[1]}) AS BIGINT), CAST(floor((my + {3 * SIGMA[1]}) / {STEP[1]}) AS BIGINT) + 1)) AS j FROM a),
c AS (SELECT *, unnest(range(CAST(ceil((z - {3 * SIGMA[2]}) / {STEP[2]}) AS BIGINT), CAST(floor((z + {3 * SIGMA[2]}) / {STEP[2]}) AS BIGINT) + 1)) AS k FROM b)
SELECT i, j, k, {rs(f'sum(exp(-power(i * {STEP[0]} - mx, 2) / {2 * SIGMA[0] ** 2} - power(j * {STEP[1]} - my, 2) / {2 * SIGMA[1] ** 2} - power(k * {STEP[2]} - z, 2) / {2 * SIGMA[2] ** 2}))', 5)} AS vote FROM c GROUP BY ALL""")
def vote_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of pairs of points on a grid of middles and half lengths; each vote ends at three deviations along an axis."""
    v = fields.votes(features(spark, sf_dir).select("mx", "my", "z"), STEP, SIGMA)
    return v.select(big("i").alias("i"), big("j").alias("j"), big("k").alias("k"), r("vote", 5).alias("vote"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
