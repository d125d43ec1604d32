"""Ordered operators over contours: codes, resampling, splitting, smoothing of order, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fixtures
from .support import Registry, big, r, rs, with_sql

reg = Registry()


def along():
    """Each contour's points in order."""
    return Window.partitionBy("contour_id").orderBy("pos")


def whole():
    return Window.partitionBy("contour_id")


@reg.query(f"""{with_sql('contours')}, s AS (SELECT contour_id, pos, lead(x) OVER w - x AS dx, (lead(y) OVER w - y)/50 AS dy FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos)),
c AS (SELECT contour_id, pos, CAST(CASE WHEN dy > .5 THEN (CASE WHEN dx > .5 THEN 1 WHEN dx < -.5 THEN 3 ELSE 2 END)
  WHEN dy < -.5 THEN (CASE WHEN dx > .5 THEN 7 WHEN dx < -.5 THEN 5 ELSE 6 END) ELSE (CASE WHEN dx > .5 THEN 0 WHEN dx < -.5 THEN 4 END) END AS BIGINT) AS code FROM s WHERE dx IS NOT NULL)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, code, (code - lag(code) OVER (PARTITION BY contour_id ORDER BY pos) + 8) % 8 AS turn FROM c WHERE code IS NOT NULL""")
def chain_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-way step codes (no move: none) and the turn from one to the next; values are scaled by 1/50."""
    s = fixtures.contours(spark, sf_dir).select("contour_id", "pos", (F.lead("x").over(along()) - F.col("x")).alias("dx"), ((F.lead("y").over(along()) - F.col("y")) / 50).alias("dy")).where("dx IS NOT NULL")
    row = lambda right, left, none: F.when(F.col("dx") > 0.5, right).when(F.col("dx") < -0.5, left).otherwise(none)
    code = F.when(F.col("dy") > 0.5, row(1, 3, 2)).when(F.col("dy") < -0.5, row(7, 5, 6)).otherwise(row(0, 4, None))
    c = s.select("contour_id", "pos", big(code).alias("code")).where("code IS NOT NULL")
    return c.select("contour_id", big("pos").alias("pos"), "code", ((F.col("code") - F.lag("code").over(along()) + 8) % 8).alias("turn"))


@reg.query(f"""{with_sql('contours')}, g AS (SELECT *, CAST(floor(y / 50) AS BIGINT) AS cell, lag(CAST(floor(y / 50) AS BIGINT)) OVER (PARTITION BY contour_id ORDER BY pos) AS before FROM contours)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, cell FROM g WHERE before IS NULL OR cell <> before""")
def grid_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a contour passes, without repeats in a row."""
    g = fixtures.contours(spark, sf_dir).withColumn("cell", big(F.floor(F.col("y") / 50)))
    g = g.withColumn("before", F.lag("cell").over(along()))
    return g.where("before IS NULL OR cell <> before").select("contour_id", big("pos").alias("pos"), "cell")


@reg.query(f"""{with_sql('contours')}, n AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM contours)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('y')} AS y FROM n WHERE (pos - 1) % 8 = 0 OR pos = n""")
def fixed_interval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth point, and both ends."""
    n = fixtures.contours(spark, sf_dir).withColumn("n", F.count("*").over(whole()))
    return n.where("(pos - 1) % 8 = 0 OR pos = n").select("contour_id", big("pos").alias("pos"), r("y").alias("y"))


@reg.query(f"""{with_sql('contours')}, n AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM contours)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('y')} AS y FROM n WHERE (pos - 1) % greatest(1, n // 10) = 0""")
def fixed_count_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About ten points of each contour; the step is one at least."""
    n = fixtures.contours(spark, sf_dir).withColumn("n", F.count("*").over(whole()))
    return n.where("(pos - 1) % greatest(1, n div 10) = 0").select("contour_id", big("pos").alias("pos"), r("y").alias("y"))


@reg.query(f"""{with_sql('contours')}, n AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM contours),
s AS (SELECT *, (pos - 1) * (n // 20 + 1) // n AS piece FROM n)
SELECT contour_id, CAST(piece AS BIGINT) AS piece, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, {rs('avg(y)')} AS mean FROM s GROUP BY ALL""")
def split_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours in pieces of twenty points at most, as even as can be."""
    n = fixtures.contours(spark, sf_dir).withColumn("n", F.count("*").over(whole()))
    s = n.withColumn("piece", F.expr("(pos - 1) * (n div 20 + 1) div n"))
    return s.groupBy("contour_id", "piece").agg(big(F.min("pos")).alias("first_pos"), big(F.max("pos")).alias("last_pos"), r(F.avg("y")).alias("mean"))


@reg.query(f"""{with_sql('contours')}, f AS (SELECT *, strength > 100 AS strong FROM contours),
g AS (SELECT *, CASE WHEN strong <> coalesce(lag(strong) OVER (PARTITION BY contour_id ORDER BY pos), NOT strong) THEN 1 ELSE 0 END AS b FROM f),
s AS (SELECT *, sum(b) OVER (PARTITION BY contour_id ORDER BY pos) AS piece FROM g)
SELECT contour_id, CAST(piece AS BIGINT) AS piece, strong, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n, {rs('max(strength)')} AS peak FROM s GROUP BY ALL""")
def split_by_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of points on one side of a strength threshold."""
    f = fixtures.contours(spark, sf_dir).withColumn("strong", F.col("strength") > 100)
    f = f.withColumn("b", F.when(F.col("strong") != F.coalesce(F.lag("strong").over(along()), ~F.col("strong")), 1).otherwise(0))
    f = f.withColumn("piece", F.sum("b").over(along().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return f.groupBy("contour_id", "piece", "strong").agg(big(F.min("pos")).alias("first_pos"), F.count("*").alias("n"), r(F.max("strength")).alias("peak"))


@reg.query(f"""{with_sql('contours')}, m AS (SELECT contour_id, 2 * pos - 1 AS pos, x, y FROM contours
UNION ALL SELECT contour_id, 2 * pos, (x + nx) / 2, (y + ny) / 2 FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos)) WHERE nx IS NOT NULL)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('x')} AS x, {rs('y')} AS y FROM m""")
def midpoint_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the midpoints between: one pass, each row explodes into itself and what follows it."""
    c = fixtures.contours(spark, sf_dir).withColumns({"nx": F.lead("x").over(along()), "ny": F.lead("y").over(along())})
    own = F.struct((2 * F.col("pos") - 1).alias("pos"), F.col("x").alias("x"), F.col("y").alias("y"))
    mid = F.when(F.col("nx").isNotNull(), F.struct((2 * F.col("pos")).alias("pos"), ((F.col("x") + F.col("nx")) / 2).alias("x"), ((F.col("y") + F.col("ny")) / 2).alias("y")))
    return c.select("contour_id", F.explode(F.array_compact(F.array(own, mid))).alias("p")).select("contour_id", big("p.pos").alias("pos"), r("p.x").alias("x"), r("p.y").alias("y"))


@reg.query(f"""{with_sql('contours')}, d AS (SELECT contour_id, pos, y, lag(y) OVER w AS a, lead(y) OVER w AS b FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos))
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('(b - a) / 2')} AS slope, {rs('b - 2*y + a')} AS second, {rs('(b - 2*y + a) / power(1 + (b-a)*(b-a)/4, 1.5)')} AS curvature FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def curvature_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central differences along each contour."""
    d = fixtures.contours(spark, sf_dir).select("contour_id", "pos", "y", F.lag("y").over(along()).alias("a"), F.lead("y").over(along()).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    return d.select("contour_id", big("pos").alias("pos"), r((b - a) / 2).alias("slope"), r(b - 2 * y + a).alias("second"), r((b - 2 * y + a) / F.pow(1 + (b - a) * (b - a) / 4, 1.5)).alias("curvature"))


@reg.query(f"""{with_sql('contours')} SELECT contour_id, CAST(pos AS BIGINT) AS pos, CAST(k AS BIGINT) AS k, {rs('strength')} AS strength FROM (SELECT *, row_number() OVER (PARTITION BY contour_id ORDER BY strength DESC, pos) AS k FROM contours) WHERE k <= 5""")
def strongest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest points of each contour (top-k is the operator)."""
    w = whole().orderBy(F.col("strength").desc(), "pos")
    return fixtures.contours(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 5").select("contour_id", big("pos").alias("pos"), big("k").alias("k"), r("strength").alias("strength"))


@reg.query(f"""{with_sql('points')}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY label),
a AS (SELECT label, id, atan2(y-cy, x-cx) AS a FROM points JOIN c USING (label)), s AS (SELECT label, arg_min(a, id) AS a0 FROM a GROUP BY label),
t AS (SELECT label, id, (a - a0) - 2*pi()*floor((a - a0)/(2*pi())) AS turned FROM a JOIN s USING (label))
SELECT label, id, {rs('turned')} AS turned, row_number() OVER (PARTITION BY label ORDER BY turned, id) AS k FROM t""")
def angular_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points about their label's centroid, turned so that the first point comes first."""
    import math

    p = fixtures.points(spark, sf_dir)
    w = Window.partitionBy("label")
    p = p.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w)})
    p = p.withColumn("a", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).withColumn("a0", F.min_by("a", "id").over(w))
    p = p.withColumn("turned", F.pmod(F.col("a") - F.col("a0"), F.lit(2 * math.pi)))
    return p.select("label", "id", r("turned").alias("turned"), big(F.row_number().over(w.orderBy("turned", "id"))).alias("k"))


@reg.query(f"""{with_sql('contours')} SELECT contour_id, {rs('arg_min(y, pos)')} AS first_y, {rs('arg_max(y, pos)')} AS last_y, count(*) AS n FROM contours GROUP BY contour_id""")
def contour_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last point of each contour."""
    return fixtures.contours(spark, sf_dir).groupBy("contour_id").agg(r(F.min_by("y", "pos")).alias("first_y"), r(F.max_by("y", "pos")).alias("last_y"), F.count("*").alias("n"))


@reg.query(f"""{with_sql('contours')}, a AS (SELECT contour_id, avg(x) AS mx, avg(y) AS my, count(*) AS n, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM contours GROUP BY contour_id)
SELECT p.contour_id AS a, q.contour_id AS b, {rs('q.mx - p.mx')} AS dx, {rs('q.my - p.my')} AS dy, {rs('q.n * 1.0 / p.n')} AS length_ratio,
  {rs('sqrt(((q.xx+q.yy)/2+sqrt((q.xx-q.yy)*(q.xx-q.yy)/4+q.xy*q.xy))/((p.xx+p.yy)/2+sqrt((p.xx-p.yy)*(p.xx-p.yy)/4+p.xy*p.xy)))', 5)} AS scale
FROM a p JOIN a q ON q.contour_id = p.contour_id + 1""")
def contour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of neighbouring contours: translation, ratio of lengths, ratio of the principal axes."""
    from ..functions.geometry import eigen2

    c = fixtures.contours(spark, sf_dir).groupBy("contour_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
    c = c.select("contour_id", "mx", "my", "n", eigen2(F.col("xx"), F.col("xy"), F.col("yy"))[0].alias("major"))
    q = c.select((F.col("contour_id") - 1).alias("contour_id"), F.col("contour_id").alias("b"), *[F.col(k).alias(f"q_{k}") for k in ("mx", "my", "n", "major")])
    return c.join(q, "contour_id").select(F.col("contour_id").alias("a"), "b", r(F.col("q_mx") - F.col("mx")).alias("dx"), r(F.col("q_my") - F.col("my")).alias("dy"), r(F.col("q_n") / F.col("n")).alias("length_ratio"), r(F.sqrt(F.col("q_major") / F.col("major")), 5).alias("scale"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
