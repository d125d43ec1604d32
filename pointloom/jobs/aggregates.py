"""Aggregates over point sets, polygons and contours, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import fixtures
from .scalars import _RING_SQL, ring
from .support import Registry, big, r, rs, with_sql

reg = Registry()

_EIGEN = "(xx+yy)/2 {} sqrt((xx-yy)*(xx-yy)/4+xy*xy)"


@reg.query(f"""{with_sql('points')}, m AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM points GROUP BY label)
SELECT label, n, {rs('cx')} AS cx, {rs('cy')} AS cy, {rs('min_x')} AS min_x, {rs('max_x')} AS max_x, {rs('min_y')} AS min_y, {rs('max_y')} AS max_y,
  {rs('xx', 8)} AS var_x, {rs('xy', 8)} AS cov_xy, {rs('yy', 8)} AS var_y, {rs(_EIGEN.format('+'), 8)} AS major, {rs(_EIGEN.format('-'), 8)} AS minor,
  {rs('sqrt(xx+yy)')} AS radius FROM m""")
def cluster_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid, bounding box, covariance with its eigenvalues and circular radius by label: one partial aggregation."""
    m = fixtures.points(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), *[f(c).alias(a) for c, b in (("x", "x"), ("y", "y")) for f, a in ((F.avg, f"c{b}"), (F.min, f"min_{b}"), (F.max, f"max_{b}"))],
        F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"),
    )
    major, minor = g.eigen2(F.col("xx"), F.col("xy"), F.col("yy"))
    return m.select(
        "label", "n", *[r(c).alias(c) for c in ("cx", "cy", "min_x", "max_x", "min_y", "max_y")], r("xx", 8).alias("var_x"), r("xy", 8).alias("cov_xy"), r("yy", 8).alias("var_y"),
        r(major, 8).alias("major"), r(minor, 8).alias("minor"), r(F.sqrt(F.col("xx") + F.col("yy"))).alias("radius"),
    )


@reg.query(f"""{with_sql('points')}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY label),
d AS (SELECT label, id, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS d FROM points JOIN c USING (label))
SELECT label, id, {rs('d')} AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id) AS k FROM d) WHERE k = 1""")
def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point nearest to each label's centroid."""
    p = fixtures.points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = g.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    best = p.join(c, "label").groupBy("label").agg(F.min(F.struct(d.alias("d"), "id")).alias("m"))
    return best.select("label", "m.id", r("m.d").alias("dist"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}
SELECT polygon_id, count(*) AS n, {rs('abs(sum(x*y2-x2*y))/2')} AS area, {rs('sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)))', 4)} AS perimeter,
  CAST(CASE WHEN sum((x2-x)*(y2+y)) > 1e-6 THEN 1 WHEN sum((x2-x)*(y2+y)) < -1e-6 THEN -1 ELSE 0 END AS BIGINT) AS clockwise,
  {rs('sqrt(abs(sum(x*y2-x2*y))/2)/(0.1+sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))))')} AS compactness
FROM ring GROUP BY polygon_id""")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter, orientation and compactness."""
    s = ring(fixtures.polygons(spark, sf_dir).drop("id"))
    a = s.groupBy("polygon_id").agg(
        F.count("*").alias("n"), (F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("area"),
        F.sum(g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).alias("perimeter"), F.sum((F.col("x2") - F.col("x")) * (F.col("y2") + F.col("y"))).alias("o"),
    )
    way = F.when(F.col("o") > 1e-6, 1).when(F.col("o") < -1e-6, -1).otherwise(0)
    return a.select("polygon_id", "n", r("area").alias("area"), r("perimeter", 4).alias("perimeter"), big(way).alias("clockwise"), r(F.sqrt("area") / (0.1 + F.col("perimeter"))).alias("compactness"))


@reg.query(f"""{with_sql('points')}, w AS (SELECT label, x, y, 1.0 + id % 3 AS wt FROM points),
m AS (SELECT label, count(*) AS n, sum(wt*x)/count(*) AS mx, sum(wt*y)/count(*) AS my FROM w GROUP BY label)
SELECT label, {rs('any_value(mx)')} AS mx, {rs('any_value(my)')} AS my, {rs('sum(wt*(x-mx)*(x-mx))/any_value(n)', 8)} AS mxx, {rs('sum(wt*(x-mx)*(y-my))/any_value(n)', 8)} AS mxy, {rs('sum(wt*(y-my)*(y-my))/any_value(n)', 8)} AS myy
FROM w JOIN m USING (label) GROUP BY label""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted moments, divided by the count."""
    p = fixtures.points(spark, sf_dir).select("label", "x", "y", (F.lit(1.0) + F.col("id") % 3).alias("wt"))
    m = p.groupBy("label").agg(F.count("*").alias("n"), (F.sum(F.col("wt") * F.col("x")) / F.count("*")).alias("mx"), (F.sum(F.col("wt") * F.col("y")) / F.count("*")).alias("my"))
    dx, dy, w = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("wt")
    s = p.join(m, "label").groupBy("label", "n", "mx", "my").agg(F.sum(w * dx * dx).alias("a"), F.sum(w * dx * dy).alias("b"), F.sum(w * dy * dy).alias("c"))
    return s.select("label", r("mx").alias("mx"), r("my").alias("my"), *[r(F.col(k) / F.col("n"), 8).alias(v) for k, v in (("a", "mxx"), ("b", "mxy"), ("c", "myy"))])


@reg.query(f"""{with_sql('contours')}, s AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos)),
b AS (SELECT contour_id, CAST((CASE WHEN dx > .5 THEN 2 WHEN dx < -.5 THEN 0 ELSE 1 END) * 3 + (CASE WHEN dy > .5 THEN 2 WHEN dy < -.5 THEN 0 ELSE 1 END) AS BIGINT) AS bin FROM s WHERE dx IS NOT NULL),
bins AS (SELECT DISTINCT contour_id, CAST(i AS BIGINT) AS bin FROM b CROSS JOIN range(9) r(i))
SELECT bins.contour_id, bins.bin, count(b.bin) AS n FROM bins LEFT JOIN b ON b.contour_id = bins.contour_id AND b.bin = bins.bin GROUP BY ALL""")
def transition_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each contour in nine bins of directions, empty ones included."""
    w = Window.partitionBy("contour_id").orderBy("pos")
    s = fixtures.contours(spark, sf_dir).withColumns({"dx": F.lead("x").over(w) - F.col("x"), "dy": F.lead("y").over(w) - F.col("y")}).where("dx IS NOT NULL")
    three = lambda c: F.when(F.col(c) > 0.5, 2).when(F.col(c) < -0.5, 0).otherwise(1)
    counts = s.groupBy("contour_id", big(three("dx") * 3 + three("dy")).alias("bin")).agg(F.count("*").alias("n"))
    held = counts.groupBy("contour_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # nine entries at most
    return held.select("contour_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("bin"), "m").select("contour_id", "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0).cast("long")).alias("n"))


@reg.query("""WITH h AS (SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT event_type, bin, n * 1.0 / sum(n) OVER (PARTITION BY event_type) AS p FROM h)
SELECT a.event_type AS a, b.event_type AS b, round(sum(a.p * ln(a.p / b.p)), 6) + 0.0 AS kl FROM p a JOIN p b ON a.bin = b.bin GROUP BY ALL""")
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the value histograms of event types; bins that either lacks are left out."""
    h = fixtures.table(spark, sf_dir, "events").groupBy("event_type", big(F.floor(F.col("value") / 25)).alias("bin")).agg(F.count("*").alias("n"))
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("event_type")))
    a, b = p.select(F.col("event_type").alias("a"), "bin", F.col("p").alias("pa")), p.select(F.col("event_type").alias("b"), "bin", F.col("p").alias("pb"))
    return a.join(b, "bin").groupBy("a", "b").agg(r(F.sum(F.col("pa") * F.log(F.col("pa") / F.col("pb")))).alias("kl"))


@reg.query(f"""{with_sql('contours')}, s AS (SELECT contour_id, sqrt((lead(x) OVER w - x)*(lead(x) OVER w - x) + (lead(y) OVER w - y)*(lead(y) OVER w - y)) AS d FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos))
SELECT contour_id, {rs('coalesce(sum(d), 0)', 4)} AS length, count(d) AS steps, {rs('max(d)', 4)} AS longest FROM s GROUP BY contour_id""")
def arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("contour_id").orderBy("pos")
    s = fixtures.contours(spark, sf_dir).select("contour_id", g.distance(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w)).alias("d"))
    return s.groupBy("contour_id").agg(r(F.coalesce(F.sum("d"), F.lit(0.0)), 4).alias("length"), F.count("d").alias("steps"), r(F.max("d"), 4).alias("longest"))


@reg.query(f"""{with_sql('contours')} SELECT contour_id, {rs('max(y) FILTER (WHERE k = 3)')} AS third, {rs('quantile_disc(y, 0.5)')} AS median FROM (SELECT *, row_number() OVER (PARTITION BY contour_id ORDER BY y) AS k FROM contours) GROUP BY contour_id""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third least and the (lower) median value of each contour."""
    w = Window.partitionBy("contour_id").orderBy("y")
    c = fixtures.contours(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return c.groupBy("contour_id").agg(r(F.max(F.when(F.col("k") == 3, F.col("y")))).alias("third"), r(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)")).alias("median"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}, s AS (SELECT polygon_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy,
  sum(x*x*x+x*y*y) AS sxz, sum(x*x*y+y*y*y) AS syz, sum(x*x+y*y) AS sz FROM ring GROUP BY polygon_id),
u AS (SELECT *, sxx-sx*sx/n AS a, sxy-sx*sy/n AS b, syy-sy*sy/n AS c, (sxz-sx*sz/n)/2 AS p, (syz-sy*sz/n)/2 AS q FROM s),
v AS (SELECT *, (p*c-q*b)/(a*c-b*b) AS cx, (a*q-b*p)/(a*c-b*b) AS cy FROM u)
SELECT polygon_id, {rs('cx', 5)} AS cx, {rs('cy', 5)} AS cy, {rs('sqrt((sz-2*cx*sx-2*cy*sy)/n+cx*cx+cy*cy)', 5)} AS radius FROM v""")
def circle_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares (algebraic) circles through the polygons' vertices: normal equations from sums, solved in closed form."""
    p = fixtures.polygons(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    z = x * x + y * y
    s = p.groupBy("polygon_id").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y), ("sxz", x * z), ("syz", y * z), ("sz", z))])
    s = s.selectExpr("*", "sxx-sx*sx/n AS a", "sxy-sx*sy/n AS b", "syy-sy*sy/n AS c", "(sxz-sx*sz/n)/2 AS p", "(syz-sy*sz/n)/2 AS q")
    s = s.selectExpr("*", "try_divide(p*c-q*b, a*c-b*b) AS cx", "try_divide(a*q-b*p, a*c-b*b) AS cy")
    return s.select("polygon_id", r("cx", 5).alias("cx"), r("cy", 5).alias("cy"), r(F.expr("sqrt((sz-2*cx*sx-2*cy*sy)/n+cx*cx+cy*cy)"), 5).alias("radius"))


@reg.query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_n, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either_n,
 (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS left_only,
 round(1 - (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) * 1.0 / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) + 0.0 AS distance""")
def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union, difference and Jaccard distance of two sets of parts, from one aggregation by part."""
    li = fixtures.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    per = li.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("a"), F.max(F.col("l_returnflag") == "A").alias("b"))
    s = per.agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count("*").alias("either_n"), F.count_if(F.col("a") & ~F.col("b")).alias("left_only"))
    return s.withColumn("distance", r(1 - F.try_divide(F.col("both_n"), F.col("either_n"))))


@reg.query("""SELECT l_suppkey AS a, l_suppkey % 7 AS grp, list_sort(list(DISTINCT l_partkey % 40)) AS members, count(DISTINCT l_partkey % 40) AS n FROM lineitem GROUP BY ALL""")
def distinct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct members of each group, sorted."""
    li = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("m")).distinct()
    return li.groupBy("a").agg(F.array_sort(F.collect_list("m")).alias("members"), F.count("*").alias("n")).withColumn("grp", F.col("a") % 7)


QUERIES, ORACLE_SQL = reg.queries, reg.sql
