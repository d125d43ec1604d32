"""Row-wise geometry and predicates over consecutive points and over polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import fixtures
from .support import Registry, big, r, rs, with_sql

reg = Registry()

_TRIPLES_SQL = """t AS (SELECT contour_id, pos, x AS x0, y AS y0,
  lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2
  FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY pos))"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points in a row of each contour: (x0, y0), (x1, y1), (x2, y2)."""
    w = Window.partitionBy("contour_id").orderBy("pos")
    c = fixtures.contours(spark, sf_dir)
    cols = {f"{a}{k}": F.lead(a, k).over(w) for k in (1, 2) for a in ("x", "y")}
    return c.withColumns(cols).where(F.col("x2").isNotNull()).withColumnsRenamed({"x": "x0", "y": "y0"})




def _cols(*names):
    return [F.col(n) for n in names]


@reg.query(f"""{with_sql('contours')}, {_TRIPLES_SQL}
SELECT contour_id, CAST(pos AS BIGINT) AS pos,
  {rs('sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))')} AS step,
  {rs('atan2(y1-y0, x1-x0)')} AS direction,
  CAST(CASE WHEN (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) < -1e-6 THEN 1 WHEN (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) > 1e-6 THEN -1 ELSE 0 END AS BIGINT) AS turn,
  {rs('0.5*abs((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))', 4)} AS area,
  {rs('abs((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))/sqrt((x2-x0)*(x2-x0)+(y2-y0)*(y2-y0))')} AS line_distance,
  {rs('greatest(least(y0, y1), least(greatest(y0, y1), y2))')} AS median_y
FROM t WHERE x2 IS NOT NULL""")
def step_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and direction of each step, turn, triangle area, distance of the middle point, median of three."""
    c = _cols("x0", "y0", "x1", "y1", "x2", "y2")
    x0, y0, x1, y1, x2, y2 = c
    return triples(spark, sf_dir).select(
        "contour_id", big("pos").alias("pos"), r(g.distance(x0, y0, x1, y1)).alias("step"), r(g.direction(x1, y1, x0, y0)).alias("direction"),
        big(g.turn(*c)).alias("turn"), r(g.triangle_area(*c), 4).alias("area"), r(g.line_distance(x0, y0, x2, y2, x1, y1)).alias("line_distance"), r(g.median3(y0, y1, y2)).alias("median_y"),
    )


@reg.query(f"""{with_sql('contours')}, {_TRIPLES_SQL}, a AS (
  SELECT *, (x0-x1)*(x0-x1)+(y0-y1)*(y0-y1) AS aa, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS bb, (x2-x0)*(x2-x0)+(y2-y0)*(y2-y0) AS cc,
    (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS cr FROM t WHERE x2 IS NOT NULL),
b AS (SELECT *, CASE WHEN sqrt(aa) < 1e-8 OR sqrt(bb) < 1e-8 THEN 0 ELSE acos(greatest(-1, least(1, (aa+bb-cc)/(2*sqrt(aa)*sqrt(bb))))) END AS ang FROM a)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('ang', 4)} AS angle,
  {rs('CASE WHEN (x0-x1)*(y2-y1)-(y0-y1)*(x2-x1) <= 1e-6 THEN ang ELSE -ang END', 4)} AS signed_angle,
  {rs('CASE WHEN t0 < 0 THEN sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)) WHEN t0 > 1 THEN sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) ELSE abs(cr)/sqrt(cc) END')} AS segment_distance
FROM (SELECT *, ((x1-x0)*(x2-x0)+(y1-y0)*(y2-y0))/cc AS t0 FROM b)""")
def visual_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle at each middle point, with its sign, and the point's distance from the segment of its neighbours."""
    x0, y0, x1, y1, x2, y2 = _cols("x0", "y0", "x1", "y1", "x2", "y2")
    return triples(spark, sf_dir).select(
        "contour_id", big("pos").alias("pos"), r(g.visual_angle(x0, y0, x2, y2, x1, y1), 4).alias("angle"),
        r(g.signed_visual_angle(x0, y0, x2, y2, x1, y1), 4).alias("signed_angle"), r(g.segment_distance(x0, y0, x2, y2, x1, y1)).alias("segment_distance"),
    )


@reg.query(f"""{with_sql('contours')}, {_TRIPLES_SQL}, d AS (
  SELECT *, atan2(y1-y0, x1-x0) AS o, atan2(y2-y1, x2-x1) AS p FROM t WHERE x2 IS NOT NULL),
e AS (SELECT *, abs(o-p) - 2*pi()*floor(abs(o-p)/(2*pi())) AS m, (p-o+pi()/4) - 2*pi()*floor((p-o+pi()/4)/(2*pi())) AS q FROM d)
SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('least(m, 2*pi()-m)')} AS bend,
  CASE floor(q/(pi()/2)) WHEN 0 THEN 'front' WHEN 1 THEN 'left' WHEN 2 THEN 'back' WHEN 3 THEN 'right' ELSE 'unknown' END AS side,
  {rs('-(y1-y0)/sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))')} AS normal_x, {rs('(x1-x0)/sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))')} AS normal_y
FROM e""")
def relative_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much and to which side each contour bends; the left normal of each step."""
    x0, y0, x1, y1, x2, y2 = _cols("x0", "y0", "x1", "y1", "x2", "y2")
    o, p = g.direction(x1, y1, x0, y0), g.direction(x2, y2, x1, y1)
    nx, ny = g.left_normal(x0, y0, x1, y1)
    return triples(spark, sf_dir).select("contour_id", big("pos").alias("pos"), r(g.angle_difference(o, p)).alias("bend"), g.side(o, p).alias("side"), r(nx).alias("normal_x"), r(ny).alias("normal_y"))


@reg.query(f"""WITH v AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS ea, b.embedding AS eb FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10)
SELECT a, b, {rs('sqrt(list_sum([(CAST(ea[i] AS DOUBLE) - eb[i]) * (CAST(ea[i] AS DOUBLE) - eb[i]) for i in range(1, 65)]))', 5)} AS dist FROM v""")
def feature_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distance of embeddings with one label whose ids are ten apart."""
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    other = e.select((F.col("vec_id") - 10).alias("vec_id"), F.col("vec_id").alias("b"), "label", F.col("e").alias("f"))
    return e.join(other, ["vec_id", "label"]).select(F.col("vec_id").alias("a"), "b", r(g.feature_distance(F.col("e"), F.col("f")), 5).alias("dist"))


_RING_SQL = """ring AS (SELECT polygon_id, pos, id, x, y,
  coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM polygons WINDOW w AS (PARTITION BY polygon_id ORDER BY pos))"""


def ring(p: DataFrame) -> DataFrame:
    """polygons with the next vertex of the ring (x2, y2)."""
    w = Window.partitionBy("polygon_id").orderBy("pos")
    return p.withColumns({"x2": F.coalesce(F.lead("x").over(w), F.first("x").over(w)), "y2": F.coalesce(F.lead("y").over(w), F.first("y").over(w))})


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}
SELECT q.id AS id, ring.polygon_id AS polygon_id, sum(CASE WHEN (ring.y > q.y) <> (y2 > q.y) AND q.x < (x2-ring.x)*(q.y-ring.y)/(y2-ring.y)+ring.x THEN 1 ELSE 0 END) % 2 = 1 AS inside
FROM points q JOIN ring ON ring.polygon_id = (q.label + 1) % 10 GROUP BY ALL""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point against the polygon of the next label, by crossings of a ray."""
    q = fixtures.points(spark, sf_dir).select("id", F.col("x").alias("px"), F.col("y").alias("py"), ((F.col("label") + 1) % 10).alias("polygon_id"))
    side = ring(fixtures.polygons(spark, sf_dir).drop("id"))
    cross = ((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < F.try_divide((F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")), F.col("y2") - F.col("y")) + F.col("x"))
    return q.join(side, "polygon_id").groupBy("id", "polygon_id").agg((F.sum(F.when(cross, 1).otherwise(0)) % 2 == 1).alias("inside"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}, pairs AS (
  SELECT a.polygon_id, a.pos AS a, b.pos AS b, a.x AS ax, a.y AS ay, a.x2 AS ax2, a.y2 AS ay2, b.x AS bx, b.y AS by_, b.x2 AS bx2, b.y2 AS by2
  FROM ring a JOIN ring b ON a.polygon_id = b.polygon_id AND b.pos = a.pos + 2),
d AS (SELECT *, (ax2-ax)*(by2-by_)-(ay2-ay)*(bx2-bx) AS det FROM pairs)
SELECT polygon_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b,
  {rs('((bx-ax)*(by2-by_)-(by_-ay)*(bx2-bx))/nullif(det, 0)', 3)} AS s, {rs('((bx-ax)*(ay2-ay)-(by_-ay)*(ax2-ax))/nullif(det, 0)', 3)} AS t
FROM d WHERE abs(det) > 1e-4""")
def side_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of sides that are two apart meet, as parameters of both; near-parallel lines are left out."""
    s = ring(fixtures.polygons(spark, sf_dir).drop("id"))
    a = s.select("polygon_id", F.col("pos").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x", "y", "x2", "y2")])
    b = s.select("polygon_id", F.col("pos").alias("b"), (F.col("pos") - 2).alias("a"), *[F.col(c).alias(f"b{c}") for c in ("x", "y", "x2", "y2")])
    j = a.join(b, ["polygon_id", "a"])
    c = _cols("ax", "ay", "ax2", "ay2", "bx", "by", "bx2", "by2")
    u, v = g.intersection(*c)
    det = (c[2] - c[0]) * (c[7] - c[5]) - (c[3] - c[1]) * (c[6] - c[4])
    return j.where(F.abs(det) > 1e-4).select("polygon_id", big("a").alias("a"), big("b").alias("b"), r(u, 3).alias("s"), r(v, 3).alias("t"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL},
v AS (SELECT polygon_id, pos, id, x, y, x2, y2, coalesce(lag(x) OVER w, last_value(x) OVER f) AS x0, coalesce(lag(y) OVER w, last_value(y) OVER f) AS y0 FROM ring
  WINDOW w AS (PARTITION BY polygon_id ORDER BY pos), f AS (PARTITION BY polygon_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT polygon_id, CAST(pos AS BIGINT) AS pos, id, (x-x0)*(y2-y0)-(y-y0)*(x2-x0) < 0 AS reflex FROM v""")
def reflex_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the (counter-clockwise) polygons at which the ring turns clockwise."""
    w = Window.partitionBy("polygon_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = ring(fixtures.polygons(spark, sf_dir)).withColumns({f"{c}0": F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in ("x", "y")})
    return s.select("polygon_id", big("pos").alias("pos"), "id", (g.cross(*_cols("x0", "y0", "x", "y", "x2", "y2")) < 0).alias("reflex"))


@reg.query(f"""{with_sql('points')}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM points GROUP BY label)
SELECT id, {rs('exp(-(yy*(x-mx)*(x-mx)-2*xy*(x-mx)*(y-my)+xx*(y-my)*(y-my))/(xx*yy-xy*xy)/2)/(2*pi()*sqrt(xx*yy-xy*xy))', 4)} AS density
FROM points JOIN m USING (label) WHERE xx*yy-xy*xy > 0""")
def gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of each point under the normal of its label."""
    p = fixtures.points(spark, sf_dir)
    m = p.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
    d = g.gaussian_pdf2(F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("xx"), F.col("xy"), F.col("yy"))
    return p.join(m, "label").where("xx*yy-xy*xy > 0").select("id", r(d, 4).alias("density"))


@reg.query(f"SELECT a.i AS x, b.i AS y, b.i * 64 + a.i AS index, (b.i * 64 + a.i) % 64 AS x_again, (a.i - 3 + 64) % 64 AS wrapped, count(l.l_orderkey) AS n FROM range(64) a(i) CROSS JOIN range(64) b(i) LEFT JOIN lineitem l ON l.l_partkey % 64 = a.i AND l.l_suppkey % 64 = b.i GROUP BY ALL")
def cell_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the raster, their linear index and back, and a wrapped column."""
    p = fixtures.pixels(spark, sf_dir)
    i = g.sub_to_index(F.col("x"), F.col("y"), fixtures.GRID)
    return p.select("x", "y", i.alias("index"), (i % fixtures.GRID).alias("x_again"), F.pmod(F.col("x") - 3, F.lit(fixtures.GRID)).alias("wrapped"), F.col("val").alias("n"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
