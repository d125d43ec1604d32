"""Meshes: adjacency, invariants, saliency, clusters of faces, outlines; and fragments put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lists, mesh
from ..sources import fixtures
from .support import Registry, big, r, rs, with_sql

reg = Registry()
#: Length at which a side counts half, steepness of that, and the similarity of faces.
BETA, GAMMA, ALIKE = 1.1, 6.0, 0.8

_D = "sqrt(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y))"
_SIDES = f"""sides AS (SELECT *, {_D.format(a='a', b='c')} AS len, least(a, b) AS u, greatest(a, b) AS v, {_D.format(a='o', b='a')} AS la, {_D.format(a='o', b='c')} AS lb FROM (
 SELECT face, 1 AS side, v1 AS a, x1 AS ax, y1 AS ay, v2 AS b, x2 AS cx, y2 AS cy, v3 AS o, x3 AS ox, y3 AS oy FROM mesh
 UNION ALL SELECT face, 2, v2, x2, y2, v3, x3, y3, v1, x1, y1 FROM mesh UNION ALL SELECT face, 3, v3, x3, y3, v1, x1, y1, v2, x2, y2 FROM mesh)),
edges AS (SELECT u, v, count(*) AS n, min(face) AS f1, arg_min(o, face) AS o1, CASE WHEN count(*) > 1 THEN max(face) END AS f2, CASE WHEN count(*) > 1 THEN arg_max(o, face) END AS o2, max(len) AS len FROM sides GROUP BY u, v),
rim AS (SELECT u AS vertex FROM edges WHERE n = 1 UNION SELECT v FROM edges WHERE n = 1)"""
_MESH = f"{with_sql('mesh')}, {_SIDES}"
_ANGLE = "acos(greatest(-1.0, least(1.0, (la*la + lb*lb - len*len) / (2*la*lb))))"


@reg.query(f"{_MESH} SELECT u, v, n, f1, o1, f2, o2, {rs('len')} AS len, n = 1 AS boundary FROM edges")
def mesh_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge with the faces beside it and the vertices opposite."""
    return mesh.edges(fixtures.mesh(spark, sf_dir)).withColumns({"len": r("len"), "boundary": F.col("n") == 1})


@reg.query(f"{_MESH} SELECT u, v, f1 AS face, o1 AS opposite FROM edges WHERE n = 1 AND o1 NOT IN (SELECT vertex FROM rim)")
def safe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary edges whose face can go without a vertex that the outline passes twice."""
    return mesh.safe(mesh.edges(fixtures.mesh(spark, sf_dir))).select("u", "v", F.col("f1").alias("face"), F.col("o1").alias("opposite"))


@reg.query(f"""{_MESH} SELECT (SELECT count(*) FROM mesh) AS n_faces, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT a) FROM sides) AS n_vertices,
 (SELECT count(*) FROM edges WHERE n = 1) AS n_boundary, (SELECT count(*) FROM edges WHERE n > 2) AS n_crowded, (SELECT count(*) FROM mesh WHERE v1 = v2 OR v2 = v3 OR v1 = v3) AS n_pinched,
 (SELECT count(*) FROM mesh WHERE (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) <= 0) AS n_turned, (SELECT count(*) FROM (SELECT a, b FROM sides GROUP BY a, b HAVING count(*) > 1)) AS n_doubled,
 (SELECT count(*) FROM (SELECT x FROM (SELECT u AS x FROM edges WHERE n = 1 UNION ALL SELECT v FROM edges WHERE n = 1) GROUP BY x HAVING count(*) % 2 = 1)) AS n_open""")
def mesh_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the mesh, and counts of what a mesh must not have."""
    return mesh.checked(fixtures.mesh(spark, sf_dir))


@reg.query(f"{_MESH} SELECT face, u, v, {rs('len - least(la, lb)')} AS flatness, {rs('greatest(0, max(len - least(la, lb)) OVER (PARTITION BY u, v))')} AS of_edge FROM sides")
def side_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much longer each side is than the shorter of the other two, and the greatest over the faces of its edge."""
    s = mesh.flat_sides(fixtures.mesh(spark, sf_dir))
    top = s.groupBy("u", "v").agg(F.greatest(F.lit(0.0), F.max("flatness")).alias("of_edge"))
    return s.join(top, ["u", "v"]).select("face", "u", "v", r("flatness").alias("flatness"), r("of_edge").alias("of_edge"))


def _length(c: str) -> str:
    return f"(1 - 1/(1 + exp(-{GAMMA} * ({c} - {BETA}) / {BETA})))"


@reg.query(f"""{_MESH}, t AS (SELECT *, {_ANGLE} AS angle FROM sides)
SELECT face, o AS vertex, u AS p, v AS q, {rs('angle', 5)} AS angle, {rs(f"{_length('la')} * {_length('lb')} * (1 - cos(angle)) / 2", 5)} AS fitness, o IN (SELECT vertex FROM rim) AS exposed FROM t""")
def corner_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle and fitness of the two edges at each corner of a face, and whether the corner is on the boundary."""
    faces = fixtures.mesh(spark, sf_dir)
    rim = mesh.boundary_vertices(mesh.edges(faces)).withColumn("exposed", F.lit(True))
    c = mesh.pair_fitness(mesh.corners(faces), BETA, GAMMA).join(rim, "vertex", "left")
    return c.select("face", "vertex", "p", "q", r("angle", 5).alias("angle"), r("fitness", 5).alias("fitness"), F.coalesce("exposed", F.lit(False)).alias("exposed"))


@reg.query(f"""{_MESH}, t AS (SELECT o AS vertex, u AS p, v AS q, {_length('la')} * {_length('lb')} * (1 - cos({_ANGLE})) / 2 AS fitness FROM sides),
e AS (SELECT vertex, p AS other, fitness FROM t UNION ALL SELECT vertex, q, fitness FROM t),
s AS (SELECT vertex, other, sum(fitness) AS s FROM e GROUP BY ALL)
SELECT vertex, count(*) AS degree, {rs('max(s)', 5)} AS best, {rs('sum(s) / 2', 5)} AS whole FROM s GROUP BY vertex""")
def radial_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vertex: sums of the fitness of its edges with those beside them in a face; the greatest of an edge, and
    that of all pairs."""
    c = mesh.pair_fitness(mesh.corners(fixtures.mesh(spark, sf_dir)), BETA, GAMMA)
    e = c.select("vertex", F.explode(F.array("p", "q")).alias("other"), "fitness").groupBy("vertex", "other").agg(F.sum("fitness").alias("s"))
    return e.groupBy("vertex").agg(F.count("*").alias("degree"), r(F.max("s"), 5).alias("best"), r(F.sum("s") / 2, 5).alias("whole"))


@reg.query(f"""{with_sql('mesh', recursive=True)}, {_SIDES}, m AS (SELECT face, max(len) AS most FROM sides GROUP BY face),
near AS MATERIALIZED (SELECT f1 AS a, f2 AS b FROM edges JOIN m x ON x.face = f1 JOIN m y ON y.face = f2 WHERE n = 2 AND len / greatest(x.most, y.most) > {ALIKE}),
both_ways AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(node, low) USING KEY (node) AS (SELECT face, face FROM mesh UNION SELECT l.node, l.low FROM (SELECT e.b AS node, min(x.low) AS low FROM reach x JOIN both_ways e ON e.a = x.node GROUP BY e.b) l JOIN recurring.reach o ON o.node = l.node WHERE l.low < o.low)
SELECT node AS face, low AS label FROM reach""")
def similar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces joined over edges that are long for both of them."""
    return mesh.similar(fixtures.mesh(spark, sf_dir), ALIKE)


@reg.query()
def mesh_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary as rings of directed edges, in order (checked against a walk in the tests)."""
    return mesh.outlines(fixtures.mesh(spark, sf_dir), fixtures.tasks(fixtures.table(spark, sf_dir, "lineitem")))


@reg.query(f"""{with_sql('polygons')}, n AS (SELECT polygon_id, pos, id, count(*) OVER w AS n, min(id) OVER w AS head, arg_min(pos, id) OVER w AS p0 FROM polygons WINDOW w AS (PARTITION BY polygon_id))
SELECT id AS node, head AS list, CAST((pos - p0 + n) % n AS BIGINT) AS pos FROM n""")
def ring_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines given only as links from point to next point: list and place of every point, from the least one on."""
    around = Window.partitionBy("polygon_id").orderBy("pos")
    p = fixtures.polygons(spark, sf_dir)
    links = p.select(F.col("id").alias("node"), F.coalesce(F.lead("id").over(around), F.first("id").over(around)).alias("next"))
    return lists.ranked(links).select("node", "list", big("pos").alias("pos"))


#: Points of a fragment; every third fragment runs backwards.
PIECE = 16


@reg.query(f"""{with_sql('contours')}, f AS (SELECT contour_id * 100000 + (pos - 1) // {PIECE} AS fragment, contour_id, pos, y FROM contours),
k AS (SELECT contour_id, min(fragment) AS list FROM f GROUP BY contour_id)
SELECT k.list, fragment, CAST(CASE WHEN fragment % 3 = 0 THEN (SELECT max(pos) + min(pos) FROM f g WHERE g.fragment = f.fragment) - pos ELSE pos END - 1 AS BIGINT) AS at, {rs('y')} AS y FROM f JOIN k USING (contour_id)""")
def stitched_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours cut into fragments that know only what follows them, and put together again: every third fragment runs
    the other way."""
    c = fixtures.contours(spark, sf_dir)
    f = c.select((F.col("contour_id") * 100000 + F.expr(f"(pos - 1) div {PIECE}")).alias("fragment"), "contour_id", "pos", "y")
    whole = f.select("contour_id", "fragment").distinct()
    ahead = whole.select((F.col("fragment") - 1).alias("fragment"), F.col("fragment").alias("next"), "contour_id")
    fragments = whole.join(ahead, ["contour_id", "fragment"], "left").select("fragment", "next", (F.col("fragment") % 3 == 0).alias("reversed"))
    return lists.stitched(fragments, f.select("fragment", "pos", "y")).select("list", "fragment", big("at").alias("at"), r("y").alias("y"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
