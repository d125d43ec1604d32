"""More rasters: bounded components, seeded distances, floods, hulls of bands, border rules; points near outlines, costs
of paths, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, kernels, raster
from ..operators.tables import written
from ..sources import fixtures
from . import rasters
from .scalars import _RING_SQL, ring
from .support import Registry, big, r, rs, with_sql

reg = Registry()

#: Sizes of components that are kept: neither specks nor the greater part of the raster.
LEAST, MOST = 2, fixtures.GRID * fixtures.GRID // 2


@reg.query(f"SELECT x, y, component, size FROM ({rasters.ORACLE_SQL['raster_components']}) WHERE size BETWEEN {LEAST} AND {MOST}")
def sized_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined cells over the foreground level, of components neither too small nor too large."""
    return rasters.raster_components(spark, sf_dir).where(F.col("size").between(LEAST, MOST))


@reg.query(f"""{with_sql('pixels')}, f AS (SELECT x, y, 1.0 / val - 1.0 / (SELECT max(val) FROM pixels) AS f FROM pixels WHERE val > 0)
SELECT p.x, p.y, {rs('sqrt(min(f.f + (p.x-f.x)*(p.x-f.x) + (p.y-f.y)*(p.y-f.y)))')} AS d FROM pixels p CROSS JOIN f GROUP BY p.x, p.y""")
def seeded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised distance transform: the more a cell holds, the nearer it is to all; empty cells are no seeds."""
    p = rasters._pixels(spark, sf_dir)
    top = p.agg(F.max("val")).first()[0]
    seeds = p.select("x", "y", F.when(F.col("val") > 0, 1.0 / F.col("val") - 1.0 / (top or 1)).alias("seed"))
    return raster.seeded_distance(seeds).select("x", "y", r(F.sqrt("d2")).alias("d"))


@reg.query(f"""{with_sql('pixels', recursive=True)}, e AS (SELECT a.x, a.y, b.x AS x2, b.y AS y2 FROM pixels a JOIN pixels b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND b.val < a.val),
reach AS (SELECT x, y, 0 AS h FROM pixels WHERE val = (SELECT max(val) FROM pixels) UNION SELECT e.x2, e.y2, h + 1 FROM reach JOIN e USING (x, y))
SELECT x, y, CAST(min(h) AS BIGINT) AS hops, (x, y) NOT IN (SELECT (x, y) FROM e) AS bottom FROM reach GROUP BY x, y""")
def descent_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the highest ones reach over ever lower neighbours, in how many steps, and which of them are bottoms."""
    p = written(rasters._pixels(spark, sf_dir).withColumn("i", F.col("y") * fixtures.GRID + F.col("x")), "cells")
    lower = raster.sent(p, raster.EIGHT, "val", "i").join(p, ["x", "y"]).where("n_val < val").select(F.col("i").alias("src"), F.col("n_i").alias("dst"))
    lower = written(lower, "lower")
    top = p.join(p.agg(F.max("val").alias("val")), "val").select(F.col("i").alias("node"))
    found = graph.breadth_first(lower, top)
    above = lower.select(F.col("src").alias("node")).distinct().withColumn("above", F.lit(True))
    return found.join(above, "node", "left").join(p.select(F.col("i").alias("node"), "x", "y"), "node").select("x", "y", "hops", F.col("above").isNull().alias("bottom"))


@reg.query("""WITH m AS (SELECT l_returnflag AS band, l_partkey % 64 AS x, l_suppkey % 64 AS y, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT band, x, y FROM m WHERE n > (SELECT 1.6 * avg(n) FROM m)),
f AS MATERIALIZED (SELECT band, min(x) AS x, y FROM g GROUP BY band, y UNION SELECT band, max(x), y FROM g GROUP BY band, y),
s AS MATERIALIZED (SELECT p.band, p.x, p.y, o.x AS x2, o.y AS y2 FROM f p JOIN f o ON p.band = o.band AND (p.x <> o.x OR p.y <> o.y)
 WHERE NOT EXISTS (SELECT 1 FROM f r WHERE r.band = p.band AND (o.x-p.x)*(r.y-p.y)-(o.y-p.y)*(r.x-p.x) < 0))
SELECT b.band, i.i AS x, j.i AS y FROM (SELECT DISTINCT band FROM s) b CROSS JOIN range(64) i(i) CROSS JOIN range(64) j(i)
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.band = b.band AND (s.x2-s.x)*(j.i-s.y)-(s.y2-s.y)*(i.i-s.x) < 0)""")
def hull_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells inside the hull of each band's foreground. A hull is one array, bounded by the raster's outline; a row of
    cells is made for each line of the raster inside the hull's box."""
    li = fixtures.table(spark, sf_dir, "lineitem")
    m = written(li.groupBy(F.col("l_returnflag").alias("label"), (F.col("l_partkey") % fixtures.GRID).alias("x"), (F.col("l_suppkey") % fixtures.GRID).alias("y")).agg(F.count("*").alias("n")), "bands")
    level = m.agg(F.avg("n") * 1.6).first()[0] or 0.0
    h = kernels.hulls(m.where(F.col("n") > level).select("label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    s = ring(h.select(F.col(h.columns[0]).alias("polygon_id"), "pos", "x", "y"))
    box = s.groupBy("polygon_id").agg(F.collect_list(F.struct("x", "y", "x2", "y2")).alias("s"), *[f(c).cast("long").alias(f"{c}{k}") for k, f in (("a", F.min), ("b", F.max)) for c in ("x", "y")])
    cells = box.select("polygon_id", "s", "xa", "xb", F.explode(F.sequence("ya", "yb")).alias("y")).select("polygon_id", "s", "y", F.explode(F.sequence("xa", "xb")).alias("x"))
    left = lambda e: g.cross(e["x"], e["y"], e["x2"], e["y2"], F.col("x"), F.col("y"))
    inside = F.forall("s", lambda e: left(e) >= 0) | F.forall("s", lambda e: left(e) <= 0)
    return cells.where(inside).select(F.col("polygon_id").alias("band"), "x", "y")


_W = fixtures.GRID


@reg.query(f"""{with_sql('pixels')}, q AS (SELECT x, y, abs(x - 2) AS fold, (x - 2 + {_W}) % {_W} AS wrap, greatest(x - 2, 0) AS rep FROM pixels)
SELECT q.x, q.y, a.val AS folded, b.val AS wrapped, c.val AS repeated, CASE WHEN q.x < 2 THEN 0 ELSE c.val END AS zeroed, CASE WHEN q.x < 2 THEN 2 * c.val - a.val ELSE c.val END AS extrapolated
FROM q JOIN pixels a ON a.x = q.fold AND a.y = q.y JOIN pixels b ON b.x = q.wrap AND b.y = q.y JOIN pixels c ON c.x = q.rep AND c.y = q.y""")
def border_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value two cells to the left, where the border folds, wraps, repeats, is zero, or goes on in a line. Each cell
    asks for the cells that its rules name; one join answers all."""
    p = rasters._pixels(spark, sf_dir)
    x = F.col("x") - 2
    asks = F.array(*[F.struct(F.lit(k).alias("rule"), at.cast("long").alias("at")) for k, at in (("fold", F.abs(x)), ("wrap", F.pmod(x, F.lit(_W))), ("repeat", F.greatest(x, F.lit(0))))])
    a = p.select("x", "y", F.explode(asks).alias("a")).select("x", "y", "a.rule", "a.at")
    got = a.join(p.select(F.col("x").alias("at"), "y", "val"), ["at", "y"]).groupBy("x", "y").agg(*[F.max(F.when(F.col("rule") == k, F.col("val"))).alias(c) for k, c in (("fold", "folded"), ("wrap", "wrapped"), ("repeat", "repeated"))])
    out = F.col("x") < 2
    return got.withColumns({
        "zeroed": F.when(out, F.lit(0).cast("long")).otherwise(F.col("repeated")),
        "extrapolated": F.when(out, 2 * F.col("repeated") - F.col("folded")).otherwise(F.col("repeated")),
    })


_BANDS = ("n", "q", "d")
_BAND_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


@reg.query(
    "WITH b AS (SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {rs(f'avg({_BANDS[i]}*{_BANDS[j]})', 3)} AS raw, {rs(f'covar_pop({_BANDS[i]}, {_BANDS[j]})', 3)} AS centred FROM b" for i, j in _BAND_PAIRS)
)
def band_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three bands of a raster: mean products, as they are and about the means. One aggregation gives all."""
    li = fixtures.table(spark, sf_dir, "lineitem")
    b = li.groupBy((F.col("l_partkey") % _W).alias("x"), (F.col("l_suppkey") % _W).alias("y")).agg(F.count("*").cast("double").alias("n"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    each = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r(F.avg(F.col(_BANDS[i]) * F.col(_BANDS[j])), 3).alias("raw"), r(F.covar_pop(_BANDS[i], _BANDS[j]), 3).alias("centred")) for i, j in _BAND_PAIRS]
    return b.agg(F.array(*each).alias("c")).select(F.explode("c").alias("c")).select("c.*")


#: Points nearer than NEAR to an outline are on it; sides are looked up in cells of CELL.
NEAR, CELL = 0.004, 0.05


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL}, t AS (SELECT p.id, q.polygon_id, p.x AS px, p.y AS py, q.x, q.y, q.x2, q.y2,
 coalesce(greatest(0, least(1, ((p.x-q.x)*(q.x2-q.x)+(p.y-q.y)*(q.y2-q.y)) / nullif((q.x2-q.x)*(q.x2-q.x)+(q.y2-q.y)*(q.y2-q.y), 0))), 0) AS t FROM points p JOIN ring q ON q.polygon_id <> p.label)
SELECT id, polygon_id FROM t WHERE sqrt(power(px-x-t*(x2-x), 2)+power(py-y-t*(y2-y), 2)) < {NEAR} GROUP BY ALL""")
def boundary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the outlines of the other labels' polygons. Sides stand in all cells that their boxes touch, points in
    their own, so only near ones meet, and once."""
    s = ring(fixtures.polygons(spark, sf_dir).drop("id"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - NEAR) / CELL), F.floor((F.greatest(a, b) + NEAR) / CELL))
    s = s.withColumn("i", F.explode(span("x", "x2"))).withColumn("j", F.explode(span("y", "y2")))
    p = fixtures.points(spark, sf_dir).select("id", "label", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / CELL).alias("i"), F.floor(F.col("y") / CELL).alias("j"))
    near = g.segment_distance(*[F.col(c) for c in ("x", "y", "x2", "y2", "px", "py")]) < NEAR
    return p.join(s, ["i", "j"]).where("polygon_id <> label").where(near).select("id", "polygon_id").distinct()


@reg.query(f"""WITH e AS (SELECT user_id, event_type, value, lead(event_type) OVER w AS t2, lead(value) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS path_id, CAST(count(*) FILTER (WHERE t2 <> event_type) AS BIGINT) AS changes, {rs('coalesce(sum(1 + (v2-value)*(v2-value)) FILTER (WHERE t2 <> event_type), 0)', 4)} AS cost FROM e GROUP BY user_id""")
def path_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each user's path over contours (the kinds of events): squared gaps where it goes from one to another."""
    e = fixtures.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("user_id", "value", F.lead("value").over(w).alias("v2"), (F.lead("event_type").over(w) != F.col("event_type")).alias("leaves"))
    gap = 1 + (F.col("v2") - F.col("value")) * (F.col("v2") - F.col("value"))
    return e.groupBy(F.col("user_id").alias("path_id")).agg(big(F.count_if("leaves")).alias("changes"), r(F.coalesce(F.sum(F.when(F.col("leaves"), gap)), F.lit(0.0)), 4).alias("cost"))


#: Points drawn from each label.
DRAWN = 20


@reg.query(f"""{with_sql('points')} SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR)), id) AS rank FROM points QUALIFY rank <= {DRAWN}""")
def drawn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each label without replacement, the same in every run: the least digests of the ids."""
    w = Window.partitionBy("label").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id")
    return fixtures.points(spark, sf_dir).select("label", "id", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= DRAWN)


@reg.query(f"""WITH s AS (SELECT vec_id AS id, {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) AS c{k}' for k in range(5))} FROM embeddings)
SELECT id, {rs('c0 + (2 - abs(c4)) * c2')} AS x, {rs('c1 + (2 - abs(c4)) * c3')} AS y FROM s""")
def projected_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vertices that move evenly since they were made stand at time 2."""
    e = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", k).cast("double").alias(f"c{k}") for k in range(5)])
    age = 2 - F.abs("c4")
    return e.select("id", r(F.col("c0") + age * F.col("c2")).alias("x"), r(F.col("c1") + age * F.col("c3")).alias("y"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
