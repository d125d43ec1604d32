"""Meshes, paths between all pairs, fits of groups, bins by angle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, kernels
from ..operators.tables import let_go, written
from ..sources import fixtures
from .aggregates import _EIGEN
from .scalars import _RING_SQL, ring
from .support import Registry, big, r, rs, with_sql

reg = Registry()


def _nation_sql(rounds: int) -> str:
    """As many squarings as paths between 25 nations can need."""
    sql = """WITH t AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS (SELECT s_nationkey AS a, c_nationkey AS b, min(abs(s_acctbal - c_acctbal)) AS d FROM t JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 n AS (SELECT s_nationkey AS a FROM supplier UNION SELECT c_nationkey FROM customer),
 d0 AS MATERIALIZED (SELECT a, b, min(d) AS d FROM (SELECT * FROM e UNION ALL SELECT a, a, 0 FROM n WHERE a IS NOT NULL) GROUP BY a, b)"""
    for i in range(rounds):
        sql += f", d{i + 1} AS MATERIALIZED (SELECT p.a, q.b, min(p.d + q.d) AS d FROM d{i} p JOIN d{i} q ON p.b = q.a GROUP BY p.a, q.b)"
    return sql + f" SELECT a, b, {rs('d', 4)} AS d FROM d{rounds}"


def nation_distances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges between nations (a, b, d: suppliers' to those of the customers they deliver to), and least distances over
    any number of edges: the distance table times itself, least for plus, until it no longer changes. A customer without
    an order gives its nation only."""
    s, c, o, li = (fixtures.table(spark, sf_dir, t) for t in ("supplier", "customer", "orders", "lineitem"))
    trade = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    e = trade.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.min(F.abs(F.col("s_acctbal") - F.col("c_acctbal"))).alias("d"))
    e = written(e, "edges")
    own = s.select(F.col("s_nationkey").alias("a")).unionByName(c.select(F.col("c_nationkey").alias("a"))).where("a IS NOT NULL").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    d = written(e.unionByName(own).groupBy("a", "b").agg(F.min("d").alias("d")), "paths")
    for _ in range(own.count() + 1):
        q = d.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("d2"))
        new = written(d.join(q, "b").groupBy("a", F.col("c").alias("b2")).agg(F.min(F.col("d") + F.col("d2")).alias("d")).withColumnRenamed("b2", "b"), "paths")
        same = new.join(d, ["a", "b", "d"], "left_anti").isEmpty()
        let_go(d)
        d = new
        if same:
            return e, d
    raise RuntimeError("the paths did not settle")


@reg.query(_nation_sql(5))
def all_pairs_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distances between nations over any number of edges."""
    return nation_distances(spark, sf_dir)[1].select("a", "b", r("d", 4).alias("d"))


@reg.query(f"""{with_sql('points')}, m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM points GROUP BY label),
p AS (SELECT label, any_value(n) AS n, sum(-ln(exp(-(yy*(x-mx)*(x-mx)-2*xy*(x-mx)*(y-my)+xx*(y-my)*(y-my))/(xx*yy-xy*xy)/2)/(2*pi()*sqrt(xx*yy-xy*xy)))) AS nll FROM points JOIN m USING (label) GROUP BY label)
SELECT label, {rs('CASE WHEN p.n > 6 THEN nll + 5 + 5*6/(p.n-5-1.0) END', 4)} AS aicc, {rs(f"({_EIGEN.format('+')})/nullif({_EIGEN.format('-')}, 0)", 4)} AS elongation FROM p JOIN m USING (label)""")
def model_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information criterion of one normal for each label, and its elongation."""
    p = fixtures.points(spark, sf_dir)
    m = p.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
    d = g.gaussian_pdf2(F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("xx"), F.col("xy"), F.col("yy"))
    s = p.join(m, "label").groupBy("label", "n", "xx", "xy", "yy").agg(F.sum(-F.log(d)).alias("nll"))
    major, minor = g.eigen2(F.col("xx"), F.col("xy"), F.col("yy"))
    return s.select("label", r(F.when(F.col("n") > 6, F.col("nll") + 5 + 30 / (F.col("n") - 6)), 4).alias("aicc"), r(F.try_divide(major, minor), 4).alias("elongation"))


@reg.query(f"""{with_sql('points')}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM points GROUP BY label),
b AS (SELECT label, CAST(floor((atan2(y-cy, x-cx)+pi())/(2*pi())*16) AS BIGINT) % 16 AS bin, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS d FROM points JOIN c USING (label))
SELECT c.label AS label, t.k AS bin, count(b.d) AS n, {rs('coalesce(min(b.d), 1.0)')} AS nearest FROM c CROSS JOIN range(16) t(k) LEFT JOIN b ON b.label = c.label AND b.bin = t.k GROUP BY ALL""")
def angular_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points about each label's centroid in sixteen bins of angles; an empty bin has distance 1."""
    p = fixtures.points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    b = p.join(c, "label").select("label", big(F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * 16) % 16).alias("bin"), F.sqrt(dx * dx + dy * dy).alias("d"))
    got = b.groupBy("label", "bin").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    held = got.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "d")))).alias("m"))  # sixteen entries
    each = held.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("bin"), "m").withColumn("v", F.try_element_at("m", F.col("bin")))
    return each.select("label", "bin", F.coalesce("v.n", F.lit(0).cast("long")).alias("n"), r(F.coalesce("v.d", F.lit(1.0))).alias("nearest"))


@reg.query(f"""{with_sql('polygons')}, {_RING_SQL},
v AS (SELECT polygon_id, x, y, x2, y2, coalesce(lag(x) OVER w, last_value(x) OVER f) AS x0, coalesce(lag(y) OVER w, last_value(y) OVER f) AS y0 FROM ring
 WINDOW w AS (PARTITION BY polygon_id ORDER BY pos), f AS (PARTITION BY polygon_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, abs(atan2(y2-y, x2-x) - atan2(y-y0, x-x0)) AS d FROM v)
SELECT polygon_id, {rs('sum(sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) + sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) + 10*least(d, 2*pi()-d))', 4)} AS energy FROM a GROUP BY polygon_id""")
def elastica_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of both sides and ten times the bend, over each closed ring."""
    w = Window.partitionBy("polygon_id").orderBy("pos")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = ring(fixtures.polygons(spark, sf_dir)).withColumns({f"{c}0": F.coalesce(F.lag(c).over(w), F.last(c).over(all_)) for c in ("x", "y")})
    x0, y0, x, y, x2, y2 = (F.col(c) for c in ("x0", "y0", "x", "y", "x2", "y2"))
    bend = g.angle_difference(g.direction(x2, y2, x, y), g.direction(x, y, x0, y0))
    return s.groupBy("polygon_id").agg(r(F.sum(g.distance(x0, y0, x, y) + g.distance(x, y, x2, y2) + 10 * bend), 4).alias("energy"))


@reg.query(f"""{with_sql('points', recursive=True)}, q AS (SELECT label + 100 AS label, quantile_disc(x, 0.2) AS x1, quantile_disc(x, 0.8) AS x2, quantile_disc(y, 0.2) AS y1, quantile_disc(y, 0.8) AS y2 FROM points GROUP BY label),
hull AS (SELECT p.label, p.x, p.y, o.x AS x2, o.y AS y2 FROM points p JOIN points o ON p.label = o.label AND p.id <> o.id
 WHERE NOT EXISTS (SELECT 1 FROM points r WHERE r.label = p.label AND (o.x-p.x)*(r.y-p.y)-(o.y-p.y)*(r.x-p.x) < 0)),
s AS MATERIALIZED (SELECT * FROM hull UNION ALL SELECT label, x1, y1, x2, y1 FROM q UNION ALL SELECT label, x2, y1, x2, y2 FROM q UNION ALL SELECT label, x2, y2, x1, y2 FROM q UNION ALL SELECT label, x1, y2, x1, y1 FROM q),
b AS (SELECT label, sum(x*y2-x2*y)/2 AS area FROM s GROUP BY label),
c AS MATERIALIZED (SELECT p.label AS outer_, q.label AS inner_ FROM b p JOIN b q ON p.area > q.area
 WHERE NOT EXISTS (SELECT 1 FROM s e JOIN s v ON e.label = p.label AND v.label = q.label AND (e.x2-e.x)*(v.y-e.y)-(e.y2-e.y)*(v.x-e.x) < 0)),
t AS (SELECT inner_ AS box, 1 AS rank FROM c UNION SELECT c.inner_, t.rank + 1 FROM t JOIN c ON c.outer_ = t.box)
SELECT b.label AS box, CAST(coalesce(max(t.rank), 0) AS BIGINT) AS rank FROM b LEFT JOIN t ON t.box = b.label GROUP BY b.label""")
def containment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each label's polygons (the hull of all its points, and the rectangle of its inner quantiles) lie in one
    another."""
    p = fixtures.points(spark, sf_dir)
    q = lambda c, f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {c})")
    whole = kernels.hulls(p).select("label", "pos", "x", "y")
    inner = p.groupBy((F.col("label") + 100).alias("label")).agg(q("x", 0.2).alias("x1"), q("x", 0.8).alias("x2"), q("y", 0.2).alias("y1"), q("y", 0.8).alias("y2"))
    corners = F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])).alias("pos", "c")
    inner = inner.select("label", corners).select("label", (F.col("pos") + 1).cast("long").alias("pos"), "c.x", "c.y")
    rings = written(whole.unionByName(inner).select(F.col("label").cast("long").alias("polygon_id"), "pos", "x", "y"), "rings")
    labels = rings.select("polygon_id").distinct()
    ranks = graph.longest_ranks(_contained(rings), labels.count())
    return labels.join(ranks, labels["polygon_id"] == ranks["node"], "left").select(F.col("polygon_id").cast(inner.schema["label"].dataType).alias("box"), F.coalesce("rank", F.lit(0).cast("long")).alias("rank"))


def _contained(rings: DataFrame) -> DataFrame:
    """src, dst of polygons where all vertices of dst lie in src, or on it, and src has the greater area. rings:
    polygon_id, pos, x, y. Boxes only find the candidates."""
    sides = written(ring(rings), "sides")
    b = sides.groupBy("polygon_id").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), (F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("area"))
    # boxes pair by the cells of a coarse grid that both touch, so only near ones meet
    o = b.select(F.col("polygon_id").alias("src"), *[F.col(c).alias(f"o{c}") for c in ("x1", "x2", "y1", "y2", "area")], F.explode(F.sequence(F.floor(F.col("x1") * 4), F.floor(F.col("x2") * 4))).alias("i"))
    i = b.select(F.col("polygon_id").alias("dst"), "x1", "x2", "y1", "y2", "area", F.floor(F.col("x1") * 4).alias("i"))
    near = o.join(i, "i").where("src <> dst AND ox1 <= x1 AND ox2 >= x2 AND oy1 <= y1 AND oy2 >= y2 AND oarea > area").select("src", "dst")
    v = near.join(rings.select(F.col("polygon_id").alias("dst"), F.col("pos").alias("k"), F.col("x").alias("px"), F.col("y").alias("py")), "dst")
    s = v.join(sides.select(F.col("polygon_id").alias("src"), "x", "y", "x2", "y2"), "src")
    crosses = F.expr("(y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / (CASE WHEN y2 <> y THEN y2 - y END) + x")
    on = F.expr("(x2 - x) * (py - y) = (y2 - y) * (px - x) AND px BETWEEN least(x, x2) AND greatest(x, x2) AND py BETWEEN least(y, y2) AND greatest(y, y2)")
    each = s.groupBy("src", "dst", "k").agg((F.max(on) | (F.count_if(crosses) % 2 == 1)).alias("inside"))
    return each.groupBy("src", "dst").agg(F.min("inside").alias("all")).where("all").select("src", "dst")


@reg.query()
def convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's mesh: area that is left when boundary triangles with a side over a length have gone, round by
    round until none goes, as a share of all. Each round is one join of faces with the edges that have one face."""
    p = fixtures.points(spark, sf_dir)
    t = kernels.triangulated(p)
    for c in ("a", "b", "c"):
        t = t.join(p.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)
    xy = [F.col(f"{c}{d}") for c in "abc" for d in "xy"]
    length = lambda u, v: g.distance(F.col(f"{u}x"), F.col(f"{u}y"), F.col(f"{v}x"), F.col(f"{v}y"))
    sides = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v"), length(u, v).alias("d")) for u, v in (("a", "b"), ("b", "c"), ("a", "c"))])
    faces = written(t.select("label", "a", "b", "c", g.triangle_area(*xy).alias("area"), sides.alias("sides")), "faces")
    whole = faces.groupBy("label").agg(F.sum("area").alias("whole"))
    live = faces
    n = faces.count()
    for _ in range(n + 1):  # each round but the last takes a face
        e = live.select("label", "a", "b", "c", F.explode("sides").alias("s")).groupBy("label", "s.u", "s.v").agg(F.count("*").alias("n"), F.first("s.d").alias("d"), F.first(F.struct("a", "b", "c")).alias("f"))
        gone = e.where("n = 1 AND d > 0.1").select("label", "f.a", "f.b", "f.c").distinct()
        rest = written(live.join(gone, ["label", "a", "b", "c"], "left_anti"), "faces")
        before, n, live = n, rest.count(), rest
        if n == before:
            break
    else:
        raise RuntimeError("the mesh did not settle")
    left = live.groupBy("label").agg(F.sum("area").alias("kept"))
    return whole.join(left, "label", "left").select("label", r(F.try_divide(F.coalesce("kept", F.lit(0.0)), F.col("whole"))).alias("convexity"))


QUERIES, ORACLE_SQL = reg.queries, reg.sql
