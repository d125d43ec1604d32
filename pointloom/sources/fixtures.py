"""Point sets, contours, polygons, graphs and rasters, read out of the given tables.

The derivations are columns and joins over the tables, so their sizes follow the tables' sizes; only what a query
needs is read. `SQL` has the same derivations for DuckDB, as common table expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = 64
#: Line items of a task that makes cells of the lattice, or edges, out of them.
TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(items: DataFrame) -> int:
    """A number that grows with the line items."""
    return max(1, -(-items.count() // TASK))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, label: the first two coordinates of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"), "label")


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contour_id, pos, x, y, strength: the values of each user's events in time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    e = e.withColumn("pos", F.row_number().over(w))
    return e.select(F.col("user_id").alias("contour_id"), "pos", F.col("pos").cast("double").alias("x"), F.col("value").alias("y"), F.col("value").alias("strength"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polygon_id, pos, x, y, id: points by label, by the angle about the label's centroid."""
    p = points(spark, sf_dir)
    centre = Window.partitionBy("label")
    p = p.withColumns({"cx": F.avg("x").over(centre), "cy": F.avg("y").over(centre)})
    p = p.withColumn("angle", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    return p.select(F.col("label").alias("polygon_id"), F.row_number().over(centre.orderBy("angle", "id")).alias("pos"), "x", "y", "id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (part), dst (supplier, numbered below zero), w: the least quantity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), F.col("l_quantity").alias("w"))
    return li.repartition(tasks(li), "src", "dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, val on a grid of 64 x 64: counts of line items, 0 where there is none."""
    li = table(spark, sf_dir, "lineitem")
    counts = li.groupBy((F.col("l_partkey") % GRID).alias("x"), (F.col("l_suppkey") % GRID).alias("y")).agg(F.count("*").alias("val"))
    cells = spark.range(GRID * GRID).select((F.col("id") % GRID).alias("x"), F.floor(F.col("id") / GRID).alias("y"))
    return cells.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("val", F.lit(0)).alias("val"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: regions below a root, nations below regions, customers below nations."""
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    return (
        r.select(name("r", "r_regionkey").alias("child"), F.lit("root").alias("parent"))
        .unionByName(n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
        .unionByName(c.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")))
    )


def lattice(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame]:
    """The width of a square grid that grows with the line items (a power of two, about the root of their number), and
    x, y, val of the cells that have some: parts by suppliers, modulo the width."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    n = li.count()
    width = 1 << max(1, int(math.log2(max(4, n)) / 2))
    # A number of tasks that grows with the line items: what a cell is made into is sorted in the task that counts it.
    at = li.select((F.col("l_partkey") % width).alias("x"), (F.col("l_suppkey") % width).alias("y")).repartition(max(1, -(-n // TASK)), "x", "y")
    return width, at.groupBy("x", "y").agg(F.count("*").alias("val"))


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face, v1, x1, y1, v2, x2, y2, v3, x3, y3: two counter-clockwise triangles for each cell of the lattice that has
    line items and neighbours above; its corners are a little out of place."""
    width, cells = lattice(spark, sf_dir)
    at = lambda i, j: (F.col("x") + i, F.col("y") + j)

    def corner(n: int, i: int, j: int) -> list:
        x, y = at(i, j)
        dx, dy = F.pmod(x * 7 + y * 13, F.lit(11)) / 11.0 - 0.5, F.pmod(x * 5 + y * 3, F.lit(7)) / 7.0 - 0.5
        return [(y * width + x).alias(f"v{n}"), (x + 0.3 * dx).alias(f"x{n}"), (y + 0.3 * dy).alias(f"y{n}")]

    cells = cells.where((F.col("x") < width - 1) & (F.col("y") < width - 1))
    face = 2 * (F.col("y") * width + F.col("x"))
    lower = cells.select(face.alias("face"), *corner(1, 0, 0), *corner(2, 1, 0), *corner(3, 1, 1))
    return lower.unionByName(cells.select((face + 1).alias("face"), *corner(1, 0, 0), *corner(2, 1, 1), *corner(3, 0, 1)))


SQL = {
    "points": "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)",
    "contours": "contours AS (SELECT user_id AS contour_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x, value AS y, value AS strength FROM events)",
    "polygons": """centred AS (SELECT *, avg(x) OVER (PARTITION BY label) AS cx, avg(y) OVER (PARTITION BY label) AS cy FROM points),
polygons AS (SELECT label AS polygon_id, row_number() OVER (PARTITION BY label ORDER BY atan2(y - cy, x - cx), id) AS pos, x, y, id FROM centred)""",
    "edges": "edges AS (SELECT l_partkey AS src, -l_suppkey AS dst, min(l_quantity) AS w FROM lineitem GROUP BY ALL)",
    "pixels": f"""counts AS (SELECT l_partkey % {GRID} AS x, l_suppkey % {GRID} AS y, count(*) AS val FROM lineitem GROUP BY ALL),
pixels AS (SELECT a.i AS x, b.i AS y, coalesce(val, 0) AS val FROM range({GRID}) a(i) CROSS JOIN range({GRID}) b(i) LEFT JOIN counts ON counts.x = a.i AND counts.y = b.i)""",
    "lattice": """width AS (SELECT CAST(1 << greatest(1, CAST(floor(log2(greatest(4, count(*))) / 2) AS INTEGER)) AS BIGINT) AS w FROM lineitem),
lattice AS (SELECT l_partkey % w AS x, l_suppkey % w AS y, count(*) AS val FROM lineitem, width GROUP BY ALL)""",
    "mesh": """mesh AS (SELECT face, y1 * w + x1 AS v1, x1 + 0.3 * ((x1 * 7 + y1 * 13) % 11 / 11.0 - 0.5) AS x1, y1 + 0.3 * ((x1 * 5 + y1 * 3) % 7 / 7.0 - 0.5) AS y1,
 y2 * w + x2 AS v2, x2 + 0.3 * ((x2 * 7 + y2 * 13) % 11 / 11.0 - 0.5) AS x2, y2 + 0.3 * ((x2 * 5 + y2 * 3) % 7 / 7.0 - 0.5) AS y2,
 y3 * w + x3 AS v3, x3 + 0.3 * ((x3 * 7 + y3 * 13) % 11 / 11.0 - 0.5) AS x3, y3 + 0.3 * ((x3 * 5 + y3 * 3) % 7 / 7.0 - 0.5) AS y3
 FROM (SELECT w, 2 * (y * w + x) AS face, x AS x1, y AS y1, x + 1 AS x2, y AS y2, x + 1 AS x3, y + 1 AS y3 FROM lattice, width WHERE x < w - 1 AND y < w - 1
 UNION ALL SELECT w, 2 * (y * w + x) + 1, x, y, x + 1, y + 1, x, y + 1 FROM lattice, width WHERE x < w - 1 AND y < w - 1))""",
    "tree": """tree AS (SELECT 'r' || r_regionkey AS child, 'root' AS parent FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)""",
}
NEEDS = {"polygons": ("points",), "mesh": ("lattice",)}


def with_sql(*names: str, recursive: bool = False) -> str:
    """WITH clause that defines the named fixtures (no trailing comma)."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order)
