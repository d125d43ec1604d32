"""Queries that exercise the reading and writing forms on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures, io
from .support import Registry, big, r, rs, with_sql

reg = Registry()


@reg.query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers, from numbers that start at 1, both ways."""
    e = fixtures.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("src"), (F.col("l_suppkey") + 1).alias("dst")).distinct()
    return io.both_ways(io.zero_based(e, "src", "dst")).distinct()


@reg.query(f"{with_sql('contours')} SELECT contour_id, CAST(pos AS BIGINT) AS pos, {rs('y')} AS y FROM contours")
def ragged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours into one row each, and back."""
    c = fixtures.contours(spark, sf_dir)
    return io.flat(io.nested(c)).select("contour_id", big("pos").alias("pos"), r("y").alias("y"))


@reg.query(f"{with_sql('points')} SELECT CAST(count(*) AS BIGINT) AS n, {rs('sum(x)', 4)} AS sx, {rs('sum(y)', 4)} AS sy FROM points")
def point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.points(spark, sf_dir)
    return p.agg(F.count("*").alias("n"), r(F.sum("x"), 4).alias("sx"), r(F.sum("y"), 4).alias("sy"))


@reg.query(f"""{with_sql('pixels')}, s AS (SELECT min(val) AS lo, max(val) AS hi FROM pixels), l AS (SELECT y, string_agg(CAST(CAST(round(255.0 * (val - lo) / (hi - lo)) AS BIGINT) AS VARCHAR), ' ' ORDER BY x) AS line FROM pixels, s GROUP BY y)
SELECT 'P2' || chr(10) || '64 64' || chr(10) || '255' || chr(10) || string_agg(line, chr(10) ORDER BY y) || chr(10) AS text FROM l""")
def grey_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as the text of a grey image (one row; the raster is of fixed size)."""
    return io.grey_text(fixtures.pixels(spark, sf_dir), fixtures.GRID, fixtures.GRID)


QUERIES, ORACLE_SQL = reg.queries, reg.sql
