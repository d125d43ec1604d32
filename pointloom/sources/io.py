"""Reading and writing the data model: point sets, edge lists, graph texts, ragged contours, point files, grey images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def read_points(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """id, x, y from the first two columns of a numeric table, whatever their names and number types."""
    t = spark.read.format(kind).options(**options).load(path)
    x, y = t.columns[:2]
    return t.select(F.monotonically_increasing_id().alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def zero_based(edges: DataFrame, *columns: str) -> DataFrame:
    """Numbers from 1 become numbers from 0; one below 1 is an error."""
    one = lambda c: F.when(F.col(c) >= 1, F.col(c) - 1).otherwise(F.raise_error(F.concat(F.lit(f"{c} is below 1: "), F.col(c).cast("string")))).alias(c)
    return edges.select(*[one(c) if c in columns else F.col(c) for c in edges.columns])


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (key) and edges (src, dst, w) of a text: N, N keys, E, E lines 's t w'. An edge with an unknown end is
    an error when the edges are read."""
    lines = spark.read.text(path, wholetext=True).select(_words(F.col("value")).alias("w"))
    n = F.get("w", 0).cast("int")
    vertices = lines.select(F.explode(F.slice("w", 2, n)).alias("key"))
    rest = lines.select(F.slice("w", n + 3, F.greatest(F.lit(0), F.size("w") - n - 2)).alias("w"))
    e = rest.select(F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("k"), "w").where("k >= 0")
    e = e.select(*[F.get("w", 3 * F.col("k") + i).alias(c) for i, c in enumerate(("src", "dst", "w"))]).withColumn("w", F.col("w").cast("double"))
    for c in ("src", "dst"):
        known = vertices.select(F.col("key").alias(c), F.lit(True).alias("known")).distinct()
        e = e.join(known, c, "left").withColumn(c, F.when(F.col("known"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown vertex "), F.col(c))))).drop("known")
    return vertices, e.select("src", "dst", "w")


def nested(contours: DataFrame) -> DataFrame:
    """contour_id, points: one row for each contour, its points in order. For contours that fit a row."""
    return contours.groupBy("contour_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("points"))


def flat(contours: DataFrame) -> DataFrame:
    """The reverse of nested()."""
    return contours.select("contour_id", F.explode("points").alias("p")).select("contour_id", "p.pos", "p.x", "p.y")


def read_point_file(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, x, y of texts with a '# n' line and 'y x' lines; lines beyond n are not points."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("l"))
    n = F.regexp_extract(F.get("l", 0), r"#\s*(\d+)", 1).cast("int")
    rows = lines.select("file", F.posexplode(F.slice("l", 2, n)).alias("pos", "line"))
    xy = _words(F.col("line"))
    return rows.select("file", "pos", F.get(xy, 1).cast("double").alias("x"), F.get(xy, 0).cast("double").alias("y")).where("x IS NOT NULL")


def read_grey(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, val of plain (P2) grey images, as texts."""
    words = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), _words(F.regexp_replace("value", r"#[^\n]*", "")).alias("w"))
    ok = words.where(F.get("w", 0) == "P2").withColumn("width", F.get("w", 1).cast("int"))
    cells = ok.select("file", "width", F.posexplode(F.slice("w", 5, F.greatest(F.lit(0), F.size("w") - 4))).alias("k", "v"))
    return cells.select("file", (F.col("k") % F.col("width")).alias("x"), F.floor(F.col("k") / F.col("width")).alias("y"), F.col("v").cast("long").alias("val"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file, band, x, y, val of bit, grey and colour images (P1 to P6, plain and binary; values of one byte or, above
    255, two, the first one greater). A file is a row, and is unpacked where it is read; a file that is none of these,
    or is cut short, is an error."""

    def unpacked(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                kind, wide, high, most, at = _header(name, raw)
                bands = 3 if kind in (3, 6) else 1
                n = wide * high * bands
                if kind == 1:  # bits may stand together
                    v = np.frombuffer(_without_notes(raw[at:]), np.uint8)
                    v = v[(v == 48) | (v == 49)].astype(np.int64) - 48
                elif kind < 4:
                    v = np.array(_without_notes(raw[at:]).split(), np.int64)
                elif kind == 4:
                    stride = -(-wide // 8)
                    rows = np.frombuffer(raw, np.uint8, offset=at)[: stride * high]
                    v = np.unpackbits(rows.reshape(-1, stride), axis=1)[:, :wide].ravel().astype(np.int64) if len(rows) == stride * high else rows[:0]
                else:
                    width = 2 if most > 255 else 1
                    v = np.frombuffer(raw[at : at + n * width], ">u2" if width == 2 else np.uint8).astype(np.int64)
                if len(v) < n:
                    raise ValueError(f"{name} is cut short")
                k = np.arange(n)
                cells = {"band": k % bands, "x": k // bands % wide, "y": k // bands // wide, "val": v[:n]}
                yield pa.RecordBatch.from_pydict({"file": [name] * n} | {c: pa.array(x.astype(np.int64)) for c, x in cells.items()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpacked, "file string, band long, x long, y long, val long")


def _without_notes(raw: bytes) -> bytes:
    import re

    return re.sub(rb"#[^\n]*", b"", raw)


def _header(name: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """Kind, width, height, greatest value, and where the values begin; notes run from # to the end of a line."""
    import re

    space = rb"(?:\s|#[^\n]*\n)+"
    m = re.match(rb"P([1-6])" + space + rb"(\d+)" + space + rb"(\d+)", raw)
    if m is None:
        raise ValueError(f"{name} is no image of this kind")
    kind, wide, high = (int(x) for x in m.groups())
    if kind in (1, 4):
        return kind, wide, high, 1, m.end() + 1
    top = re.compile(space + rb"(\d+)").match(raw, m.end())
    if top is None:
        raise ValueError(f"{name} has no greatest value")
    return kind, wide, high, int(top[1]), top.end() + 1


def image_bytes(cells: DataFrame, kind: int, width: int, height: int, most: int = 255) -> DataFrame:
    """One row, content: the cells (band, x, y, val) as a binary image of kind 4, 5 or 6; missing cells are 0, and values
    are cut off at the greatest. Lines are packed where their cells meet; the header and the lines are put together last,
    as a file is one row."""
    bands = 3 if kind == 6 else 1

    def line(batch):
        import numpy as np
        import pyarrow as pa

        row = np.zeros((width, bands), np.int64)
        row[batch.column("x").to_numpy(), batch.column("band").to_numpy()] = np.clip(batch.column("val").to_numpy(), 0, 1 if kind == 4 else most)
        packed = np.packbits(row[:, 0].astype(np.uint8)) if kind == 4 else row.astype(">u2" if most > 255 else np.uint8)
        return pa.table({"y": pa.array([batch.column("y")[0].as_py()], pa.int64()), "line": pa.array([packed.tobytes()], pa.binary())})

    inside = cells.where(f"x >= 0 AND x < {width} AND y >= 0 AND y < {height} AND band >= 0 AND band < {bands}")
    lines = inside.select(*[F.col(c).cast("long").alias(c) for c in ("band", "x", "y", "val")]).groupBy("y").applyInArrow(line, "y long, line binary")
    size = -(-width // 8) if kind == 4 else width * bands * (2 if most > 255 else 1)
    every = cells.sparkSession.range(height).select(F.col("id").alias("y")).join(lines, "y", "left")
    blank = F.unhex(F.repeat(F.lit("00"), F.lit(size)))
    head = f"P{kind}\n{width} {height}\n" + ("" if kind == 4 else f"{most}\n")
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", F.hex(F.coalesce("line", blank)).alias("h")))), lambda x: x["h"]), "")
    return every.agg(F.unhex(F.concat(F.lit(head.encode().hex()), hexes)).alias("content"))


def grey_text(cells: DataFrame, width: int, height: int) -> DataFrame:
    """One row, text: the cells (x, y, val) as a plain grey image, scaled to 0-255; missing cells are 0."""
    s = cells.agg(F.min("val").alias("lo"), F.max("val").alias("hi")).first()
    lo, hi = (float(s[k] or 0) for k in ("lo", "hi"))
    v = F.coalesce(F.round(F.try_divide(255.0 * (F.col("val") - lo), F.lit(hi - lo))), F.lit(0)).cast("int")
    rows = cells.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", v.alias("v")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.try_element_at("m", x.cast(dict(cells.dtypes)["x"])), F.lit(0)).cast("string")), " ")
    lines = rows.select("y", line.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("l"))
    return lines.select(F.concat(F.lit(f"P2\n{width} {height}\n255\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
