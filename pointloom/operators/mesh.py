"""Triangle meshes as tables of faces, sides and edges; look-ups are equi-joins and aggregates, never walks.

faces: face, v1, x1, y1, v2, x2, y2, v3, x3, y3, counter-clockwise. An edge has one face or two; with one it is on the
boundary. Edges of three faces and more are no mesh: `checked` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graph, lists


def sides(faces: DataFrame, *more: Column) -> DataFrame:
    """face, side, a, ax, ay, b, bx, by, o, ox, oy, len: each face's sides from a to b, with the vertex opposite; and more
    of the face."""
    parts = []
    for k, (i, j, o) in enumerate(((1, 2, 3), (2, 3, 1), (3, 1, 2)), 1):
        parts.append(F.struct(F.lit(k).alias("side"), *[F.col(f"{c}{n}").alias(m) for n, m3 in ((i, ("a", "ax", "ay")), (j, ("b", "bx", "by")), (o, ("o", "ox", "oy"))) for c, m in zip(("v", "x", "y"), m3)]))
    held = faces.select("*", *more)
    s = held.select("face", *held.columns[len(faces.columns) :], F.explode(F.array(*parts)).alias("s"))
    s = s.select(*[c for c in s.columns if c != "s"], "s.*")
    return s.withColumn("len", g.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def edges(faces: DataFrame) -> DataFrame:
    """u, v, n (faces), f1, o1, f2, o2 (null on the boundary), len. u < v; f1 < f2 are the faces beside, o1 and o2 the
    vertices opposite in them."""
    s = sides(faces).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "len", F.struct("face", "o").alias("f"))
    e = s.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.max("len").alias("len"))
    two = F.col("n") > 1
    return e.select("u", "v", "n", F.col("lo.face").alias("f1"), F.col("lo.o").alias("o1"), F.when(two, F.col("hi.face")).alias("f2"), F.when(two, F.col("hi.o")).alias("o2"), "len")


def boundary_vertices(e: DataFrame) -> DataFrame:
    """vertex: ends of edges with one face."""
    b = e.where("n = 1")
    return b.select(F.col("u").alias("vertex")).unionByName(b.select(F.col("v").alias("vertex"))).distinct()


def safe(e: DataFrame) -> DataFrame:
    """Boundary edges whose opposite vertex is on no boundary edge: taking their face away leaves the outline simple."""
    return e.where("n = 1").join(boundary_vertices(e), F.col("o1") == F.col("vertex"), "left_anti")


def adjacent(e: DataFrame) -> DataFrame:
    """f1, f2, u, v, len: faces that share an edge."""
    return e.where("n = 2").select("f1", "f2", "u", "v", "len")


def similar(faces: DataFrame, t: float) -> DataFrame:
    """face, label: faces joined over edges whose length is more than t of the longest side of either face; the label is
    the least face."""
    longest = F.greatest(*[g.distance(*[F.col(f"{c}{n}") for n in pair for c in "xy"]) for pair in ((1, 2), (2, 3), (3, 1))])
    s = sides(faces, longest.alias("most")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "face", "len", "most")
    near = s.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("face").alias("f1"), F.max("face").alias("f2"), F.max("len").alias("len"), F.max("most").alias("most"))
    near = near.where("n = 2").where(F.col("len") / F.col("most") > t)
    roots = graph.components(near.select(F.col("f1").alias("a"), F.col("f2").alias("b")))
    return faces.select("face").join(roots, F.col("face") == F.col("node"), "left").select("face", F.coalesce("root", "face").alias("label"))


def checked(faces: DataFrame) -> DataFrame:
    """One row of counts: faces, edges, vertices, boundary edges, and faults: edges with three faces or more, faces with
    a vertex twice, clockwise or flat faces, sides that two faces have in the same direction, vertices whose boundary
    edges do not pair up."""
    s, e = sides(faces), edges(faces)
    each = faces.agg(F.count("*").alias("n_faces"), F.count_if((F.col("v1") == F.col("v2")) | (F.col("v2") == F.col("v3")) | (F.col("v1") == F.col("v3"))).alias("n_pinched"), F.count_if(g.cross(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "x3", "y3")]) <= 0).alias("n_turned"))
    of_edges = e.agg(F.count("*").alias("n_edges"), F.count_if(F.expr("n = 1")).alias("n_boundary"), F.count_if(F.expr("n > 2")).alias("n_crowded"))
    vertices = s.select(F.col("a").alias("v")).distinct().agg(F.count("*").alias("n_vertices"))
    doubled = s.groupBy("a", "b").agg(F.count("*").alias("k")).agg(F.count_if(F.expr("k > 1")).alias("n_doubled"))
    ends = e.where("n = 1").select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("k")).agg(F.count_if(F.expr("k % 2 = 1")).alias("n_open"))
    return each.crossJoin(of_edges).crossJoin(vertices).crossJoin(doubled).crossJoin(ends)  # one row each


def corners(faces: DataFrame) -> DataFrame:
    """face, vertex, p, q, angle, lp, lq: at each corner its two edges (to p and q, p < q), their angle and lengths."""
    s = sides(faces)
    swap = F.col("a") < F.col("b")
    angle = g.visual_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("ox"), F.col("oy"))
    la, lb = (g.distance(F.col("ox"), F.col("oy"), F.col(f"{c}x"), F.col(f"{c}y")) for c in "ab")
    return s.select("face", F.col("o").alias("vertex"), F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), angle.alias("angle"), F.when(swap, la).otherwise(lb).alias("lp"), F.when(swap, lb).otherwise(la).alias("lq"))


def length_term(length: Column, t: float, alpha: float) -> Column:
    """From 1 for short to 0 for long, a half at t."""
    return 1 - 1 / (1 + F.exp(-alpha * (length - t) / t))


def angle_term(angle: Column) -> Column:
    return (1 - F.cos(angle)) / 2


def pair_fitness(c: DataFrame, t: float, alpha: float) -> DataFrame:
    """Corners with fitness: both edges short, and straight on."""
    return c.withColumn("fitness", length_term(F.col("lp"), t, alpha) * length_term(F.col("lq"), t, alpha) * angle_term(F.col("angle")))


def flat_sides(faces: DataFrame) -> DataFrame:
    """face, u, v, flatness: a side's length less the shorter of the other two; most is the greatest flatness of an edge
    over its faces, not below 0."""
    s = sides(faces)
    la, lb = (g.distance(F.col("ox"), F.col("oy"), F.col(f"{c}x"), F.col(f"{c}y")) for c in "ab")
    return s.select("face", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "len", (F.col("len") - F.least(la, lb)).alias("flatness"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From corners (v, a, b: the vertices before and after v in a face) in the order of v and a: of each boundary edge the
    next one in the same fan of faces, as node and next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        v = table.column("v").to_numpy()
        whole = int(np.searchsorted(v, v[-1])) if len(v) else 0  # the last vertex may go on
        held = table.slice(whole)
        if whole:
            yield _fans(table.slice(0, whole))
    if held is not None and len(held):
        yield _fans(held)


def _fans(corners: pa.Table) -> pa.RecordBatch:
    v, a, b = (corners.column(c).to_numpy() for c in ("v", "a", "b"))
    key, after = v << 32 | a, v << 32 | b
    to = np.minimum(np.searchsorted(key, after), len(key) - 1)
    inner = key[to] == after
    begins = np.ones(len(key), bool)
    begins[to[inner]] = False
    first = np.flatnonzero(begins)
    last = np.where(inner, to, np.arange(len(key)))
    for _ in range(len(key).bit_length()):
        if not inner[last[first]].any():
            break
        last = last[last]
    ends = last[first]
    return pa.RecordBatch.from_pydict({"node": pa.array(a[first] << 32 | v[first]), "next": pa.array(after[ends], mask=inner[ends])})


def outlines(faces: DataFrame, tasks: int | None = None) -> DataFrame:
    """vertex, to, ring, pos: the boundary as rings of directed edges with the mesh on their left. A ring's edges are
    named a * 2^32 + b of their ends (vertices below 2^31); where outlines touch in a vertex, each goes on to the next
    boundary edge of the same fan of faces. Corners are shuffled to their vertices once, and only boundary edges leave
    these tasks."""
    each = F.explode(F.array(*[F.struct(F.col(f"v{k}").cast("long").alias("v"), F.col(f"v{i}").cast("long").alias("a"), F.col(f"v{j}").cast("long").alias("b")) for i, k, j in ((3, 1, 2), (1, 2, 3), (2, 3, 1))]))
    corners = faces.select(each.alias("c")).select("c.*")
    corners = corners.repartition(tasks, "v") if tasks else corners.repartition("v")
    found = lists.ranked(corners.sortWithinPartitions("v", "a").mapInArrow(_turns, "node long, next long"))
    return found.select(F.shiftright("node", 32).alias("vertex"), F.col("node").bitwiseAND((1 << 32) - 1).alias("to"), F.col("list").alias("ring"), "pos", "closed")
