"""Growth of regions from sources over a graph of nodes with heights, in rounds; a round is a frontier joined with the
steps that are open to it. Whether a step is open depends on heights alone, so it is decided once, for all steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .tables import Growing, bucketed, let_go, written


def ways(links: DataFrame) -> DataFrame:
    """a, b: links in both directions, each once, without loops. links: a, b."""
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def surveyed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, ha, hb, top: links in both directions with the heights of both ends, and the greatest height of a and its
    neighbours; a written table, out of which peaks and steps are read. nodes: node, height."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("height").alias(f"h{c}"))
    near = ways(links).join(at("b"), "b").join(at("a"), "a")
    return written(near.withColumn("top", F.greatest("ha", F.max("hb").over(Window.partitionBy("a")))).select("a", "b", "ha", "hb", "top"), "surveyed")


def peaks(links: DataFrame, nodes: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """node, source: nodes below no neighbour; peaks that touch are one, named by its least node. around: what `surveyed`
    has found, if it is known."""
    around = around if around is not None else surveyed(links, nodes)
    level = around.where("ha = top AND hb = ha").select("a", "b")  # from peaks; to peaks where the way back is from one too
    near = level.join(level.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    roots = graph.components(near)
    top = nodes.select("node").join(around.where("top > ha").select(F.col("a").alias("node")), "node", "left_anti")
    return top.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("source"))


def open_steps(around: DataFrame) -> DataFrame:
    """u, v: steps on which growth goes from u to its neighbour v: no neighbour of v, nor v itself, is above u."""
    return around.where("hb >= top").select(F.col("b").alias("u"), F.col("a").alias("v"))


def grown(links: DataFrame, nodes: DataFrame, sources: DataFrame, apart: bool = True, around: DataFrame | None = None) -> DataFrame:
    """source, node, parent, time: what each source reaches, when, and from where (of the nodes that reach it first, the
    least). apart: every source grows over all nodes by itself; else a node belongs to what reaches it first.
    sources: node, source. As many rounds as the longest way down from a source."""
    steps = open_steps(around if around is not None else surveyed(links, nodes))
    key = ["source", "node"] if apart else ["node"]
    front = written(sources.groupBy(*key).agg(F.min("source").alias("source")) if not apart else sources.select("source", "node").distinct(), "front")
    front = written(front.select("source", "node", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("time")), "front")
    found, time = Growing(front, "grown"), 0
    with bucketed(steps, "u", "steps") as steps:
        while not front.isEmpty():
            time += 1
            sent = front.join(steps, front["node"] == steps["u"]).select("source", F.col("v").alias("node"), F.col("u").alias("parent"))
            first = sent.groupBy(*key).agg(F.min(F.struct("parent", "source")).alias("s")).select(*([F.col("s.source").alias("source")] if not apart else ["source"]), "node", F.col("s.parent").alias("parent"), F.lit(time).cast("long").alias("time"))
            new = written(first.join(found.table().select(*key), key, "left_anti"), "front")
            let_go(front)
            front = new
            found.add(front)
    return found.table()
