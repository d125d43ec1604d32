"""Graph algorithms as loops over edge tables. Every round ends in a written table, and the driver sees counts only.

Edges are (src, dst[, w]); node ids are long. Loops stop when nothing changes; a bound on the rounds raises.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .tables import Growing, bucketed, let_go, written

#: Rounds in which a loop must settle; rounds of a path search before it counts how many there may be.
ROUNDS, UNCOUNTED = 60, 16


def _settling(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """df as a written table, and its count and checksum, observed while it is written. (A task that is run again can
    only make the sums differ, and so cost a round.)"""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("s")), name)
    return table, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node with an edge; root is the least of its component. Large
    and small stars in turn."""
    e, seen = _settling(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, now = _settling(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        let_go(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def undirected(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *cols) for a, b in (("src", "dst"), ("dst", "src"))]
    return edges.select(F.explode(F.array(*ways)).alias("e")).select("e.*")


def shortest_paths(edges: DataFrame, source: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, dist, parent, relaxed until nothing improves (Bellman-Ford). source: node. Ties take the least parent. Only
    nodes that improved send in the next round. Raises on a negative cycle: when the rounds, as many as there are nodes
    unless given, have not emptied the front. Distances that a round improves are added to one folder."""
    return relaxed(edges, source.select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent")).distinct(), rounds)


def relaxed(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """shortest_paths from nodes that have a distance and a parent already. start: node, dist, parent."""
    front, done = written(start.select("node", "dist", "parent"), "front"), 0
    found = Growing(front, "dist")
    with bucketed(edges.select("src", "dst", "w"), "src", "edges") as edges:
        while not front.isEmpty():
            if rounds is None and done >= UNCOUNTED:
                rounds = edges.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(start.select("node")).distinct().count()
            if rounds is not None and done > rounds:
                raise ValueError("a negative cycle, or paths longer than the rounds allowed")
            sent = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent"))).alias("s"))
            sent = written(sent.select("node", "s.dist", "s.parent"), "sent")
            old = found.table().select(F.col("node").alias("n"), F.col("dist").alias("d")).join(sent.select(F.col("node").alias("n")), "n", "left_semi").groupBy("n").agg(F.min("d").alias("d"))
            new = written(sent.join(old, F.col("node") == F.col("n"), "left").where("d IS NULL OR dist < d").select("node", "dist", "parent"), "front")
            let_go(front, sent)
            front = new
            found.add(front)
            done += 1
    return found.table().groupBy("node").agg(F.min(F.struct("dist", "parent")).alias("s")).select("node", "s.dist", "s.parent")


def breadth_first(edges: DataFrame, source: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, hops."""
    found = shortest_paths(edges.withColumn("w", F.lit(1.0)), source, rounds)
    return found.select("node", F.col("dist").cast("long").alias("hops"))


def spanning_forest(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """src, dst, w of a minimum spanning forest (Boruvka): each component takes its least edge (ties: the least ends),
    components merge, and so on."""
    e = written(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    live = e.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b"))
    taken = None
    for _ in range(rounds):
        both = live.select("a", "w", "src", "dst", "b").unionByName(live.select(F.col("b").alias("a"), "w", "src", "dst", F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("s")).select("a", "s.*"), "least")
        if least.isEmpty():
            break
        new = least.select("src", "dst", "w").distinct()
        taken = new if taken is None else taken.unionByName(new)
        roots = components(least.select("a", "b"))
        to = lambda c, d: roots.select(F.col("node").alias(c), F.col("root").alias(d))
        live = live.join(to("a", "ra"), "a", "left").join(to("b", "rb"), "b", "left")
        live = live.select("src", "dst", "w", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
        live = written(live, "live")
    else:
        raise RuntimeError("the forest did not settle")
    return (taken if taken is not None else e.limit(0)).distinct()


def longest_ranks(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, rank: the longest path that ends in the node (topological levels), of any length unless rounds bound it.
    Raises on a cycle: a round in which no node is ready."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    edges = written(edges.select("src", "dst").distinct(), "edges")
    rank, left, rest = 0, written(nodes, "nodes"), edges
    done = Growing(left.limit(0).withColumn("rank", F.lit(0).cast("long")), "ranks")
    while not left.isEmpty():
        if rounds is not None and rank > rounds:
            raise ValueError("paths longer than the rounds allowed")
        ready = written(left.join(rest.select(F.col("dst").alias("node")), "node", "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done.add(ready.withColumn("rank", F.lit(rank).cast("long")))
        fewer = written(left.join(ready, "node", "left_anti"), "nodes"), written(rest.join(ready.withColumnRenamed("node", "src"), "src", "left_anti"), "edges")
        let_go(left, rest, ready)
        left, rest = fewer
        rank += 1
    return done.table()


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, root: strongly connected components by forward and backward colouring; root is the least member."""
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    nodes = written(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "nodes")
    found = None
    for _ in range(rounds):
        if nodes.isEmpty():
            break
        colour = _spread(nodes.withColumn("root", F.col("node")), e, None)
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("root").alias("r1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("root").alias("r2")), "dst")
        inside = written(inside.where("r1 = r2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("r1").alias("root")), "inside")
        mine = written(_reached(colour.where("node = root"), inside), "mine")
        found = mine if found is None else found.unionByName(mine)
        gone = mine.select("node")
        nodes = written(nodes.join(gone, "node", "left_anti"), "nodes")
        e = written(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "edges")
    else:
        raise RuntimeError("too many rounds")
    return found if found is not None else nodes.withColumn("root", F.col("node"))


def _spread(colour: DataFrame, e: DataFrame, _: None) -> DataFrame:
    """Each node takes the least colour that reaches it."""
    colour, seen = _settling(colour, "colour")
    while True:
        sent = e.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "root")
        colour, now = _settling(colour.unionByName(sent).groupBy("node").agg(F.min("root").alias("root")), "colour")
        if now == seen:
            return colour
        seen = now


def _reached(start: DataFrame, inside: DataFrame) -> DataFrame:
    """Nodes that a root reaches by edges of its own colour."""
    found = front = written(start.select("node", "root"), "front")
    while not front.isEmpty():
        sent = front.join(inside, (inside["src"] == front["node"]) & (inside["root"] == front["root"])).select(F.col("dst").alias("node"), front["root"]).distinct()
        front = written(sent.join(found, ["node", "root"], "left_anti"), "front")
        found = written(found.unionByName(front), "found")
    return found


def traced(parents: DataFrame, rounds: int | None = None) -> DataFrame:
    """child, ancestor, steps for every ancestor, by doubling: a round joins the ancestors at the greatest distance yet
    with their own, so a chain takes as many rounds as its length has binary digits. parents: child, parent. Raises on a
    cycle (a node that is its own ancestor), or on paths longer than 2 to the power of rounds."""
    found = written(parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps")), "traced")
    for k in itertools.count():
        if not found.where("child = ancestor").isEmpty():
            raise ValueError("the graph has a cycle")
        far = found.where(F.col("steps") == 2**k)
        if far.isEmpty():
            return found
        if rounds is not None and k >= rounds:
            raise ValueError("paths longer than the rounds allowed")
        more = far.join(found.select(F.col("child").alias("c"), F.col("ancestor").alias("p"), F.col("steps").alias("s")), F.col("ancestor") == F.col("c"))
        new = written(found.unionByName(more.select("child", F.col("p").alias("ancestor"), (F.col("steps") + F.col("s")).alias("steps"))), "traced")
        let_go(found)
        found = new


def best_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, parent: the highest neighbour that is higher than the node (ties: the least id); null at peaks.
    nodes: node, height."""
    w = Window.partitionBy("node").orderBy(F.col("h2").desc(), F.col("other"))
    e = undirected(edges.select("src", "dst")).distinct().select(F.col("src").alias("node"), F.col("dst").alias("other"))
    up = e.join(nodes, "node").join(nodes.select(F.col("node").alias("other"), F.col("height").alias("h2")), "other").where("h2 > height")
    top = up.withColumn("k", F.row_number().over(w)).where("k = 1").select("node", F.col("other").alias("parent"))
    return nodes.select("node").join(top, "node", "left")
