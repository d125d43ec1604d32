"""Conversation prefix trie: ternary search trees over range shards, merged at the boundaries.

Turns are put in order once, by a range partition of (conv_id, turn), and ranked by counts of what earlier tasks hold of
the same conversation. A turn is known by a digest of its role and text; no text travels. A conversation is a sequence
of these digests, cut into segments of SEGMENT turns; a segment belongs to the group of all segments with the same turns
before them (a chained digest). Segments are range-partitioned by (group, sequence, conv_id) into shards. A shard
encodes its digests as dense numbers, inserts its distinct sequences into a ternary search tree, medians first, so that
siblings form balanced trees, and traverses it with a stack of its own: members, children, leaves and savings of each
node are sums over what lies below.

Only nodes on the paths of a shard's first and last sequence can occur in other shards. They leave the shard as partial
sums (without their shares of each other) and are merged by a digest of their path: sums, then for each boundary node
the sums of all boundary nodes below it. Levels of segments are handled from the deepest up; what a group's root sums to
is added to the node that it continues. Hashes of the members that end in a boundary node stream over the shards' lists
in order.

A conversation of any length is spread over segments, equal conversations over shards. SHA-256 over the members of one
node is sequential by its nature: one task reads the list of a boundary node as a stream, in bounded memory.

Rows with equal turn numbers (null first) follow the digest of role and text, and equal rows are turns of their own.
Null roles and texts count as empty. A null conv_id names no conversation: such rows have no place in any sequence and
are left out. A conversation without turns is a member of the root. An empty table has no nodes, and further columns are
not read, whatever their names. A very long text counts by its digest and length only.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch_dir, starts, written

#: Turns of a segment, turns of a shard, bytes of a digest.
SEGMENT, SHARD_TURNS, KEY = 256, 200_000, 16
#: The group of first segments.
ROOT = bytes(KEY)
#: A conversation's first turns come from the first one of its BLOCK ids; at most HEADS - 1 of them.
BLOCK, HEADS = 100, 6


def _short(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()[:KEY]


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), key, chars of every turn, as a written table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, KEY).alias("key"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("tie")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "chars")

    def run(batches):
        part, conv, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            fresh = np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            begin = np.maximum.accumulate(np.where(fresh, at, -1))
            local = np.where(begin < 0, seen + at, at - begin)  # the first run may go on from the batch before
            conv, seen = ids[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), b.column("conv_id"), pa.array(local.astype(np.int64)), b.column("key"), b.column("chars")], ["part", "conv_id", "local", "key", "chars"])

    turns = written(ranged.mapInArrow(run, "part long, conv_id long, local long, key binary, chars long"), "turns")
    # One row for each task: how many turns of its first conversation earlier tasks hold.
    spans = turns.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max(F.struct("conv_id", "local")).alias("hi")).orderBy("part").collect()
    conv, held, before = None, 0, []
    for r in spans:
        ahead = held if r["lo"] == conv else 0
        before.append((r["part"], r["lo"], ahead))
        held = r["hi"]["local"] + 1 + (ahead if r["lo"] == r["hi"]["conv_id"] else 0)
        conv = r["hi"]["conv_id"]
    ahead = conversations.sparkSession.createDataFrame(before, "part long, conv_id long, ahead long")
    return turns.join(ahead, ["part", "conv_id"], "left").select("conv_id", (F.col("local") + F.coalesce("ahead", F.lit(0))).alias("rank"), "key", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first conversation of their block: conv_id, pos, key, chars of
    the turns; and conv_id, length of all conversations."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    plan = written(
        convs.join(bases, "base", "left")
        .withColumn("b", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "rebuilt",
    )
    own = turns.join(plan, "conv_id").where(F.col("rank") >= F.col("h")).select("conv_id", (F.col("rank") - F.col("h") + F.col("b")).alias("pos"), "key", "chars")
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("rank") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    lent = plan.where("b > 0").join(heads, "base").where(F.col("rank") < F.col("b")).select("conv_id", F.col("rank").alias("pos"), "key", "chars")
    return own.unionByName(lent), plan.select("conv_id", "length")


def segments(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, int, int]:
    """conv_id, seg, prefix, keys, chars, next (the group that continues a full segment), as a written table; how many
    levels, and how many turns. A conversation has a last segment that is not full, even if it is empty."""
    part = F.struct("pos", "key", "chars")
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(F.array_sort(F.collect_list(part)).alias("t"))
    cut = cut.select("conv_id", "seg", F.col("t.key").alias("keys"), F.col("t.chars").alias("chars"))
    bare = lengths.where(F.col("length") % segment == 0).select("conv_id", F.expr(f"length div {segment}").alias("seg"), F.expr("cast(array() as array<binary>)").alias("keys"), F.expr("cast(array() as array<bigint>)").alias("chars"))
    table = written(cut.unionByName(bare), "segments")
    levels, turns_in_all = table.agg(F.coalesce(F.max("seg"), F.lit(-1)) + 1, F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    if levels <= 1:
        return table.select("conv_id", "seg", F.lit(ROOT).alias("prefix"), "keys", "chars", F.lit(None).cast("binary").alias("next")), levels, turns_in_all
    # Groups of later segments, for conversations that have some: digests of the segments before, chained.
    rolled = F.aggregate("keys", F.lit(b"").cast("binary"), lambda a, x: F.unhex(F.sha2(F.concat(a, x), 256)))
    chained = table.where(F.size("keys") == segment).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", rolled.alias("d")))).alias("full"))

    def chain(batches):
        for b in batches:
            out = [[], [], [], []]
            for conv, full in zip(b.column("conv_id").to_pylist(), b.column("full").to_pylist()):
                group = ROOT
                for s, x in enumerate([*full, None]):
                    after = _short(group + x["d"]) if x else None
                    for c, v in zip(out, (conv, s, group, after)):
                        c.append(v)
                    group = after
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["conv_id", "seg", "prefix", "next"])

    groups = chained.mapInArrow(chain, "conv_id long, seg long, prefix binary, next binary")
    whole = table.join(groups, ["conv_id", "seg"], "left").select("conv_id", "seg", F.coalesce("prefix", F.lit(ROOT)).alias("prefix"), "keys", "chars", "next")
    return written(whole, "grouped"), levels, turns_in_all


class Ternary:
    """A ternary search tree over sequences of numbers; a node stands for the sequence that leads to it."""

    def __init__(self):
        self.top = -1
        self.sign, self.low, self.equal, self.high, self.up = [], [], [], [], []

    def _new(self, sign: int, up: int) -> int:
        for column, value in ((self.sign, sign), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up)):
            column.append(value)
        return len(self.sign) - 1

    def insert(self, word: list[int]) -> list[int]:
        """The nodes of a sequence."""
        path, up = [], -1
        for x in word:
            at = self.top if up < 0 else self.equal[up]
            if at < 0:
                at = self._new(x, up)
                if up < 0:
                    self.top = at
                else:
                    self.equal[up] = at
            while self.sign[at] != x:
                side = self.low if x < self.sign[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(x, up)
                at = side[at]
            path.append(at)
            up = at
        return path

    def walk(self) -> list[int]:
        """All nodes, each after the one above it."""
        order, stack = [], [self.top] if self.top >= 0 else []
        while stack:
            at = stack.pop()
            order.append(at)
            stack += [x for x in (self.high[at], self.equal[at], self.low[at]) if x >= 0]
        return order


def medians(n: int) -> list[int]:
    """0 to n - 1, the median of each range before its halves."""
    out, at = [(0, n)] if n else [], 0
    order = []
    while at < len(out):
        a, z = out[at]
        at += 1
        mid = (a + z) // 2
        order.append(mid)
        out += [(x, y) for x, y in ((a, mid), (mid + 1, z)) if x < y]
    return order


_RAW = (
    "edge boolean, shard long, depth long, prefix binary, conv_id long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved long, chars long, "
    "ends_sha256 string, path array<binary>, ends string, ends_first long, b_children long, b_leaves long, b_saved long, b_ends string"
)
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _RAW.split(", "))])
_BELOW = ("b_children", "b_leaves", "b_saved", "b_ends")


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def shard_nodes(rows: dict[str, list], shard: int, segment: int = SEGMENT) -> list[dict]:
    """The nodes of a shard, whose rows are in order of (prefix, keys, conv_id)."""
    n = len(rows["conv_id"])
    if not n:
        return []
    prefix, keys, convs = rows["prefix"], rows["keys"], rows["conv_id"]
    book = sorted({*prefix, *(k for row in keys for k in row)})
    number = {k: i for i, k in enumerate(book)}
    cuts = [i for i in range(n) if i == 0 or prefix[i] != prefix[i - 1] or keys[i] != keys[i - 1]] + [n]
    tree, size, last, ends, below, chars, paths = Ternary(), [], [], {}, {}, [], {}
    for g in medians(len(cuts) - 1):
        a, z = cuts[g], cuts[g + 1]
        path = tree.insert([number[prefix[a]], *(number[k] for k in keys[a])])
        if g in (0, len(cuts) - 2):
            paths[g] = path
        for column, blank in ((size, 0), (last, None), (chars, 0)):
            column += [blank] * (len(tree.sign) - len(column))
        least = min(convs[a:z])
        for v, c in zip(path, [0, *rows["chars"][a]]):
            size[v] += z - a
            last[v] = least if last[v] is None else min(last[v], least)
            chars[v] = c
        if len(keys[a]) < segment:
            ends[path[-1]] = convs[a:z]
        elif rows["b_leaves"][a] is not None:
            below[path[-1]] = tuple(rows[c][a] for c in _BELOW)
    edges = {v for p in paths.values() for v in p}
    order = tree.walk()
    kids, leaves, saved, depth = ([0] * len(order) for _ in range(4))
    for v in order:
        depth[v] = depth[tree.up[v]] + 1 if tree.up[v] >= 0 else 0
    for v in reversed(order):
        if v in edges:
            continue
        b = below.get(v)
        if b:
            kids[v], leaves[v], saved[v] = b[0], b[1], saved[v] + b[2]
        leaves[v] = leaves[v] or 1
        saved[v] += (size[v] - 1) * chars[v]
        up = tree.up[v]
        if up >= 0:
            kids[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    marks: dict[int, list[bytes]] = {}
    for p in paths.values():
        path: list[bytes] = []
        for v in p:
            path = [*path, _short((path[-1] if path else b"") + book[tree.sign[v]])]
            marks[v] = path
    out = []
    for v in order:
        up, b = tree.up[v], below.get(v)
        row = {"edge": v in edges, "shard": shard, "depth": depth[v], "prefix": book[tree.sign[v]] if up < 0 else None, "conv_id": last[v], "n_convs": size[v], "n_children": kids[v], "n_leaves": leaves[v], "saved": saved[v], "chars": chars[v]}
        if v in edges:
            row |= {"path": marks[v], **dict(zip(_BELOW, b or (None,) * 4))}
            if v in ends:
                row |= {"ends": _joined(ends[v]), "ends_first": ends[v][0]}
        else:
            row |= {"ends_sha256": b[3] if b else hashlib.sha256(_joined(ends.get(v, [])).encode()).hexdigest()}
            if up >= 0:
                row |= {"parent": marks[up][-1]} if up in edges else {"parent_conv_id": last[up]}
        out.append(row)
    return out


def _level(rows: DataFrame, shards: int, segment: int) -> DataFrame:
    """depth, prefix (of roots), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of the
    nodes of a level; rows: conv_id, prefix, keys, chars and what lies below full segments."""

    def run(batches):
        starts("prefix_trie")
        held: dict[str, list] = {}
        for b in batches:
            for c in b.schema.names:
                held.setdefault(c, []).extend(b.column(c).to_pylist())
        nodes = shard_nodes(held, TaskContext.get().partitionId(), segment) if held else []
        for a in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_pylist(nodes[a : a + 10_000], _SCHEMA)

    order = ["prefix", "keys", "conv_id"]
    raw = written(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, _RAW), "nodes")
    edges = raw.where("edge").withColumn("id", F.element_at("path", -1))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    alike = [F.max(c).alias(c) for c in ("path", "depth", "prefix", "chars", *_BELOW)]
    # At most two paths of each shard.
    merged = written(edges.groupBy("id").agg(F.min("conv_id").alias("conv_id"), *sums, *alike).withColumn("up", F.when(F.size("path") > 1, F.try_element_at("path", F.size("path") - 1))), "merged")
    kids = merged.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"))

    def hashed(batches):
        at, made = None, None
        for b in batches:
            done = []
            for key, text in zip(b.column("id").to_pylist(), b.column("ends").to_pylist()):
                if key != at:
                    if at is not None:
                        done.append((at, made.hexdigest()))
                    at, made = key, hashlib.sha256()
                else:
                    made.update(b",")
                made.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["id", "listed"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([made.hexdigest()])], ["id", "listed"])

    lists = edges.where(F.col("ends").isNotNull()).select("id", "ends_first", "ends").repartition("id").sortWithinPartitions("id", "ends_first")
    lists = lists.select("id", "ends").mapInArrow(hashed, "id binary, listed string")
    own = merged.join(kids, "id", "left").join(lists, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)) + F.coalesce("b_children", F.lit(0)))
    own = own.withColumn("leaf", F.col("n_leaves") + F.coalesce("b_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)))
    own = own.withColumn("save", F.col("saved") + F.coalesce("b_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars"))
    own = written(own, "own")
    total = own.select(F.explode("path").alias("id"), "leaf", "save").groupBy("id").agg(F.sum("leaf").alias("all_leaves"), F.sum("save").alias("all_saved"))
    above = merged.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    bound = own.join(total, "id").join(above, "up", "left").select(
        "depth", "prefix", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), F.coalesce("b_ends", "listed", F.lit(nothing)).alias("ends_sha256")
    )
    inner = raw.where("not edge").withColumnRenamed("saved", "saved_tokens")
    within = edges.select("shard", F.col("id").alias("parent")).distinct().join(above.withColumnsRenamed({"up": "parent", "parent_conv_id": "of_parent"}), "parent")
    inner = inner.where("parent is null").withColumn("of_parent", F.lit(None).cast("long")).unionByName(inner.where("parent is not null").join(within, ["shard", "parent"]))
    return inner.select("depth", "prefix", "conv_id", F.coalesce("parent_conv_id", "of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").unionByName(bound)


def prefix_nodes(table: DataFrame, levels: int, turns: int, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations in segments: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = table.sparkSession
    folder = f"{scratch_dir(spark)}/trie-{uuid.uuid4().hex}"
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    below = spark.createDataFrame([], "next binary, b_children long, b_leaves long, b_saved long, b_ends string")
    for s in reversed(range(levels)):
        rows = table.where(F.col("seg") == s).join(below, "next", "left") if s < levels - 1 else table.where(F.col("seg") == s).withColumns({c: F.lit(None).cast("string" if c == "b_ends" else "long") for c in _BELOW})
        found = written(_level(rows.select("conv_id", "prefix", "keys", "chars", *_BELOW), shards, segment), "level")
        below = found.where("depth = 0").select(F.col("prefix").alias("next"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"), F.col("ends_sha256").alias("b_ends"))
        kept = found if s == 0 else found.where("depth > 0")
        kept.withColumn("depth", F.col("depth") + s * segment).select(*(c.split()[0] for c in schema.split(", "))).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if levels else spark.createDataFrame([], schema)


def trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), rebuilt with the first turns of their block."""
    return prefix_nodes(*segments(*rebuilt(ranked_turns(conversations)), segment), segment)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt."""
    return trie(documents(spark, sf_dir, "conversations"))


_SQL = """
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), turns AS (
  SELECT conv_id, coalesce(text, '') AS text, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), parts AS (
  SELECT c.conv_id, 0 AS own, t.rank, t.id FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS own, t.rank, t.id FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank >= c.h
), seqs AS (
  SELECT c.conv_id, coalesce(list(p.id ORDER BY p.own, p.rank) FILTER (p.id IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id
), paths AS (
  SELECT conv_id, s[1:d] AS path, d, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY path, d
), texts AS (
  SELECT id, any_value(length(text)) AS chars FROM turns GROUP BY id
), kids AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), shares AS (
  SELECT n.path, n.d, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * x.chars END AS saved
  FROM nodes n LEFT JOIN kids k ON k.path = n.path LEFT JOIN texts x ON n.d > 0 AND x.id = n.path[n.d]
), totals AS (
  SELECT path[1:k] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT path, leaf, saved, unnest(range(d + 1)) AS k FROM shares) GROUP BY 1
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.path = n.path LEFT JOIN kids k ON k.path = n.path
LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {"op12_prefix_trie": _SQL}
