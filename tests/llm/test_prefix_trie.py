"""Prefix tries against a walk over all prefixes, and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pointloom.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """rows: (conv_id, turn, role, text) -> set of nodes, by every prefix of every rebuilt conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, mark, (role, text)))
    convs = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    nodes = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) % 100 * (-1 if c < 0 else 1)
        whole = convs.get(c - base, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append((c, d == len(whole)))
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    total = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [total[k] for k in kids[path]]
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        total[path] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    out = set()
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        up = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.add((min(c for c, _ in members), len(path), up, len(members), len(kids[path]), *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(seed, convs, most):
    """Conversations that share beginnings, some of them copies, with few different turns."""
    dice, rows = random.Random(seed), []
    for c in convs:
        n = dice.randrange(most)
        for t in range(n):
            rows.append((c, t, dice.choice(["user", "assistant"]), "x" * dice.randrange(1, 3)))
    return rows


@pytest.mark.parametrize("segment", [3, 256])
def test_against_all_prefixes(spark, segment):
    rows = made(segment, [*range(0, 240), *range(-230, -180), 10_000, 10_077], 12)
    got = [tuple(r) for r in P.trie(frame(spark, rows), segment).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_copies_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(900) for t in range(7)]
    rows += [(c, t, "user", f"turn {t}") for c in range(900, 1000) for t in range(c % 7)]
    assert {tuple(r) for r in P.trie(frame(spark, rows), 3).select(*COLUMNS).collect()} == plain_trie(rows)


def test_one_conversation_holds_most_turns(spark):
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(3000)] + made(1, range(100, 130), 9)
    assert {tuple(r) for r in P.trie(frame(spark, rows), 1024).select(*COLUMNS).collect()} == plain_trie(rows)


def test_odd_input(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (7, None, None, None), (7, None, "user", None), (7, 1, "user", ""), (7, 1, "user", ""), (8, 3, "u", "z" * 100_000), (9, 3, "u", "z" * 100_000), (-1, 0, "u", "é漢\U0001f600")]
    df = frame(spark, rows).selectExpr("*", "'own' AS depth", "1 AS n_convs", "'x' AS key", "2 AS seg", "3 AS parent")
    assert {tuple(r) for r in P.trie(df).select(*COLUMNS).collect()} == plain_trie(rows)
    assert P.trie(frame(spark, [])).count() == 0
    assert P.trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    alone = P.trie(frame(spark, [(101, 0, "user", "hello")])).select(*COLUMNS).collect()
    assert {tuple(r) for r in alone} == plain_trie([(101, 0, "user", "hello")])


def test_query_against_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duck.sql(P.ORACLE_SQL["op12_prefix_trie"])
    got = P.op12_prefix_trie(spark, sf)
    assert got.columns == want.columns
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_trees_are_balanced_and_walk_in_order():
    assert sorted(P.medians(23)) == list(range(23)) and P.medians(3) == [1, 0, 2] and P.medians(0) == []
    tree = P.Ternary()
    for i in P.medians(1023):
        tree.insert([i])
    depth = {}

    def deep(v):
        return 0 if v < 0 else 1 + max(deep(tree.low[v]), deep(tree.high[v]))

    depth = deep(tree.top)
    assert depth == 10 and len(tree.walk()) == 1023
