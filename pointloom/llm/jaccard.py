"""N-gram Jaccard join by token-combination prefixes.

Two documents link when their sets of k-word shingles have a Jaccard similarity of at least num / den; the result is
the components of these links, exactly.

1. Blocks of texts deal their shingle hashes to hash ranges, which count in how many documents each occurs (a
   shingle that several texts of a block share goes there once, with its count) and send back those that occur in
   two or more. A document of which too few shingles are shared at all links with nothing and goes no further.
2. Documents with equal sets form a class, and one of them stands for it.
3. A representative's shingles are ordered from rare to frequent. Of its prefix, rare shingles are indexed one by
   one; frequent ones fall into groups and are indexed by pairs, very frequent ones by triples, and the prefix is
   extended until a partner within the threshold must share one of these keys: sum over the groups of
   max(0, tokens - k + 1) exceeds the number of shingles that may differ. Group numbers follow bands of set sizes.
4. Representatives that share a key are candidates. In a round, each key's least member meets the others whose size
   is near enough and that no link joins to it yet; these pairs are verified exactly, and links grow to components. The
   least member has then met all others and leaves its key; a key whose members are all in one component is done. Most
   keys are after one round; there are ROUNDS of them.
5. What is left (keys with many members in several components) is verified in groups: the components of the keys'
   members, inside of which sets are compared until no pair not yet compared can still join two parts. Large groups
   are cut into blocks, and pairs of blocks are verified by different tasks. Only links that were verified join texts.

Null and empty texts have no shingles and link with nothing; texts with fewer words than k have one shingle, of all
their words; very long texts are taken whole, each in a block of its own. A null doc_id takes part; its component is the least non-null id, or null; any long is an id. Repeated rows are members
of one class. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Words, documents, gram_hashes, mixed, pack_sorted, slices, starts, trim, unpack_sorted, written

#: Bytes of text for each hash range.
RANGE_BYTES = 6 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: A shingle in at least 2^4 documents is indexed in pairs, in at least 2^8 in triples.
PAIRS_FROM, TRIPLES_FROM = 4, 8
#: Rounds in which keys' least members are verified.
ROUNDS = 2
#: Of one verifying task: documents and shingles of a component's block, shingles over small components.
BLOCK_DOCS, BLOCK_SHINGLES, TASK_SHINGLES = 4096, 1 << 20, 1 << 20
_MANY = np.uint32(0xFFFFFFFF)


def _planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x, np.uint32)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def shingle_pairs(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs in order of hash, then text; and the set size of each text."""
    w = Words(texts)
    grams = gram_hashes(w.hash, k)
    at = np.flatnonzero(w.text[: len(grams)] == w.text[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    h, t = grams[at], w.text[at]
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        own = np.array([gram_hashes(w.hash[w.first[i] : w.first[i + 1]], int(w.n[i]))[0] for i in short], np.uint64)
        h, t = np.concatenate([h, own]), np.concatenate([t, short])
    order = np.argsort(h, kind="stable")  # within a text's words, so text by text
    h, t = h[order], t[order]
    # equal hashes are short runs: order them by text, then keep one of each
    run = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(run, len(h)))
    if (size > 1).any():
        inside = np.flatnonzero(np.repeat(size > 1, size))
        sub = np.lexsort((t[inside], h[inside]))
        t[inside] = t[inside][sub]
    keep = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
    h, t = h[keep], t[keep]
    return h, t.astype(np.uint32), np.bincount(t, minlength=len(texts))


_DEALT = "range long, block long, hashes binary, texts binary, counts binary, ids binary, sizes binary"


def _dealt(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """A row for each block and range, and one for each block itself (range -1 - block) with its ids and what is
    shared inside of it."""

    def run(batches):
        starts("jaccard")
        part, block = TaskContext.get().partitionId(), -1
        for b in slices(batches, BLOCK_BYTES):
            block += 1
            number = (part << 20) + block
            ids = b.column("doc_id").to_pylist()
            h, t, sizes = shingle_pairs(b.column("text").to_pylist(), k)
            run_at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(run_at, len(h)))
            many = np.repeat(count > 1, count)
            first_h, first_t = h[run_at], np.where(count > 1, _MANY, t[run_at])
            place = mixed_range(first_h, ranges).astype(np.int64)
            begins = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
            rows = [[], [], [], [], [], [], []]

            def put(*x):
                for c, y in zip(rows, x):
                    c.append(y)

            id_blob = np.array([0 if i is None else i for i in ids], np.int64).tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
            put(-1 - number, number, pack_sorted(h[many]), _planes(t[many]), b"", id_blob, _planes(sizes))
            for a, z in zip(begins, np.append(begins[1:], len(place))):  # a row only for ranges that get something
                put(int(place[a]), number, pack_sorted(first_h[a:z]), _planes(first_t[a:z]), _planes(count[a:z][count[a:z] > 1]), b"", b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[2:])],
                ["range", "block", "hashes", "texts", "counts", "ids", "sizes"],
            )
            del h, t, first_h, first_t, many, count, run_at, rows
            trim()

    return docs.mapInArrow(run, _DEALT)


def mixed_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hashes' upper 32 bits, in order."""
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _counted(table: pa.Table) -> pa.Table:
    """Of one range: what occurs in two or more documents, back to the blocks, with its class (log2 of the count)."""
    if table.column("range")[0].as_py() < 0:  # a block's own row passes
        return pa.table({"block": table.column("block"), "hashes": table.column("hashes"), "texts": table.column("texts"), "classes": table.column("counts"), "ids": table.column("ids"), "sizes": table.column("sizes")})
    trim()
    blocks = table.column("block").to_pylist()
    hashes = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    texts = np.concatenate([_unplanes(x) for x in table.column("texts").to_pylist()])
    count = np.ones(len(texts), np.int64)
    count[texts == _MANY] = np.concatenate([_unplanes(x) for x in table.column("counts").to_pylist()])
    owner = np.repeat(np.arange(len(blocks)), [len(x) for x in hashes])
    h = np.concatenate(hashes)
    del hashes
    order = np.argsort(h, kind="stable")
    h, texts, owner, count = h[order], texts[order], owner[order], count[order]
    run = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    total = np.add.reduceat(count, run)
    size = np.diff(np.append(run, len(h)))
    shared = np.repeat(total > 1, size)
    kind = np.repeat(np.log2(np.maximum(1, total)).astype(np.uint8), size)[shared]
    h, texts, owner = h[shared], texts[shared], owner[shared]
    order = np.argsort(owner, kind="stable")
    h, texts, owner, kind = h[order], texts[order], owner[order], kind[order]
    cuts = np.searchsorted(owner, np.arange(len(blocks) + 1))
    out = [(b, pack_sorted(h[a:z]), _planes(texts[a:z]), kind[a:z].tobytes()) for b, a, z in zip(blocks, cuts, cuts[1:]) if z > a]
    cols = list(zip(*out)) or [(), (), (), ()]
    none = pa.array([b""] * len(out), pa.binary())
    return pa.table({"block": pa.array(cols[0], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("hashes", "texts", "classes"), cols[1:])}, "ids": none, "sizes": none})


_SETS = "key long, doc_id long, n long, shared binary, classes binary, print binary"


def _assembled(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: a row for each document; those that may link carry their shared shingles, rare first."""
        own = None
        trim()
        parts = []
        block = table.column("block")[0].as_py()
        for r in table.select(["hashes", "texts", "classes", "ids", "sizes"]).to_pylist():
            if r["sizes"] or not (r["classes"] or r["hashes"]):
                own = r
            else:
                parts.append((unpack_sorted(r["hashes"]), _unplanes(r["texts"]), np.frombuffer(r["classes"], np.uint8)))
        sizes = _unplanes(own["sizes"]).astype(np.int64)
        ids, no_id = np.frombuffer(own["ids"], np.int64, len(sizes)), np.frombuffer(own["ids"], np.uint8, len(sizes), 8 * len(sizes)) > 0
        h, t, c = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate((np.uint64, np.uint32, np.uint8)))
        many = t == _MANY
        inner_h, inner_t = unpack_sorted(own["hashes"]), _unplanes(own["texts"])
        by = np.argsort(h[many], kind="stable")
        at = np.searchsorted(h[many][by], inner_h)
        inner_c = c[many][by][at] if len(inner_h) else np.zeros(0, np.uint8)
        h, t, c = (np.concatenate([x[~many], y]) for x, y in ((h, inner_h), (t, inner_t), (c, inner_c)))
        shared = np.bincount(t, minlength=len(ids))
        able = (shared > 0) & (den * shared >= num * sizes)
        keep = able[t]
        h, t, c = h[keep], t[keep], c[keep]
        order = np.lexsort((h, c, t))
        h, t, c = h[order], t[order], c[order]
        cuts = np.searchsorted(t, np.arange(len(ids) + 1))
        blobs, kinds, prints = [], [], []
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            blob = h[a:z].tobytes() if able[i] else None
            blobs.append(blob)
            kinds.append(c[a:z].tobytes() if able[i] else None)
            prints.append(hashlib.blake2b(blob, digest_size=16).digest() if able[i] and shared[i] == sizes[i] else None)
        return pa.table({
            "key": pa.array((np.int64(block) << 20) + np.arange(len(ids))),
            "doc_id": pa.array(ids, mask=no_id),
            "n": pa.array(sizes), "shared": pa.array(blobs, pa.binary()), "classes": pa.array(kinds, pa.binary()), "print": pa.array(prints, pa.binary()),
        })

    return run


def keys_of(h: np.ndarray, kinds: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """The keys of one set: h, its shared shingles from rare to frequent; kinds, their classes; n, the set's size."""
    may_differ = n - -(-num * n // den) - (n - len(h))  # of the shared ones; the others differ anyhow
    found = []
    for band in range((-(-num * n // den)).bit_length(), (n * den // num).bit_length() + 1):
        groups = max(1, (1 << band) // 40)
        k = np.ones(len(h), np.int64)
        if band > 3:
            k += (kinds >= PAIRS_FROM).astype(np.int64) + (kinds >= TRIPLES_FROM)
        group = (h % np.uint64(groups)).astype(np.int64) * 4 + k
        seen: dict[int, int] = {}
        left, end = may_differ + 1, 0
        while left > 0 and end < len(h):
            g = int(group[end])
            seen[g] = seen.get(g, 0) + 1
            left -= seen[g] >= k[end]
            end += 1
        found.append(mixed(h[:end][k[:end] == 1] + np.uint64(band)))
        for g in seen:
            size = g % 4
            if size > 1:
                own = np.sort(h[:end][group[:end] == g])
                if len(own) >= size:
                    at = np.array(list(combinations(range(len(own)), size)))
                    key = np.full(len(at), (band << 8) + size, np.uint64)
                    for j in range(size):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[at[:, j]])
                    found.append(key)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _keys(sets: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 200):
                c = b.slice(a, 200)
                keys, owners, sizes = [], [], []
                for key, n, blob, kind in zip(*(c.column(x).to_pylist() for x in ("key", "n", "shared", "classes"))):
                    k = keys_of(np.frombuffer(blob, np.uint64), np.frombuffer(kind, np.uint8), n, num, den)
                    keys.append(k)
                    owners.append(np.full(len(k), key, np.int64))
                    sizes.append(np.full(len(k), n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (owners, sizes))], ["sig", "key", "n"])

    return sets.select("key", "n", "shared", "classes").mapInArrow(run, "sig long, key long, n long")


def linked(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int, part: np.ndarray | None = None) -> np.ndarray:
    """The part that each set belongs to (a position below the number of sets), from parts known to be linked. A set is
    compared with all others at once; that ends when all sets not yet compared are in one part."""
    m = len(sets)
    part = np.arange(m) if part is None else part.copy()
    lengths = np.array([len(s) for s in sets])
    dense = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(lengths) - lengths
    mark = np.zeros(int(dense.max()) + 1, np.int32)
    todo = np.ones(m, bool)
    while True:
        open_parts = np.bincount(part[todo], minlength=m)
        rest = np.flatnonzero(todo & (part != open_parts.argmax()))
        if not len(rest):
            return part
        x = rest[0]
        own = dense[first[x] : first[x] + lengths[x]]
        mark[own] = 1
        inter = np.add.reduceat(mark[dense], first)
        mark[own] = 0
        hit = den * inter >= num * (sizes + sizes[x] - inter)
        hit[x] = True  # its own shingles that no other set has are not here
        parts = np.unique(part[hit])
        part[np.isin(part, parts)] = parts.min()
        todo[x] = False


def _compared(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one task: the members that link with their pivot. A pivot's own row has key = pivot."""
        trim()
        pivot, key, n = (table.column(c).to_numpy() for c in ("pivot", "key", "n"))
        blobs = table.column("shared")
        order = np.lexsort((key != pivot, pivot))  # the pivot first
        a_out, b_out = [], []
        cuts = [*np.flatnonzero(np.append(True, pivot[order][1:] != pivot[order][:-1])).tolist(), len(order)]
        for a, z in zip(cuts, cuts[1:]):
            head, *rest = order[a:z].tolist()
            while rest and key[rest[0]] == pivot[head]:  # a pivot whose members lie in several parts comes for each
                rest.pop(0)
            if rest:
                own = np.sort(np.frombuffer(blobs[head].as_py(), np.uint64))
                sets = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in rest]
                flat, first = np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets[:-1])])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                inter = np.add.reduceat(hit.astype(np.int64), first)
                on = den * inter >= num * (n[rest] + n[head] - inter)
                a_out.append(key[rest][on])
                b_out.append(np.full(int(on.sum()), pivot[head]))
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in (("a", a_out), ("b", b_out))})

    return run


def _links(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of those pairs (key, n, pivot, pivot_n) that link. A pivot with many members is repeated for parts of them."""
    load = pairs.groupBy("pivot", "pivot_n").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    load = load.select("pivot", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).alias("parts"), "pivot_n", "shingles")
    total = load.agg(F.coalesce(F.sum(F.col("shingles") + F.col("parts") * F.col("pivot_n")), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_SHINGLES))
    task = F.pmod(F.xxhash64("pivot", "part"), F.lit(tasks)).alias("task")
    members = pairs.join(load.select("pivot", "parts"), "pivot").select("key", "pivot", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))
    heads = load.select(F.col("pivot").alias("key"), "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    rows = members.unionByName(heads).select("key", "pivot", task)
    return rows.join(reps.select("key", "n", "shared"), "key").groupBy("task").applyInArrow(_compared(num, den), "a long, b long")


def _verified(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one task: for each document but one of every part, an edge to the part's least key."""
        trim()
        comp, key, n, root = (table.column(c).to_numpy() for c in ("comp", "key", "n", "root"))
        blobs = table.column("shared")
        order = np.lexsort((key, comp))
        cuts = np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1])).tolist() + [len(order)]
        a_out, b_out = [], []
        for a, z in zip(cuts, cuts[1:]):
            i = order[a:z]
            if len(i) > 1:
                known = np.unique(root[i], return_inverse=True)[1]
                part = linked([np.frombuffer(blobs[int(j)].as_py(), np.uint64) for j in i], n[i], num, den, known)
                ks = key[i]
                least = np.full(len(i), np.iinfo(np.int64).max)
                np.minimum.at(least, part, ks)
                to = least[part]
                a_out.append(ks[ks != to])
                b_out.append(to[ks != to])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in (("a", a_out), ("b", b_out))})

    return run


def _rest(live: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links among what the rounds left. live: key, root, pivot (the least key of the signature) of signatures
    whose members are in several components."""
    groups = components(live.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
    member = live.select("key", "root").distinct().join(groups.withColumnRenamed("node", "key").withColumnRenamed("root", "comp"), "key")
    member = written(member.join(reps.select("key", F.octet_length("shared").alias("bytes")), "key"), "candidates")
    sizes = member.groupBy("comp").agg(F.count("*").alias("docs"), (F.sum("bytes") / 8).alias("shingles"))
    sizes = sizes.withColumn("cuts", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)))
    total = member.agg(F.coalesce(F.sum("bytes") / 8, F.lit(0))).first()[0]
    tasks = max(1, int(-(-total // TASK_SHINGLES)))
    mine = F.pmod(F.xxhash64("key"), F.col("cuts"))
    # pairs of blocks: each block meets every block, itself included; small groups have one
    task = F.when(F.col("cuts") == 1, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(tasks)).cast("string")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1), lambda o: F.concat_ws("-", F.col("comp").cast("string"), F.least(mine, o).cast("string"), F.greatest(mine, o).cast("string")))
    )
    dealt = member.join(sizes, "comp").select("comp", "key", "root", F.explode(task).alias("task"))
    return dealt.join(reps.select("key", "n", "shared"), "key").groupBy("task").applyInArrow(_verified(num, den), "a long, b long")


def _roots(keys: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """node, root of the components of all links. keys: sig, key, n."""
    edges = roots = tried = None
    live = keys.withColumn("root", F.col("key"))
    for again in range(ROUNDS + 1):
        heads = live.groupBy("sig").agg(F.min("key").alias("pivot"), F.min_by("n", "key").alias("pivot_n"), F.min_by("root", "key").alias("pivot_root"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        live = written(live.join(heads.where("lo <> hi").drop("lo", "hi"), "sig"), "live")
        if live.isEmpty():
            break
        if again == ROUNDS:
            rest = written(_rest(live.select("key", "root", "pivot"), reps, num, den), "links")
            edges = rest if edges is None else edges.unionByName(rest)
            roots = components(edges)
            break
        near = (den * F.least("n", "pivot_n") >= num * F.greatest("n", "pivot_n")) & (F.col("root") != F.col("pivot_root"))
        pairs = live.where("key <> pivot").where(near).select("key", "n", "pivot", "pivot_n")
        # One row for a pair, however many keys it shares: a join with those tried would be planned before the rows of
        # equal pairs are one.
        pairs = pairs.withColumn("new", F.lit(True)) if tried is None else pairs.withColumn("new", F.lit(True)).unionByName(tried)
        pairs = written(pairs.groupBy("key", "n", "pivot", "pivot_n").agg(F.min("new").alias("new")).where("new").drop("new"), "pairs")
        met = pairs.withColumn("new", F.lit(False))
        tried = met if tried is None else tried.unionByName(met)
        found = written(_links(pairs, reps, num, den), "links")
        edges = found if edges is None else edges.unionByName(found)
        roots = written(components(edges), "roots")
        live = live.where("key <> pivot").select("sig", "key", "n").join(roots, F.col("key") == F.col("node"), "left").select("sig", "key", "n", F.coalesce("root", "key").alias("root"))
    return roots if roots is not None else keys.select(F.col("key").alias("node"), F.col("key").alias("root")).limit(0)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own
    included), first (true for one row of each component)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(8, -(-size // RANGE_BYTES))
    counted = _dealt(slim, k, ranges).groupBy("range").applyInArrow(lambda t: _counted(t), "block long, hashes binary, texts binary, classes binary, ids binary, sizes binary")
    sets = written(counted.groupBy("block").applyInArrow(_assembled(num, den), _SETS), "sets")

    able = sets.where(F.col("shared").isNotNull())
    equal = written(able.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("key").alias("rep")), "equal")
    single = able.where(F.col("print").isNull())
    reps = able.join(equal.select(F.col("rep").alias("key")), "key", "left_semi").unionByName(single)
    reps = written(reps.select("key", "n", "shared", "classes"), "reps")
    roots = _roots(written(_keys(reps, num, den), "keys"), reps, num, den)

    member = able.select("key", "doc_id", "print").join(equal, "print", "left").select("key", "doc_id", F.coalesce("rep", "key").alias("rep"))
    member = written(member.join(roots, member["rep"] == roots["node"], "left").select("key", "doc_id", F.coalesce("root", "rep").alias("root")), "members")
    groups = member.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head"))
    member = member.join(groups, "root").select("key", "component_id", (F.col("key") == F.col("head")).alias("first"))
    return sets.select("key", "doc_id", F.col("n").alias("n_shingles")).join(member, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first")
    )


def op4_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_token_combinations": op4_token_combinations}
ORACLE_SQL: dict[str, str] = {}
