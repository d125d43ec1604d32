"""Benchmark decontamination by greedy string tiling.

The test items' words give seeds: the Karp-Rabin hashes of SEED words in a row. A document that shares a seed with an
item is tiled against it: again and again the longest match of words that no tile covers yet is marked (ties: the first
in the document, then in the item), until none of SEED words or more is left. The tiles' share of the item's words is
its coverage, wherever they stand, so reordered passages count; a document is contaminated if it covers THRESHOLD of an
item. The longest match is found by running Karp-Rabin: hashes of windows of any length come from one running sum, and
a match of some length implies shorter ones, so lengths are halved; memory is linear in the words, however repetitive.

The join of seeds has two forms with one result. A benchmark of up to BLOCK_WORDS words is broadcast. A larger one is
never brought together: its seeds are shuffled to the documents' seeds, of which a bitmap of SLOTS bits holds back most
that no item has; pairs that share a seed are distinct, get their texts, and are tiled by themselves.

Words are runs of letters, digits and underscores, in lower case. Null and empty texts share nothing; very long texts
are read whole; items that are null or shorter than SEED words match nothing; a null item_id is carried, and comes last
among ties; repeated items and documents are treated alike and each by itself; empty tables give no rows or no
contamination; columns of the input named like the outputs are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, mixed, remembers, slices, starts, written

SEED = 5
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
#: Bits of the map of items' seeds (8 MB).
SLOTS = 1 << 26
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_hashes = WordHashes()
remembers("tiling words", _hashes.clear, ("tiling",))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Running:
    """Karp-Rabin hashes of all windows of a sequence of ids, modulo 2^64, for any length of window."""

    def __init__(self, ids: np.ndarray):
        x = mixed(ids.astype(np.uint64) + np.uint64(1))
        power = np.full(len(x), _BASE, np.uint64)
        back = np.full(len(x), _UNBASE, np.uint64)
        power[:1] = back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])

    def windows(self, k: int) -> np.ndarray:
        n = max(0, len(self.back) - k + 1)
        return (self.sums[k : k + n] - self.sums[:n]) * self.back[:n]


def _free_windows(taken: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Windows of k words that no tile covers."""
    gone = np.concatenate([[0], np.cumsum(taken)])
    return np.flatnonzero(gone[k : k + len(hashes)] == gone[: len(hashes)])


def tiles(d: np.ndarray, p: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of item p over document d (ids of words). Returns (start in d, start in p, length), longest first
    as marked."""
    run_d, run_p = Running(d), Running(p)
    taken_d, taken_p = np.zeros(len(d), bool), np.zeros(len(p), bool)
    found: list[tuple[int, int, int]] = []

    def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of n words in d and in p that have a hash of the other side, and all hashes."""
        h, g = run_d.windows(n), run_p.windows(n)
        a, b = _free_windows(taken_d, h, n), _free_windows(taken_p, g, n)
        b = b[np.isin(g[b], h[a])]
        return (a[np.isin(h[a], g[b])] if len(b) else a[:0]), b, h, g

    longest = min(len(d), len(p))
    while longest >= k:
        low, high = k - 1, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(shared(n)[1]) else (low, n - 1)
        if low < k:
            break
        at_d, at_p, h, g = shared(low)
        places: dict[int, list[int]] = {}
        for b in at_p.tolist():
            places.setdefault(int(g[b]), []).append(b)
        end = 0
        for a in at_d.tolist():
            if a < end:
                continue
            left = [b for b in places.get(int(h[a]), ()) if not taken_p[b : b + low].any()]  # what is taken stays so
            places[int(h[a])] = left
            for b in left:
                if (d[a : a + low] == p[b : b + low]).all():  # hashes can collide
                    taken_d[a : a + low] = taken_p[b : b + low] = True
                    found.append((a, b, low))
                    end = a + low
                    break
            if not left and not any(places.values()):
                break
        longest = low - 1
    return found


def _tiled(d: np.ndarray, at: np.ndarray, p: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """tiles() of the stretches of d that hold seeds of p (they start at `at`), and of nothing else of d."""
    held = np.zeros(len(d) + 1, np.int64)
    np.add.at(held, at, 1)
    np.add.at(held, at + k, -1)
    where = np.flatnonzero(np.cumsum(held)[:-1])
    if not len(where):
        return []
    gap = np.flatnonzero(np.diff(where) > 1) + 1
    where = np.insert(where, gap, -1)  # stretches do not touch
    part = np.where(where >= 0, d[where], np.int64(-2))
    return [(int(where[a]), b, n) for a, b, n in tiles(part, p, k)]


class Items:
    """Test items, ready to be looked up: the items of each seed, once for each item."""

    def __init__(self, rows: list[tuple[int | None, str | None]], seed: int):
        self.seed = seed
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for ws in words]
        self.seeds = [np.unique(Running(x).windows(seed)) for x in self.words]
        h = np.concatenate([*self.seeds, np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], np.repeat(np.arange(len(rows)), [len(x) for x in self.seeds])[order]

    def found(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """Items that share a seed with the text: position, coverage, tiles."""
        get = self.vocabulary.get
        d = np.array([get(w, -1) for w in words_of(text)], np.int64)
        k = self.seed
        if len(d) < k or not len(self.hash):
            return []
        unknown = np.cumsum(np.append(0, d < 0))
        where = np.flatnonzero(unknown[k:] == unknown[:-k])  # windows of known words
        if not len(where):
            return []
        h = Running(d).windows(k)[where]
        seen = np.unique(h)
        a, z = np.searchsorted(self.hash, seen, "left"), np.searchsorted(self.hash, seen, "right")
        n = z - a
        if not n.any():
            return []
        out = []
        for i in np.unique(self.item[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]).tolist():
            got = _tiled(d, where[np.isin(h, self.seeds[i])], self.words[i], k)
            if got:
                out.append((i, sum(x[2] for x in got) / len(self.words[i]), got))
        return out


_TILES = "array<struct<item_id:bigint,doc_word:int,item_word:int,words:int>>"
_ADDED = (("contaminated", "boolean"), ("coverage", "double"), ("item_id", "bigint"), ("tiles", _TILES))
_TILE_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))


def _marks(item: int | None, got: list[tuple[int, int, int]]) -> list[dict]:
    return [{"item_id": item, "doc_word": x, "item_word": y, "words": z} for x, y, z in got]


def _by_broadcast(own: DataFrame, items: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Every document looks its seeds up among those of all items: at most BLOCK_WORDS words."""
    schema = own.select("*", *(F.lit(None).cast(t).alias(c) for c, t in _ADDED)).schema
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    held = own.sparkSession.sparkContext.broadcast(Items(rows, seed))

    def run(batches):
        starts("tiling")
        items = held.value
        for b in slices(batches):
            cover, best, marks = [], [], []
            for text in b.column("text").to_pylist():
                found = [(-c, items.ids[i] is None, items.ids[i] or 0, items.ids[i], got) for i, c, got in items.found(text)]
                top = min(found, key=lambda x: x[:3], default=(0.0, True, 0, None, ()))
                cover.append(0.0 - top[0])
                best.append(top[3])
                marks.append([m for c, _, _, item, got in found if -c >= threshold for m in _marks(item, got)])
            added = [pa.array([c >= threshold for c in cover]), pa.array(cover, pa.float64()), pa.array(best, pa.int64()), pa.array(marks, _TILE_KIND)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *(c for c, _ in _ADDED)])

    return own.mapInArrow(run, schema)


def _hashed(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)).view(np.int64)


def _seeds(rows: DataFrame, key: str, seed: int, held=None) -> DataFrame:
    """seed, key: the distinct seeds of each text; with a map of seeds held, only those that it has."""

    def run(batches):
        starts("tiling")
        bits = np.frombuffer(held.value, np.uint8) if held is not None else None
        for b in slices(batches):
            seeds, keys = [], []
            for text, k in zip(b.column("text").to_pylist(), b.column(key).to_pylist()):
                h = np.unique(Running(_hashed(text)).windows(seed)) if text else np.zeros(0, np.uint64)
                if bits is not None and len(h):
                    slot = (h % np.uint64(SLOTS)).astype(np.int64)
                    h = h[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0]
                seeds.append(h.view(np.int64))
                keys.append(np.full(len(h), k, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (seeds, keys)], ["seed", key])

    return rows.select(key, "text").mapInArrow(run, f"seed long, {key} long")


def _by_shuffle(own: DataFrame, items: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Seeds of documents and items meet by their hashes; pairs that share one are tiled."""
    spark = own.sparkSession
    items = written(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    docs = written(own.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("_row")), "numbered")
    texts = docs.select("_row", F.col("own.text").cast("string").alias("text"))
    item_seeds = written(_seeds(items, "_item", seed), "seeds")
    slot = F.expr(f"(seed & {SLOTS - 1}L) + 1L")  # bitmap functions count from one
    bits = item_seeds.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    whole = np.zeros(SLOTS // 8, np.uint8)
    for r in bits.collect():  # at most SLOTS bits
        at = (r["n"] - 1) * len(r["bits"])
        whole[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(whole.tobytes())
    pairs = _seeds(texts, "_row", seed, held).join(item_seeds, "seed").select("_row", "_item").distinct()
    pairs = pairs.join(texts, "_row").join(items.select("_item", "item_id", F.col("text").alias("item")), "_item")

    def run(batches):
        starts("tiling")
        for b in slices(batches):
            cover, marks, texts = [], [], []
            for text, item, i in zip(*(b.column(c).to_pylist() for c in ("text", "item", "item_id"))):
                d, p = _hashed(text), _hashed(item)
                at = np.flatnonzero(np.isin(Running(d).windows(seed), Running(p).windows(seed)))
                got = _tiled(d, at, p, seed)
                cover.append(sum(x[2] for x in got) / len(p))
                marks.append(_marks(i, got))
                texts.append(item if cover[-1] >= threshold else None)  # orders the tiles of items with one id
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), b.column("item_id"), pa.array(cover, pa.float64()), pa.array(marks, _TILE_KIND)], ["_row", "item", "item_id", "c", "t"])

    tiled = pairs.mapInArrow(run, f"_row long, item string, item_id long, c double, t {_TILES}").where("c > 0")
    order = F.struct(-F.col("c"), F.col("item_id").isNull(), "item_id")
    enough = F.when(F.col("c") >= threshold, F.struct(F.col("item_id").isNull().alias("last"), "item_id", "item", "t"))
    best = tiled.groupBy("_row").agg(F.max("c").alias("coverage"), F.min_by("item_id", order).alias("item_id"), F.array_sort(F.collect_list(enough)).alias("items"))
    best = best.select("_row", "coverage", "item_id", F.flatten(F.transform("items", lambda x: x["t"])).alias("tiles"))
    out = docs.join(best, "_row", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return out.select("own.*", (F.col("coverage") >= threshold).alias("contaminated"), "coverage", "item_id", F.coalesce("tiles", F.array().cast(_TILES)).alias("tiles"))


def decontaminated(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, most_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with contaminated; coverage and item_id of the item covered most (ties: the least id); the tiles of all
    items that are covered enough, by the items' ids (null last) and texts. A benchmark of more than about most_words words is joined by a shuffle."""
    own = docs.drop(*(c for c, _ in _ADDED))
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 5 + 1), F.lit(0.0))).first()[0]
    return (_by_broadcast if words <= most_words else _by_shuffle)(own, items, threshold, seed)


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return decontaminated(docs, documents(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "coverage", "item_id", F.size("tiles").alias("n_tiles"))


QUERIES = {"op3_string_tiling": op3_string_tiling}
ORACLE_SQL: dict[str, str] = {}
