"""What the operators of this subpackage share: scratch tables, word rules, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import scratch_dir, written  # noqa: F401

#: ASCII white space: what separates words (fixed values).
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences, one byte plane after another (planes of zeros compress to nothing)."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class TwoAges(dict):
    """A bounded memo: when it is full, its entries become the old age and those of the last old age go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def slices(batches, most: int = 6 << 20):
    """Record batches cut so that the texts of each take about `most` bytes, or one row."""
    import pyarrow.compute as pc

    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield b.slice(a, z - a)


def trim() -> None:
    """Gives freed memory back: workers live on between tasks, and two share an executor with its JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_memos: dict[str, tuple[tuple[str, ...], object]] = {}
_at_work: list[str] = []


def remembers(name: str, clear, users: tuple[str, ...]) -> None:
    """Makes a worker's memo known: it is cleared when an operator that is none of its users starts there."""
    _memos[name] = (users, clear)


def starts(operator: str) -> None:
    """An operator's task starts in this worker: memos of others go, and freed memory with them."""
    if _at_work != [operator]:
        _at_work[:] = [operator]
        for users, clear in _memos.values():
            if operator not in users:
                clear()
    trim()


class WordHashes(dict):
    """word -> its 64-bit hash; forgets when it has grown too large."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_hashes = WordHashes()
remembers("words", _hashes.clear, ("jaccard", "line_labels", "language_model"))


class Words:
    """The ASCII-space words of some texts, as arrays over all of them.

    data: the bytes, texts parted by a line end; text_at: where each text begins (one more at the end);
    at: where each word begins; first: index of each text's first word (one more at the end); hash: 64-bit
    hashes of the words; text: the text that each word belongs to.
    """

    def __init__(self, texts: list[str | None], lower: bool = True, hashed: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"\n".join([*raw, b""])
        self.data = np.frombuffer(joined, np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
        space = _SPACE[self.data]
        begins = ~space
        begins[1:] &= space[:-1]
        self.at = np.flatnonzero(begins)
        self.first = np.searchsorted(self.at, self.text_at)
        self.words = (joined.lower() if lower else joined).split()
        if hashed:
            self.hash = np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(raw)), self.n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values well stirred."""
    h = h.copy()
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram of a sequence of word hashes, by its first position (len - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


#: Groups that the rows of one class are dealt into before its sample is drawn.
DEALT = 64


def least_hashes(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` rows of each value of group: those whose _id has the least hash. Map tasks pass on up to `most` rows
    of a value each, so a value is dealt into DEALT groups first, and its last step sees DEALT * most rows at any size."""
    order = [F.xxhash64("_id"), F.col("_id")]
    deal = Window.partitionBy(group, F.pmod(F.hash("_id"), F.lit(DEALT))).orderBy(*order)
    few = rows.withColumn("_k", F.row_number().over(deal)).where(F.col("_k") <= most)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


#: A text of a training sample counts with so many characters at most. This bounds what the driver trains on; whatever is
#: scored is read whole.
TRAINING_CHARS = 1 << 15


def drawn(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` rows of each value of group, from rows with doc_id and text: those with the least hash of both, so
    that rows without an id, or with the same one, are rows of their own; their texts up to TRAINING_CHARS characters.
    Only hashes are ranked at first; rows that have the hashes found are then few, or equal, and ranked once more."""
    keyed = rows.withColumn("_id", F.xxhash64("doc_id", "text"))
    few = least_hashes(keyed.select("_id", group), group, most).select("_id").distinct()
    met = keyed.join(F.broadcast(few), "_id", "left_semi").withColumn("text", F.substring("text", 1, TRAINING_CHARS))
    return least_hashes(met, group, most).drop("_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, out_fold: int) -> tuple[DataFrame, dict[int, int]]:
    """At most per_class rows of each label, none of the held-out fold, with _label: rows of the documents whose id has
    the least hash, and of these rows the ones that `drawn` takes; and how many documents each label marks outside of the
    fold. The sample's ids are bounded, and are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != out_fold))
    known = known.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    ids = least_hashes(known, "_label", per_class)
    return drawn(docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id"), "_label", per_class), counts
