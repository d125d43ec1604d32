"""Document fingerprints: quartile bucket digests.

Every byte of a text begins six triplets (itself and two of the four bytes that follow; the text counts as followed by
four zero bytes). Each triplet is hashed to one of BUCKETS buckets. A digest holds, in hex: the length on a logarithmic
scale (one byte), the first and second quartile of the bucket counts as sixteenths of the third (one byte), and for each
bucket two bits that say between which quartiles its count lies. Two digests differ by the sum over buckets of the
distance of their codes (3 counts as FAR), plus bounded terms for length and quartiles; the difference is bounded by
UNRELATED, what codes drawn at random would give, and likeness is 1 less its share of that bound: 1 for equal digests,
about 0 for unrelated ones.

`with_next` gives each row the row that follows it in an order: rows are range-partitioned by the order (sampled
boundaries; a tie number in the key keeps equal keys from being one task's), each task pairs the rows that it holds, and
the last row of each task is joined with the first of the next one, which are two rows a task.

Null text counts as empty, whose digest has all codes 0; a text of one byte has six triplets; a very long text is counted
in chunks, whole; equal texts have equal digests, whatever the rest of the row. In the order, null ids come last, rows
with equal ids follow a hash of their text, and equal rows are interchangeable; repeated rows are rows of their own; the
last row is followed by the first, a single row by itself; an empty table gives no rows; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, starts, written

BUCKETS = 256
#: Which two of the following bytes make a triplet, and the odd multiplier of its hash (fixed values).
TRIPLETS = ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA77), (1, 4, 0xC2B2AE3D), (2, 3, 0x27D4EB2F), (2, 4, 0x165667B1), (3, 4, 0xD6E8FEB9))
TAIL = 4
#: A difference of 3 between codes counts as so many.
FAR = 6
#: Lengths are powers of LENGTH_BASE; what a step of length or of a quartile counts, and at most.
LENGTH_BASE, STEP, MOST_LENGTH, MOST_QUARTILE = 1.1, 2, 40, 40
#: Mean difference of codes drawn at random: of 16 pairs 6 differ by 1, 4 by 2, 2 by 3.
UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * FAR) // 16
#: Bytes counted at once, and texts.
CHUNK, CHUNK_TEXTS = 1 << 20, 2048


def bucket_counts(raw: list[bytes]) -> np.ndarray:
    """Counts of the texts' triplets by bucket: one row for each text."""
    out = np.zeros((len(raw), BUCKETS), np.int64)
    first = 0
    while first < len(raw):
        last, size = first, 0
        while last < len(raw) and last - first < CHUNK_TEXTS and (last == first or size + len(raw[last]) <= CHUNK):
            size += len(raw[last])
            last += 1
        if size <= CHUNK:
            _count(raw[first:last], out[first:last])
        else:  # one long text, whose chunks overlap by the bytes that triplets look ahead
            for a in range(0, size, CHUNK):
                _count([raw[first][a : a + CHUNK]], out[first : first + 1], raw[first][a + CHUNK : a + CHUNK + TAIL])
        first = last
    return out


def _count(raw: list[bytes], out: np.ndarray, tail: bytes = b"") -> None:
    """Adds the triplets of some texts to out; tail: what follows the last one."""
    pad = bytes(TAIL)
    data = np.frombuffer(pad.join(raw) + (tail + pad)[:TAIL], np.uint8).astype(np.uint32)
    n = len(data) - TAIL
    if n <= 0:
        return
    owner = np.full(n, len(raw), np.int32)  # a row more, for what begins between texts
    at = 0
    for i, x in enumerate(raw):
        owner[at : at + len(x)] = i
        at += len(x) + TAIL
    base = owner * BUCKETS
    counts = np.zeros((len(raw) + 1) * BUCKETS, np.int64)
    for a, b, factor in TRIPLETS:
        h = (data[:n] | data[a : a + n] << np.uint32(8) | data[b : b + n] << np.uint32(16)) * np.uint32(factor)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(base + (h >> np.uint32(24)).astype(np.int32), minlength=len(counts))
    out += counts.reshape(-1, BUCKETS)[: len(raw)]


def digests(texts: list[str | None]) -> list[str]:
    raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    if not raw:
        return []
    counts = bucket_counts(raw)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(len(raw), -1, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    length = np.minimum(np.rint(np.log1p([len(x) for x in raw]) / np.log(LENGTH_BASE)), 255).astype(np.uint8)
    part = [np.minimum(16 * q // np.maximum(q3, 1), 15)[:, 0].astype(np.uint8) for q in (q1, q2)]
    whole = np.column_stack([length, part[0] << 4 | part[1], packed.astype(np.uint8)])
    return [row.tobytes().hex() for row in whole]


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """Of digests in pairs, each at most UNRELATED."""
    if not len(a):
        return np.zeros(0, np.int64)
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), -1).astype(np.int64) for s in (a, b))
    total = np.minimum(STEP * abs(x[:, 0] - y[:, 0]), MOST_LENGTH)
    total += np.minimum(STEP * (abs((x[:, 1] >> 4) - (y[:, 1] >> 4)) + abs((x[:, 1] & 15) - (y[:, 1] & 15))), MOST_QUARTILE)
    for shift in (6, 4, 2, 0):
        gap = abs((x[:, 2:] >> shift & 3) - (y[:, 2:] >> shift & 3))
        total += np.where(gap == 3, FAR, gap).sum(axis=1)
    return np.minimum(total, UNRELATED)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    return 1.0 - differences(a, b) / UNRELATED


def fingerprinted(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the digest of a text column, which replaces a column of that name."""

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        starts("bucket_digest")
        return pd.Series(digests([x if isinstance(x, str) else None for x in texts]), dtype="object")

    return df.withColumn(name, of(F.col(text).cast("string")))


def alike(a: Column, b: Column) -> Column:
    """The likeness of two digest columns; null where one is null."""

    @F.pandas_udf("double")
    def of(x, y):
        import pandas as pd

        there = (x.notna() & y.notna()).to_numpy()
        out = pd.Series([None] * len(x), index=x.index, dtype="Float64")
        out[there] = likeness(list(x[there]), list(y[there]))
        return out

    return of(a, b)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of the next one, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], own: list[str]) -> list[list]:
    """The results of all texts but the last one, whose digests own has; each is followed by the next of the list."""
    made = [edited(a, b) for a, b in zip(texts, texts[1:])]
    prints = digests(made)
    return [
        ids[:-1],
        [len(x) for x in texts[:-1]],
        [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in made],
        own[:-1],
        prints,
        likeness(own[:-1], prints).tolist(),
        likeness(own[:-1], own[1:]).tolist(),
    ]


#: Bytes of text that are paired at once.
AT_ONCE = 4 << 20


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, each document against the
    next one by descending doc_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = slim.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("tie")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def pair(batches):
        starts("bucket_digest")
        part = TaskContext.get().partitionId()
        head, held = None, None  # the first row of the task, the last one seen
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            a = 0
            while a < len(ids):
                z, size = a, 0
                while z < len(ids) and (z == a or size < AT_ONCE):
                    size += len(texts[z])
                    z += 1
                own = digests(texts[a:z])
                if head is None:
                    head = (ids[a], texts[a], own[0])
                front = [held] if held else []
                got = [*zip(*front, strict=True)] if front else [(), (), ()]
                some = _rows([*got[0], *ids[a:z]], [*got[1], *texts[a:z]], [*got[2], *own])
                held = (ids[z - 1], texts[z - 1], own[-1])
                a = z
                if some[0]:
                    yield batch("pair", part, some)
        if head is not None:
            for kind, (doc, text, own) in (("first", head), ("last", held)):
                yield batch(kind, part, [[doc], [len(text)], [None], [own], [None], [None], [None]], [text])

    def batch(kind: str, part: int, columns: list[list], text: list | None = None):
        n = len(columns[0])
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        arrays = [pa.array([kind] * n), pa.array([part] * n, pa.int64()), pa.array(text or [None] * n, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "part", "text", *(c.split()[0] for c in _OUT.split(", "))])

    table = written(ranged.mapInArrow(pair, "kind string, part long, text string, " + _OUT), "paired")
    done = table.where("kind = 'pair'").select(*(c.split()[0] for c in _OUT.split(", ")))

    # Two rows for each task: its last is followed by the first of the next task that has rows, around the end.
    parts = sorted(r["part"] for r in table.where("kind = 'first'").select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part long, after long")
    last = table.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint")
    first = table.where("kind = 'first'").select(F.col("part").alias("after"), F.col("text").alias("t"), F.col("fingerprint").alias("f"))
    met = last.join(following, "part").join(first, "after").select("doc_id", "text", "fingerprint", "t", "f")

    def close(batches):
        starts("bucket_digest")
        for b in batches:
            columns = [[] for _ in range(7)]
            for doc, text, own, t, f in zip(*(c.to_pylist() for c in b.columns)):
                for c, x in zip(columns, _rows([doc, None], [text, t], [own, f])):
                    c += x
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _OUT.split(", ")])

    return done.unionByName(met.mapInArrow(close, _OUT))


def op11_bucket_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts, and the documents that follow."""
    return with_next(documents(spark, sf_dir))


QUERIES = {"op11_bucket_digest": op11_bucket_digest}
ORACLE_SQL: dict[str, str] = {}
