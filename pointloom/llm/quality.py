"""Quality classifier: a factorisation machine.

Features of a text: its words hashed into a fixed number of slots (log-damped counts, of length one), binned
statistics of its structure, and the n_chars metadata column, binned. The score is
w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2): pairwise interactions in linear time. It is trained in
numpy by Adagrad on a bounded sample of labelled documents (PER_CLASS of each label), reweighted to the labels' own
shares; the model has a fixed size and goes to the tasks with the code.

Null and empty texts have statistics of zero and are scored like any text; a null doc_id is scored and lies outside
the labelled rows; repeated rows are scored alike; without labels every score is 0.5; columns of the input named
like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, labelled_sample, remembers, slices, starts

WORD_SLOTS = 1 << 16
FACTORS = 8
PER_CLASS = 5000
EPOCHS = 6
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

#: Statistics and the edges of their bins.
_RATIO = (0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
_COUNT = tuple(2.0**k for k in range(0, 16))
STATS = (
    ("symbols", _RATIO), ("capitals", _RATIO), ("exclaims", _RATIO), ("digits", _RATIO), ("stops", _RATIO), ("distinct", _RATIO),
    ("most_common", _RATIO), ("repeats", _RATIO), ("line_distinct", _RATIO), ("word_length", (2, 3, 4, 5, 6, 7, 8, 10, 14, 20)),
    ("words", _COUNT), ("lines", _COUNT), ("line_words", _COUNT), ("n_chars", _COUNT),
)
_BASE = np.cumsum([0, *(len(e) + 2 for _, e in STATS)])
SLOTS = WORD_SLOTS + int(_BASE[-1])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_slots: dict[bytes, int] = {}
remembers("slots", _slots.clear, ("quality",))


def _slot(word: bytes) -> int:
    s = _slots.get(word)
    if s is None:
        if len(_slots) > 400_000:
            _slots.clear()
        s = _slots[word] = zlib.crc32(word) % WORD_SLOTS
    return s


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.lower().split()
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    n, tf = len(words), Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = chars[65:91].sum() + chars[97:123].sum()
    ends = chars[[33, 46, 63]].sum()
    stats = (
        chars[_SYMBOLS].sum() / max(1, len(raw)), chars[65:91].sum() / max(1, letters), chars[33] / max(1, n), chars[48:58].sum() / max(1, len(raw)),
        ends / max(1, n), len(tf) / max(1, n), max(tf.values(), default=0) / max(1, n), sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        len(set(lines)) / max(1, len(lines)), len(raw) / max(1, n), n, len(lines), n / max(1, len(lines)), -1 if n_chars is None else n_chars,
    )
    own = [WORD_SLOTS + int(_BASE[i]) + (0 if s < 0 else 1 + int(np.searchsorted(e, s, "right"))) for i, ((_, e), s) in enumerate(zip(STATS, stats))]
    value = np.log1p(np.fromiter(tf.values(), np.float32, len(tf)))
    value /= max(1e-6, float(np.sqrt((value * value).sum())))
    slots = np.fromiter(map(_slot, tf), np.int32, len(tf))
    return np.concatenate([slots, np.array(own, np.int32)]), np.concatenate([value, np.full(len(own), 0.3, np.float32)]).astype(np.float32)


class Machine:
    """w0, w and v; score() in linear time."""

    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(SLOTS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SLOTS, FACTORS)).astype(np.float32)

    def raw(self, slots: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins; v x; their sums by document. first: where each document's features begin (none is empty)."""
        vx = self.v[slots] * x[:, None]
        s = np.add.reduceat(vx, first)
        q = np.add.reduceat((vx * vx).sum(1), first)
        return self.w0 + np.add.reduceat(self.w[slots] * x, first) + 0.5 * ((s * s).sum(1) - q), vx, s

    def score(self, slots: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.raw(slots, x, first)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rate: float = 0.15, l2: float = 1e-5, seed: int = 7) -> "Machine":
        rng = np.random.default_rng(seed)
        gw0, gw, gv = 1e-6, np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), 128):
                part = order[a : a + 128]
                slots = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                n = np.array([len(rows[i][0]) for i in part])
                z, vx, s = self.raw(slots, x, np.cumsum(n) - n)
                g = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[part]) * weight[part] / len(part)).astype(np.float32)
                each = np.repeat(g, n)
                uniq, at = np.unique(slots, return_inverse=True)
                dw, dv = np.zeros(len(uniq), np.float32), np.zeros((len(uniq), FACTORS), np.float32)
                np.add.at(dw, at, each * x)
                np.add.at(dv, at, (each * x)[:, None] * (np.repeat(s, n, 0) - vx))
                dw += l2 * self.w[uniq]
                dv += l2 * self.v[uniq]
                gw0, gw[uniq], gv[uniq] = gw0 + float(g.sum()) ** 2, gw[uniq] + dw * dw, gv[uniq] + dv * dv
                self.w0 -= rate * float(g.sum()) / gw0**0.5
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
        return self


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    """Trained on documents that labels.quality marks, outside of the held-out fold; None without any."""
    sample, counts = labelled_sample(_slim(docs), labels, "quality", per_class, FOLDS, HELD_OUT)

    def run(batches):
        starts("quality")
        for b in slices(batches):
            f = [features(t, c) for t, c in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array([s.tobytes() for s, _ in f]), pa.array([x.tobytes() for _, x in f])], ["doc_id", "y", "s", "x"])

    got = sample.mapInArrow(run, "doc_id long, y int, s binary, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["s"]))
    rows = [(np.frombuffer(r["s"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got]
    label = np.array([r["y"] for r in got])
    seen = {c: max(1, int((label == c).sum())) for c in counts}
    weight = np.array([counts[c] / seen[c] for c in label])
    return Machine().train(rows, (label >= 1).astype(np.float64), weight / weight.mean())


def _slim(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def scored(docs: DataFrame, model: Machine | None) -> DataFrame:
    """docs with score; model as fit() gives it."""
    out = docs.drop("score")
    if model is None:
        return out.withColumn("score", F.lit(0.5))
    has = "n_chars" in out.columns
    schema = out.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        starts("quality")
        for b in slices(batches):
            chars = b.column("n_chars").to_pylist() if has else [None] * b.num_rows
            f = [features(t, None if c is None else int(c)) for t, c in zip(b.column("text").to_pylist(), chars)]
            n = np.array([len(s) for s, _ in f])
            p = model.score(np.concatenate([s for s, _ in f]), np.concatenate([x for _, x in f]), np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "score"])

    return out.mapInArrow(run, schema)


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _slim(documents(spark, sf_dir))
    out = scored(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_factorisation_machine": op8_factorisation_machine}
ORACLE_SQL: dict[str, str] = {}
