"""Language ID: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read forwards and backwards; both states at a position give that position's language
probabilities and its label, and the document's probabilities are the means over all its positions. A long text is read
in stretches of LABELLED bytes, each with the WARM bytes on either side of it, so that states have context at the first
byte that is labelled; beyond a text's ends stand spaces. Gates and candidates are piecewise linear (clipped), which
keeps a step cheap. The network is trained in numpy by backpropagation through time (Adam) on a bounded sample:
PER_CLASS documents of each language, SPANS spans of each. It has a few thousand weights of a fixed number and goes to
the tasks with the code.

Texts that are null or have no letter are `und` with score 0. Very long texts are labelled whole, stretch by stretch.
Equal probabilities fall to the language whose name comes first. A null doc_id is carried; a null lang is not learned
from; repeated rows are labelled alike; an empty table gives no rows, and without any labelled document every text
is `und`; columns of the input named like the outputs are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drawn, fold, slices, starts

SPAN = 64
LABELLED, WARM = 112, 16
HIDDEN = 8
PER_CLASS = 400
SPANS = 6
STEPS = 500
BATCH = 192
FOLDS, HELD_OUT = 4, 2
_LETTER = re.compile(r"[^\W\d_]")


class Direction:
    """One reading direction. x-table rows: what a byte adds to update gate, reset gate and candidate."""

    NAMES = ("table", "u", "uc")

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.table = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)
        self.uc = rng.normal(0, 0.3, (h, h)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: steps x rows of bytes; the states after each step. Table, gates and states are rows of a step."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in range(len(x)):
            inp = self.table[x[t]]
            zr = inp[:, : 2 * h] + state @ self.u
            zr *= 0.25
            zr += 0.5
            np.clip(zr, 0, 1, out=zr)
            rs = zr[:, h:] * state
            c = inp[:, 2 * h :] + rs @ self.uc
            np.clip(c, -1, 1, out=c)
            if keep is not None:
                keep.append((state, zr, rs, c))
            state = state + zr[:, :h] * (c - state)
            out[t] = state
        return out

    def read(self, x: np.ndarray) -> np.ndarray:
        """As forward(), in buffers that are used again."""
        h, rows = HIDDEN, x.shape[1]
        scale = [0.25, 0.25, 1.0]
        tables = [np.ascontiguousarray(self.table[:, k * h : (k + 1) * h] * s + (0.5 if k < 2 else 0)) for k, s in enumerate(scale)]
        uz, ur = (np.ascontiguousarray(self.u[:, k * h : (k + 1) * h] * 0.25) for k in (0, 1))
        state, out = np.zeros((rows, h), np.float32), np.empty((*x.shape, h), np.float32)
        z, r, c, a, b = (np.empty((rows, h), np.float32) for _ in range(5))
        for t in range(len(x)):
            at = x[t].astype(np.intp)
            for table, y in zip(tables, (z, r, c)):
                np.take(table, at, axis=0, out=y, mode="clip")
            z += np.matmul(state, uz, out=a)
            r += np.matmul(state, ur, out=b)
            np.minimum(np.maximum(z, 0, out=z), 1, out=z)
            np.minimum(np.maximum(r, 0, out=r), 1, out=r)
            r *= state
            c += np.matmul(r, self.uc, out=a)
            np.minimum(np.maximum(c, -1, out=c), 1, out=c)
            c -= state
            c *= z
            state += c
            out[t] = state
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> list[np.ndarray]:
        h = HIDDEN
        g = [np.zeros_like(self.table), np.zeros_like(self.u), np.zeros_like(self.uc)]
        d, d_in = np.zeros_like(d_out[0]), np.empty((*x.shape, 3 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, zr, rs, c = keep[t]
            z, r = zr[:, :h], zr[:, h:]
            d = d + d_out[t]
            dc = d * z * (np.abs(c) < 1)
            dz = d * (c - state)
            drs = dc @ self.uc.T
            dzr = np.concatenate([dz, drs * state], 1) * 0.25 * ((zr > 0) & (zr < 1))
            g[1] += state.T @ dzr
            g[2] += rs.T @ dc
            d_in[t, :, : 2 * h], d_in[t, :, 2 * h :] = dzr, dc
            d = d * (1 - z) + drs * r + dzr @ self.u.T
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        seen, at = np.unique(flat[order], return_index=True)
        g[0][seen] = np.add.reduceat(d_in.reshape(-1, 3 * h)[order], at)
        return g


class Network:
    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.sides = [Direction(rng), Direction(rng)]
        self.out = rng.normal(0, 0.2, (2 * HIDDEN, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def logits(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """steps x rows x languages."""
        keeps = ([], []) if keep is not None else (None, None)
        f = self.sides[0].forward(x, keeps[0])
        b = self.sides[1].forward(x[::-1], keeps[1])[::-1]
        if keep is not None:
            keep.extend((keeps, f, b))
        return f @ self.out[:HIDDEN] + b @ self.out[HIDDEN:] + self.bias

    def train(self, spans: np.ndarray, y: np.ndarray, seed: int = 3) -> "Network":
        """spans: rows x SPAN of bytes. Every position learns its document's language."""
        rng = np.random.default_rng(seed)
        params = [p for s in self.sides for p in (s.table, s.u, s.uc)] + [self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            i = rng.integers(0, len(spans), BATCH)
            x = np.ascontiguousarray(spans[i].T)
            keep: list = []
            z = self.logits(x, keep)
            (kf, kb), f, b = keep
            p = np.exp(z - z.max(-1, keepdims=True))
            p /= p.sum(-1, keepdims=True)
            p[:, np.arange(BATCH), y[i]] -= 1
            p /= p.shape[0] * BATCH
            flat = p.reshape(-1, len(self.langs))
            g_out = np.concatenate([f.reshape(-1, HIDDEN).T @ flat, b.reshape(-1, HIDDEN).T @ flat])
            grads = self.sides[0].backward(x, kf, p @ self.out[:HIDDEN].T) + self.sides[1].backward(x[::-1], kb, (p @ self.out[HIDDEN:].T)[::-1])
            rate = 0.02 * min(1.0, step / 20) * (1.0 if step < 0.7 * STEPS else 0.2)
            for k, (w, g) in enumerate(zip(params, [*grads, g_out, flat.sum(0)])):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, texts: list[str | None], positions: bool = False, rows: int = 1024):
        """Of each text, the mean of its positions' probabilities and how many positions each language has; with
        positions, also each byte's language."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        n = np.array([len(r) for r in raw], np.int64)
        parts, k = -(-n // LABELLED), len(self.langs)
        first, total = np.cumsum(parts) - parts, int(parts.sum())
        # all texts with spaces around them: text i begins at begin[i]
        begin = np.cumsum(np.append(0, parts * LABELLED + 2 * WARM))
        data = np.full(begin[-1], 32, np.uint8)
        for r, a in zip(raw, begin):
            data[a + WARM : a + WARM + len(r)] = np.frombuffer(r, np.uint8)
        owner = np.repeat(np.arange(len(raw)), parts)
        stretch = np.arange(total) - first[owner]
        at, real = begin[owner] + stretch * LABELLED, np.minimum(LABELLED, n[owner] - stretch * LABELLED)
        sums, votes, marks = np.zeros((total, k)), np.zeros((total, k), np.int64), []
        for a in range(0, total, rows):
            x = np.ascontiguousarray(data[at[a : a + rows] + np.arange(LABELLED + 2 * WARM)[:, None]])
            f = self.sides[0].read(x)[WARM : WARM + LABELLED]
            b = self.sides[1].read(x[::-1])[::-1][WARM : WARM + LABELLED]
            z = f @ self.out[:HIDDEN]
            z += b @ self.out[HIDDEN:]
            z += self.bias
            best = z.argmax(-1)
            z -= z.max(-1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(-1, keepdims=True)
            on = np.arange(LABELLED)[:, None] < real[a : a + rows]
            z *= on[..., None]
            sums[a : a + rows] = z.sum(0)
            for j in range(k):
                votes[a : a + rows, j] = ((best == j) & on).sum(0)
            if positions:
                marks.append(best.T.astype(np.int8))
        pooled, labelled = np.zeros((len(raw), k)), np.zeros((len(raw), k), np.int64)
        np.add.at(pooled, owner, sums)
        np.add.at(labelled, owner, votes)
        pooled /= np.maximum(1, n)[:, None]
        if positions:
            each = np.concatenate([*marks, np.zeros((0, LABELLED), np.int8)])
            return pooled, labelled, [each[a : a + m].ravel()[:c] for a, m, c in zip(first, parts, n)]
        return pooled, labelled


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """Trained on documents with a lang, outside of the held-out fold; at most per_class of each language (those
    with the least hash of id and text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = slim.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    sample = drawn(known, "lang", per_class)

    def run(batches):
        starts("language")
        for b in slices(batches):
            keys, ys, spans = [], [], []
            for i, text, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                at = np.unique(np.linspace(0, max(0, len(raw) - SPAN), SPANS).astype(int))  # over the whole text
                for a in at:
                    keys.append(-1 if i is None else i)
                    ys.append(lang)
                    spans.append(raw[a : a + SPAN].ljust(SPAN, b" "))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ys, pa.string()), pa.array(spans, pa.binary())], ["i", "y", "s"])

    got = sorted(sample.mapInArrow(run, "i long, y string, s binary").collect())  # bounded by per_class
    if not got:
        return None
    langs, y = np.unique([r["y"] for r in got], return_inverse=True)
    return Network(langs.tolist()).train(np.frombuffer(b"".join(r["s"] for r in got), np.uint8).reshape(-1, SPAN), y)


def identified(docs: DataFrame, model: Network | None) -> DataFrame:
    """docs with lang_pred, score (the pooled probability of lang_pred) and positions (of each language that labels any
    byte, how many)."""
    own = docs.drop("lang_pred", "score", "positions")
    none = F.create_map().cast("map<string,bigint>")
    if model is None:
        return own.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "positions": none})
    schema = own.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("positions")).schema

    def run(batches):
        starts("language")
        for b in slices(batches, 4 << 20):
            texts = b.column("text").to_pylist()
            p, votes = model.label(texts)
            best = p.argmax(1)
            known = [t is not None and _LETTER.search(t) is not None for t in texts]
            langs = [model.langs[k] if ok else "und" for k, ok in zip(best, known)]
            score = np.where(known, p[np.arange(len(best)), best], 0.0)
            each = [[(lang, int(c)) for lang, c in zip(model.langs, v) if c] for v in votes]
            columns = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(each, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "lang_pred", "score", "positions"])

    return own.mapInArrow(run, schema)


def op9_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = identified(texts, fit(docs))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", F.coalesce(F.try_element_at("positions", F.col("lang_pred")), F.lit(0)).alias("n_positions"))


QUERIES = {"op9_byte_network": op9_byte_network}
ORACLE_SQL: dict[str, str] = {}
