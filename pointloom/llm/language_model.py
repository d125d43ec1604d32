"""LM scoring with an Elias-Fano n-gram trie.

Texts are read once, in blocks, and every later step takes a block's tokens from a written table, so nothing depends
on how files are split. Between steps, blocks and shards exchange rows of packed arrays, a row only where there is
something to send, so the exchanges grow with the tokens.

1. Blocks deal their distinct words to hash ranges, which sum them, number them (the frequent ones get small numbers)
   and send numbers and counts back.
2. Words counted HOT times or more are split over several shards as contexts. Blocks deal the distinct pairs of words
   of which one is hot to ranges, and get their counts back.
3. Blocks send their distinct triples (a word with the two before it, and how often training texts have it) to the
   shard of the middle word. A hot middle word is split by the word before it, and where that pair is hot, too, by the
   word after it; such triples carry the counts of the pairs, so the split changes no result.
4. A shard builds its trie from the triples of training texts, scores all distinct triples once, and sends each block
   the scores of its own; the block sums them by document.

A shard's trie has a level of contexts v; below each, its successors w, and the words u that stand before v; below
each (u, v), its successors, numbered relative to those of v. All levels are Elias-Fano sequences with monotone
pointers, and log-probabilities are quantised to BITS bits; they lie in a memory-mapped file without a name, which a
task that is run again builds anew, and a query searches the successor of a number inside its context's range.

Probabilities are interpolated: P(w) = (c + 0.5) / (N + 0.5 (V + 1)), one unknown word taking the rest;
P(w | v) = L2 c(vw) / c(v) + (1 - L2) P(w); P(w | u, v) = L3 c(uvw) / c(uv) + (1 - L3) P(w | v), each where its
context was seen. A text begins with two begin marks and ends with an end token, which counts as a token.

Null and empty texts are the end token alone; a text longer than BLOCK_BYTES is a block of its own and is scored whole;
a null doc_id is carried (its fold is that of the empty text); repeated rows are learned from and scored as often as
they come; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, fold, mixed, pack_sorted, slices, starts, trim, unpack_sorted, written
from .elias_fano import Sequence, elias_fano, grouped, mapped, ordered, pack_bits, read_bits

FOLDS, HELD_OUT = 5, 1
L2, L3 = 0.15, 0.35
BITS = 13
BLOCK_BYTES = 5 << 20
#: Bytes of text for each hash range and each shard of triples; count from which a context is split.
RANGE_BYTES, SHARD_BYTES, HOT = 12 << 20, 6 << 20, 1_000_000
#: The end token's hash input; no word holds white space.
_END = b"\n"
_STEPS = 4096  # of a unit of log10, in what goes between blocks and shards
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: What blocks and ranges or shards send each other. A block's own row passes the ranges unchanged; its dest is
#: negative.
_SENT = "dest long, block long, own boolean, data binary"


def squeeze(x: np.ndarray, kind: str) -> bytes:
    """Byte planes of little-endian numbers, compressed."""
    import zstandard

    x = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def unsqueeze(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def bundled(*columns: tuple[np.ndarray, str]) -> bytes:
    """Some columns as one value; of a column of zeros only the length is kept."""
    parts = [squeeze(x, kind) if x.any() else b"" for x, kind in columns]
    sizes = np.array([[len(x), len(p)] for (x, _), p in zip(columns, parts)], "<u4")
    return sizes.tobytes() + b"".join(parts)


def unbundled(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for (n, size), kind in zip(np.frombuffer(data, "<u4", 2 * len(kinds)).reshape(-1, 2).tolist(), kinds):
        out.append(unsqueeze(data[at : at + size], kind) if size else np.zeros(n, kind))
        at += size
    return out


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("dest", "block", "own", "data"), cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))})


def _sliced(dest: np.ndarray) -> list[tuple[int, int, int]]:
    """Of sorted destinations: each one, and where its rows begin and end."""
    at = np.flatnonzero(np.append(True, dest[1:] != dest[:-1])) if len(dest) else np.zeros(0, np.int64)
    return list(zip(dest[at].tolist(), at.tolist(), np.append(at[1:], len(dest)).tolist()))


def _starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns that are sorted together."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_OWN = ("<u4", "<u4", "<u1", "<i8", "<u1")  # tokens (words of the block by number), sizes, train, doc ids, null ids


def _dealt_words(ranges: int, block_bytes: int):
    def run(batches):
        import xxhash

        starts("language_model")
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, block_bytes)):
            number = (part << 20) + k
            w = Words(b.column("text").to_pylist())
            n = len(w.n)
            # each text's words, then the end
            tokens = np.empty(len(w.hash) + n, np.uint64)
            ends = w.first[1:] + np.arange(n)
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner], tokens[ends] = w.hash, xxhash.xxh64_intdigest(_END)
            sizes, train = w.n + 1, b.column("train").to_numpy(zero_copy_only=False)
            del w
            hashes, index = np.unique(tokens, return_inverse=True)
            counts = np.bincount(index[np.repeat(train, sizes)], minlength=len(hashes))
            ids = b.column("doc_id")
            own = bundled(*zip((index, sizes, train, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)), _OWN))
            dest = (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            rows = [(-1 - number, number, True, own)]
            for r, a, z in _sliced(dest):
                blob = pack_sorted(hashes[a:z])
                rows.append((r, number, False, len(blob).to_bytes(4, "little") + blob + bundled((counts[a:z], "<u4"))))
            yield from _table(rows).to_batches()
            trim()

    return run


def _numbered(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one range: sums over the blocks; numbers and counts back to each; tokens and words of the range once
        (block -1)."""
        trim()
        if table.column("own")[0].as_py():
            return table.append_column("tokens", pa.array([0] * len(table), pa.int64())).append_column("words", pa.array([0] * len(table), pa.int64()))
        r = table.column("dest")[0].as_py()
        blocks, hashes, counts = table.column("block").to_pylist(), [], []
        for data in table.column("data").to_pylist():
            size = int.from_bytes(data[:4], "little")
            hashes.append(unpack_sorted(data[4 : 4 + size]))
            counts.append(unbundled(data[4 + size :], "<u4")[0])
        cuts = np.cumsum([0, *(len(x) for x in hashes)])
        h, counts = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
        order = np.argsort(h, kind="stable")
        run_at = _starts_of(h[order])
        total = np.add.reduceat(counts[order], run_at)
        at = np.empty(len(h), np.int64)
        at[order] = np.repeat(np.arange(len(run_at)), np.diff(np.append(run_at, len(h))))
        number = np.empty(len(total), np.int64)
        # by count, ties by hash: the same in every run
        number[np.argsort(-total, kind="stable")] = np.arange(len(total)) * ranges + r + 1
        rows = [(r, b, False, bundled((number[at[a:z]], "<u8"), (total[at[a:z]], "<u8"))) for b, a, z in zip(blocks, cuts, cuts[1:])]
        rows.append((r, -1, False, b""))
        out = _table(rows)
        for name, x in (("tokens", int(total.sum())), ("words", int((total > 0).sum()))):
            out = out.append_column(name, pa.array([0] * (len(rows) - 1) + [x], pa.int64()))
        return out

    return run


class _Block:
    """A block's tokens: words have ranks in the order of their numbers, 0 is the begin mark."""

    def __init__(self, table: pa.Table, n_docs: int, hot: int, pair_rows: list[dict] = ()):
        rows = table.to_pylist()
        self.pair_rows = pair_rows
        own = next(r for r in rows if r["own"])
        back = [unbundled(r["data"], "<u8", "<u8") for r in sorted((r for r in rows if not r["own"]), key=lambda r: r["dest"])]
        index, sizes, self.train, self.docs, self.null = unbundled(own["data"], *_OWN)
        self.number, self.sizes, self.hot = own["block"], sizes.astype(np.int64), hot
        ids, counts = (np.concatenate([x[k] for x in back]) for k in (0, 1))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(1, len(ids) + 1)
        self.ids = np.append(np.uint64(0), ids[order])
        self.count = np.append(np.int64(n_docs), counts[order].astype(np.int64))
        self.w = rank[index]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.v, self.u = np.zeros_like(self.w), np.zeros_like(self.w)
        self.v[1:], self.u[2:] = self.w[:-1], self.w[:-2]
        self.v[self.first] = self.u[self.first] = 0
        self.u[(self.first + 1)[self.sizes > 1]] = 0
        self.width = np.int64(len(self.ids))


    def is_hot(self, x: np.ndarray) -> np.ndarray:
        return self.count[x] >= self.hot

    def hot_pairs(self) -> np.ndarray:
        """Distinct pairs (v, w) of which one is hot, as v * width + w, in order."""
        some = self.is_hot(self.v) | self.is_hot(self.w)
        return np.unique(self.v[some] * self.width + self.w[some])

    def split(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n_docs: int, ranges: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shards of triples with a hot v, and c(v), c(vw), c(uv) of each: by u, and by w where (u, v) is hot."""
        pairs = self.hot_pairs()
        order, _ = _pair_order(self, pairs, ranges)
        count = np.empty(len(pairs), np.int64)
        count[order] = np.concatenate([unbundled(r["data"], "<u8")[0] for r in sorted(self.pair_rows, key=lambda r: -r["dest"])])
        c_v, c_vw = self.count[v], count[np.searchsorted(pairs, v * self.width + w)]
        begins = v == 0
        c_uv = np.full(len(v), n_docs, np.int64)
        c_uv[~begins] = count[np.searchsorted(pairs, (u * self.width + v)[~begins])]
        by_u = np.uint64(1) + mixed(self.ids[u] + np.uint64(77)) % (-(-c_v // self.hot)).astype(np.uint64)
        place = _place(self.ids[v], by_u, shards)
        pair = np.flatnonzero(c_uv >= self.hot)
        by_w = mixed(self.ids[w[pair]] + np.uint64(78)) % (-(-c_uv[pair] // self.hot)).astype(np.uint64)
        place[pair] = _place(mixed(self.ids[v[pair]] * _GOLDEN + self.ids[u[pair]]), by_w, shards)
        return place, np.stack([c_v, c_vw, c_uv])


def _place(a: np.ndarray, b: np.ndarray, places: int) -> np.ndarray:
    return (mixed(a.astype(np.uint64) * _GOLDEN + b.astype(np.uint64)) % np.uint64(places)).astype(np.int64)


def _pair_order(x: _Block, pairs: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """In what order pairs are sent, and to which ranges."""
    dest = _place(x.ids[pairs // x.width], x.ids[pairs % x.width] + np.uint64(1), ranges)
    order = np.argsort(dest, kind="stable")
    return order, dest[order]


def _pairs(n_docs: int, hot: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: its hot pairs and their counts in training texts, to the ranges."""
        trim()
        x = _Block(table, n_docs, hot)
        pairs = x.hot_pairs()
        key = x.v * x.width + x.w
        key = key[(x.train[x.owner] > 0) & (x.is_hot(x.v) | x.is_hot(x.w))]
        count = np.bincount(np.searchsorted(pairs, key), minlength=len(pairs))
        order, dest = _pair_order(x, pairs, ranges)
        pairs, count = pairs[order], count[order]
        return _table([(d, x.number, False, bundled((x.ids[pairs[a:z] // x.width], "<u8"), (x.ids[pairs[a:z] % x.width], "<u8"), (count[a:z], "<u4"))) for d, a, z in _sliced(dest)])

    return run


def _pair_sums(table: pa.Table) -> pa.Table:
    """Of one range: each pair's count over all blocks, back to the blocks (dest -1 - range)."""
    trim()
    r, blocks = table.column("dest")[0].as_py(), table.column("block").to_pylist()
    v, w, n = (np.concatenate(c) for c in zip(*(unbundled(x, "<u8", "<u8", "<u4") for x in table.column("data").to_pylist())))
    cuts = np.cumsum([0, *(np.frombuffer(x[:4], "<u4")[0] for x in table.column("data").to_pylist())]).astype(np.int64)
    order = ordered(v, w)
    at = _starts_of(v[order], w[order])
    total = np.empty(len(v), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), at), np.diff(np.append(at, len(v))))
    return _table([(-1 - r, b, False, bundled((total[a:z], "<u8"))) for b, a, z in zip(blocks, cuts, cuts[1:])])


#: A triple's v (as a difference), u, w, count in training texts, -log10 P(w); of a split v, c(v), c(vw), c(uv).
_TRIPLES = ("<u8", "<u8", "<u8", "<u4", "<u2", "<u8", "<u8", "<u8")


def _laid(x: _Block, n_docs: int, ranges: int, shards: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a block: the shards of its distinct triples, in order; u, v, w of each, its count in training texts, and c(v),
    c(vw), c(uv) where v is split; and which triple each position has."""
    # positions by v, u, w
    context = np.unique(x.v * x.width + x.u, return_inverse=True)[1]
    key = context * x.width + x.w
    order = np.argsort(key)
    at = _starts_of(key[order])
    entry = np.empty(len(key), np.int64)
    entry[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    u, v, w = (y[order[at]] for y in (x.u, x.v, x.w))
    n = np.bincount(entry[x.train[x.owner] > 0], minlength=len(at))
    counts = np.zeros((3, len(at)), np.int64)
    dest = _place(x.ids[v], np.zeros(len(v), np.uint64), shards)
    split = np.flatnonzero(x.is_hot(v))
    if len(split):
        dest[split], counts[:, split] = x.split(u[split], v[split], w[split], n_docs, ranges, shards)
    by = np.argsort(dest, kind="stable")
    sent = np.empty(len(by), np.int64)
    sent[by] = np.arange(len(by))
    return dest[by], [y[by] for y in (u, v, w, n, *counts)], sent[entry]


def _log_words(x: _Block, n_tokens: int, n_words: int) -> np.ndarray:
    """log10 P(w) of the block's words."""
    return np.log10(x.count + 0.5) - np.log10(n_tokens + 0.5 * (n_words + 1))


def _triples(n_tokens: int, n_words: int, n_docs: int, hot: int, ranges: int, shards: int):
    def run(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        """Of one block: its distinct triples to the shards."""
        trim()
        x = _Block(blocks, n_docs, hot, pairs.to_pylist())
        dest, (u, v, w, n, *counts), _ = _laid(x, n_docs, ranges, shards)
        p = np.rint(_log_words(x, n_tokens, n_words) * -_STEPS).clip(0, 65535)[w]
        columns, rows = [x.ids[v], x.ids[u], x.ids[w], n, p, *counts], []
        for d, a, z in _sliced(dest):
            part = [y[a:z] for y in columns]
            part[0] = np.diff(part[0], prepend=np.uint64(0))  # v rises inside a shard
            rows.append((d, x.number, False, bundled(*zip(part, _TRIPLES))))
        return _table(rows)

    return run


class Trie:
    """Levels (see the module), and the score of positions."""

    def __init__(self, levels: dict[str, np.ndarray]):
        self.at = levels
        self.seq = {}
        for name in ("v", "v_w", "w", "v_u", "u", "u_w", "w3"):
            self.seq[name] = Sequence({k: levels[f"{name}.{k}"] for k in ("meta", "low", "high")})
        self.scale = levels["scale"]

    @staticmethod
    def levels(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, p: np.ndarray, c_v: np.ndarray, c_vw: np.ndarray, c_uv: np.ndarray) -> dict[str, np.ndarray]:
        """From distinct triples and how often each occurs in training texts (p: log10 P(w)); c_v, c_vw, c_uv: counts
        over all shards where v is split, else 0. What was seen in training anywhere is in the levels."""
        summed = lambda x, at: np.add.reduceat(x, at) if len(at) else x[:0]
        # contexts v
        on = (n > 0) | (c_v > 0)
        order = np.argsort(v[on], kind="stable")
        at = _starts_of(v[on][order])
        contexts = v[on][order[at]]
        total_v = np.where(c_v[on][order[at]] > 0, c_v[on][order[at]], summed(n[on][order], at))
        # pairs (v, w)
        i = np.flatnonzero((n > 0) | (c_vw > 0))
        i = i[ordered(v[i], w[i])]
        at = _starts_of(v[i], w[i])
        k2, w2, p2 = np.searchsorted(contexts, v[i[at]]), w[i[at]], p[i[at]]
        c2 = np.where(c_vw[i[at]] > 0, c_vw[i[at]], summed(n[i], at))
        prob2 = L2 * c2 / total_v[k2] + (1 - L2) * 10.0**p2
        flat, first = grouped(w2, _starts_of(k2)), np.searchsorted(k2, np.arange(len(contexts) + 1))
        pair_of = np.empty(len(n), np.int64)
        pair_of[i] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(i))))
        # pairs (u, v)
        i = np.flatnonzero((n > 0) | (c_uv > 0))
        i = i[ordered(v[i], u[i])]
        at = _starts_of(v[i], u[i])
        k_u, u_u = np.searchsorted(contexts, v[i[at]]), u[i[at]]
        total_u = np.where(c_uv[i[at]] > 0, c_uv[i[at]], summed(n[i], at))
        first_u = np.searchsorted(k_u, np.arange(len(contexts) + 1))
        context_of = np.empty(len(n), np.int64)
        context_of[i] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(i))))
        # triples, as (u, v) and the rank of w among the successors of v
        i = np.flatnonzero(n > 0)
        g, of_u = pair_of[i], context_of[i]
        order = ordered(of_u, g)
        i, g, of_u = i[order], g[order], of_u[order]
        prob3 = L3 * n[i] / total_u[of_u] + (1 - L3) * prob2[g]
        levels = {}
        for name, x in (
            ("v", contexts), ("v_w", first), ("w", flat), ("v_u", first_u), ("u", grouped(u_u, _starts_of(k_u))),
            ("u_w", np.searchsorted(of_u, np.arange(len(at) + 1))), ("w3", grouped(g - first[k_u[of_u]], _starts_of(of_u))),
        ):
            levels |= {f"{name}.{part}": y for part, y in elias_fano(x).items()}
        logs = [np.log10(prob2), np.log10(prob3)]
        low = min([0.0, *(float(x.min()) for x in logs if len(x))])
        step = max(1e-9, -low / ((1 << BITS) - 1))
        levels["scale"] = np.array([low, step])
        for name, x in zip(("q2", "q3"), logs):
            levels[name] = pack_bits(np.rint((x - low) / step).astype(np.uint64), BITS)
        return levels

    def _log(self, name: str, i: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * read_bits(self.at[name], BITS, i)

    def _child(self, pointers: str, below: str, parent: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of x among the children of parent: its index, its number inside the range, and whether it is there."""
        ptr, seq = self.seq[pointers], self.seq[below]
        # one look at each parent of a run
        new = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(parent)))
        own = parent[new]
        a, z = ptr.get(own), ptr.get(own + 1)
        before = np.zeros(len(a), np.int64)
        some = a > 0
        before[some] = seq.get(a[some] - 1) + 1
        a, z, before = (np.repeat(y, size) for y in (a, z, before))
        i, equal = seq.successor(x + before)
        return i, i - a, equal & (i < z)

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 P(w | u, v); p: log10 P(w). Positions are looked up in the order of their contexts."""
        order = ordered(v, u, w)
        out = np.empty(len(v))
        for a in range(0, len(v), 1 << 18):
            i = order[a : a + (1 << 18)]
            out[i] = self._score(*(x[i].astype(np.int64) for x in (u, v, w)), p[i])
        return out

    def _score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = p.astype(np.float64).copy()
        new = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(v)))
        k_v, seen_v = self.seq["v"].successor(v[new])
        on = np.flatnonzero(np.repeat(seen_v, size))
        if not len(on):
            return out
        k = np.repeat(k_v, size)[on]
        g, rank, seen2 = self._child("v_w", "w", k, w[on])
        two = out[on] + np.log10(1 - L2)
        two[seen2] = self._log("q2", g[seen2])
        i, _, seen_u = self._child("v_u", "u", k, u[on])
        two[seen_u] += np.log10(1 - L3)
        both = np.flatnonzero(seen_u & seen2)
        if len(both):
            j, _, seen3 = self._child("u_w", "w3", i[both], rank[both])
            two[both[seen3]] = self._log("q3", j[seen3])
        out[on] = two
        return out


def _shard_scores(table: pa.Table) -> pa.Table:
    """Of one shard: the trie from its training triples, the score of each distinct triple, and to each block those of
    its own."""
    trim()
    s, blocks = table.column("dest")[0].as_py(), table.column("block").to_pylist()
    parts = [unbundled(x, *_TRIPLES) for x in table.column("data").to_pylist()]
    cuts = np.cumsum([0, *(len(x[0]) for x in parts)])
    v = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    u, w, n, p, *counts = (np.concatenate([x[i] for x in parts]) for i in range(1, len(_TRIPLES)))
    del parts
    order = ordered(v, u, w)
    at = _starts_of(v[order], u[order], w[order])
    of = np.empty(len(v), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(v))))
    n = np.add.reduceat(n[order].astype(np.int64), at)
    u, v, w, p, *counts = (x[order[at]] for x in (u, v, w, p, *counts))
    del order
    p = p.astype(np.float64) / -_STEPS
    trie = Trie(mapped(Trie.levels(u, v, w, n, p, *(x.astype(np.int64) for x in counts))))
    got = np.rint(trie.score(u, v, w, p) * -_STEPS).clip(0, 65535)[of]
    return _table([(s, b, False, bundled((got[a:z], "<u2"))) for b, a, z in zip(blocks, cuts, cuts[1:])])


def _summed(n_tokens: int, n_words: int, n_docs: int, hot: int, ranges: int, shards: int):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        """Of one block: the scores of its positions, summed by document. The triples are laid out again as they were
        sent, which costs less than to send where each position's triple went."""
        trim()
        rows = found.to_pylist()
        x = _Block(blocks, n_docs, hot, [r for r in rows if r["dest"] < 0])
        entry = _laid(x, n_docs, ranges, shards)[2]
        got = np.concatenate([unbundled(r["data"], "<u2")[0] for r in sorted((r for r in rows if r["dest"] >= 0), key=lambda r: r["dest"])])
        score = np.bincount(x.owner, got[entry], len(x.sizes)) / -_STEPS
        return pa.table({
            "doc_id": pa.array(x.docs, mask=x.null > 0), "held_out": pa.array(x.train == 0), "n_tokens": pa.array(x.sizes),
            "n_known": pa.array(np.add.reduceat((x.count > 0)[x.w].astype(np.int64), x.first)), "train_tokens": pa.array(np.full(len(x.sizes), n_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(_log_words(x, n_tokens, n_words)[x.w], x.first)), "score": pa.array(score),
        })

    return run


def scored(docs: DataFrame, train: Column, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the model is learned
    from those for which train holds; words that occur hot times or more are split as contexts."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size, n_docs = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    ranges, shards = max(4, -(-size // RANGE_BYTES)), max(8, -(-size // SHARD_BYTES))
    dealt = slim.mapInArrow(_dealt_words(ranges, block_bytes), _SENT)
    # The blocks' tokens lie in this table from now on; docs are not read again.
    words = written(dealt.groupBy("dest").applyInArrow(_numbered(ranges), _SENT + ", tokens long, words long"), "words")
    n_tokens, n_words = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    blocks = words.where("block >= 0").select("dest", "block", "own", "data")
    by_block = blocks.groupBy("block")  # shuffled once: the steps below use the same exchange
    sizes = (n_docs, hot, ranges)
    pairs = by_block.applyInArrow(_pairs(*sizes), _SENT)
    counted = pairs.groupBy("dest").applyInArrow(lambda t: _pair_sums(t), _SENT)
    triples = by_block.cogroup(counted.groupBy("block")).applyInArrow(_triples(n_tokens, n_words, *sizes, shards), _SENT)
    scores = triples.groupBy("dest").applyInArrow(lambda t: _shard_scores(t), _SENT)
    return by_block.cogroup(scores.unionByName(counted).groupBy("block")).applyInArrow(
        _summed(n_tokens, n_words, *sizes, shards), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op1_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), fold("doc_id", FOLDS) != HELD_OUT)


QUERIES = {"op1_elias_fano_trie": op1_elias_fano_trie}
ORACLE_SQL: dict[str, str] = {}
