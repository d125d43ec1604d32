"""Quality rules by line sequence labelling.

A linear-chain conditional random field with two labels marks each line as content or boilerplate; Viterbi decoding
gives the best labels of a document, and the share of its words on content lines decides whether it is kept. Beside
that stand plain counts of the text (see `COUNTS`) and the base rule on them, which a document has to pass first.

The field sees a line's ratios of characters, its lengths, its words (each hashed to one of WORD_SLOTS weights, whose mean
counts), the share of words that good documents have in common, and the lengths of the lines beside it. It is trained in numpy (forward-backward, gradient ascent with Adam) on a
bounded sample of labelled documents, PER_CLASS rows of each label of `quality` with TRAINING_CHARS characters each. Its
labels come from what it does not see: a line is boilerplate if the text had it before, or if it is short and stands
between different lines in NEIGHBOURHOODS places of the corpus at least, all documents counted. Other lines
take their document's label at first, content in a good one and boilerplate in a bad one; then, for ROUNDS rounds, the
field's own probabilities open the labels that it does not believe (they are summed out), and it is trained on. Lines
without a word are open. Whole documents of junk would teach it that labels never change, so each good document of the
sample is learned from a second time with up to MOST_PLANTED boilerplate lines of the sample put between its own.

Null and empty texts have no words: they fail the base rule. Very long texts are decoded whole. A null doc_id is
carried; repeated rows get the same verdict; equal scores fall to content; without labels every line is content;
columns of the input named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, gram_hashes, labelled_sample, mixed, slices, starts

PER_CLASS = 1000
#: Steps of the first training and of each further round; a label with a posterior below DOUBT is opened.
STEPS, MORE_STEPS, ROUNDS, DOUBT = 120, 60, 2, 0.5
RIDGE = 0.05
#: A document stays if at least this share of its words lies on content lines.
CONTENT_SHARE = 1 / 3
#: A short line has at most so many words; it is repeated if it has so many different neighbourhoods.
SHORT_LINE, NEIGHBOURHOODS = 25, 5
MOST_PLANTED = 6
LEAST_WORDS = 20
MOST_REPEATED = 30
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
FOLDS, HELD_OUT = 5, 0

_SETS = {"symbols": SYMBOLS, "capitals": bytes(range(65, 91)), "exclaims": b"!", "bars": b"|", "digits": b"0123456789", "ends": b".?!:;", "brackets": b"{}[]()=;_/\\@"}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _SETS.items()}
_SYMBOL_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_EDGES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.999])
_WORD_EDGES = np.array([1, 2, 3, 5, 8, 12, 20, 35, 60, 120])
_RATIOS = ("symbols", "capitals", "exclaims", "bars", "digits", "ends", "brackets", "repeated", "followed")
_WIDTH = len(_EDGES) + 1
_SIZES = len(_WORD_EDGES) + 2
#: A word is common if so many good documents of the sample have it in lines that do not show to be boilerplate.
COMMON = 3
#: Bins of each ratio; of the words in a line, of their mean length, of the words in the line before and after (with one
#: for none); of the share of common words; a constant; then the words' slots.
WORD_SLOTS = 1 << 16
_BINS = (len(_RATIOS) + 1) * _WIDTH + 4 * _SIZES + 1
FEATURES = _BINS + WORD_SLOTS
_COLUMNS = len(_RATIOS) + 6
_SIZE, _BEFORE, _AFTER, _SHARE = (len(_RATIOS) + k for k in (0, 2, 3, 4))  # columns of sizes


def beside(active: np.ndarray, n_lines: np.ndarray) -> None:
    """Fills in the columns of the lines before and after, by the sizes of the lines of each text."""
    base = len(_RATIOS) * _WIDTH
    size = active[_SIZE] - base
    none = _SIZES - 1
    before, after = np.concatenate([[none], size[:-1]]), np.concatenate([size[1:], [none]])
    first = np.cumsum(n_lines) - n_lines
    before[first], after[first + n_lines - 1] = none, none
    active[_BEFORE], active[_AFTER] = base + 2 * _SIZES + before, base + 3 * _SIZES + after


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def familiar(active: np.ndarray, words: np.ndarray, hashes: np.ndarray, common: np.ndarray) -> None:
    """Fills in the column of the share of common words (sorted hashes)."""
    line = np.repeat(np.arange(len(words)), words)
    share = np.bincount(line, np.isin(hashes, common), len(words)) / np.maximum(1, words)
    active[_SHARE] = len(_RATIOS) * _WIDTH + 4 * _SIZES + np.searchsorted(_EDGES, share, "right")


def _line_hashes(w: Words, word_line: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each line's words in order; 0 without any."""
    first = np.cumsum(n) - n
    place = np.arange(len(w.hash)) - np.repeat(first, n)
    out = np.zeros(len(n), np.uint64)
    if len(w.hash):
        out[n > 0] = np.add.reduceat(mixed(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first[n > 0])
    return out


def neighbourhoods(texts: list[str | None], sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the short lines that are sought (sorted hashes): the line, and a hash of the lines before and after it, each
    pair once."""
    w = Words(texts, lower=False)
    line_at = np.concatenate([[0], np.flatnonzero(w.data == 10) + 1])[:-1]
    word_line = np.searchsorted(line_at, w.at, "right") - 1
    n = np.bincount(word_line, minlength=len(line_at))
    h = _line_hashes(w, word_line, n)
    if not len(h):
        return h, h
    before, after = np.concatenate([[0], h[:-1]]).astype(np.uint64), np.concatenate([h[1:], [0]]).astype(np.uint64)
    first = np.searchsorted(line_at, w.text_at)
    first = first[first < len(h)]
    before[first], after[first[1:] - 1] = 0, 0
    at = np.flatnonzero((n > 0) & (n <= SHORT_LINE) & np.isin(h, sought))
    pairs = np.unique(np.stack([h[at], mixed(mixed(before[at] + np.uint64(1)) + after[at])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def counted(texts: list[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The counts of each text; active features (column x line, as indices) of all lines; lines of each text; of each
    line its words, a hash of them, and whether its text had it before; the hash of each word."""
    w = Words(texts, lower=False)
    data, n_texts = w.data, len(texts)
    line_at = np.concatenate([[0], np.flatnonzero(data == 10) + 1])[:-1]  # each text ends with a line end here
    line_of_text = np.searchsorted(line_at, w.text_at)
    n_lines = np.diff(line_of_text)
    size = np.maximum(1, np.diff(np.append(line_at, len(data))) - 1)
    per = {k: np.add.reduceat(t[data], line_at, dtype=np.int64) if len(data) else np.zeros(0, np.int64) for k, t in _TABLES.items()}
    word_line = np.searchsorted(line_at, w.at, "right") - 1
    n = np.bincount(word_line, minlength=len(line_at))
    by_text = lambda x: np.add.reduceat(x, w.text_at[:-1], dtype=np.int64) if n_texts else np.zeros(0, np.int64)
    points = by_text((data & 0xC0) != 0x80) - 1  # code points, without the line end added
    spaces = by_text(_SYMBOL_SPACE[data]) - 1
    counts = {"n_words": w.n, "word_chars": points - spaces, "n_symbols": by_text(_TABLES["symbols"][data])}

    # lines with a word that equal an earlier line of their text
    dup = np.zeros(len(line_at), bool)
    ends = np.append(line_at[1:], len(data)) - 1
    raw = data.tobytes()
    for t in range(n_texts):
        a, z = line_of_text[t], line_of_text[t + 1]
        if z - a > 1:
            seen: set[bytes] = set()
            for i in range(a, z):
                if n[i]:
                    line = raw[line_at[i] : ends[i]]
                    if line in seen:
                        dup[i] = True
                    seen.add(line)
    counts["n_dup_lines"] = np.add.reduceat(dup, line_of_text[:-1], dtype=np.int64) if n_texts else np.zeros(0, np.int64)

    # words in windows that occur twice or more in their text
    covered = np.zeros(len(w.hash) + 1, np.int64)
    grams = gram_hashes(w.hash, REPEAT_WINDOW)
    if len(grams):
        inside = w.text[: len(grams)] == w.text[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(inside)
        key = mixed(grams[at] + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = at[order[np.append(same, False) | np.append(False, same)]] if len(order) else at[:0]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    hit = np.cumsum(covered)[:-1] > 0
    counts["n_repeat_words"] = np.bincount(w.text[hit], minlength=n_texts)

    # of each line: words seen already in it, words equal to the one before
    key = mixed(w.hash + word_line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    distinct = np.bincount(word_line[np.unique(key, return_index=True)[1]], minlength=len(line_at)) if len(key) else n
    follows = np.zeros(len(w.hash), bool)
    follows[1:] = (w.hash[1:] == w.hash[:-1]) & (word_line[1:] == word_line[:-1])
    some = np.maximum(1, n)
    ratios = {
        "symbols": per["symbols"] / size, "capitals": per["capitals"] / size, "exclaims": per["exclaims"] / some, "bars": per["bars"] / some, "digits": per["digits"] / size,
        "ends": per["ends"] / some, "brackets": per["brackets"] / size, "repeated": 1 - distinct / some, "followed": np.bincount(word_line[follows], minlength=len(line_at)) / some,
    }
    active = [i * _WIDTH + np.searchsorted(_EDGES, ratios[k], "right") for i, k in enumerate(_RATIOS)]
    base = len(_RATIOS) * _WIDTH
    active.append(base + np.searchsorted(_WORD_EDGES, n, "right"))
    active.append(base + _SIZES + np.searchsorted(_WORD_EDGES, size / some, "right"))
    active += [np.zeros(len(line_at), np.int64)] * 3 + [np.full(len(line_at), _BINS - 1)]
    active = np.stack(active).astype(np.int64) if len(line_at) else np.zeros((_COLUMNS, 0), np.int64)
    if len(line_at):
        beside(active, n_lines)
    return counts, active, n_lines, {"words": n, "hash": _line_hashes(w, word_line, n), "again": dup & (n > 0), "hashes": w.hash}


class Field:
    """Weights of the features (for content, less those for boilerplate) and of the transitions."""

    def __init__(self):
        self.w, self.t, self.common = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(0, np.uint64)

    def emissions(self, active: np.ndarray, words: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For each line, content's score less boilerplate's; words: of each line, slots: of each word."""
        line = np.repeat(np.arange(len(words)), words)
        return self.w[active].sum(0) + np.bincount(line, self.w[_BINS + slots], len(words)) / np.maximum(1, words)

    def decode(self, e: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Viterbi over all texts in step: 1 for content. Ties fall to content."""
        out = np.ones(len(e), np.int8)
        first = np.cumsum(n_lines) - n_lines
        order = np.argsort(-n_lines, kind="stable")
        n, first = n_lines[order], first[order]
        if not len(n) or not n[0]:
            return out
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # texts with more than so many lines
        score = np.stack([np.zeros(live[0]), e[first[: live[0]]]], 1)
        back = []
        last = np.zeros((len(n), 2))
        for k in range(1, n[0]):
            m = live[k]
            last[m : len(score)] = score[m:]
            s = score[:m]
            from0, from1 = s[:, :1] + self.t[0], s[:, 1:] + self.t[1]
            best = from1 >= from0
            back.append(best)
            score = np.where(best, from1, from0)
            score[:, 1] += e[first[:m] + k]
        last[: len(score)] = score
        state = (last[:, 1] >= last[:, 0]).astype(np.int8)
        for k in range(n[0] - 1, 0, -1):
            m = live[k]
            out[first[:m] + k] = state[:m]
            state[:m] = back[k - 1][np.arange(m), state[:m]]
        out[first[: live[0]]] = state[: live[0]]
        return out

    def marginals(self, e: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Forward-backward over documents that are sorted by falling number of lines n: the weighted sum of
        log-partition values, each line's probability of content, and the weighted sums of the label pairs' ones.
        e: the scores of both labels of each line."""
        first = np.cumsum(n) - n
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[first] = e[first]
        for k in range(1, n[0]):
            i = first[: live[k]] + k
            a[i] = e[i] + np.logaddexp(a[i - 1][:, :1] + self.t[0], a[i - 1][:, 1:] + self.t[1])
        for k in range(n[0] - 1, 0, -1):
            i = first[: live[k]] + k
            x = e[i] + b[i]
            b[i - 1] = np.logaddexp(x[:, :1] + self.t[:, 0], x[:, 1:] + self.t[:, 1])
        z = np.logaddexp(*(a[first + n - 1]).T)
        z_line, w_line = np.repeat(z, n), np.repeat(weights, n)
        i = np.delete(np.arange(len(e)), first)
        pairs = np.empty((2, 2))
        for u in (0, 1):
            for v in (0, 1):
                pairs[u, v] = (w_line[i] * np.exp(a[i - 1, u] + self.t[u, v] + e[i, v] + b[i, v] - z_line[i])).sum()
        return float((weights * z).sum()), np.exp(a[:, 1] + b[:, 1] - z_line), pairs

    def gradient(self, active: np.ndarray, words: np.ndarray, slots: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the weighted log-likelihood of the labels y (1 content, 0 boilerplate, -1 open: both are summed out); and
        each line's probability of content, whatever its label."""
        e = np.stack([np.zeros(len(y)), self.emissions(active, words, slots)], 1)
        held = e.copy()
        held[y == 1, 0] = held[y == 0, 1] = -1e9
        z1, p1, pairs1 = self.marginals(held, n, weights)
        z0, p0, pairs0 = self.marginals(e, n, weights)
        d = np.repeat(weights, n) * (p1 - p0)
        g = sum(np.bincount(c, d, FEATURES) for c in active)
        g += np.bincount(_BINS + slots, np.repeat(d / np.maximum(1, words), words), FEATURES)
        return z1 - z0, g, pairs1 - pairs0, p0

    def train(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
        """Gradient ascent; docs: active features, words, slots and labels. Returns each line's probability of content."""
        order = np.argsort([-len(d[3]) for d in docs], kind="stable")
        n = np.array([len(docs[i][3]) for i in order])
        active = np.concatenate([docs[i][0] for i in order], 1)
        words, slots, y = (np.concatenate([docs[i][k] for i in order]) for k in (1, 2, 3))
        weights = weights[order]
        moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
        for step in range(1, steps + 1):
            _, g, gt, p = self.gradient(active, words, slots, y, n, weights)
            grad = np.concatenate([g - RIDGE * self.w, (gt - RIDGE * self.t).ravel()])
            moments[0] = 0.9 * moments[0] + 0.1 * grad
            moments[1] = 0.999 * moments[1] + 0.001 * grad**2
            move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
            self.w += move[:FEATURES]
            self.t += move[FEATURES:].reshape(2, 2)
        cut = np.split(p, np.cumsum(n)[:-1])
        out: list = [None] * len(docs)
        for i, x in zip(order, cut):
            out[i] = x
        return out


def _repeated_lines(docs: DataFrame, sought: np.ndarray) -> np.ndarray:
    """Which of the sought lines (hashes) stand in NEIGHBOURHOODS different neighbourhoods at least, in all documents.
    Copies of whole documents are one neighbourhood. A task passes on NEIGHBOURHOODS of a line at most, which is enough
    to know, so a line that most documents have is a few rows of each."""
    held = docs.sparkSession.sparkContext.broadcast(np.unique(sought).tobytes())

    def run(batches):
        starts("line_labels")
        known, seen = np.frombuffer(held.value, np.uint64), {}
        for b in slices(batches):
            fresh = []
            for h, k in zip(*(x.tolist() for x in neighbourhoods(b.column("text").to_pylist(), known))):
                of = seen.setdefault(h, set())
                if len(of) < NEIGHBOURHOODS and k not in of:
                    of.add(k)
                    fresh.append((h, k))
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*fresh)], ["h", "k"])

    found = docs.select("text").mapInArrow(run, "h long, k long").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= NEIGHBOURHOODS)
    return np.sort(found.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))  # no more than are sought


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """Trained on the lines of documents that labels.quality marks; without any, every line is content."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, _ = labelled_sample(slim, labels, "quality", per_class, FOLDS, HELD_OUT)

    def run(batches):
        starts("line_labels")
        for b in slices(batches):
            counts, active, n, line = counted(b.column("text").to_pylist())
            lines, words = np.cumsum(n)[:-1], np.cumsum(counts["n_words"])[:-1]
            cut = lambda x, at: pa.array([y.tobytes() for y in np.split(x, at)])
            columns = [cut(active.T.astype(np.int32), lines), cut(line["hash"], lines), cut(line["words"].astype(np.int32), lines), cut(line["again"].astype(np.int8), lines), cut(line["hashes"], words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), *columns], ["doc_id", "y", "a", "h", "n", "e", "s"])

    got = sample.mapInArrow(run, "doc_id long, y int, a binary, h binary, n binary, e binary, s binary").collect()  # bounded by per_class
    field = Field()
    if not got:
        return field
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["a"], r["h"]))
    lines = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int32)) for r in got]
    repeated = _repeated_lines(slim, np.concatenate([h[(n > 0) & (n <= SHORT_LINE)] for h, n in lines]))
    good = np.array([int(r["y"] >= 1) for r in got])
    shown = [(n > 0) & ((np.frombuffer(r["e"], np.int8) > 0) | (n <= SHORT_LINE) & np.isin(h, repeated)) for r, (h, n) in zip(got, lines)]
    hashes = [np.frombuffer(r["s"], np.uint64) for r in got]
    own = [np.unique(h[np.repeat(~e, n)]) for h, e, (_, n), g in zip(hashes, shown, lines, good) if g]
    seen, times = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
    field.common = seen[times >= COMMON]
    rows = []
    for r, (_, n), evident, h in zip(got, lines, shown, hashes):
        y = np.where(n > 0, np.where(evident, 0, int(r["y"] >= 1)), -1)
        a, n = np.frombuffer(r["a"], np.int32).reshape(-1, _COLUMNS).T.astype(np.int64), n.astype(np.int64)
        familiar(a, n, h, field.common)
        rows.append((a, n, slots_of(h), y))
    mixed_rows = _planted(rows, good, shown)
    kind = np.concatenate([good, np.full(len(mixed_rows), 2)])
    docs_ = rows + mixed_rows
    share = np.array([1 / max(1, (kind == c).sum()) for c in (0, 1, 2)])
    weights = share[kind] * len(kind) / 3 / np.array([max(1, len(d[3])) ** 0.5 for d in docs_])
    p = field.train(docs_, weights)
    for _ in range(ROUNDS):
        for i, (a, n, s, y) in enumerate(rows):
            believed = np.where(good[i] > 0, p[i], 1 - p[i])
            docs_[i] = (a, n, s, np.where(shown[i] | (n == 0) | (believed >= DOUBT), y, -1))
        p = field.train(docs_, weights, MORE_STEPS)
    return field


def _planted(rows: list, good: np.ndarray, shown: list[np.ndarray]) -> list:
    """Good documents with up to MOST_PLANTED boilerplate lines put between their own: lines that show to be boilerplate, and
    lines of bad documents, in equal parts where there are both."""
    cut = lambda r: np.split(r[2], np.cumsum(r[1])[:-1])
    pools = [{}, {}]  # each line once, however often it is there
    for r, g, e in zip(rows, good, shown):
        for k, part in enumerate(cut(r)):
            if r[1][k] and (e[k] or not g):
                pools[0 if e[k] else 1].setdefault(part.tobytes(), (r[0][:, k], part))
    pools = [list(x.values()) for x in pools if x]
    rng, out = np.random.default_rng(5), []
    for r in (r for r, g in zip(rows, good) if g and pools):
        parts, some = cut(r), 1 + rng.integers(MOST_PLANTED)
        at = np.sort(rng.integers(0, len(r[1]) + 1, some))
        put = [(pool := pools[rng.integers(len(pools))])[rng.integers(len(pool))] for _ in range(some)]
        a = np.insert(r[0], at, np.stack([x[0] for x in put], 1), 1)
        beside(a, np.array([a.shape[1]]))
        for k, x in sorted(zip(at.tolist(), put), key=lambda z: -z[0]):
            parts.insert(k, x[1])
        n = np.array([len(x) for x in parts])
        out.append((a, n, np.concatenate(parts), np.insert(r[3], at, 0)))
    return out


def labelled(docs: DataFrame, field: Field, share: float = CONTENT_SHARE) -> DataFrame:
    """docs with the counts, content_share, content_lines (positions of the lines kept), base_failed and kept."""
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("content_share", "double"), ("content_lines", "array<int>"), ("base_failed", "boolean"), ("kept", "boolean")]
    own = docs.drop(*(c for c, _ in added))
    schema = own.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added)).schema

    def run(batches):
        starts("line_labels")
        for b in slices(batches):
            counts, active, n_lines, line = counted(b.column("text").to_pylist())
            familiar(active, line["words"], line["hashes"], field.common)
            content = field.decode(field.emissions(active, line["words"], slots_of(line["hashes"])), n_lines) == 1
            cuts = np.cumsum(n_lines)
            first = cuts - n_lines
            on = np.add.reduceat(line["words"] * content, first)
            part = on / np.maximum(1, counts["n_words"])
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            lines = [np.flatnonzero(content[a:z]).astype(np.int32) for a, z in zip(first, cuts)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(part), pa.array(lines, pa.list_(pa.int32())), pa.array(failed), pa.array(~failed & (part >= share))],
                [*b.schema.names, *(c for c, _ in added)],
            )

    return own.mapInArrow(run, schema)


def op5_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = labelled(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "content_share")


QUERIES = {"op5_line_labels": op5_line_labels}
ORACLE_SQL: dict[str, str] = {}
