"""Token counts that follow edits.

A document's text is cut into pre-tokens, whose token counts add up to the document's. Runs of LEAF pre-tokens are the
leaves of a tree whose nodes hold the sums of characters and tokens below them. An edit finds its leaf by character
sums, re-cuts the text from a pre-token that it cannot have changed until the cuts fall on old ones again, encodes
only the pre-tokens between, and corrects the sums on the leaf's way to the root.

Edits are (start, removed, inserted), in characters of the text as it then is, applied in order; they are clipped to
the text. Null text is empty, null edits are none; a null doc_id is carried; repeated rows are counted alike; an empty
table gives no rows; columns of the input named like the outputs are replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoAges, documents, remembers, slices, starts

LEAF = 64
MEMO = 300_000
#: How far beyond its end the cut of a pre-token can depend on the text (a contraction is up to three characters).
REACH = 3
EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"

_counters: dict[tuple, "Counter"] = {}
remembers("counts", _counters.clear, ("edit_counts",))


class Counter:
    """Pre-tokens of texts, and how many tokens each has."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.cut = self.pattern.findall
        self.memo = TwoAges(MEMO)

    def counts(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        found = [memo[p] for p in pieces]
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    found[i] = len(self.encoding.encode_ordinary(pieces[i]))
                    memo.put(pieces[i], found[i])
        return found

    def pieces_from(self, text: str, at: int):
        return (m.group() for m in self.pattern.finditer(text, at))


def counter(path: str | None = None, pattern: str | None = None) -> Counter:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


class CountTree:
    """Leaves: lists of pre-tokens and of their counts. Nodes: sums of characters and tokens; node 1 is the root."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        pieces = counter.cut(text)
        self._build(pieces, counter.counts(pieces))

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        cuts = range(0, max(1, len(pieces)), LEAF)
        self.pieces = [pieces[a : a + LEAF] for a in cuts]
        self.counts = [counts[a : a + LEAF] for a in cuts]
        self.width = 1 << (len(self.pieces) - 1).bit_length()
        none = [0] * (self.width - len(self.pieces))
        chars = [0] * self.width + [sum(map(len, p)) for p in self.pieces] + none
        tokens = [0] * self.width + [sum(c) for c in self.counts] + none
        for i in range(self.width - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        self.chars, self.tokens = chars, tokens

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.pieces for p in leaf)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, and how many characters stand before the leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.pieces) - 1), before

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.pieces[leaf], self.counts[leaf] = pieces, counts
        node = leaf + self.width
        chars, tokens = sum(map(len, pieces)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = max(0, min(start, self.length))
        end = max(start, min(start + max(0, removed), self.length))
        # Back to a pre-token that ends REACH before the edit: nothing up to there can change.
        leaf, at = self._leaf_at(max(0, start - REACH))
        k = 0
        while k < len(self.pieces[leaf]) and at + len(self.pieces[leaf][k]) <= start - REACH:
            at += len(self.pieces[leaf][k])
            k += 1
        first, head, base = leaf, k, at
        # The old text from there on, leaf by leaf, until the new cuts meet the old ones.
        last, old, old_cuts, reach = first, self.pieces[first][head:], [], base
        for p in old:
            reach += len(p)
            old_cuts.append(reach)
        while True:
            while reach < end and last + 1 < len(self.pieces):
                last, reach = self._next(last, old, old_cuts, reach)
            text = "".join(old)
            new = text[: start - base] + inserted + text[end - base :]
            shift = len(inserted) - (end - start)
            ends = {c + shift: i for i, c in enumerate(old_cuts) if c >= end}
            whole = last + 1 == len(self.pieces)
            fresh, pos, met = [], base, None
            for p in self.counter.pieces_from(new, 0):
                pos += len(p)
                # a cut near the end of what was read can depend on what follows it
                if not whole and pos > base + len(new) - REACH:
                    break
                fresh.append(p)
                if pos in ends and pos >= start + len(inserted):
                    met = ends[pos]
                    break
            if met is not None or whole:
                break
            last, reach = self._next(last, old, old_cuts, reach)
        tail = old[met + 1 :] if met is not None else []
        counts = self.counter.counts(fresh)
        self.encoded += len(fresh)
        old_counts = [c for x in range(first, last + 1) for c in self.counts[x]]
        kept = len(self.pieces[first][:head])
        pieces = self.pieces[first][:head] + fresh + tail
        counts = self.counts[first][:head] + counts + (old_counts[kept + met + 1 :] if met is not None else [])
        n = last - first + 1
        if len(pieces) > 4 * LEAF * n:  # a long insertion: new leaves
            all_p = [p for x in self.pieces[:first] for p in x] + pieces + [p for x in self.pieces[last + 1 :] for p in x]
            all_c = [c for x in self.counts[:first] for c in x] + counts + [c for x in self.counts[last + 1 :] for c in x]
            self._build(all_p, all_c)
            return
        for i in range(n):
            a, z = len(pieces) * i // n, len(pieces) * (i + 1) // n
            self._set(first + i, pieces[a:z], counts[a:z])

    def _next(self, last: int, old: list[str], cuts: list[int], reach: int) -> tuple[int, int]:
        for p in self.pieces[last + 1]:
            reach += len(p)
            cuts.append(reach)
        old.extend(self.pieces[last + 1])
        return last + 1, reach


_ADDED = (("n_tokens", "bigint"), ("n_edits", "bigint"), ("n_tokens_edited", "bigint"), ("n_pieces", "bigint"), ("n_encoded_again", "bigint"), ("n_chars_edited", "bigint"))


def recounted(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs (text, edits) with n_tokens before and n_tokens_edited after the edits, n_edits, n_pieces (pre-tokens
    before), n_encoded_again (pre-tokens encoded for the edits) and n_chars_edited."""
    own = docs.drop(*(c for c, _ in _ADDED))
    schema = own.select("*", *(F.lit(0).cast(t).alias(c) for c, t in _ADDED)).schema

    def run(batches):
        starts("edit_counts")
        c = counter(path, pattern)
        for b in slices(batches):
            rows = []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                tree = CountTree(text or "", c)
                before, pieces = tree.total, sum(map(len, tree.pieces))
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((before, len(edits or ()), tree.total, pieces, tree.encoded, tree.length))
            cols = np.array(rows, np.int64).reshape(-1, len(_ADDED)).T
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in cols)], [*b.schema.names, *(n for n, _ in _ADDED)])

    return own.mapInArrow(run, schema)


def revisions(docs: DataFrame) -> DataFrame:
    """docs with edits drawn from the documents themselves: three for each, at places that follow from a hash of the
    id; each removes up to 40 characters and puts in up to 60 of the same text from elsewhere."""
    n = F.length(F.coalesce("text", F.lit("")))

    def one(k: int):
        h = lambda j, most: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k), F.lit(j)), most)
        return F.struct(h(1, n + 1).cast("bigint").alias("start"), h(2, F.lit(41)).cast("bigint").alias("removed"), F.substring("text", h(3, n + 1).cast("int"), h(4, F.lit(61)).cast("int")).alias("inserted"))

    return docs.withColumn("edits", F.array(*(one(k) for k in range(3))).cast(EDITS))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return recounted(revisions(docs)).drop("text", "edits")


QUERIES = {"op7_edit_counts": op7_edit_counts}
ORACLE_SQL: dict[str, str] = {}
