"""Packing: concatenate and cut.

Every document becomes its token ids and an end id. A first pass writes the ids in order and the token total of
each partition; prefix sums over the totals give every partition, and so every document, its global offset. A
second pass cuts the one long sequence into fixed windows and keeps boundary records: which piece of which
document lies where. Only the last window can need padding.

Documents follow each other as they stand in the input, in the order of its partitions and of the rows in each; no
column orders them, so there are no ties, and the first pass fixes the order in a written table. Null text counts as
empty (its document is the end id alone); a very long text is cut over as many windows as it takes; a null doc_id is
carried; repeated rows are packed as often as they come; an empty table gives no pieces; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoAges, documents, remembers, slices, starts, written

WINDOW = 4096
END_ID = 2
#: Words whose ids a worker remembers, in each of two ages.
MEMO = 400_000
#: Stands between words that are encoded together; its id occurs in no word without it.
MARK = b"|"

_encoders: dict[str, tuple] = {}
remembers("ids", _encoders.clear, ("packing",))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str):
    """texts -> list of ids as little-endian bytes, and the width of an id. Where white space ends a token in the
    vocabulary, words are encoded once and remembered, and the ids equal those of whole texts; with other vocabularies
    whole texts are encoded."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        kind = "<u2" if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        mark = tok.encode(MARK.decode(), add_special_tokens=False).ids
        lower = tok.normalizer is not None and tok.normalizer.normalize_str("ABCXYZ") == "abcxyz"
        _encoders[path] = (tok, kind, TwoAges(MEMO), mark[0] if len(mark) == 1 else None, lower, _parts_at_spaces(tok))
    tok, kind, memo, mark, lower, by_word = _encoders[path]

    def whole(texts: list[str | None]) -> list[bytes]:
        texts = [text.encode("utf-8", "replace").decode() if text else "" for text in texts]
        return [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    if not by_word:
        return whole, kind

    def fresh(words: list[bytes]) -> dict[bytes, bytes]:
        """Words are encoded as one text with marks between; those that hold the mark are encoded by themselves."""
        single = [w for w in words if mark is None or MARK in w]
        joint = [w for w in words if mark is not None and MARK not in w]
        made = {w: np.array(e.ids, kind).tobytes() for w, e in zip(single, tok.encode_batch_fast([w.decode() for w in single], add_special_tokens=False))}
        for a in range(0, len(joint), 2048):
            part = joint[a : a + 2048]
            ids = np.array(tok.encode_batch_fast([(b" " + MARK + b" ").join(part).decode()], add_special_tokens=False)[0].ids, kind)
            cuts = np.flatnonzero(ids == mark).tolist()
            raw, width = ids.tobytes(), ids.itemsize
            made.update((w, raw[i * width : j * width]) for w, i, j in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True))
        return made

    def encode(texts: list[str | None]) -> list[bytes]:
        # the vocabulary knows lower case only; marks of special tokens are kept as they are
        raw = [text.encode("utf-8", "replace") if text else b"" for text in texts]
        split = [(x if not lower or b"<|" in x else x.lower()).split() for x in raw]
        found = [[memo[w] for w in words] for words in split]
        new = {w: None for words, got in zip(split, found) if None in got for w, x in zip(words, got) if x is None}
        made = fresh(list(new))
        for w, x in made.items():
            memo.put(w, x)
        return [b"".join([made[w] if x is None else x for w, x in zip(words, got)] if None in got else got) for words, got in zip(split, found)]

    return encode, kind


def _parts_at_spaces(tok) -> bool:
    """Whether white space ends every token and leaves none itself: no token of two characters or more holds a space or
    a sign that stands for one (signs are fixed values of the common vocabularies), and texts of words and marks encode
    as their words do."""
    if any(len(t.removesuffix("</w>")) > 1 and any(c in t for c in " \t\n\u0120\u010a\u2581") for t in tok.get_vocab(with_added_tokens=False)):
        return False
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    words = ["a", "word", "Some", "don't", "12,3.", "x_y", "\u00e9t\u00e9", "\u6f22\u5b57", "##b", MARK.decode(), "end."]
    apart = [i for w in words for i in ids(w)]
    return bool(apart) and all(ids(space.join(words)) == apart and ids(space + space.join(words) + space) == apart for space in (" ", "\n", "\t ", "  "))


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """First pass: doc_id, part, start (in its partition), n, ids; as a written table."""

    def run(batches):
        starts("packing")
        encode, kind = encoder(tokenizer)
        end = np.array([end_id], kind).tobytes()
        width, part, at = len(end), TaskContext.get().partitionId(), 0
        for b in slices(batches, 2 << 20):
            ids = [x + end for x in encode(b.column("text").to_pylist())]
            n = np.array([len(x) // width for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "start", "n", "ids"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, "doc_id long, part long, start long, n long, ids binary"), "encoded")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit, binary)."""
    tokenizer = tokenizer or default_tokenizer()
    table = encoded(docs, tokenizer, end_id)
    # One row a partition: the totals are small beside the data they stand for.
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    sums = np.cumsum([0, *(n for _, n in totals)])
    base = docs.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, sums)], "part long, base long")
    if len(totals) <= 1_000_000:  # 16 bytes a row; beyond that Spark chooses the join
        base = F.broadcast(base)

    def cut(batches):
        kind = encoder(tokenizer)[1]
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, start, n, blob in zip(b.column("doc_id").to_pylist(), b.column("start").to_numpy(), b.column("n").to_numpy(), b.column("ids")):
                ids = np.frombuffer(blob.as_buffer(), kind).astype("<u4").tobytes()
                at, end = int(start), int(start + n)
                while at < end:
                    to = min(end, (at // window + 1) * window)
                    a = at - int(start)
                    for c, x in zip(out, (doc, a, to - at, int(n), at // window, at % window, ids[4 * a : 4 * (to - int(start))])):
                        c.append(x)
                    at = to
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    placed = table.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, ids (padded to the window), n_tokens, boundaries (offset, doc_id, start)."""
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(window)))
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select(
        "sequence_id",
        F.substring(F.concat(joined, pad), 1, 4 * window).alias("ids"),
        "n_tokens",
        F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"])).alias("boundaries"),
    )


def op10_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096; a row for each piece."""
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_concat_cut": op10_concat_cut}
ORACLE_SQL: dict[str, str] = {}
