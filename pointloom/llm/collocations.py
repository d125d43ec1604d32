"""Phrase collocations by Toivonen's sampling method.

Texts are lower-cased (A-Z), split into pieces and words, and written once as blocks: the block's own dictionary and
numbers in place of words. A phrase of k words is admitted to a count if both phrases of k - 1 words inside it belong to
the family of phrases that is held to be frequent; so what is counted is that family and its negative border, and no
phrase can be frequent without being admitted or having a frequent phrase inside that the family lacks.

1. Level by level, a sample of the documents (SAMPLE of 64 by hash) proposes the family: what reaches LOWERED times the
   threshold in it.
2. A full pass counts the family and its border over all blocks, words included.
3. Phrases of the border that prove frequent join the family, and further passes count what is newly admitted, until no
   pass finds any: then every frequent phrase has been counted.
4. Two last passes spell out the frequent phrases, and then the words that these hold, and count them as they are
   spelled, so that nothing rests on hashes.

The family travels to the tasks as a bit map of 64-bit hashes, whose size is a parameter (BITS) and does not grow with
the data. A bit that another phrase has set only admits a phrase too many, which is counted and then found infrequent;
where the map fills up, passes count more but find the same. Blocks add up a task's counts before anything is shuffled,
so a frequent word or phrase is one row of a task.

Scores, and the rule that drops phrases inside longer ones, are joins among the frequent phrases. A phrase inside a
longer candidate that is as frequent is inside one that is longer by one word, too, so one word is enough to look at.

Null texts count as empty, a null lang as `und`; pieces without words count for nothing; a very long text is one block
of its own; repeated rows count as often as they come; ties are broken by the order of the contract (score, count,
phrase in UTF-8 bytes), which leaves none; an empty table gives no rows; further columns are not read, whatever their
names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mixed, slices, starts, written

#: Counts that make a phrase a candidate, longest phrases, phrases returned for a language.
LEAST, LONGEST, MOST = 100, 5, 2000
#: The sample: documents in 64, and the part of the expected count that proposes a phrase.
SAMPLE, LOWERED = 8, 0.5
#: Bits of the family's map: 2 to this power (8 MB).
BITS = 26
#: Bytes of text of a block; distinct phrases that a task holds before it passes them on.
BLOCK, HELD = 4 << 20, 2_000_000

#: What ends a piece, and an upper-case letter's lower case, byte by byte (fixed values); 0xFF occurs in no text.
_FOLD = bytes(0xFF if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_END = b"\xff"


def words_of(text: bytes) -> list[bytes]:
    """Words, with _END after each piece."""
    folded = text.translate(_FOLD).replace(_END, b" \xff ") + b" \xff"
    return [w for w in folded.split(b" ") if w]


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks: lang, sampled, n (words), book (the block's words, spaces between), ids (little-endian 32-bit, 0 ends a
    piece); as a written table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), (F.pmod(F.xxhash64("doc_id", text), F.lit(64)) < SAMPLE).alias("sampled"), text.alias("text"))

    def run(batches):
        starts("collocations")
        for b in slices(batches, BLOCK):
            groups = defaultdict(list)
            for lang, sampled, t in zip(*(b.column(c).to_pylist() for c in ("lang", "sampled", "text"))):
                if t:
                    groups[lang, sampled].append(t.encode("utf-8", "surrogatepass"))
            for (lang, sampled), raw in groups.items():
                words = words_of(b"\n".join(raw))
                book: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
                book[_END] = 0
                ids = np.fromiter(map(book.__getitem__, words), np.uint32, len(words))
                del book[_END]
                if not book:
                    continue
                # Ends that follow an end say nothing.
                ids = ids[np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])]
                yield pa.RecordBatch.from_pydict({"lang": [lang], "sampled": [sampled], "n": [int((ids > 0).sum())], "book": pa.array([b" ".join(book)], pa.binary()), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    return written(slim.mapInArrow(run, "lang string, sampled boolean, n long, book binary, ids binary"), "blocks")


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(h: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words: of their first k - 1 words, and the last."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k))


def _bits(family: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map of 64-bit words."""
    p = hashes >> np.uint64(64 - BITS)
    return (family[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


class Block:
    """The phrases of one block, level by level: those of k words begin where two of k - 1 words begin in a row."""

    def __init__(self, lang: str, book: bytes, ids: bytes):
        self.book = book.split(b" ")
        self.ids = np.frombuffer(ids, "<u4").astype(np.int64)
        self.words = _word_hashes(lang, self.book)

    def counted(self, family: np.ndarray, first: int = 1, longest: int = LONGEST, before: np.ndarray | None = None):
        """Yields hashes and counts of the phrases of first to longest words that the family admits and the one before
        did not: those of which all shorter phrases are in it. Only hashes are compared here, place by place."""
        if first <= 1 and before is None:
            yield self.words, np.bincount(self.ids[self.ids > 0] - 1, minlength=len(self.book))
        good = np.concatenate([[False], _bits(family, self.words)])[self.ids]
        at = np.flatnonzero(good)
        h = self.words[self.ids[at] - 1]
        old = _bits(before, h) if before is not None else np.zeros(len(h), bool)
        for k in range(2, longest + 1):
            # Two places in a row where phrases of the family begin hold phrases that share all but a word.
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            if not len(pair):
                return
            old, at = old[pair] & old[pair + 1], at[pair]
            h = _longer(h[pair], self.words[self.ids[at + k - 1] - 1], k)
            if k >= first:
                yield np.unique(h[~old], return_counts=True)
            keep = _bits(family, h)
            at, h, old = at[keep], h[keep], old[keep]
            if before is not None:
                old &= _bits(before, h)

    def spelled(self, family: np.ndarray, longest: int = LONGEST):
        """Yields the phrases of two words and more that are in the family, and their counts; phrases are told apart by
        numbers in the block (of a phrase and its next word), so counts are exact."""
        number = self.ids - 1
        at = np.flatnonzero(np.concatenate([[False], _bits(family, self.words)])[self.ids])
        number, hashes = number[at], self.words
        for k in range(2, longest + 1):
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            if not len(pair):
                return
            at = at[pair]
            keys, one, number, count = np.unique(number[pair] * len(self.book) + self.ids[at + k - 1] - 1, return_index=True, return_inverse=True, return_counts=True)
            hashes = _longer(hashes[keys // len(self.book)], self.words[keys % len(self.book)], k)
            good = _bits(family, hashes)
            for i, n in zip(at[one[good]].tolist(), count[good].tolist()):
                yield self.spell(i, k), n
            keep = good[number]
            at, number = at[keep], number[keep]

    def of_words(self, family: np.ndarray):
        """Yields the words that are in the family, and their counts."""
        good = np.flatnonzero(_bits(family, self.words))
        count = np.bincount(self.ids, minlength=len(self.book) + 1)
        for i, n in zip(good.tolist(), count[good + 1].tolist()):
            yield self.book[i], n

    def spell(self, at: int, k: int) -> bytes:
        return b" ".join(self.book[i - 1] for i in self.ids[at : at + k].tolist())


def _blocks(batches):
    """lang and Block, one at a time: a batch holds many, and only one of them is unpacked."""
    for b in batches:
        for i in range(b.num_rows):
            lang, book, ids = (b.column(c)[i].as_py() for c in ("lang", "book", "ids"))
            yield lang, Block(lang, book, ids)


def _counted(blocks: DataFrame, family, before=None, first: int = 1, longest: int = LONGEST) -> DataFrame:
    """h, n: counts, by hash, of the phrases of first to longest words that the family admits and the one before did not."""

    def run(batches):
        starts("collocations")
        new, old = np.frombuffer(family.value, np.uint64), None if before is None else np.frombuffer(before.value, np.uint64)
        held, size = [], 0

        def flush():
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            order = np.argsort(h)
            h, n = h[order], n[order]
            first_of = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[first_of], np.add.reduceat(n, first_of)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for _, block in _blocks(batches):
            for h, n in block.counted(new, first, longest, old):
                held.append((h, n))
                size += len(h)
            if size > HELD:
                yield flush()
                size = 0
        if size:
            yield flush()

    return blocks.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _marked(counts: DataFrame, least: int, family: np.ndarray) -> np.ndarray:
    """The family with the phrases that have at least that count. What reaches the driver is at most the map's words."""
    p = F.shiftrightunsigned("h", 64 - BITS)
    found = counts.where(F.col("n") >= least).select(p.alias("p")).select(F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = family.copy()
    out[table.column("word").to_numpy()] |= table.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, k, f: every phrase of 2 to longest words that occurs at least so often, and its words, counted
    exactly."""
    spark = blocks.sparkSession
    send = lambda family: spark.sparkContext.broadcast(family.tobytes())
    family = np.zeros(1 << (BITS - 6), np.uint64)
    sample = blocks.where("sampled")
    proposed = max(2, int(least * LOWERED * SAMPLE / 64))
    for k in range(1, longest):
        family = _marked(_counted(sample, send(family), first=k, longest=k), proposed, family)
    before, frequent = None, np.zeros_like(family)
    while True:
        counts = _counted(blocks, send(family), None if before is None else send(before), longest=longest)
        frequent = _marked(counts, least, frequent)
        grown = family | frequent
        if (grown == family).all():
            break
        before, family = family, grown
    whole = written(_spelled(blocks, send(frequent), lambda block, bits: block.spelled(bits, longest), least), "phrases")
    # Of words, those count that the phrases hold.
    held = whole.select("lang", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word")).distinct()

    def hashed(batches):
        for b in batches:
            h = [int(_word_hashes(lang, [w.encode("utf-8", "surrogatepass")])[0]) for lang, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], ["h"])

    needed = _marked(held.mapInArrow(hashed, "h long").withColumn("n", F.lit(1)), 1, np.zeros_like(frequent))
    words = _spelled(blocks, send(needed), lambda block, bits: block.of_words(bits), least)
    return whole.unionByName(written(words, "words"))


#: Phrases that a task adds up before it passes them on, by hash of the phrase to so many dealers.
SPELLED, DEALERS = 500_000, 256


def _spelled(blocks: DataFrame, family, of, least: int) -> DataFrame:
    """lang, phrase, k, f: what of(block, family) yields of all blocks, added up by the phrases themselves. Tasks pass on
    what they have added up as packed rows, one for each dealer; phrases meet there."""
    kind = pa.schema([("dealer", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        import xxhash

        starts("collocations")
        bits, sums, size = np.frombuffer(family.value, np.uint64), defaultdict(lambda: defaultdict(int)), 0

        def flush():
            rows = []
            for lang, found in sums.items():
                dealt = defaultdict(list)
                for phrase in found:
                    dealt[xxhash.xxh32_intdigest(phrase) % DEALERS].append(phrase)
                for d, phrases in dealt.items():
                    rows.append({"dealer": d, "lang": lang, "phrases": b"\n".join(phrases), "counts": np.array([found[x] for x in phrases], "<i8").tobytes()})
            sums.clear()
            return pa.RecordBatch.from_pylist(rows, kind)

        for lang, block in _blocks(batches):
            found = sums[lang]
            size -= len(found)
            for phrase, n in of(block, bits):
                found[phrase] += n
            size += len(found)
            if size > SPELLED:
                yield flush()
                size = 0
        if size:
            yield flush()

    def merge(batches):
        sums = defaultdict(int)
        for b in batches:
            for lang, phrases, counts in zip(*(b.column(c).to_pylist() for c in ("lang", "phrases", "counts"))):
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<i8").tolist()):
                    sums[lang, phrase] += n
        found = [(lang, x.decode(), x.count(b" ") + 1, n) for (lang, x), n in sums.items() if n >= least]
        for a in range(0, len(found), 10_000):
            columns = list(zip(*found[a : a + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "k", "f"])

    dealt = blocks.mapInArrow(run, "dealer int, lang string, phrases binary, counts binary")
    return dealt.repartition("dealer").mapInArrow(merge, "lang string, phrase string, k int, f long")


def scored(phrases: DataFrame, totals: DataFrame, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language; totals: lang, n."""
    words = F.split("phrase", " ")
    whole = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    inner = phrases.where("k > 2").select("lang", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("k") - 1), " "), F.array_join(F.slice(words, 2, F.col("k") - 1), " "))).alias("phrase"), F.col("f").alias("within"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    left = whole.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a"))).drop("within")
    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w", "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    parts = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"]).join(parts.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]).join(totals, "lang")
    # a * n has at most 38 digits, and so has l * r; the quotient is at most 1000 * n / 100.
    score = F.expr("cast(cast(a as decimal(12,0)) * cast(n as decimal(17,0)) * cast(1000 as decimal(4,0)) as decimal(38,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = cuts.select("lang", "phrase", "a", "n", F.struct(score.cast("long").alias("score"), "cut", "l", "r").alias("c")).groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    best = best.select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    blocks = encoded(docs)
    return scored(frequent_phrases(blocks, least, longest), blocks.groupBy("lang").agg(F.sum("n").alias("n")), most)


def op13_toivonen_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    return collocations(documents(spark, sf_dir))


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), sizes AS (
  SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c
), shorter AS (
  SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM sizes
), inside AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN shorter s
  ON s.lang = c.lang AND array_to_string(s.w[s.i:s.i + s.m - 1], ' ') = c.phrase AND 100 * s.a >= 100 * c.a
), left_over AS (
  SELECT c.lang, c.phrase, c.a, c.w, c.k, unnest(range(1, c.k)) AS cut FROM c ANTI JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
), cuts AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n,
    CAST(CAST(1000 AS HUGEINT) * x.a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM left_over x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')
  JOIN n ON n.lang = x.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
) WHERE rank <= 2000
"""

QUERIES = {"op13_toivonen_mining": op13_toivonen_mining}
ORACLE_SQL = {"op13_toivonen_mining": _SQL}
