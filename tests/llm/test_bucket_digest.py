"""Quartile bucket digests: against counts triplet by triplet, and against a sort of all documents."""

import hashlib
import random

import numpy as np

from pointloom.llm import bucket_digest as B


def plain_counts(raw: bytes) -> list[int]:
    out, data = [0] * B.BUCKETS, raw + bytes(B.TAIL)
    for i in range(len(raw)):
        for a, b, factor in B.TRIPLETS:
            h = (data[i] | data[i + a] << 8 | data[i + b] << 16) * factor % 2**32
            h ^= h >> 15
            out[h * 0x2C1B3C6D % 2**32 >> 24] += 1
    return out


def plain_difference(a: str, b: str) -> int:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = min(2 * abs(x[0] - y[0]), 40) + min(2 * (abs(x[1] // 16 - y[1] // 16) + abs(x[1] % 16 - y[1] % 16)), 40)
    for p, q in zip(x[2:], y[2:]):
        for s in (6, 4, 2, 0):
            gap = abs((p >> s) % 4 - (q >> s) % 4)
            total += 6 if gap == 3 else gap
    return min(total, B.UNRELATED)


def plain_next(rows):
    """doc_id -> what the query returns, by a sort of all rows."""
    rows = sorted(rows, key=lambda r: -r[0])
    found = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        n = len(text) // 3
        made = text[: len(text) - n] + after[:n]
        a, b, c = B.digests([text, made, after])
        found[doc] = (len(text), hashlib.sha256(made.encode()).hexdigest(), a, b, 1 - plain_difference(a, b) / B.UNRELATED, 1 - plain_difference(a, c) / B.UNRELATED)
    return found


def test_counts_of_any_length(monkeypatch):
    dice = random.Random(4)
    raw = [bytes(dice.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 700, 0, 90)]
    want = [plain_counts(x) for x in raw]
    assert B.bucket_counts(raw).tolist() == want
    monkeypatch.setattr(B, "CHUNK", 64)  # long texts in chunks
    assert B.bucket_counts(raw).tolist() == want
    assert sum(want[6]) == 6 * 700


def test_likeness_is_bounded():
    a, b, empty = B.digests(["the rain in spain stays mainly", "qqq zzz 123 ... +++ ///", None])
    assert B.digests(["the rain in spain stays mainly", ""]) == [a, empty]
    assert list(B.likeness([a, a, empty], [a, b, empty])) == [1.0, 1 - plain_difference(a, b) / B.UNRELATED, 1.0]
    assert 0 <= B.likeness([a], [b])[0] < 1


def test_query_against_a_sort(spark, sf, docs):
    got = {r["doc_id"]: tuple(r[1:]) for r in B.op11_bucket_digest(spark, sf).collect()}
    want = plain_next([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got.keys() == want.keys()
    for k, (n, sha, a, b, near, after) in got.items():
        assert (n, sha, a, b) == want[k][:4]
        assert abs(near - want[k][4]) < 1e-12 and abs(after - want[k][5]) < 1e-12
    long = [v for v in got.values() if v[0] > 200]
    assert np.mean([v[4] >= v[5] for v in long]) > 0.99


def test_more_tasks_than_rows_give_the_same(spark, docs):
    few = docs.limit(7).collect()
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in few], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in B.with_next(frame.repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: v[1] for k, v in plain_next([(r["doc_id"], r["text"]) for r in few]).items()}


def test_odd_input(spark, odd, empty):
    assert B.with_next(empty).count() == 0
    rows = B.with_next(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and same[0]["fingerprint"] == same[1]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    alone = B.with_next(odd.where("doc_id = 7")).collect()
    assert [(r["n_chars"], r["near_next"]) for r in alone] == [(7, 1.0)]


def test_columns_of_a_table(spark, odd):
    marked = B.fingerprinted(B.fingerprinted(odd), "lang", "of_lang")
    assert marked.columns == [*odd.columns, "fingerprint", "of_lang"]
    rows = marked.select("fingerprint", "of_lang", B.alike(marked["fingerprint"], marked["of_lang"]).alias("like")).collect()
    assert all(abs(r["like"] - (1 - plain_difference(r["fingerprint"], r["of_lang"]) / B.UNRELATED)) < 1e-12 for r in rows)
    gone = spark.createDataFrame([(None, "00"), ("00", None)], "a string, b string")
    assert [r[0] for r in gone.select(B.alike(gone["a"], gone["b"])).collect()] == [None, None]
