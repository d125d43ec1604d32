"""Phrase mining against counts of every phrase, with and without border failures."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pointloom.llm import collocations as C


def plain(rows, least, longest=5, most=2000):
    """(lang, text) -> the contract's rows, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in kept.items():
        if any(x[0] == lang and len(x[1]) > len(w) and b >= a and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1)) for x, b in kept.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:most], 1)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def made(seed, n=150):
    dice = random.Random(seed)
    words = ["a", "B", "b", "c", "dd", "É", "漢字", "x-y", "(z)"]
    rows = []
    for _ in range(n):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(dice.randrange(25)))
        rows.append((dice.choice(["en", "de", None]), text + dice.choice(["", "New York City is big", "a b c dd É"])))
    return rows


@pytest.mark.parametrize(("seed", "lowered"), [(1, 0.5), (2, 1e9)])
def test_against_every_phrase(spark, monkeypatch, seed, lowered):
    monkeypatch.setattr(C, "LOWERED", lowered)  # so high a bar proposes nothing: all comes from border failures
    rows = made(seed)
    got = [tuple(r) for r in C.collocations(frame(spark, rows), 7).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 7) and len(got) > 20


def test_sample_that_misses_a_word_is_mended(spark, monkeypatch):
    """Phrases that no sampled document has."""
    rows = [("en", f"only here {i} one two three four five")for i in range(60)] + [("en", "common words " * 3)] * 40
    df = frame(spark, rows)
    blocks = C.encoded(df)
    assert {r["sampled"] for r in blocks.select("sampled").distinct().collect()} == {True, False}
    monkeypatch.setattr(C, "LOWERED", 3.0)
    assert {tuple(r) for r in C.collocations(df, 10).collect()} == plain(rows, 10)


def test_a_full_map_changes_nothing(spark, monkeypatch):
    rows = made(3, 80)
    monkeypatch.setattr(C, "_marked", lambda counts, least, family: counts.count() * 0 + ~(family & 0))
    assert {tuple(r) for r in C.collocations(frame(spark, rows), 5).collect()} == plain(rows, 5)


def test_first_ones_only(spark):
    rows = made(4)
    assert {tuple(r) for r in C.collocations(frame(spark, rows), 5, most=3).collect()} == plain(rows, 5, most=3)


def test_odd_input(spark, odd, empty):
    assert C.collocations(empty).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in C.collocations(odd, 2).collect() if r["lang"] != "de"} == {r for r in plain([r for r in rows if r[0] != "de"], 2)}
    long = [("en", "one two three, " * 50_000), ("en", None), (None, "")]
    got = C.collocations(frame(spark, long)).collect()
    assert [(r["phrase"], r["a"]) for r in got] == [("one two three", 50_000)]


def test_arithmetic_beyond_64_bits(spark):
    big = 4_000_000_000
    phrases = spark.createDataFrame([("en", "x y", 2, big), ("en", "x", 1, big), ("en", "y", 1, big + 1)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (r,) = C.scored(phrases, totals).collect()
    assert r["score"] == 1000 * big * 10**13 // (big * (big + 1))
