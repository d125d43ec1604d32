"""The operators against brute-force versions."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import edit_counts, elias_fano, jaccard, language, language_model, line_labels, packing, perspectives, quality, queries, sharding, tiling
from pointloom.llm.common import fold, least_hashes
from pointloom.operators.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


# --- language model ---------------------------------------------------------


@pytest.mark.parametrize("n,top", [(0, 10), (1, 1), (5, 100), (1000, 1200), (1000, 10**12), (20_000, 10**9), (300, 300)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    x = np.sort(r.integers(0, top, n))
    s = elias_fano.Sequence(elias_fano.mapped(elias_fano.elias_fano(x)))
    assert (s.get(np.arange(n)) == x).all()
    q = np.concatenate([r.integers(0, top + 5, 500), x[:200]])
    at, equal = s.successor(q)
    assert (at == np.searchsorted(x, q)).all() and (equal == np.isin(q, x)).all()


@pytest.mark.parametrize("hot", [None, 40, 3])
def test_language_model(spark, sf, docs, texts, hot):
    if hot is None:
        found = language_model.op1_elias_fano_trie(spark, sf)
    else:  # frequent words, and pairs, are split over shards; many blocks
        found = language_model.scored(docs, fold("doc_id", 5) != 1, hot, 20_000)
    got = {r["doc_id"]: r for r in found.collect()}
    tokens = {i: [*ascii_words(t), "\n"] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c1, c2, c3, cv, cuv = Counter(), Counter(), Counter(), Counter(), Counter()
    for i in train:
        s = [0, 0, *tokens[i]]
        c1.update(tokens[i])
        for u, v, w in zip(s, s[1:], s[2:]):
            c2[v, w] += 1
            c3[u, v, w] += 1
            cv[v] += 1
            cuv[u, v] += 1
    n, distinct = sum(c1.values()), len(c1)
    held, base_held = 0.0, 0.0
    for i, t in tokens.items():
        r, base, score = got[i], 0.0, 0.0
        s = [0, 0, *t]
        for u, v, w in zip(s, s[1:], s[2:]):
            p = (c1[w] + 0.5) / (n + 0.5 * (distinct + 1))
            base += math.log10(p)
            if cv[v]:
                p = language_model.L2 * c2[v, w] / cv[v] + (1 - language_model.L2) * p
            if cuv[u, v]:
                p = language_model.L3 * c3[u, v, w] / cuv[u, v] + (1 - language_model.L3) * p
            score += math.log10(p)
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(c1[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6 * len(t)
        assert abs(r["score"] - score) < 1e-3 * len(t)
        if r["held_out"]:
            held, base_held = held + r["score"], base_held + r["base_score"]
    assert held > base_held


# --- sharding ---------------------------------------------------------------


def test_shards_are_even(spark, sf, texts):
    got = sharding.op2_sampled_splitters(spark, sf).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(t.encode()) + 1 for i, t in texts.items()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(16):
        own = [r for r in got if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 16) <= largest
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_places_against_a_sort(spark, monkeypatch, law):
    """Shards and slots are what one sort of all records gives; few and skewed samples make ranges overfull, so that
    they are subdivided."""
    monkeypatch.setattr(sharding, "SAMPLES_A_RANGE", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    rounds = []
    drawn = sharding._drawn
    monkeypatch.setattr(sharding, "_drawn", lambda *x: rounds.append(x[2]) or drawn(*x))
    rows = [(i, (i * i) % 7 if i % 3 else 5, 1 + (i * 7919) % 300 + (20_000 if i == 500 else 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, h long, size long")
    got = {r["doc_id"]: r for r in sharding.shard(df, F.col("h"), "doc_id", F.col("size"), 6, law).collect()}
    assert len(rounds) > 1
    order = sorted(rows, key=lambda x: (x[1], str(x[0])))
    total, at, slots = sum(x[2] for x in rows), 0, Counter()
    for rank, (i, _, size) in enumerate(order):
        want = rank * 6 // len(rows) if law == "rows" else min(5, (2 * at + size) * 6 // (2 * total))
        assert (got[i]["shard"], got[i]["slot"]) == (want, slots[want])
        slots[want] += 1
        at += size


def test_a_hot_key_is_divided(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(rows, F.xxhash64("text"), "doc_id", F.lit(1), 10, "rows").collect()
    assert [sum(r["shard"] == s for r in got) for s in range(10)] == [300] * 10
    place = {(r["shard"], r["slot"]): r["text"] for r in got}
    order = [place[k] for k in sorted(place)]
    first = order.index("same")
    assert order[first : first + 1000] == ["same"] * 1000  # equal texts stand together


# --- decontamination --------------------------------------------------------


def brute_tiles(d, p, k):
    free_d, free_p, out = [True] * len(d), [True] * len(p), []
    while True:
        best = []
        most = k - 1
        for a in range(len(d)):
            for b in range(len(p)):
                n = 0
                while a + n < len(d) and b + n < len(p) and d[a + n] == p[b + n] and free_d[a + n] and free_p[b + n]:
                    n += 1
                if n > most:
                    most, best = n, [(a, b)]
                elif n == most and n >= k:
                    best.append((a, b))
        if most < k:
            return out
        for a, b in sorted(best):
            if all(free_d[a : a + most]) and all(free_p[b : b + most]):
                free_d[a : a + most] = free_p[b : b + most] = [False] * most
                out.append((a, b, most))


def test_tiles_match_brute_force():
    r = random.Random(5)
    for _ in range(150):
        p = [r.randrange(4) for _ in range(r.randrange(3, 25))]
        d = [r.randrange(4) for _ in range(r.randrange(0, 20))] + p[len(p) // 2 :] + p[: len(p) // 2]
        k = r.randrange(2, 5)
        items = tiling.Items([(1, " ".join(f"w{x}" for x in p))], k)
        got = items.found(" ".join(f"w{x}" for x in d))
        want = brute_tiles(d, p, k)
        assert (got[0][2] if got else []) == want


def test_reordered_passage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    turned = "Zeta, eta theta iota kappa lambda mu! words between -- alpha beta gamma delta epsilon."
    d = spark.createDataFrame([(1, turned), (2, "alpha beta gamma delta and then other words follow")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in tiling.decontaminated(d, b).collect()}
    assert got[1]["contaminated"] and got[1]["coverage"] == 1.0 and len(got[1]["tiles"]) == 2
    assert not got[2]["contaminated"]


def test_benchmark_against_brute_force(spark, sf, docs, texts):
    """Coverage and contamination of all documents, with the benchmark broadcast and with its seeds shuffled."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: tiling.words_of(r["text"]) for r in bench.collect()}
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in items.items()}
    want = {}
    for i, t in texts.items():
        w = tiling.words_of(t)
        seeds = {}
        for j in range(len(w) - 4):
            seeds.setdefault(tuple(w[j : j + 5]), []).append(j)
        best = (0.0, None)
        for k in sorted(items):
            at = sorted({j + m for g in grams[k] & seeds.keys() for j in seeds[g] for m in range(5)})
            if at:
                near = [w[j] if j in at else object() for j in range(at[0], at[-1] + 1)]  # other words match nothing
                c = sum(x[2] for x in brute_tiles(near, items[k], 5)) / len(items[k])
                best = max(best, (c, k), key=lambda x: x[0])
        want[i] = best
    for most in (tiling.BLOCK_WORDS, 0):
        got = tiling.decontaminated(docs, bench, most_words=most).collect()
        assert {r["doc_id"]: (r["coverage"], r["item_id"]) for r in got} == want
        assert all(r["contaminated"] == (r["coverage"] >= 0.5) for r in got)
        assert all(sum(x["words"] for x in r["tiles"] if x["item_id"] == r["item_id"]) == round(r["coverage"] * len(items[r["item_id"]])) for r in got if r["contaminated"])
    assert sum(c >= 0.5 for c, _ in want.values()) > 0


def test_joins_of_seeds_agree(spark, odd, empty):
    bench = spark.createDataFrame([(3, "quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (None, "fox jumps over the lazy dog and goes home again"), (4, None), (5, "too short")], "item_id long, text string")
    rows = lambda most: sorted(map(str, tiling.decontaminated(odd, bench, most_words=most).select("doc_id", "contaminated", "coverage", "item_id", "tiles").collect()))
    assert rows(0) == rows(100_000) and any("contaminated=True" in x for x in rows(0))
    assert tiling.decontaminated(empty, bench, most_words=0).count() == 0


def test_repeated_words_need_little_memory():
    import tracemalloc

    items = tiling.Items([(1, "same " * 2000)], 5)
    tracemalloc.start()
    got = items.found("same " * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1.0, [(0, 0, 2000)])] and peak < 100 << 20


# --- near duplicates --------------------------------------------------------


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = ascii_words(t or "")
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= num * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard(docs, texts, k, num):
    comp, n = brute_components(texts, k, num, 100)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs, k, num, 100).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert {i: r["n_shingles"] for i, r in got.items()} == n


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_jaccard_of_large_groups(spark, monkeypatch, rounds):
    """Groups of near copies whose shingles are frequent, cut into blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 40)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    r = random.Random(9)
    rows, vocabulary = [], [f"v{i}" for i in range(3000)]
    for g in range(3):
        base = [r.choice(vocabulary) for _ in range((30, 120, 400)[g])]
        for _ in range(300 if g == 1 else 60):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(50)]
    comp, _ = brute_components(dict(rows), 4, 85, 100)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == comp


def test_jaccard_pairs_are_one_before_they_are_compared(spark, monkeypatch):
    """Texts that share a passage, and so many keys, but do not link: no join sees a pair once for each of its keys, and
    no pair is compared twice."""
    tables, keep = [], jaccard.written

    def written(df, name):
        table = keep(df, name)
        if name == "pairs":
            tables.append((df._jdf.queryExecution().optimizedPlan().toString(), [(r["key"], r["pivot"]) for r in table.collect()]))
        return table

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(jaccard, "ROUNDS", 3)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"v{r.randrange(9999)}" for _ in range(4)] + passage + [f"v{r.randrange(9999)}" for _ in range(4)])) for i in range(80)]
    rows += [(80 + i, " ".join([*rows[i][1].split()[:-1], f"z{i}"])) for i in range(20)]
    comp, _ = brute_components(dict(rows), 4, 85, 100)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == comp
    pairs = [p for _, found in tables for p in found]
    assert len(tables) > 1 and len(set(pairs)) == len(pairs)
    assert not any("Join LeftAnti" in plan for plan, _ in tables)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100}


# --- quality rules ----------------------------------------------------------


def test_line_counts(spark, sf, texts):
    for r in line_labels.op5_line_labels(spark, sf).collect():
        t = texts[r["doc_id"]]
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))
        assert tuple(r[c] for c in line_labels.COUNTS) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    field = line_labels.Field()
    field.t = r.normal(0, 1, (2, 2))
    n = np.array([1, 5, 3, 7, 2])
    e = r.normal(0, 1, n.sum())
    got = np.split(field.decode(e, n), np.cumsum(n)[:-1])
    for part, x in zip(got, np.split(e, np.cumsum(n)[:-1])):
        best = max(product((0, 1), repeat=len(x)), key=lambda s: sum(x[i] * s[i] for i in range(len(s))) + sum(field.t[a, b] for a, b in zip(s, s[1:])))
        assert tuple(part) == best


def test_labels_separate(spark):
    """Good documents of the held-out fold stay, and bad ones go, those too that the base rule lets pass."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in line_labels.labelled(docs, line_labels.fit(docs, labels)).collect()}
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good = [x["kept"] for q, x in held if q == 1 and not x["base_failed"]]
    bad = [x["kept"] for q, x in held if q == 0 and not x["base_failed"]]
    assert len(good) > 40 and bad and sum(good) >= 0.98 * len(good) and not any(bad)


def test_neighbourhoods_against_a_count(spark, docs):
    """Lines that stand between different lines in several documents, against a dictionary."""
    texts = [r["text"] or "" for r in docs.collect()] + [f"a{i} b\nthe same line\nc{i}\nonly here {i}" for i in range(7)] + ["x y\ntwice in copies\nz"] * 9
    places = {}
    for t in texts:
        lines = [tuple(x.split()) for x in t.split("\n")]
        for i, x in enumerate(lines):
            if 0 < len(x) <= line_labels.SHORT_LINE:
                places.setdefault(x, set()).add((lines[i - 1] if i else None, lines[i + 1] if i + 1 < len(lines) else None))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    one = {}
    for x in places:
        w = line_labels.Words([" ".join(x)], lower=False)
        one[x] = int(line_labels._line_hashes(w, np.zeros(len(x), np.int64), np.array([len(x)]))[0])
    found = set(line_labels._repeated_lines(d.repartition(5), np.array(list(one.values()), np.uint64)).tolist())
    # A blank line beside counts as none, as its hash is that of no words.
    plain = lambda p: {tuple(n or None for n in q) for q in p}
    assert found == {one[x] for x, p in places.items() if len(plain(p)) >= line_labels.NEIGHBOURHOODS}
    assert one["the", "same", "line"] in found and one["twice", "in", "copies"] not in found


def test_gradient_of_the_field():
    """Of the likelihood with open labels, against differences; and against a sum over all labellings."""
    from itertools import product

    r = np.random.default_rng(4)
    field = line_labels.Field()
    field.w, field.t = r.normal(0, 1, line_labels.FEATURES), r.normal(0, 1, (2, 2))
    n, weights = np.array([5, 3, 1]), np.array([0.7, 1.0, 2.0])
    active, words = r.integers(0, line_labels.FEATURES, (3, n.sum())), r.integers(0, 4, n.sum())
    slots = r.integers(0, line_labels.WORD_SLOTS, words.sum())
    y = np.array([1, -1, 0, -1, 1, 0, 0, -1, 1])
    value, g, gt, p = field.gradient(active, words, slots, y, n, weights)
    e, want, at = field.emissions(active, words, slots), 0.0, 0
    assert np.allclose(e, [sum(field.w[a[i]] for a in active) + sum(field.w[line_labels.FEATURES - line_labels.WORD_SLOTS + k] for k in part) / max(1, len(part)) for i, part in enumerate(np.split(slots, np.cumsum(words)[:-1]))])
    for m, weight in zip(n, weights):
        total = held = 0.0
        for s in product((0, 1), repeat=int(m)):
            p = math.exp(sum(e[at + i] * s[i] for i in range(m)) + sum(field.t[a, b] for a, b in zip(s, s[1:])))
            total += p
            held += p * all(y[at + i] in (-1, s[i]) for i in range(m))
        want, at = want + weight * math.log(held / total), at + m
    assert abs(value - want) < 1e-9
    for x, grad in [(field.w, g), (field.t.reshape(-1), gt.ravel())]:
        for i in [*r.integers(0, len(x), 8), *(active[0, :4] if len(x) > 4 else ()), *(line_labels.FEATURES - line_labels.WORD_SLOTS + slots[:4] if len(x) > 4 else ())]:
            x[i] += 1e-5
            up = field.gradient(active, words, slots, y, n, weights)[0]
            x[i] -= 2e-5
            down = field.gradient(active, words, slots, y, n, weights)[0]
            x[i] += 1e-5
            assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_planted_lines_are_marked(spark):
    """Boilerplate planted between the good lines of held-out documents: which lines are marked, and what is kept.
    Labels come from lines that the corpus repeats, so this wants a corpus of some size."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    field = line_labels.fit(docs, labels)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    r, rows, planted = random.Random(8), [], {}
    junk = ["All rights reserved.", "Licensed under the MIT License.", "BUY!! NOW!! BUY!! IT!! ALL!! TODAY!!", "home | about | contact | help", "## $$ %% words&&& and*** more$$$ of%%% them###"]
    junk += ["Share this page with your friends", "Subscribe to our newsletter for weekly updates", "Click here to read more", "Sign in or create an account"]  # of no document
    for i, t in texts.items():
        lines = [x for x in (t or "").split("\n") if x.strip()]
        if i not in good or zlib.crc32(str(i).encode()) % 5 or not 4 <= len(lines) <= 40:
            continue
        at = sorted(r.sample(range(len(lines) + 1), 2))
        new = [*lines[: at[0]], r.choice(junk), *lines[at[0] : at[1]], r.choice(junk), *lines[at[1] :]]
        rows.append((i, "\n".join(new)))
        planted[i] = {at[0], at[1] + 1}
    got = {x["doc_id"]: x for x in line_labels.labelled(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    hit = wrong = clean = mixed = 0
    for i, t in rows:
        content = set(got[i]["content_lines"])
        hit += len(planted[i] - content)
        own = set(range(len(t.split("\n")))) - planted[i]
        clean, wrong = clean + len(own), wrong + len(own - content)
        words = [len(x.split()) for x in t.split("\n")]
        share = sum(w for k, w in enumerate(words) if k in content) / sum(words)
        assert abs(got[i]["content_share"] - share) < 1e-9
        assert got[i]["kept"] == (share >= line_labels.CONTENT_SHARE and not got[i]["base_failed"])
        mixed += 0 < share < 1
    print("planted", hit / (2 * len(rows)), "good lines lost", wrong / clean, "mixed", mixed / len(rows), len(rows))
    assert len(rows) > 10 and hit >= 0.9 * 2 * len(rows) and wrong <= 0.15 * clean and mixed > 0.9 * len(rows)


# --- chat, token counts -----------------------------------------------------


def test_perspectives_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(c.sql(perspectives._SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in perspectives.op6_perspective_rotation(spark, sf).collect()), key=str) == want


def test_edit_counts_match_full_counts():
    c, r, bad = edit_counts.counter(), random.Random(1), 0
    source = "don't I'll we've  can 12 34a, b;\n\n  xé ü 漢字 !!?? a's   "
    for _ in range(300):
        t = "".join(r.choice(source) for _ in range(r.randint(0, 900)))
        tree = edit_counts.CountTree(t, c)
        for _ in range(4):
            s, n = r.randint(0, len(t) + 2), r.randint(0, 30) if r.random() < 0.95 else 500
            new = "".join(r.choice(source) for _ in range(r.randint(0, 20) if r.random() < 0.97 else 3000))
            tree.edit(s, n, new)
            s = min(s, len(t))
            t = t[:s] + new + t[min(len(t), s + n) :]
            bad += tree.text() != t or tree.total != len(c.encoding.encode_ordinary(t))
    assert not bad


def test_edit_counts_query(spark, sf, docs):
    got = {r["doc_id"]: r for r in edit_counts.op7_edit_counts(spark, sf).collect()}
    c = edit_counts.counter()
    for r in edit_counts.revisions(docs).collect():
        t = r["text"]
        assert got[r["doc_id"]]["n_tokens"] == len(c.encoding.encode_ordinary(t))
        for e in r["edits"]:
            t = t[: e["start"]] + e["inserted"] + t[e["start"] + e["removed"] :]
        assert got[r["doc_id"]]["n_tokens_edited"] == len(c.encoding.encode_ordinary(t))
        assert got[r["doc_id"]]["n_encoded_again"] < got[r["doc_id"]]["n_pieces"] + 60


# --- classifiers ------------------------------------------------------------


def test_machine_matches_pairwise_sum():
    m = quality.Machine()
    m.w = np.random.default_rng(1).normal(0, 1, quality.SLOTS).astype(np.float32)
    slots, x = quality.features("Some words, some OTHER words!\nand 12 more", 40)
    want = m.w0 + float(m.w[slots] @ x) + sum(float(m.v[a] @ m.v[b]) * float(xa * xb) for i, (a, xa) in enumerate(zip(slots, x)) for b, xb in zip(slots[i + 1 :], x[i + 1 :]))
    assert abs(m.raw(slots, x, np.array([0]))[0][0] - want) < 1e-3


def test_quality_on_held_out(spark, labels):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op8_factorisation_machine(spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    good = [r["score"] for r in rows if marks[r["doc_id"]] == 1]
    poor = [r["score"] for r in rows if marks[r["doc_id"]] == 0]
    assert sum(a > b for a in good for b in poor) >= 0.98 * len(good) * len(poor)


def test_language_on_held_out(spark, sf, docs):
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language.op9_byte_network(spark, sf).collect() if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_network_positions_and_pooling():
    """Every byte is labelled from its stretch and the bytes around it; a document's probabilities are the means."""
    n = language.Network(["a", "b", "c"])
    texts = ["h\u00e9llo world " * 30, "", "x", None, "y" * language.LABELLED, " ".join(f"w{i}" for i in range(400))]
    pooled, labelled, marks = n.label(texts, positions=True, rows=3)
    for t, p, votes, m in zip(texts, pooled, labelled, marks):
        raw = (t or "").encode()
        assert len(m) == len(raw) and votes.tolist() == [int((m == k).sum()) for k in range(3)]
        z = np.zeros((0, 3))
        for a in range(0, len(raw), language.LABELLED):
            around = b" " * language.WARM + raw + b" " * (language.LABELLED + language.WARM)
            got = n.logits(np.frombuffer(around[a : a + language.LABELLED + 2 * language.WARM], np.uint8)[:, None])[:, 0]
            z = np.concatenate([z, got[language.WARM : language.WARM + min(language.LABELLED, len(raw) - a)]])
        if raw:
            each = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            assert np.allclose(each.mean(0), p, atol=1e-5) and (z.argmax(1) == m).mean() > 0.99


def test_positions_of_a_document_in_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    parts = {x: next(r["text"] for r in docs.where(f"lang = '{x}' AND length(text) BETWEEN 800 AND 2000").orderBy("doc_id").collect()) for x in ("de", "en")}
    text = parts["de"][:600] + "\n" + parts["en"][:300]
    r = language.identified(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r["lang_pred"] == "de" and r["positions"]["de"] > r["positions"]["en"] > 100
    assert sum(r["positions"].values()) == len(text.encode())


def test_network_gradient():
    r = np.random.default_rng(0)
    n = language.Network(["a", "b"])
    x, y = r.integers(97, 105, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        z = n.logits(x)
        return -(z - np.log(np.exp(z).sum(-1, keepdims=True)))[:, np.arange(4), y].mean()

    keep = []
    z = n.logits(x, keep)
    p = np.exp(z) / np.exp(z).sum(-1, keepdims=True)
    p[:, np.arange(4), y] -= 1
    p /= 24
    (kf, kb), _, _ = keep
    grads = [n.sides[0].backward(x, kf, p @ n.out[: language.HIDDEN].T), n.sides[1].backward(x[::-1], kb, (p @ n.out[language.HIDDEN :].T)[::-1])]
    for side, g in zip(n.sides, grads):
        for name, own in zip(language.Direction.NAMES, g):
            w = getattr(side, name)
            at = np.unravel_index(np.abs(own).argmax(), own.shape)
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - own[at]) < 0.05 * abs(own[at]) + 1e-4, name


# --- packing ----------------------------------------------------------------


def test_packing_round_trip(spark, sf, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(docs).collect()
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in texts.items()}
    end, taken = {}, Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
        taken[r["doc_id"]] += r["length"]
    assert taken == {i: len(x) for i, x in ids.items()}
    last = max(end)
    assert sorted(end) == list(range(last + 1)) and all(n == 4096 for s, n in end.items() if s != last)
    whole = packing.sequences(packing.pack(docs)).collect()
    assert all(len(r["ids"]) == 4 * 4096 for r in whole) and sum(r["n_tokens"] for r in whole) == sum(taken.values())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_packs_whole_texts(spark, docs, texts, name):
    """A vocabulary in which spaces belong to tokens has its texts encoded whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    assert packing._parts_at_spaces(tok) == (name == "word_bpe_49k.json")
    pieces = packing.pack(docs, path).collect()
    got = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in texts.items()}


def test_words_encode_as_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    encode, kind = packing.encoder(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "The <|ENDOFTEXT|> END", "ÀÉ ΣΑΣ. Straße", "a|b | c||", "x y  ́z é é İ ß", "don't  12 3.4\n\tend", "  a b", ""]
    for t, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, kind).tolist() == tok.encode(t, add_special_tokens=False).ids


# --- all --------------------------------------------------------------------


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf, docs, texts):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in pieces}
    leaked = {r["doc_id"] for r in tiling.op3_string_tiling(spark, sf).collect() if r["contaminated"]}
    assert kept and not kept & leaked
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scored(docs, model).collect() if r["score"] >= quality.THRESHOLD}
    assert kept <= good
    comp, _ = brute_components({i: texts[i] for i in kept}, 5, 80, 100)
    assert all(i == c for i, c in comp.items())  # no two that stay are near duplicates


def test_each_stage_of_the_pipeline(spark, sf, docs, texts):
    """Each stage by itself, on what a small table gives it: what stays, and that columns stay."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: [r["doc_id"] for r in d.collect()]
    own = docs.withColumn("_row", F.lit("own")).withColumn("score", F.lit(-1.0)).where("doc_id % 2 = 0")
    held = set(ids(own))
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, sf)
        assert out.columns == own.columns, name
        rows = out.collect()
        assert all(r["_row"] == "own" and r["score"] == -1.0 for r in rows), name
        got[name] = sorted(r["doc_id"] for r in rows)
    model = quality.fit(own, spark.read.parquet(f"{sf}/labels.parquet"))
    assert got["quality classifier"] == sorted(r["doc_id"] for r in quality.scored(docs.where("doc_id % 2 = 0"), model).collect() if r["score"] >= quality.THRESHOLD)
    net, low = language.fit(own), []
    for i in held:
        p = net.label([texts[i]])[0][0]
        if language._LETTER.search(texts[i] or "") and p.max() >= corpus_pipeline.LEAST_LANGUAGE:
            low.append(i)
    assert got["language ID"] == sorted(low)
    comp, _ = brute_components({i: texts[i] for i in held}, 5, 80, 100)
    assert Counter(comp[i] for i in got["n-gram Jaccard join"]) == Counter(set(comp.values()))
    leaked = {r["doc_id"] for r in tiling.op3_string_tiling(spark, sf).collect() if r["contaminated"]}  # equal to brute force above
    assert got["benchmark decontamination"] == sorted(held - leaked)
    packed = stages["packing"](spark, own, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(held)


def test_results_do_not_depend_on_splits(spark, sf, docs):
    """Tables that are split otherwise when they are read again: the same documents stay, with the same scores."""
    import corpus_pipeline

    import tempfile

    at = tempfile.mkdtemp(prefix="spark-") + "/documents.parquet"
    docs.repartition(7).write.parquet(at)
    sizes = itertools.cycle(["32k", "128m", "100k"])
    read = spark.read.parquet(at)
    written = language_model.written

    def other_splits(df, name="table"):
        out = written(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    try:
        found = []
        for patched in (written, other_splits):
            for module in (language_model, jaccard, corpus_pipeline):
                module.written = patched
            scores = {r["doc_id"]: round(r["score"], 6) for r in language_model.scored(read, fold("doc_id", 5) != 1, 50, 30_000).collect()}
            found.append((sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, read, sf).collect()), scores))
        assert len(found[0][0]) == len(found[1][0]) > 100
        assert found[0][1].keys() == found[1][1].keys()
        assert all(abs(v - found[1][1][i]) < 1e-3 * (1 + abs(v)) for i, v in found[0][1].items())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for module in (language_model, jaccard, corpus_pipeline):
            module.written = written


def test_least_hashes_of_a_hot_class(spark):
    """One class of most rows over many partitions, ids that repeat, and a class below the bound."""
    rows = spark.range(0, 6000, numPartitions=40).select((F.col("id") % 5000).alias("_id"), F.when(F.col("id") % 500 == 0, "rare").otherwise("hot").alias("c"))
    got = sorted((r["c"], r["_id"]) for r in least_hashes(rows, "c", 300).collect())
    want = []
    for c in ("hot", "rare"):
        own = rows.where(F.col("c") == c).select("_id", F.xxhash64("_id").alias("h")).collect()
        want += [(c, r["_id"]) for r in sorted(own, key=lambda r: (r["h"], r["_id"]))[:300]]
    assert got == sorted(want)
