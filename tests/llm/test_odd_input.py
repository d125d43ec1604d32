"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: each operator's defined result."""

import pytest
from pyspark.sql import functions as F

from pointloom.llm import edit_counts, jaccard, language, language_model, line_labels, packing, perspectives, quality, sharding, tiling
from pointloom.llm.common import fold

N = 12


def size_of():
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1


OPERATORS = {
    "language_model": lambda d: language_model.scored(d, fold("doc_id", 5) != 1),
    "sharding": lambda d: sharding.shard(d, F.xxhash64("text"), "doc_id", size_of(), 4),
    "tiling": lambda d: tiling.decontaminated(d, d.select(F.col("doc_id").alias("item_id"), "text", "source")),
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "line_labels": lambda d: line_labels.labelled(d, line_labels.Field()),
    "edit_counts": lambda d: edit_counts.recounted(edit_counts.revisions(d)),
    "quality": lambda d: quality.scored(d, quality.Machine()),
    "quality_unlearned": lambda d: quality.scored(d, None),
    "language": lambda d: language.identified(d, language.Network(["de", "en"])),
    "language_unlearned": lambda d: language.identified(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd, empty):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == N
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    twins = [r.asDict() for r in rows if r["doc_id"] == 1]
    for column in set(twins[0]) - {"slot", "shard", "first"}:
        assert twins[0][column] == twins[1][column], column
    assert OPERATORS[name](empty).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_model(odd):
    got = by_id(language_model.scored(odd, fold("doc_id", 5) != 1))
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == got[5]["n_tokens"] == 1
    assert got[7]["n_tokens"] == 3 and got[6]["n_tokens"] == 60_001
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in got.values())


def test_language_model_without_training(odd):
    got = language_model.scored(odd, F.lit(False)).collect()
    assert len(got) == N and all(r["train_tokens"] == r["n_known"] == 0 and abs(r["score"] - r["base_score"]) < 1e-6 for r in got)


def test_sharding(odd):
    got = sharding.shard(odd, F.xxhash64("text"), "doc_id", size_of(), 4, "rows").collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert counts == [3, 3, 3, 3]
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(3)]
    assert {r["score"] for r in got} == {"own"}


def test_jaccard(odd):
    got = by_id(jaccard.jaccard_components(odd))
    assert got[1]["component_id"] == got[2]["component_id"] == 1
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == got[5]["n_shingles"] == 0
    assert got[7]["n_shingles"] == 1 and got[7]["component_id"] == 7
    rows = jaccard.jaccard_components(odd).collect()
    assert sum(r["first"] for r in rows if r["component_id"] == 1) == 1


def test_line_labels(odd):
    got = by_id(line_labels.labelled(odd, line_labels.Field()))
    assert got[3]["n_words"] == got[5]["n_words"] == 0 and not got[3]["kept"] and not got[5]["kept"]
    assert got[8]["n_symbols"] == 7 and got[9]["n_words"] == 4  # only ASCII space parts words
    assert got[1]["score"] == "own"


def test_line_labels_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert (line_labels.fit(odd, none).w == 0).all()


def test_quality_without_labels(odd, spark):
    assert quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, nulls) is None
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {0.5}


def test_quality_of_one_class(odd, spark):
    some = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd, quality.fit(odd, some)).collect()
    assert all(0.5 < r["score"] <= 1 for r in got)


def test_language_of_nothing(odd, empty):
    got = by_id(language.identified(odd, language.Network(["de", "en"])))
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[3]["score"] == 0
    assert got[9]["lang_pred"] in ("de", "en")
    assert language.fit(empty) is None


def test_packing(odd, empty):
    got = packing.pack(odd).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1
    whole = [r for r in got if r["doc_id"] == 6]
    assert sum(r["length"] for r in whole) == whole[0]["doc_tokens"] and len(whole) > 30
    assert sum(r["doc_id"] == 1 and r["start"] == 0 for r in got) == 2
    assert packing.pack(empty).count() == 0
    assert packing.sequences(packing.pack(empty)).count() == 0


def test_tiling_nulls(odd, spark):
    bench = spark.createDataFrame([(None, "the lazy dog and goes home again"), (2, None), (3, "one two"), (4, "")], "item_id long, text string")
    got = by_id(tiling.decontaminated(odd, bench))
    assert got[1]["contaminated"] and got[1]["item_id"] is None and got[1]["tiles"][0]["words"] == 7
    assert not got[7]["contaminated"] and not got[3]["contaminated"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in tiling.decontaminated(odd, none).collect())


def test_edit_counts_nulls(spark):
    rows = [(1, "some text here", None), (2, None, [(0, 5, "new words")]), (None, "abc def", [None, (99, 99, None), (-5, 2, "x")])]
    d = spark.createDataFrame(rows, f"doc_id long, text string, edits {edit_counts.EDITS}")
    got = {r["doc_id"]: r for r in edit_counts.recounted(d).collect()}
    assert got[1]["n_tokens"] == got[1]["n_tokens_edited"] == 3 and got[1]["n_edits"] == 0
    assert got[2]["n_tokens"] == 0 and got[2]["n_chars_edited"] == 9
    assert got[None]["n_chars_edited"] == 6


def test_perspectives_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, None, "bot", "b"), (None, 0, "user", "c"), (2, 0, "system", "s"), (3, None, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS speaker", "2 AS start", "3 AS block")
    got = perspectives.rotated(d).collect()
    one = [r for r in got if r["conv_id"] == 1]
    assert {r["perspective"] for r in one} == {"user", "unknown", "bot"} and len(one) == 12
    assert not [r for r in got if r["conv_id"] == 2] and len([r for r in got if r["conv_id"] is None]) == 1
    whole = {(r["conv_id"], r["perspective"]): r for r in perspectives.dialogues(perspectives.rotated(d)).collect()}
    text = whole[1, "user"]["text"]
    assert text.startswith("<|user|> bot:\nb<|end|>\n<|assistant|>\na<|end|>\n<|assistant|>\na<|end|>\n<|user|> unknown:\n<|end|>\n")
    assert [text[s["start"] : s["end"]] for s in whole[1, "user"]["learned"]] == ["a<|end|>\n"] * 2
    assert perspectives.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
