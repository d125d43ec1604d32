"""What must hold where ids, numbers or texts repeat in bulk: bounded samples, one order of results, no Python workers."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pointloom.llm import edit_counts, language, line_labels, perspectives, quality, sharding, tiling
from pointloom.llm.common import TRAINING_CHARS, drawn, labelled_sample



def test_both_forms_of_tiling_order_tiles_alike(spark):
    items = [(5, "one two three four five six seven eight nine ten"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "red green blue white black brown pink grey gold teal"), (2, "one two three four five six seven eight nine ten")]
    text = "; ".join([items[1][1], items[0][1], items[2][1]]).replace(";", "")
    docs = spark.createDataFrame([(1, text), (2, "nothing of this"), (3, items[2][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [sorted((tuple(r) for r in tiling.decontaminated(docs, bench, most_words=m).collect()), key=str) for m in (1 << 30, 0)]
    assert found[0] == found[1]
    tiles = next(r for r in found[0] if r[0] == 1)[-1]
    assert [t["item_id"] for t in tiles] == [2, 5, 5, None] and len({t["doc_word"] for t in tiles}) == 3


@pytest.mark.parametrize("ids", ["7L", "cast(null as long)", "id"])
def test_samples_are_bounded_in_rows(spark, ids):
    rows = spark.range(0, 20_000, numPartitions=16).selectExpr(f"{ids} AS doc_id", "concat('text ', id % 9000) AS text", "if(id % 10 = 0, 'rare', 'hot') AS lang")
    got = drawn(rows, "lang", 40).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"rare": 40, "hot": 40}
    equal = rows.withColumn("text", F.lit("the same"))
    assert {r["count"] for r in drawn(equal, "lang", 40).groupBy("lang").count().collect()} == {40}
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    sample, counts = labelled_sample(rows.drop("lang"), labels, "quality", 40, 5, 4)
    assert sample.count() == (40 if ids == "7L" else 2 if ids == "id" else 0) and counts == {0: 1, 1: 1}


def test_training_holds_a_bounded_part_of_a_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000, "en"), (2, "kurz", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["n"] for r in drawn(docs, "lang", 4).select("doc_id", F.length("text").alias("n")).collect()}
    assert got == {1: TRAINING_CHARS, 2: 4}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, 4) is not None and line_labels.fit(docs, labels, 4) is not None and language.fit(docs, 4).langs == ["de", "en"]


def test_shards_are_made_without_python_workers(spark, sf, docs):
    keyed = docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    plan = sharding.shard(keyed, F.col("h"), "doc_id", F.col("size"))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan
    assert sharding.shard(keyed.limit(0), F.col("h"), "doc_id", F.col("size")).count() == 0


def test_perspectives_of_bulk(spark, tmp_path):
    """Rows without a conversation, a conversation of equal turn numbers, a very long one."""
    dice = random.Random(3)
    rows = [(None, t % 3, dice.choice(["user", "bot", "system", None]), f"lone {t}") for t in range(500)]
    rows += [(1, dice.choice([4, None]), dice.choice(["user", "bot", "system"]), f"t{dice.randrange(40)}") for _ in range(900)]
    rows += [(2, t, ("user", "bot")[t % 2], "x" * (t % 7)) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = perspectives.rotated(df.repartition(5))
    want = duck.sql(perspectives.ORACLE_SQL["op6_perspective_rotation"])
    assert got.columns == want.columns
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    alone = [r for r in rows if r[0] is None]
    assert len(alone) == sum(r[0] is None and r[2] != "system" for r in df.collect()) and all(r[1] == r[3] and r[5] == 0 for r in alone)


def test_an_edit_encodes_what_it_touches():
    """The pre-tokens encoded again are those of the inserted text, and a few at its ends, however long the text is."""
    dice = random.Random(9)
    counter = edit_counts.counter()
    text = " ".join(dice.choice(["word", "don't", "12345", "naïve", "x;y", "\n\n", "end."]) for _ in range(20_000))
    tree = edit_counts.CountTree(text, counter)
    for size in (0, 1, 5, 40, 400):
        for _ in range(20):
            new = "".join(dice.choice("ab c1.'\n") for _ in range(size))
            at, before = dice.randrange(len(text)), tree.encoded
            tree.edit(at, size // 2, new)
            text = text[:at] + new + text[at + size // 2 :]
            assert tree.encoded - before <= len(counter.cut(new)) + 8
    assert tree.text() == text and tree.total == len(counter.encoding.encode_ordinary(text))


def test_the_pipeline_scores_quality_as_the_operator_does(spark):
    """On a table where a score without n_chars would give other verdicts."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = lambda d: {r["doc_id"] for r in quality.scored(d, model).collect() if r["score"] >= quality.THRESHOLD}
    assert good(docs) != good(docs.drop("n_chars"))
    assert {r["doc_id"] for r in corpus_pipeline.good(spark, docs, sf).collect()} == good(docs)
