"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import jaccard, language, packing, quality, tiling
from pointloom.llm.common import documents, written

#: A document goes if its language is undetermined or less likely than this.
LEAST_LANGUAGE = 0.4
#: What the operators read of documents, when they are trained and when they score.
READ = ("doc_id", "text", "lang", "n_chars")


def _filtered(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs whose results keep; columns that no operator reads stand aside while it runs, as they may be
    named like its results."""
    aside = {c: f"own_{n}_{c}" for n, c in enumerate(docs.columns) if c not in READ}
    found = operator(docs.withColumnsRenamed(aside)).where(keep)
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, documents(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: quality.scored(d, model), F.col("score") >= quality.THRESHOLD)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones have."""
    model = language.fit(docs)
    return _filtered(docs, lambda d: language.identified(d, model), (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8). Rows have numbers here, so that repeated rows
    and ids count as documents of their own; they are written once, so that every reading sees the same numbers."""
    keyed = written(docs.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")), "numbered")
    groups = jaccard.jaccard_components(keyed.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text")), 5, 80, 100)
    return keyed.join(groups.where("first").select(F.col("doc_id").alias("row")), "row", "left_semi").select("own.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return _filtered(docs, lambda d: tiling.decontaminated(d, documents(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("language ID", in_a_language),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", clean),
    ("packing", packed),
]

#: No stage but the last could be SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
