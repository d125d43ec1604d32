"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant, the others
as named users and system turns as they are. The result is a row for each turn of each rendering: its text, its place
in the rendered dialogue, and the part of it that is learned (the assistant's words and the end mark). Whole dialogues
are these rows put together (`dialogues`). Places are prefix sums in two levels: turns are range-partitioned by their
order, and sums run over the parts of a conversation and inside them, so that neither a very long conversation nor one
with many equal turn numbers is a single task's.

Turns are in the order of turn (null first), role, text; equal rows are turns of their own, and interchangeable. A null
role is the participant `unknown`, a null text is empty. Each row with a null conv_id is a conversation of its own, of
one turn: its speaker's. A conversation of system turns alone has no participant and no rendering; a very long text is
one turn; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

SYSTEM = "system"
UNKNOWN = "unknown"
#: Marks of the rendering (fixed values).
ASSISTANT_HEAD, SYSTEM_HEAD, END = "<|assistant|>\n", "<|system|>\n", "<|end|>\n"
USER_HEAD, USER_HEAD_END = "<|user|> ", ":\n"


def _head(speaker: Column, perspective: Column) -> Column:
    user = F.concat(F.lit(USER_HEAD), speaker, F.lit(USER_HEAD_END))
    return F.when(speaker == SYSTEM, SYSTEM_HEAD).when(speaker == perspective, ASSISTANT_HEAD).otherwise(user)


def rotated(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, start, learned, learned_start, learned_end (characters)."""
    t = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = t.where(F.col("conv_id").isNotNull())
    # The part that a turn is dealt to is its block; written, so that every reading sees the same parts.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text"), F.monotonically_increasing_id()]
    blocks_of = written(whole.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "turns")
    return _together(blocks_of).unionByName(_alone(t.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM))))


def _alone(t: DataFrame) -> DataFrame:
    """Turns that are conversations of their own, by their speakers."""
    size = F.length("text") + len(ASSISTANT_HEAD) + len(END)
    return t.select(
        "conv_id", F.col("speaker").alias("perspective"), "turn", "speaker", F.concat(F.lit(ASSISTANT_HEAD), "text", F.lit(END)).alias("rendered"), F.lit(0).cast("long").alias("start"),
        F.lit(True).alias("learned"), F.lit(len(ASSISTANT_HEAD)).cast("long").alias("learned_start"), size.cast("long").alias("learned_end"),
    )


def _together(t: DataFrame) -> DataFrame:
    people = t.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = t.join(people, F.col("conv_id") == F.col("c")).drop("c")
    rows = rows.withColumn("head", _head(F.col("speaker"), F.col("perspective")))
    rows = rows.withColumn("size", (F.length("head") + F.length("text") + len(END)).cast("long"))
    # First level: where each block begins.
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    # Second level: the turns of a block.
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(blocks, (F.col("conv_id") == F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start, learned = F.col("base") + F.col("inner"), (F.col("speaker") == F.col("perspective"))
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.concat("head", "text", F.lit(END)).alias("rendered"),
        start.alias("start"),
        learned.alias("learned"),
        F.when(learned, start + F.length("head")).alias("learned_start"),
        F.when(learned, start + F.col("size")).alias("learned_end"),
    )


def dialogues(rows: DataFrame) -> DataFrame:
    """Whole renderings: conv_id, perspective, text, learned (array of start and end). For conversations that fit a row."""
    return rows.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("start", "rendered", "learned_start", "learned_end"))).alias("t")).select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"),
        F.transform(F.filter("t", lambda x: x["learned_start"].isNotNull()), lambda x: F.struct(x["learned_start"].alias("start"), x["learned_end"].alias("end"))).alias("learned"),
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(documents(spark, sf_dir, "conversations"))


_SQL = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), rows AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10)
         WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user|> ' || speaker || ':' || chr(10) END AS head
  FROM t JOIN people ON t.conv_id = people.c
), placed AS (
  SELECT *, CAST(length(head) + length(text) + 8 AS BIGINT) AS size,
    CAST(coalesce(sum(length(head) + length(text) + 8) OVER (
      PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rows
)
SELECT conv_id, perspective, turn, speaker, head || text || '<|end|>' || chr(10) AS rendered, start,
  speaker = perspective AS learned,
  CASE WHEN speaker = perspective THEN start + length(head) END AS learned_start,
  CASE WHEN speaker = perspective THEN start + size END AS learned_end
FROM placed
UNION ALL
SELECT conv_id, speaker, turn, speaker, '<|assistant|>' || chr(10) || text || '<|end|>' || chr(10), 0, true, 14, CAST(14 + length(text) + 8 AS BIGINT)
FROM t WHERE conv_id IS NULL AND speaker <> 'system'
"""

QUERIES = {"op6_perspective_rotation": op6_perspective_rotation}
ORACLE_SQL = {"op6_perspective_rotation": _SQL}
