"""Sharding by sampled splitters, with DataFrame functions only.

Records lie in the order of a key (a hash of the text, then the id, then a tie number). A size-weighted sample of
the keys gives quantile boundaries, and records are dealt to ranges by them. Exact counts and bytes of each range
follow; ranges that hold too much are subdivided with boundaries from a denser sample of their own. Prefix sums
over the ranges and running sums inside them place each record in the whole order, and a shard is an equal share
of that order, in bytes or in rows. Equal texts stand together; a group larger than a shard spans several.

The ranges are at most MOST_RANGES, whatever the rows (a range is sorted by a task, which spills), so samples,
boundaries and sums by range are of a bounded size on the driver, and boundaries travel as one constant array. Ranges
are subdivided until none is overfull, but for what has no boundary inside: a single record.

Null texts have size 1 (no bytes, plus 1); a null id sorts first; repeated rows are placed as often as they come;
an empty table gives no rows; columns of the input keep their values, and the added ones (shard, slot) replace any
of the same name.
"""

from __future__ import annotations

import bisect
import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Rows that a range should hold, ranges at most, ranges at least for a shard, sampled keys for a range.
RANGE_ROWS = 200_000
MOST_RANGES = 4096
RANGES_A_SHARD = 8
SAMPLES_A_RANGE = 32
#: A range above so many times the mean of bytes or rows is subdivided.
OVERFULL = 2.0

_KEY = "struct<h:bigint,id:string,tie:bigint>"


def _constant(keys: list) -> Column:
    """Keys as one array, which the optimiser folds into a single literal."""
    return F.from_json(F.lit(json.dumps([dict(zip(("h", "id", "tie"), k)) for k in keys])), f"array<{_KEY}>")


def _range_of(key: Column, splitters: list) -> Column:
    """How many splitters are at or below the key: a search in two levels."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    rows, heads = (_constant(x) for x in (splitters, splitters[::step]))
    block = F.size(F.filter(heads, lambda s: s <= key))
    inside = F.size(F.filter(F.slice(rows, (block - 1) * step + 1, F.lit(step)), lambda s: s <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def _quantiles(sample: DataFrame, weight: Column, parts: int) -> list:
    """Keys that cut the sample's weight into equal parts. The sample's size is bounded by its rate."""
    rows = sample.select("_key", weight.alias("w")).orderBy("_key").collect()
    total, seen, cuts, k = sum(r["w"] for r in rows), 0.0, [], 1
    for r in rows:
        while k < parts and seen >= total * k / parts:
            cuts.append(tuple(r["_key"]))
            k += 1
        seen += r["w"]
    return list(dict.fromkeys(cuts))


def _drawn(keyed: DataFrame, rate: float, seed: int) -> tuple[DataFrame, Column]:
    """Rows with a chance in proportion to their size, and the weight that each stands for."""
    u = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return keyed.where(u < F.col("_size") * rate), F.greatest(F.col("_size").cast("double"), F.lit(1.0 / rate))


def _stats(keyed: DataFrame, splitters: list) -> dict[int, tuple[int, int]]:
    rows = keyed.groupBy(_range_of(F.col("_key"), splitters).alias("r")).agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect()
    return {r["r"]: (r["n"], r["b"]) for r in rows}


def shard(df: DataFrame, key: Column, id_col: str, size: Column, n_shards: int = 16, law: str = "bytes") -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless in a shard). law 'bytes': sizes near equal, no shard is off
    by more than its largest record; law 'rows': counts at most one apart."""
    own = [c for c in df.columns if c not in ("shard", "slot")]
    tie = F.monotonically_increasing_id()
    # The tie number is drawn once: the table is written, and every pass reads the same keys.
    keyed = written(
        df.select(F.struct(*own).alias("_row"), F.struct(key.cast("bigint").alias("h"), F.col(id_col).cast("string").alias("id"), tie.alias("tie")).cast(_KEY).alias("_key"), F.coalesce(size, F.lit(1)).cast("bigint").alias("_size")),
        "keyed",
    )
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    ranges = max(n_shards * RANGES_A_SHARD, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    splitters: list = []
    if rows:
        splitters = _quantiles(*_drawn(keyed, SAMPLES_A_RANGE * ranges / max(1, total), 1), ranges)
    stats = _stats(keyed, splitters)
    for again in itertools.count(2):
        most_n, most_b = OVERFULL * rows / ranges, OVERFULL * total / ranges
        over = {r: max(n / most_n, b / most_b) for r, (n, b) in stats.items() if n > 1 and (n > most_n or b > most_b)}
        if not over:
            break  # at the latest when every record has a range
        inner = keyed.withColumn("_r", _range_of(F.col("_key"), splitters)).where(F.col("_r").isin(list(over)))
        parts = -(-sum(over.values()) // 1) * 2
        held = sum(stats[r][1] for r in over)
        more = _quantiles(*_drawn(inner, SAMPLES_A_RANGE * parts / held, again), int(parts))
        fresh = sorted({*splitters, *more}, key=_order)
        if len(fresh) == len(splitters):
            break  # nothing to cut at, as inside a record
        splitters = fresh
        stats = _stats(keyed, splitters)
    base_n = base_b = 0
    bases = []
    for r, (n, b) in sorted(stats.items()):
        bases.append((r, base_n, base_b))
        base_n, base_b = base_n + n, base_b + b
    # A row for each range: their number is the parameter above.
    rows_of = F.from_json(F.lit(json.dumps([dict(zip(("_r", "_base_n", "_base_b"), b)) for b in bases])), "array<struct<_r:int,_base_n:bigint,_base_b:bigint>>")
    table = F.broadcast(df.sparkSession.range(1).select(F.inline(rows_of)))
    order = Window.partitionBy("_r").orderBy("_key")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("_r", _range_of(F.col("_key"), splitters))
        .join(table, "_r")
        .withColumn("_rank", F.col("_base_n") + F.row_number().over(order) - 1)
        .withColumn("_at", F.col("_base_b") + F.sum("_size").over(run) - F.col("_size"))
    )
    if law == "rows":
        share = F.expr(f"_rank * {n_shards} div {max(1, rows)}")
    else:  # the shard in which the middle of the record lies
        share = F.expr(f"least((2 * _at + _size) * {n_shards} div {2 * max(1, total)}, {n_shards - 1})")
    placed = placed.withColumn("shard", share.cast("int"))
    # Only ranges in which a shard begins, and the next ones, can hold a shard's first record.
    whole, at = (rows, 1) if law == "rows" else (total, 2)
    starts = sorted(b[at] for b in bases)
    near = {min(i + k, len(bases) - 1) for s in range(n_shards) for i in [max(0, bisect.bisect_right(starts, s * whole // n_shards) - 1)] for k in (0, 1)} if bases else set()
    opening = placed.where(F.col("_r").isin([bases[i][0] for i in sorted(near)]))
    first = F.broadcast(opening.groupBy("shard").agg(F.min("_rank").alias("_first")))  # a row for each shard
    return placed.join(first, "shard").select("_row.*", "shard", (F.col("_rank") - F.col("_first")).cast("bigint").alias("slot"))


def _order(k: tuple) -> tuple:
    """Spark's order of the key: nulls first."""
    return tuple((x is not None, x) if x is not None else (False, 0 if i != 1 else "") for i, x in enumerate(k))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order in each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    out = shard(docs, F.col("h"), "doc_id", F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sampled_splitters": op2_sampled_splitters}
ORACLE_SQL: dict[str, str] = {}
