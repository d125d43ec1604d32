"""Running measures of contours over a stream of their points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_moments(points: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, contour_id, n, mean, sd of points (contour_id, ts, y) by event time; what is later than `late` goes."""
    p = points.withWatermark("ts", late)
    return p.groupBy(F.window("ts", length), "contour_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))


def running_lengths(points: DataFrame) -> DataFrame:
    """contour_id, steps, length after each batch: the state of a contour is its last point and its sums. Points of a
    batch are taken in the order of ts, then event_id; earlier batches come first."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, steps, length = state.get if state.exists else (None, 0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for y in rows["y"]:
            if last is not None:
                length += (1.0 + (y - last) ** 2) ** 0.5
                steps += 1
            last = float(y)
        state.update((last, steps, length))
        yield pd.DataFrame({"contour_id": [key[0]], "steps": [steps], "length": [length]})

    return points.groupBy("contour_id").applyInPandasWithState(run, "contour_id long, steps long, length double", "last double, steps long, length double", "update", GroupStateTimeout.NoTimeout)
