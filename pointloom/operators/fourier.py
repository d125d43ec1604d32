"""Fourier transforms of rasters: one task for a row, one shuffle that transposes, one task for a column. No task holds
the raster. Rasters are padded with zeros to powers of two; the forward transform has the positive exponent, and the
inverse is divided by the number of cells (fixed conventions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _lines(cells: DataFrame, along: str, across: str, size: int, inverse: bool) -> DataFrame:
    """Transforms along one axis; a line without cells stays without."""

    def run(batch):
        import numpy as np
        import pyarrow as pa

        at = batch.column(along).to_numpy()
        z = np.zeros(size, complex)
        np.add.at(z, at, batch.column("re").to_numpy() + 1j * batch.column("im").to_numpy())
        z = np.fft.fft(z) / size if inverse else np.fft.ifft(z) * size
        return pa.table({along: pa.array(np.arange(size)), across: pa.array(np.full(size, batch.column(across)[0].as_py())), "re": pa.array(z.real), "im": pa.array(z.imag)})

    return cells.groupBy(across).applyInArrow(run, f"{along} long, {across} long, re double, im double")


def transformed(cells: DataFrame, width: int, height: int, inverse: bool = False) -> DataFrame:
    """x, y, re, im of the transform of cells (x, y, re, im); missing cells are zero."""
    wide, high = power_of_two(width), power_of_two(height)
    c = cells.select(*[F.col(k).cast("long").alias(k) for k in ("x", "y")], *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in ("re", "im")])
    rows = _lines(c.where(f"x >= 0 AND x < {width} AND y >= 0 AND y < {height}"), "x", "y", wide, inverse)
    return _lines(rows, "y", "x", high, inverse).select("x", "y", "re", "im")


def frequency(c: str, size: int) -> Column:
    """Signed frequency of a place on an axis."""
    return F.when(F.col(c) > size // 2, F.col(c) - size).otherwise(F.col(c))


def fan(spectrum: DataFrame, wide: int, high: int, bands: int) -> DataFrame:
    """spectrum with band: which fan of directions (0 to bands - 1, about 0, pi/bands, ...) a frequency lies in; null for
    the mean. Opposite frequencies are in one fan, so that each fan's share of a real raster is real, but for the
    frequencies at half the sampling rate, which are their own opposites in one axis only."""
    import math

    fx, fy = frequency("x", wide), frequency("y", high)
    flip = (fy < 0) | ((fy == 0) & (fx < 0))
    angle = F.atan2(F.when(flip, -fy).otherwise(fy).cast("double"), F.when(flip, -fx).otherwise(fx).cast("double"))
    k = F.pmod(F.floor(angle * bands / math.pi + 0.5), F.lit(bands)).cast("int")
    return spectrum.withColumn("band", F.when((fx != 0) | (fy != 0), k))
