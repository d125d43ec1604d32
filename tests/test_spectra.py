"""Transforms against numpy, projections by their invariants, images by round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.jobs import spectra
from pointloom.operators import fourier
from pointloom.sources import fixtures, io


def grid(frame, high, wide):
    out = np.zeros((high, wide), complex)
    for r in frame.collect():
        out[r["y"], r["x"]] += r["re"] + 1j * r["im"]
    return out


def test_transform_and_its_inverse(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(11, 6)) + 1j * rng.normal(size=(11, 6))
    a[4] = 0
    rows = [(int(x), int(y), float(a[y, x].real), float(a[y, x].imag)) for y, x in zip(*np.nonzero(a))]
    cells = spark.createDataFrame(rows, "x int, y int, re double, im double")
    s = fourier.transformed(cells, 6, 11)
    padded = np.zeros((16, 8), complex)
    padded[:11, :6] = a
    assert np.allclose(grid(s, 16, 8), np.conj(np.fft.fft2(np.conj(padded))), atol=1e-9)
    assert np.allclose(grid(fourier.transformed(s, 8, 16, inverse=True), 16, 8), padded, atol=1e-9)
    assert fourier.transformed(cells.limit(0), 6, 11).count() == 0


def test_a_fan_keeps_its_direction(spark):
    """Stripes that vary along x pass the first fan, and stripes along y do not; fans add up to the raster less its mean."""
    y, x = np.mgrid[:16, :16]
    a = 3 + np.cos(2 * np.pi * 2 * x / 16) + 2 * np.cos(2 * np.pi * 3 * y / 16)
    cells = spark.createDataFrame([(int(i), int(j), float(a[j, i]), 0.0) for j in range(16) for i in range(16)], "x int, y int, re double, im double")
    s = fourier.fan(fourier.transformed(cells, 16, 16), 16, 16, 4)
    parts = [grid(fourier.transformed(s.where(F.col("band") == k).drop("band"), 16, 16, inverse=True), 16, 16) for k in range(4)]
    assert np.allclose(parts[0], np.cos(2 * np.pi * 2 * x / 16), atol=1e-9)
    assert np.allclose(parts[2], 2 * np.cos(2 * np.pi * 3 * y / 16), atol=1e-9)
    assert np.allclose(sum(parts), a - 3, atol=1e-9)


def test_fan_filtered_query(spark, sf):
    width, cells = spectra.lattice_cells(spark, sf)
    a = grid(cells, width, width)
    s = np.conj(np.fft.fft2(np.conj(a)))
    fy, fx = np.meshgrid(*[np.where(np.arange(width) > width // 2, np.arange(width) - width, np.arange(width))] * 2, indexing="ij")
    flip = (fy < 0) | ((fy == 0) & (fx < 0))
    band = np.floor(np.arctan2(np.where(flip, -fy, fy), np.where(flip, -fx, fx)) * spectra.BANDS / np.pi + 0.5) % spectra.BANDS
    s[(band != 0) | ((fx == 0) & (fy == 0))] = 0
    want = np.fft.fft2(s) / width**2
    got = {(r["x"], r["y"]): r["val"] for r in spectra.fan_filtered(spark, sf).collect()}
    assert len(got) == width * width and max(abs(got[x, y] - want[y, x].real) for x, y in got) < 1e-3


def test_projection(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings").orderBy("vec_id").collect()
    v = np.array([r["embedding"][: spectra.DIMENSIONS] for r in rows], float)
    values = np.linalg.eigvalsh(np.cov(v.T, bias=True))[::-1]
    got = {r["id"]: r for r in spectra.principal_projection(spark, sf).collect()}
    p = np.array([[got[r["vec_id"]][c] for c in ("p0", "p1", "w0", "w1")] for r in rows])
    cov = np.cov(p.T, bias=True)
    assert np.allclose([cov[0, 0], cov[1, 1]], values[:2], atol=1e-5) and abs(cov[0, 1]) < 1e-5
    assert np.allclose([cov[2, 2], cov[3, 3]], 1, atol=1e-3) and np.allclose(p.mean(0), 0, atol=1e-5)


@pytest.mark.parametrize(("kind", "most", "bands"), [(4, 1, 1), (5, 255, 1), (5, 1000, 1), (6, 255, 3), (6, 65535, 3)])
def test_binary_images(spark, tmp_path, kind, most, bands):
    rng = np.random.default_rng(kind + most)
    a = rng.integers(0, most + 1, (5, 11, bands))
    a[2] = 0
    cells = spark.createDataFrame([(int(b), int(x), int(y), int(a[y, x, b])) for y, x, b in np.argwhere(a)], "band int, x int, y int, val int")
    content = bytes(io.image_bytes(cells, kind, 11, 5, most).first()["content"])
    (tmp_path / "a.img").write_bytes(content)
    got = np.zeros_like(a)
    rows = io.read_images(spark, str(tmp_path / "a.img")).collect()
    for r in rows:
        got[r["y"], r["x"], r["band"]] = r["val"]
    assert len(rows) == a.size and (got == a).all()


def test_plain_images_and_faults(spark, tmp_path):
    texts = {"a": b"P1\n# note\n3 2\n101\n0 1 0\n", "b": b"P2 2 2 # wide\n9\n1 2\n3 # x\n 4\n", "c": b"P3\n1 2\n255\n1 2 3 4 5 6\n"}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t)
    got = {n: [tuple(r)[1:] for r in sorted(io.read_images(spark, str(tmp_path / n)).collect())] for n in texts}
    assert [r[3] for r in sorted(got["a"], key=lambda r: (r[2], r[1]))] == [1, 0, 1, 0, 1, 0]
    assert [r[3] for r in sorted(got["b"], key=lambda r: (r[2], r[1]))] == [1, 2, 3, 4]
    assert [r[3] for r in sorted(got["c"], key=lambda r: (r[2], r[0]))] == [1, 2, 3, 4, 5, 6]
    for n, t in {"d": b"P5\n4 4\n255\nabc", "e": b"GIF89a"}.items():
        (tmp_path / n).write_bytes(t)
        with pytest.raises(Exception, match="cut short|no image"):
            io.read_images(spark, str(tmp_path / n)).collect()

