"""Lapped transforms and resampling against their formulas, over chunk edges and streams of many lengths."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonespark.operators import spectra

LENGTHS = {1: 700, 2: 64, 3: 1, 4: 65, 5: 127, 6: 128, None: 40}


@pytest.fixture(scope="module")
def stream(spark):
    r = random.Random(5)
    rows = [(u, f, r.uniform(-1, 1)) for u, n in LENGTHS.items() for f in range(n)]
    by = {u: np.array([x for v, _, x in rows if v == u]) for u in LENGTHS}
    return spark.createDataFrame(rows, "user_id long, frame long, x double").repartition(3).cache(), by


@pytest.mark.parametrize("window", spectra.WINDOWS)
def test_windows_and_transforms(window):
    for n in (32, 64, 256, 1024):
        w = spectra.WINDOWS[window](2 * n)
        assert np.allclose(w[:n] ** 2 + w[n:] ** 2, 1) and np.allclose(w, w[::-1])
    n, x = 16, np.random.default_rng(1).normal(size=(3, 32))
    cosines = np.cos(math.pi / n * (np.arange(2 * n)[:, None] + 0.5 + n / 2) * (np.arange(n) + 0.5))
    assert np.allclose(spectra.mdct(x), x @ cosines) and np.allclose(spectra.inverse_mdct(x[:, :n]), x[:, :n] @ cosines.T * 2 / n)


@pytest.mark.parametrize(("n", "chunk", "window"), [(32, 32, "sine"), (32, 64, "kbd"), (32, 1 << 13, "power"), (64, 128, "sine"), (256, 256, "kbd"), (1024, 1 << 13, "power")])
def test_lapped_blocks_are_restored(stream, n, chunk, window, monkeypatch):
    monkeypatch.setattr(spectra, "PART_ROWS", 200)
    df, by = stream
    blocks = spectra.lapped(df, n, window, chunk)
    w = spectra.WINDOWS[window](2 * n)
    got = {(r.user_id, r.block): r.c for r in blocks.collect()}
    assert got.keys() == {(u, b) for u, x in by.items() for b in range((len(x) - 1) // n + 2)}
    cosines = np.cos(math.pi / n * (np.arange(2 * n)[:, None] + 0.5 + n / 2) * (np.arange(n) + 0.5))
    for (u, b), c in got.items():
        line = np.zeros((len(by[u]) // n + 4) * n)
        line[n : n + len(by[u])] = by[u]
        assert np.allclose(c, (line[b * n : b * n + 2 * n] * w) @ cosines, atol=1e-9)
    back = {(r.user_id, r.frame): r.x for r in spectra.unlapped(blocks, n, window, chunk).collect()}
    for u, x in by.items():
        whole = np.zeros(((len(x) - 1) // n + 1) * n)
        whole[: len(x)] = x
        assert np.allclose([back.pop((u, f)) for f in range(len(whole))], whole, atol=1e-9)
    assert not back and spectra.lapped(df.where("false"), n, window).count() == 0 and spectra.unlapped(blocks.where("false"), n, window).count() == 0


@pytest.mark.parametrize(("up", "down"), [(1, 3), (1, 2), (1, 4), (1, 6), (3, 1), (2, 1), (4, 1), (6, 1), (160, 147), (2, 4)])
def test_resampling_equals_a_convolution(stream, up, down, monkeypatch):
    monkeypatch.setattr(spectra, "PART_ROWS", 200)
    df, by = stream
    cut = min(1.0, up / down)
    for chunk in (100, 1 << 13):
        got = {(r.user_id, r.frame): r.x for r in spectra.resample(df, up, down, 8, chunk).collect()}
        assert got.keys() == {(u, m) for u, x in by.items() for m in range((len(x) - 1) * up // down + 1)}
    for (u, m), y in got.items():
        t = m * down / up - np.arange(len(by[u]))
        h = np.where(np.abs(t) < 8 / cut, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(math.pi * t * cut / 8)), 0)
        assert abs(y - h @ by[u]) < 1e-9
    assert spectra.resample(df.where("false"), up, down).count() == 0


def test_a_tone_keeps_its_level(spark):
    tone = spark.range(30_000).select(F.lit("s").alias("user_id"), F.col("id").alias("frame"), F.sin(F.col("id") * (2 * math.pi * 1000 / 48_000)).alias("x"))
    for up, down in ((1, 3), (1, 2), (1, 4)):
        low = spectra.resample(tone, up, down)
        back = spectra.resample(low, down, up).where("frame between 2000 and 27000").select("frame", "x").toPandas()
        assert np.abs(back["x"] - np.sin(back["frame"] * (2 * math.pi * 1000 / 48_000))).max() < 2e-3


def test_spectra_of_rows(spark):
    r = np.random.default_rng(2)
    rows = [(1, r.normal(size=64).tolist()), (2, r.normal(size=7).tolist()), (3, []), (4, None), (5, r.normal(size=64).tolist())]
    got = {}
    for x in spectra.power_spectra(spark.createDataFrame(rows, "i long, e array<double>"), "i", "e").orderBy("k").collect():
        got.setdefault(x.i, []).append(x.power)
    assert got.keys() == {1, 2, 5} and all(np.allclose(got[i], np.abs(np.fft.rfft(e)) ** 2) for i, e in rows if e)


def test_tasks_hold_values_not_rows(spark, monkeypatch):
    """A block counts as all of its values, and short streams' blocks are transformed in slices."""
    monkeypatch.setattr(spectra, "PART_ROWS", 4096)
    stream = spark.range(2000).selectExpr("id AS user_id", "0L AS frame", "1D AS x")
    blocks = spectra.lapped(stream, 64, "sine", 64)
    sizes = []
    real = spectra.mdct
    monkeypatch.setattr(spectra, "mdct", lambda b: sizes.append(b.size) or real(b))
    run = {}
    monkeypatch.setattr(type(blocks.groupBy("user_id")), "applyInArrow", lambda g, f, schema: run.setdefault("f", f))
    spectra.lapped(stream, 64, "sine", 64)
    table = pa.table({"user_id": np.arange(500), "frame": np.zeros(500, np.int64), "x": np.ones(500), "_chunk": np.zeros(500, np.int64), "_part": np.zeros(500, np.int64)})
    made = list(run["f"](iter(table.to_batches())))
    assert max(sizes) <= 2 * (4096 + 2 * 64) and sum(b.num_rows for b in made) == 500
    parts = spectra._dealt(blocks.selectExpr("user_id", "block AS frame", "c"), 1, 0, 1, 64).groupBy("_part").count().collect()
    assert len(parts) > 20 and max(r["count"] for r in parts) * 64 < 4 * 4096
