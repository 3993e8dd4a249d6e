"""Scans over blocks against plain loops: streams of many lengths, blocks of blocks, gaps, ties and null streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonespark.operators import scans


@pytest.fixture(scope="module")
def stream(spark):
    r = random.Random(3)
    rows = [(u, f * (2 if u == 4 else 1) + (40 if u == 5 else 0), r.randrange(-50, 50), r.randrange(0, 9), r.randrange(0, 9), r.randrange(0, 9)) for u, n in ((1, 300), (2, 33), (3, 1), (4, 90), (5, 20), (None, 25)) for f in range(n)]
    return spark.createDataFrame(rows, "user_id long, frame long, x long, a long, b long, c long").repartition(5).cache(), rows


def plain(rows, step, start):
    out, now = {}, {}
    for u, f, *x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        now[u] = step(now.get(u, start), x)
        out[u, f] = now[u]
    return out


CASES = {
    "affine": (scans.smoothing(0.25, 4.0), lambda y, x: y + 0.25 * (x[0] - y), 4.0),
    "floor": (scans.Floor(1.1), lambda y, x: min(1.1 * y, x[0] + 60), float("inf")),
    "clamped": (scans.Clamped(-30, 25, 3), lambda y, x: min(max(y + x[0], -30), 25), 3),
    "congruential": (scans.Congruential(1_664_525, 42), lambda y, x: (y * 1_664_525 + x[0] + 60) % (1 << 32), 42),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [4, 64, 1024])
def test_scans_equal_loops(stream, name, block, monkeypatch):
    monkeypatch.setattr(scans, "PART_ROWS", 40)
    df, rows = stream
    r, step, start = CASES[name]
    x = {"floor": F.col("x") + 60, "congruential": F.col("x") + 60}.get(name, F.col("x"))
    got = {(v.user_id, v.frame): v.y for v in scans.scan(df.select("user_id", "frame", x.cast("double" if r.kind == "double" else "long").alias("x")), r, ["x"], ["y"], block).collect()}
    want = plain(rows, step, start)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    assert scans.scan(df.where("false").select("user_id", "frame", "x"), r, ["x"], ["y"], block).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
@pytest.mark.parametrize(("forward", "back"), [([0.5, 0.25, -0.125, 0.3], [-0.6, 0.3]), ([1.0], [-0.9]), ([0.5, 0.5], [])])
def test_iir_filters(stream, block, forward, back):
    df, rows = stream
    got = {(v.user_id, v.frame): v.y for v in scans.scan(df.select("user_id", "frame", F.col("x").cast("double").alias("x")), scans.iir(forward, back), ["x"], ["y"], block).collect()}
    for u in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == u)
        y = []
        for n in range(len(own)):
            y.append(sum(c * own[n - k][1] for k, c in enumerate(forward) if n >= k) - sum(c * y[n - 1 - k] for k, c in enumerate(back) if n > k))
            assert abs(got[u, own[n][0]] - y[n]) < 1e-9 * max(1, abs(y[n]))


@pytest.mark.parametrize("block", [3, 16, 1024])
@pytest.mark.parametrize("moves", [[[0, 5, 9], [5, 0, 5], [9, 5, 0]], [[0, 0, 0]] * 3, [[3, 1, 4], [1, 5, 9], [2, 6, 5]]])
def test_cheapest_paths_equal_a_sequential_reader(stream, block, moves, monkeypatch):
    monkeypatch.setattr(scans, "PART_ROWS", 50)
    df, rows = stream
    got = {(v.user_id, v.frame): v.state for v in scans.cheapest_path(df, moves, ["a", "b", "c"], block).collect()}
    want = {}
    for u in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == u)
        v, back = [0, 0, 0], []
        for _, _, *cost in own:
            through = [[v[i] + moves[i][j] for i in range(3)] for j in range(3)]
            back.append([t.index(min(t)) for t in through])
            v = [min(t) + c for t, c in zip(through, cost, strict=True)]
        now = v.index(min(v))
        for (f, *_), b in zip(reversed(own), reversed(back), strict=True):
            want[u, f] = now
            now = b[now]
    assert got == want and scans.cheapest_path(df.where("false"), moves, ["a", "b", "c"], block).count() == 0


def test_one_long_stream_is_many_tasks(spark):
    n = 1 << 20
    one = spark.range(n).select(F.lit("s").alias("user_id"), F.col("id").alias("frame"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    made = scans.scan(one, scans.iir([0.5], [-0.99, 0.1]), ["x"], ["y"])
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    x, y = np.arange(n) * 7919 % 1000 * 0.5, [0.0, 0.0]
    for v in x.tolist():
        y.append(v + 0.99 * y[-1] - 0.1 * y[-2])
    got = made.orderBy("frame").select("y").toPandas()["y"].to_numpy()
    assert np.allclose(got, y[2:], rtol=1e-9, atol=1e-9)


def test_digests_of_streams(spark):
    import hashlib

    from tonespark.functions import checksums

    rows = [(u, f, bytes([f % 256]) * (f % 5)) for u, n in ((1, 1000), (2, 1), (3, 7), (None, 3)) for f in range(n)] + [(2, 1, None)]
    df = spark.createDataFrame(rows, "user_id long, frame long, data binary").repartition(5)
    got = {r.user_id: r.md5 for r in checksums.ordered_md5(df, "user_id", "frame", "data").collect()}
    assert got == {u: hashlib.md5(b"".join(x for v, _, x in rows if v == u and x)).hexdigest() for u in (1, 2, 3, None)}
    assert checksums.ordered_md5(df.where("false"), "user_id", "frame", "data").count() == 0
