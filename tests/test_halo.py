"""Blocks and halos give what a window over the whole stream gives, and one long stream is many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonespark.operators import halo, ordered, relational


@pytest.fixture(scope="module")
def stream(spark):
    r = random.Random(4)
    rows = [(u, i, r.randrange(-999, 999)) for u, n in ((1, 103), (2, 20), (3, 1), (4, 21)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, frame long, q long").cache()


def values(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [5, 20, 1000, None])
def test_blocks_equal_whole_streams(stream, block):
    w = Window.partitionBy("user_id").orderBy("frame")
    lags = lambda x: {f"l{k}": F.lag("q", k).over(x) for k in (1, 4)}
    assert values(halo.looking_back(stream, 4, lags, block)) == values(stream.withColumns(lags(w)))
    leads = lambda x: {"a": F.lead("q", 3).over(x)}
    assert values(halo.looking_ahead(stream, 3, leads, block)) == values(stream.withColumns(leads(w)))
    assert values(halo.running_sums(stream, {"s": F.col("q"), "n": F.lit(1)}, block)) == values(stream.withColumn("s", F.sum("q").over(w)).withColumn("n", F.row_number().over(w)))
    got = F.when(F.col("q") % 7 == 0, F.col("q"))
    assert values(halo.last_known(stream, got, "k", block)) == values(stream.withColumn("k", F.last(got, True).over(w)))
    assert halo._small(stream)  # what None goes by
    moved = stream.select("user_id", (F.col("frame") * 3 + 7).alias("at"))
    assert values(halo.numbered(moved, "user_id", "at", "k", block).select("user_id", "at", "k")) == values(moved.withColumn("k", F.floor((F.col("at") - 7) / 3)))
    assert values(ordered.restore_fixed(ordered.fixed_residuals(stream, block), block)) == values(stream.select("user_id", "frame", *["q"] * 4))


def test_restored_from_residuals_alone(spark):
    """The samples are not looked at: residuals of other samples give those."""
    q = [3, -5, 8, 100, 7, -9, 2]
    diff = lambda x: [b - a for a, b in zip(x, x[1:], strict=False)]
    levels = [q]
    for _ in range(4):
        levels.append(diff(levels[-1]))
    rows = [(1, i, -77, *(levels[n][i - n] if i >= n else None for n in range(5))) for i in range(len(q))]
    df = spark.createDataFrame(rows, "user_id long, frame long, q long, r0 long, r1 long, r2 long, r3 long, r4 long")
    df = df.withColumn("r0", F.when(F.col("frame") == 0, F.col("r0")))  # of order 0, the first sample alone
    assert [tuple(r)[2:] for r in ordered.restore_fixed(df, 3).orderBy("frame").collect()] == [(x,) * 4 for x in q]


def test_one_long_stream_is_many_tasks(spark):
    n = 1 << 20
    one = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("frame"), (F.col("id") % 1000).alias("q"))
    rows = halo.looking_back(one, 4, lambda w: {"d": F.lag("q", 4).over(w)}, 1 << 14).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) < 0.5 * n


def test_missing_frames(spark):
    got = spark.createDataFrame([(1, f) for f in (0, 1, 5, 6, 9)] + [(2, 4)], "user_id long, frame long")
    assert values(ordered.missing_frames(got)) == [(1, 2, 3), (1, 7, 2)]


@pytest.mark.parametrize(("adaptive", "partitions"), [("true", "1"), ("true", "4"), ("false", "4"), ("true", "200")])
def test_branches_of_one_shuffled_stream(spark, adaptive, partitions):
    """Both sides of an as-of join share a shuffle by user: no row comes twice, and no value is lost."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(400).select((F.col("id") % 7).alias("user_id"), F.floor(F.col("id") / 7).alias("frame"), F.col("id").alias("q"))
        for stream in (rows.repartition("user_id"), rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("frame"))).drop("n")):
            right = stream.where("frame % 10 = 3").withColumnRenamed("q", "v")
            for block in (8, 1 << 20) if partitions == "4" else (8,):
                got = relational.asof_join(stream, right, "v", "known", block).collect()
                assert len(got) == 400
                assert all(r.known == ((r.frame - 3) // 10 * 70 + 21 + r.user_id if r.frame >= 3 else None) for r in got)
            assert ordered.cheapest_subframes(stream, 16).count() == sum(-(-(58 if u == 0 else 57) // 16) for u in range(7))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
