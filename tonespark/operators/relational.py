"""Joins by order and by range, as equi-joins and windows over bounded parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.operators import halo


def asof_join(left: DataFrame, right: DataFrame, value: str, name: str, block: int) -> DataFrame:
    """``left`` (user_id, frame, ...) with the ``value`` of the last row of ``right`` (user_id, frame, value) at or before
    each row's frame, null where there is none. ``frame`` is any integer order; of several right rows at a frame, the
    greatest value counts. Parts are ``block`` wide, so neither side of a key meets in one task."""
    extra = [c for c in left.columns if c not in ("user_id", "frame")]
    own = left.select("user_id", "frame", F.struct(*extra, F.lit(True).alias("_left")).alias("_row"))
    one = right.where(F.col(value).isNotNull()).groupBy("user_id", "frame").agg(F.max(value).alias("_known"))
    both = halo.merged(own.withColumn("_known", F.lit(None).cast(right.schema[value].dataType)), one, "user_id", F.floor(F.col("frame") / block))
    # A right row sorts before the left rows of its frame: frames are doubled, left ones odd.
    placed = both.withColumn("frame", F.col("frame") * 2 + F.col("_row").isNotNull().cast("int"))
    made = halo.last_known(placed, F.col("_known"), name, 2 * block).where("_row is not null")
    return made.select("user_id", F.floor(F.col("frame") / 2).cast("long").alias("frame"), *[F.col(f"_row.{c}").alias(c) for c in extra], name)


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """``points`` joined with the ``ranges`` whose ``start`` to before ``end`` holds ``at``: an equi-join on buckets of
    ``width``, of which a range takes as many as it meets."""
    low, high = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    spread = ranges.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(low, high)))
    own = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return own.join(spread, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def compare(signal: DataFrame, test: DataFrame, tolerance: float) -> DataFrame:
    """By user: the first frame whose values ``v`` differ by more than ``tolerance`` or that one side lacks, how many
    differ, and how many frames only the signal (``missing``) or only the test (``extra``) has."""
    a, b = signal.select("user_id", "frame", F.col("v").alias("a")), test.select("user_id", "frame", F.col("v").alias("b"))
    both = a.join(b, ["user_id", "frame"], "full")
    differs = F.abs(F.col("a") - F.col("b")) > tolerance
    bad = F.coalesce(differs, F.lit(True))
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy("user_id").agg(
        F.min(F.when(bad, F.col("frame"))).alias("first_frame"), count(differs).alias("mismatches"),
        count(F.col("b").isNull()).alias("missing"), count(F.col("a").isNull()).alias("extra"),
    )
