"""Ordered work in blocks: a stream is many tasks, not one.

Frames of a stream are numbered from 0 without gaps. What looks back a few frames gets the last frames of the block
before as a halo; what runs through the whole stream is summed by block first, and each block is given what the blocks
before it come to. Windows over whole streams then see a row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16
SMALL = 64 << 20


def in_block() -> WindowSpec:
    """A block's frames in order."""
    return Window.partitionBy("user_id", "_block").orderBy("frame")


def by_stream() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("frame")


def _small(rows: DataFrame) -> bool:
    """By the optimizer's estimate, which never is below the files' size scaled by the columns read."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def merged(a: DataFrame, b: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows of both, dealt anew by ``keys``.

    Branches of one shuffled stream may look as if their union were dealt by the stream's key already while it is run as
    twice the partitions; what gathers rows of a key from it would then meet each key twice.
    """
    return a.unionByName(b, allowMissingColumns=True).repartition(*[F.col(k) if isinstance(k, str) else k for k in keys])


def looking_back(stream: DataFrame, frames: int, make: Callable[[WindowSpec], dict[str, Column]], block: int | None = None) -> DataFrame:
    """``stream`` (user_id, frame, ...) with the columns that ``make`` builds over a window which reaches back up to
    ``frames`` frames."""
    if block is None and _small(stream):
        return stream.withColumns(make(by_stream()))
    block = block or BLOCK
    own = F.floor(F.col("frame") / block).cast("long")
    to = F.when(F.col("frame") % block >= block - frames, F.array(own, own + 1)).otherwise(F.array(own))
    spread = stream.withColumn("_block", F.explode(to))
    return spread.withColumns(make(in_block())).where(F.col("_block") == own).drop("_block")


def looking_ahead(stream: DataFrame, frames: int, make: Callable[[WindowSpec], dict[str, Column]], block: int | None = None) -> DataFrame:
    """The same for a window that reaches ahead."""
    if block is None and _small(stream):
        return stream.withColumns(make(by_stream()))
    block = block or BLOCK
    own = F.floor(F.col("frame") / block).cast("long")
    to = F.when((F.col("frame") % block < frames) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = stream.withColumn("_block", F.explode(to))
    return spread.withColumns(make(in_block())).where(F.col("_block") == own).drop("_block")


def running_sums(stream: DataFrame, sums: dict[str, Column], block: int | None = None) -> DataFrame:
    """``stream`` with running sums over each stream, the frame's own value included."""
    if block is None and _small(stream):
        up_to = by_stream().rowsBetween(Window.unboundedPreceding, 0)
        return stream.withColumns({n: F.sum(c).over(up_to) for n, c in sums.items()})
    block, names = block or BLOCK, list(sums)
    valued = stream.withColumn("_block", F.floor(F.col("frame") / block).cast("long")).withColumns({f"_{n}": c for n, c in sums.items()})
    totals = valued.groupBy("user_id", "_block").agg(*[F.sum(f"_{n}").alias(n) for n in names])
    before = Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("user_id", "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base_{n}") for n in names])
    within = in_block().rowsBetween(Window.unboundedPreceding, 0)
    made = valued.join(bases, ["user_id", "_block"]).withColumns({n: F.sum(f"_{n}").over(within) + F.col(f"_base_{n}") for n in names})
    return made.drop("_block", *[f"_{n}" for n in names], *[f"_base_{n}" for n in names])


def last_known(stream: DataFrame, value: Column, name: str, block: int | None = None) -> DataFrame:
    """``stream`` with the last value that isn't null up to each frame, null before the first."""
    if block is None and _small(stream):
        return stream.withColumn(name, F.last(value, True).over(by_stream().rowsBetween(Window.unboundedPreceding, 0)))
    block = block or BLOCK
    valued = stream.withColumn("_block", F.floor(F.col("frame") / block).cast("long")).withColumn("_value", value)
    blocks = valued.groupBy("user_id", "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("frame"))).alias("_end"))
    before = Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("user_id", "_block", F.last("_end", True).over(before).alias("_base"))
    within = in_block().rowsBetween(Window.unboundedPreceding, 0)
    made = valued.join(bases, ["user_id", "_block"]).withColumn(name, F.coalesce(F.last("_value", True).over(within), F.col("_base")))
    return made.drop("_block", "_value", "_base")


def numbered(rows: DataFrame, key: str, order: str, name: str, block: int | None = None) -> DataFrame:
    """``rows`` with their place (from 0) among those of equal ``key`` by the integer column ``order``, counted in blocks
    of its values."""
    if block is None and _small(rows):
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
    block = block or BLOCK
    placed = rows.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    counts = placed.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(key, "_block").orderBy(order)
    return placed.join(bases, [key, "_block"]).withColumn(name, (F.row_number().over(own) - 1 + F.col("_base")).cast("long")).drop("_block", "_base")
