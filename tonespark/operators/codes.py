"""Code lengths and bit budgets by group, from histograms that are summed before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespark.operators import halo

#: Bits of a slope that one histogram tells apart.
DIGIT = 12
SLOPE_BITS = 48


def package_merge(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of at most ``limit`` that take the fewest bits, for ascending counts; at each level the chosen items
    are the smallest, leaves before packages of equal weight."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if limit < 1 or n > 1 << limit:
        raise ValueError(f"{n} symbols have no codes of {limit} bits")
    levels, packages = [], np.zeros(0, counts.dtype)
    for _ in range(limit):
        weight = np.concatenate([counts, packages])
        order = np.argsort(weight, kind="stable")
        levels.append(order < n)  # whether an item is a leaf
        weight = weight[order]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return lengths


def code_lengths(values: DataFrame, keys: list[str], symbol: str, limit: int = 15) -> DataFrame:
    """``keys, symbol, n, length, code``: a prefix code of each group's symbols with lengths up to ``limit``, of the
    fewest bits for the group; codes are canonical (by length, then symbol).

    Of symbols of equal counts lower ones have the shorter codes. A group's only symbol has a code of one bit. Null
    symbols count as none. More than 2 ** limit symbols in a group raise an error, so a task holds no more than that.
    """
    counts = values.where(F.col(symbol).isNotNull()).groupBy(*keys, symbol).agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        n, s = table["n"].to_numpy(), table[symbol].to_numpy()
        order = np.lexsort((-s, n))
        length = np.empty(len(n), np.int64)
        length[order] = package_merge(n[order], limit)
        code, rows, now, last = np.empty(len(n), np.int64), np.lexsort((s, length)), 0, 0
        for k in rows.tolist():
            now <<= int(length[k]) - last
            code[k], last = now, int(length[k])
            now += 1
        return table.append_column("length", pa.array(length)).append_column("code", pa.array(code))

    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema) + ", length bigint, code bigint"
    return counts.groupBy(*keys).applyInArrow(run, made)


def within_budget(steps: DataFrame, budget: DataFrame, block: int | None = None) -> DataFrame:
    """The rows of ``steps`` (user_id, frame, slope, bits, ...) that a group's budget (user_id, budget) pays for: by
    falling slope, of equal ones by frame, up to the first that doesn't fit.

    ``slope`` is a whole number from 0 to before 2 ** 48, ``bits`` one from 1, ``frame`` tells a group's rows of one slope
    apart. The slope where the budget ends is found digit by digit: a group's bits are summed by the next DIGIT bits of
    their slopes, and a cumulative cut over these few sums tells the digit. Only rows of just that slope are then put in
    order. Groups without a budget, and rows with nulls, give none.
    """
    extra = [c for c in steps.columns if c not in ("user_id", "frame", "slope", "bits")]
    rows = steps.where("user_id is not null and frame is not null and slope is not null and bits is not null")
    left = budget.where("user_id is not null and budget is not null").groupBy("user_id").agg(F.min("budget").alias("_left"))
    cut = left.withColumn("_prefix", F.lit(0).cast("long"))
    for shift in range(SLOPE_BITS - DIGIT, -1, -DIGIT):
        # What is left travels with the sums, so that each cut is named once: the plan grows by a pass over the rows a digit.
        here = rows.join(cut, "user_id").where(F.shiftright("slope", shift + DIGIT) == F.col("_prefix"))
        sums = here.groupBy("user_id", F.shiftright("slope", shift).alias("_digit")).agg(F.sum("bits").alias("_bits"), F.min("_left").alias("_left"))
        above = Window.partitionBy("user_id").orderBy(F.desc("_digit"))  # at most 2 ** DIGIT rows a group
        ends = sums.withColumn("_above", F.sum("_bits").over(above) - F.col("_bits")).where(F.col("_above") <= F.col("_left"))
        # The lowest digit that the budget reaches; all of those above it are paid for.
        least = ends.groupBy("user_id").agg(F.min(F.struct("_digit", (F.col("_left") - F.col("_above")).alias("_rest"))).alias("m"))
        cut = least.select("user_id", F.col("m._rest").alias("_left"), F.col("m._digit").alias("_prefix"))
    ended = rows.join(cut, "user_id")
    paid = ended.where(F.col("slope") > F.col("_prefix"))
    last = halo.running_sums(ended.where(F.col("slope") == F.col("_prefix")), {"_spent": F.col("bits")}, block).where(F.col("_spent") <= F.col("_left"))
    return paid.select("user_id", "frame", "slope", "bits", *extra).unionByName(last.select("user_id", "frame", "slope", "bits", *extra))
