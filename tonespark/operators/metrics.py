"""Quality metrics of one signal against another, in two levels of aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.functions.sample import decibels, float_to_int, int_to_float


def requantised(stream: DataFrame, depth: int = 8) -> DataFrame:
    """``s`` and the test signal ``t``: the same at fewer bits."""
    return stream.select("user_id", "frame", F.col("v").alias("s"), int_to_float(float_to_int(F.col("v"), depth), depth).alias("t"))


def snr(both: DataFrame) -> DataFrame:
    """Whole-stream signal-to-noise ratio and peak error; null without noise."""
    e = F.col("s") - F.col("t")
    sums = both.groupBy("user_id").agg(F.sum(F.col("s") * F.col("s")).alias("p"), F.sum(e * e).alias("n"), F.max(F.abs(e)).alias("peak"))
    return sums.select("user_id", F.round(F.when(F.col("n") > 0, decibels(F.col("p") / F.col("n"))), 6).alias("snr_db"), F.round("peak", 9).alias("peak_error"))


def segmental_snr(both: DataFrame, length: int = 20) -> DataFrame:
    """Mean of the frames' ratios, energies floored at 1e-10, each clamped to -10 to 35 dB; partial frames don't count."""
    e = F.col("s") - F.col("t")
    part = both.groupBy("user_id", F.floor(F.col("frame") / length).alias("block")).agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("p"), F.sum(e * e).alias("d"))
    ratio = decibels(F.greatest("p", F.lit(1e-10)) / F.greatest("d", F.lit(1e-10)))
    whole = part.where(F.col("n") == length).withColumn("r", F.least(F.greatest(ratio, F.lit(-10.0)), F.lit(35.0)))
    return whole.groupBy("user_id").agg(F.round(F.avg("r"), 6).alias("segmental_db"), F.count("*").alias("segments"))


def _tone_sums(both: DataFrame, frequency: float, rate: float) -> DataFrame:
    """Sums of a sine and a cosine of the frequency against each other and the signal, and the 2 x 2 solution p, r."""
    w = 2 * 3.141592653589793 * frequency / rate
    a, b, x = F.sin(F.col("frame") * w), F.cos(F.col("frame") * w), F.col("s")
    s = both.groupBy("user_id").agg(*[F.sum(c).alias(n) for n, c in (("aa", a * a), ("ab", a * b), ("bb", b * b), ("xa", x * a), ("xb", x * b), ("xx", x * x))])
    s = s.withColumn("det", F.expr("aa * bb - ab * ab")).where("det > 1e-6")
    return s.withColumn("p", F.expr("(xa * bb - xb * ab) / det")).withColumn("r", F.expr("(xb * aa - xa * ab) / det"))


def tone_fit(both: DataFrame, frequency: float, rate: float) -> DataFrame:
    """Amplitude of the least-squares sine of a frequency: five sums and a closed 2 x 2 solution."""
    return _tone_sums(both, frequency, rate).select("user_id", F.round(F.expr("sqrt(p * p + r * r)"), 6).alias("amplitude"))


def tone_purity(both: DataFrame, frequency: float, rate: float) -> DataFrame:
    """The share of a signal's energy that the least-squares sine takes; silent signals give no row."""
    return _tone_sums(both, frequency, rate).where("xx > 0").select("user_id", F.round(F.expr("(xa * p + xb * r) / xx"), 6).alias("purity"))


def a_weighted_snr(both: DataFrame, length: int, rate: float) -> DataFrame:
    """Signal-to-noise ratio of A-weighted power over Hann windows of ``length`` that overlap by half, and the bins of
    their discrete Fourier transform from 1; partial windows don't count. A window is one bounded array."""
    hop, pi = length // 2, "3.141592653589793D"
    own = F.floor(F.col("frame") / hop).cast("long")
    part = both.withColumn("w", F.explode(F.array(own, own - 1))).where("w >= 0")
    rows = part.groupBy("user_id", "w").agg(F.sort_array(F.collect_list(F.struct("frame", "s", (F.col("s") - F.col("t")).alias("e")))).alias("x")).where(F.size("x") == length)
    gain = f"(0.5D - 0.5D * cos(2 * {pi} * j / {length}))"
    total = lambda v, f: f"pow(aggregate(sequence(0, {length - 1}), 0D, (a, j) -> a + x[j].{v} * {gain} * {f}(2 * {pi} * k * j / {length})), 2)"
    f = f"(k * {rate / length}D)"
    weight = f"pow(pow(12194D, 2) * pow({f}, 4) / (({f} * {f} + pow(20.6D, 2)) * sqrt(({f} * {f} + pow(107.7D, 2)) * ({f} * {f} + pow(737.9D, 2))) * ({f} * {f} + pow(12194D, 2))), 2)"
    power = lambda v: F.expr(f"aggregate(sequence(1, {hop}), 0D, (b, k) -> b + ({total(v, 'cos')} + {total(v, 'sin')}) * {weight})")
    sums = rows.select("user_id", power("s").alias("p"), power("e").alias("n")).groupBy("user_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("user_id", F.round(decibels(F.col("p") / F.col("n")), 5).alias("snr_db"))


def first_mismatch(both: DataFrame, tolerance: float) -> DataFrame:
    """The first frame that differs by more than ``tolerance``, by stream; streams without one give no row."""
    bad = both.where(F.abs(F.col("s") - F.col("t")) > tolerance)
    return bad.groupBy("user_id").agg(F.min("frame").alias("first_frame"), F.count("*").alias("mismatches"))
