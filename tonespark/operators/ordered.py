"""Operators over ordered samples: framing, prediction, stereo, detection, trimming; windows are per block of a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tonespark.functions.sample import zigzag
from tonespark.operators import halo


def by_frame() -> WindowSpec:
    """A stream's frames in order."""
    return Window.partitionBy("user_id").orderBy("frame")


def block_of(length: int, frame: str = "frame") -> Column:
    return F.floor(F.col(frame) / length).cast("long")


def fixed_residuals(stream: DataFrame, block: int | None = None) -> DataFrame:
    """``r0`` to ``r4``: finite differences of orders 0 to 4; null where the stream has no history."""
    binomial = [[1], [1, -1], [1, -2, 1], [1, -3, 3, -1], [1, -4, 6, -4, 1]]

    def make(w: WindowSpec) -> dict[str, Column]:
        lag = [F.col("q"), *(F.lag("q", k).over(w) for k in range(1, 5))]
        return {f"r{n}": reduce(lambda a, b: a + b, (F.lit(c) * lag[k] for k, c in enumerate(row))) for n, row in enumerate(binomial)}

    return halo.looking_back(stream.select("user_id", "frame", "q"), 4, make, block)


def restore_fixed(residuals: DataFrame, block: int | None = None) -> DataFrame:
    """Samples ``x1`` to ``x4`` from residuals of orders 1 to 4 alone, by as many running sums.

    A residual of order n begins with warm-up residuals of the orders below it: at frame k, that of order k.
    """
    warm = lambda n: F.col(f"r{n}") if n == 0 else F.when(F.col("frame") >= n, F.col(f"r{n}"))
    rows, names = residuals, {}
    for n in range(1, 5):
        value = warm(n)
        for k in range(n - 1, -1, -1):  # the warm-up of order k is the (n - k)-th difference's start
            value = F.when(F.col("frame") == k, F.col(f"r{k}")).otherwise(value)
        names[n] = f"s{n}"
        rows = rows.withColumn(names[n], value)
    for step in range(1, 5):  # at each step every order that still has sums to take takes one
        sums = {}
        for n in range(step, 5):
            level = n - step  # what the sum restores: differences of this order
            own = F.col(f"s{n}")
            # Frames below the level hold warm-up residuals of lower orders, which this sum leaves alone.
            sums[f"t{n}"] = F.when(F.col("frame") >= level, own).otherwise(F.lit(0))
        rows = halo.running_sums(rows, sums, block)
        rows = rows.withColumns({f"s{n}": F.when(F.col("frame") >= n - step, F.col(f"t{n}")).otherwise(F.col(f"s{n}")) for n in range(step, 5)}).drop(*sums)
    return rows.select("user_id", "frame", *[F.col(f"s{n}").cast("long").alias(f"x{n}") for n in range(1, 5)])


def rice_costs(values: DataFrame, keys: list[str], most: int = 14) -> DataFrame:
    """``keys, k, bits``: coded bits of the column ``u`` under each Rice parameter; sums are taken before the shuffle."""
    cost = [F.sum(F.shiftright("u", k) + 1 + k).alias(f"b{k}") for k in range(most + 1)]
    wide = values.groupBy(*keys).agg(*cost)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("bits")) for k in range(most + 1)])).alias("c")
    return wide.select(*keys, pairs).select(*keys, "c.k", "c.bits")


def rice_values(stream: DataFrame, block: int = 64) -> DataFrame:
    made = halo.looking_back(stream, 1, lambda w: {"d": F.col("q") - F.lag("q").over(w)}).where("d is not null")
    return made.select("user_id", block_of(block).alias("block"), zigzag(F.col("d")).alias("u"))


def rice_partitions(stream: DataFrame, block: int = 64, orders: int = 4, most: int = 30) -> DataFrame:
    """By block: the partition order whose partitions, each with its best Rice parameter up to ``most``, take the fewest
    bits (of equal ones the lowest), and these bits; a partition's parameter takes 5."""
    made = halo.looking_back(stream, 1, lambda w: {"d": F.col("q") - F.lag("q").over(w)}).where("d is not null")
    finest = F.floor(F.col("frame") % block / (block >> (orders - 1))).cast("int")
    values = made.select("user_id", block_of(block).alias("block"), finest.alias("part"), zigzag(F.col("d")).alias("u"))
    # The finest partitions are summed from the samples, coarser ones from these.
    fine = rice_costs(values, ["user_id", "block", "part"], most)
    each = fine.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).withColumn("part", F.expr(f"shiftright(part, {orders - 1} - o)"))
    best = each.groupBy("user_id", "block", "o", "part", "k").agg(F.sum("bits").alias("bits")).groupBy("user_id", "block", "o", "part").agg((F.min("bits") + 5).alias("bits"))
    total = best.groupBy("user_id", "block", "o").agg(F.sum("bits").alias("bits"))
    least = total.groupBy("user_id", "block").agg(F.min(F.struct("bits", "o")).alias("m"))
    return least.select("user_id", "block", F.col("m.o").alias("partition_order"), F.col("m.bits").alias("bits"))


def cheapest_subframes(stream: DataFrame, block: int = 64, depth: int = 16, most: int = 30) -> DataFrame:
    """By block, the cheapest kind and its bits: 0 constant (one sample), 1 verbatim (all samples), 8 to 12 a fixed
    predictor of order 0 to 4 (warm-up samples, then residuals under the best Rice parameter, 6 bits and 5). A predictor
    looks no further back than its block."""
    r = fixed_residuals(stream).withColumn("block", block_of(block)).withColumn("i", F.col("frame") % block)
    each = r.select("user_id", "block", "i", F.posexplode(F.array(*[F.col(f"r{k}") for k in range(5)])).alias("o", "r")).where("i >= o")
    costs = rice_costs(each.select("user_id", "block", "o", zigzag(F.col("r")).alias("u")), ["user_id", "block", "o"], most)
    fixed = costs.groupBy("user_id", "block", "o").agg((F.min("bits") + 11 + F.col("o") * depth).alias("bits")).select("user_id", "block", (F.col("o") + 8).alias("kind"), "bits")
    whole = r.groupBy("user_id", "block").agg(F.count("*").alias("n"), (F.min("q") == F.max("q")).alias("same"))
    plain = whole.select("user_id", "block", F.lit(1).alias("kind"), (F.col("n") * depth).alias("bits")).unionByName(whole.where("same").select("user_id", "block", F.lit(0).alias("kind"), F.lit(depth).cast("long").alias("bits")))
    best = halo.merged(fixed, plain, "user_id", "block").groupBy("user_id", "block").agg(F.min(F.struct("bits", "kind")).alias("m"))
    return best.select("user_id", "block", F.col("m.kind").alias("kind"), F.col("m.bits").alias("bits"))


def pairs(stream: DataFrame) -> DataFrame:
    """Adjacent samples as left and right of one stereo frame."""
    both = halo.looking_ahead(stream, 1, lambda w: {"b": F.lead("q").over(w)}).where("frame % 2 = 0 and b is not null")
    return both.select("user_id", (F.col("frame") / 2).cast("long").alias("frame"), F.col("q").alias("l"), F.col("b").alias("r"))


def mid_side(frames: DataFrame) -> DataFrame:
    """Mid and side and their exact inverse: side's lowest bit is mid's lost one."""
    s, m = F.col("l") - F.col("r"), F.shiftright(F.col("l") + F.col("r"), 1)
    made = frames.select("*", m.alias("mid"), s.alias("side"))
    twice = F.shiftleft("mid", 1).bitwiseOR(F.col("side").bitwiseAND(F.lit(1).cast("long")))
    return made.withColumns({"left_back": F.shiftright(twice + F.col("side"), 1), "right_back": F.shiftright(twice - F.col("side"), 1)})


def cheapest_stereo(frames: DataFrame, block: int = 64) -> DataFrame:
    """The channel assignment with the smallest sum of magnitudes, by block."""
    ms = mid_side(frames).withColumn("block", block_of(block))
    size = lambda c: F.sum(F.abs(c))
    sums = ms.groupBy("user_id", "block").agg(size("l").alias("l"), size("r").alias("r"), size("mid").alias("m"), size("side").alias("s"))
    options = F.array(*[F.struct((F.col(a) + F.col(b)).alias("cost"), F.lit(i).alias("mode")) for i, (a, b) in enumerate((("l", "r"), ("l", "s"), ("r", "s"), ("m", "s")))])
    best = F.array_min(options)
    return sums.select("user_id", "block", best["mode"].alias("mode"), best["cost"].alias("cost"))


def restore_sided(frames: DataFrame) -> DataFrame:
    """``right_back`` from left and side, ``left_back`` from side and right."""
    return frames.withColumns({"right_back": F.col("l") - F.col("side"), "left_back": F.col("side") + F.col("r")})


def coded_stereo(frames: DataFrame, block: int = 64, most: int = 30) -> DataFrame:
    """The channel assignment of the fewest coded bits, by block: 0 left and right, 1 left and side, 2 side and right, 3 mid
    and side, of equal ones the lowest; each channel under its best Rice parameter, which takes 5 bits."""
    ms = mid_side(frames).withColumn("block", block_of(block))
    channels = F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in ("l", "r", "mid", "side")])
    each = ms.select("user_id", "block", F.explode(channels).alias("c")).select("user_id", "block", "c.ch", zigzag(F.col("c.v")).alias("u"))
    least = rice_costs(each, ["user_id", "block", "ch"], most).groupBy("user_id", "block", "ch").agg((F.min("bits") + 5).alias("bits"))
    own = lambda c: F.max(F.when(F.col("ch") == c, F.col("bits"))).alias(c)
    by = least.groupBy("user_id", "block").agg(*[own(c) for c in ("l", "r", "mid", "side")])
    modes = (("l", "r"), ("l", "side"), ("side", "r"), ("mid", "side"))
    best = F.array_min(F.array(*[F.struct((F.col(a) + F.col(b)).alias("bits"), F.lit(i).alias("mode")) for i, (a, b) in enumerate(modes)]))
    return by.select("user_id", "block", best["mode"].alias("mode"), best["bits"].alias("bits"))


def attacks(stream: DataFrame, block: int = 8, ratio: float = 4.0) -> DataFrame:
    """Blocks whose high-passed energy is over ``ratio`` times that of the block before."""
    high = halo.looking_back(stream, 1, lambda w: {"h": F.col("q") - F.lag("q").over(w)}).withColumn("block", block_of(block))
    energy = high.groupBy("user_id", "block").agg(F.sum(F.col("h") * F.col("h")).alias("energy"))
    before = F.lag("energy").over(Window.partitionBy("user_id").orderBy("block"))
    return energy.withColumn("attack", F.coalesce(F.col("energy") > ratio * before, F.lit(False)))


def activity_runs(stream: DataFrame, level: int = 3200) -> DataFrame:
    """Runs of frames at or over a level: gaps and islands."""
    loud = halo.numbered(stream.where(F.col("q") >= level), "user_id", "frame", "k").withColumn("island", F.col("frame") - F.col("k"))
    return loud.groupBy("user_id", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).drop("island")


def conceal(stream: DataFrame, every: int = 5, block: int | None = None) -> DataFrame:
    """Lost frames (each ``every``-th) are filled with the last good sample, or 0."""
    got = F.when(F.col("frame") % every != every - 1, F.col("q"))
    made = halo.last_known(stream, got, "held", block)
    return made.select("user_id", "frame", F.coalesce("held", F.lit(0)).alias("filled"), got.isNull().alias("lost"))


def missing_frames(received: DataFrame) -> DataFrame:
    """``user_id, first, n``: runs of frame numbers that lie between those received and are not among them."""
    after = Window.partitionBy("user_id").orderBy("frame")
    gap = received.select("user_id", "frame", F.lag("frame").over(after).alias("before")).where("frame > before + 1")
    return gap.select("user_id", (F.col("before") + 1).alias("first"), (F.col("frame") - F.col("before") - 1).alias("n"))
