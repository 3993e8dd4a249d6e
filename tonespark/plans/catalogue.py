"""The registered signal queries, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonespark.functions import bits, checksums
from tonespark.functions.sample import float_to_int, from_log, int_to_float, magnitude_bits, power_compand, power_expand, to_log, unzigzag, zigzag
from tonespark.operators import halo, metrics, ordered
from tonespark.operators.ordered import block_of, by_frame
from tonespark.sources import containers, packets, signals
from tonespark.sources.signals import event_stream, vector_blocks
from tonespark.streaming import blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The event stream and the vector blocks in SQL.
E = """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value / 1024 AS v,
  cast(least(greatest(round(value / 1024 * 32768), -32768), 32767) AS bigint) AS q FROM events)"""
V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)"
PI = "3.141592653589793"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Sample conversion


@register("quantize_i16", f"{E} SELECT user_id, frame, q FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).select("user_id", "frame", "q")


@register("dequantize_i16", f"{E} SELECT user_id, frame, q / 32768.0::double AS x FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).select("user_id", "frame", int_to_float(F.col("q"), 16).alias("x"))


_DEPTHS = ", ".join(f"cast(least(greatest(round(v * {1 << (n - 1)}), -{1 << (n - 1)}), {(1 << (n - 1)) - 1}) AS bigint) AS q{n}" for n in (8, 16, 24, 32))


@register("quantize_all_depths", f"{E} SELECT user_id, frame, {_DEPTHS} FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).select("user_id", "frame", *[float_to_int(F.col("v"), n).alias(f"q{n}") for n in (8, 16, 24, 32)])


@register("wav8_unsigned_map", f"{E} SELECT user_id, frame, (q >> 8) + 128 AS b, (q >> 8) / 128.0::double AS x FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    b = F.shiftright("q", 8) + 128
    return event_stream(s, d).select("user_id", "frame", b.alias("b"), ((b - 128).cast("double") / 128).alias("x"))


@register("zigzag_delta", f"""{E}, d AS (SELECT user_id, frame, q - lag(q) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM e)
SELECT user_id, frame, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u, d AS back FROM d WHERE d IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    made = halo.looking_back(event_stream(s, d), 1, lambda w: {"d": F.col("q") - F.lag("q").over(w)}).where("d is not null")
    return made.select("user_id", "frame", zigzag(F.col("d")).alias("u")).withColumn("back", unzigzag(F.col("u")))


@register("signed_bits", f"""{E}, d AS (SELECT user_id, frame // 64 AS block, q - lag(q) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM e)
SELECT user_id, block, max(CASE WHEN d IN (0, -1) THEN 1 ELSE cast(floor(log2(CASE WHEN d < 0 THEN -d - 1 ELSE d END)) AS int) + 2 END) AS bits FROM d WHERE d IS NOT NULL GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    made = halo.looking_back(event_stream(s, d), 1, lambda w: {"d": F.col("q") - F.lag("q").over(w)}).where("d is not null")
    return made.groupBy("user_id", block_of(64).alias("block")).agg(F.max(magnitude_bits(F.col("d"))).alias("bits"))


@register("wasted_bits", f"{E}, b AS (SELECT user_id, frame // 64 AS block, bit_or(q * 4) AS x FROM e GROUP BY ALL) SELECT user_id, block, CASE WHEN x = 0 THEN 0 ELSE cast(log2(x & -x) AS int) END AS wasted FROM b")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    made = event_stream(s, d).groupBy("user_id", block_of(64).alias("block")).agg(F.bit_or(F.col("q") * 4).alias("x"))
    return made.select("user_id", "block", F.when(x == 0, 0).otherwise(F.length(F.bin(x.bitwiseAND(-x))) - 1).alias("wasted"))


@register("gain_q78", f"{E} SELECT user_id, frame, round(v * pow(10.0::double, (frame % 512 - 256) / 256.0::double / 20), 9) AS x FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    gain = F.pow(F.lit(10.0), (F.col("frame") % 512 - 256) / F.lit(256.0) / 20)
    return event_stream(s, d).select("user_id", "frame", F.round(F.col("v") * gain, 9).alias("x"))


# Framing


@register("block_framing", f"{E} SELECT user_id, frame // 20 AS block, count(*) AS n, min(q) AS low, max(q) AS high, cast(sum(q) AS bigint) AS total FROM e GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).groupBy("user_id", block_of(20).alias("block")).agg(F.count("*").alias("n"), F.min("q").alias("low"), F.max("q").alias("high"), F.sum("q").alias("total"))


@register("deinterleave", f"{E} SELECT user_id, frame // 2 AS frame, cast(frame % 2 AS int) AS ch, q FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).select("user_id", F.floor(F.col("frame") / 2).alias("frame"), (F.col("frame") % 2).cast("int").alias("ch"), "q")


@register("interleave_blocks", f"{V} SELECT vec_id, cast(i AS bigint) AS i, round(e[1 + (i % 2) * 32 + i // 2], 9) AS x FROM v, range(64) AS r(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"), "e")
    at = (F.col("i") % 2 * 32 + F.floor(F.col("i") / 2) + 1).cast("int")
    return made.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.element_at("e", at), 9).alias("x"))


@register("channel_permute_51", f"{V} SELECT vec_id, {', '.join(f'round(e[{k + 1}], 9) AS x{n}' for n, k in enumerate((0, 2, 1, 5, 3, 4)))} FROM v")
def _(s: SparkSession, d: str) -> DataFrame:
    return vector_blocks(s, d).select("vec_id", *[F.round(F.col("e")[k], 9).alias(f"x{n}") for n, k in enumerate((0, 2, 1, 5, 3, 4))])


#: Where each channel of a stream of 3 to 8 stands in the order of its container.
CHANNEL_ORDERS = ((0, 2, 1), (0, 1, 2, 3), (0, 2, 1, 3, 4), (0, 2, 1, 5, 3, 4), (0, 2, 1, 6, 4, 3, 5), (0, 2, 1, 7, 5, 6, 3, 4))


@register("channel_orders", " UNION ALL ".join([f"{V} SELECT vec_id, {len(o)} AS channels, {n} AS place, round(e[{k + 1}], 9) AS x FROM v" if not i + n else f"SELECT vec_id, {len(o)}, {n}, round(e[{k + 1}], 9) FROM v" for i, o in enumerate(CHANNEL_ORDERS) for n, k in enumerate(o)]))
def _(s: SparkSession, d: str) -> DataFrame:
    orders = F.explode(F.array(*[F.struct(F.lit(len(o)).alias("channels"), F.array(*map(F.lit, o)).alias("o")) for o in CHANNEL_ORDERS])).alias("c")
    each = vector_blocks(s, d).select("vec_id", "e", orders).select("vec_id", "e", "c.channels", F.posexplode("c.o").alias("place", "of"))
    return each.select("vec_id", "channels", "place", F.round(F.get("e", F.col("of")), 9).alias("x"))


_LOG = "cast(round(log2(greatest(q, 1)::double) * 128) AS bigint)"
_POWER = "cast(sign(q - 8000) * round(pow(abs(q - 8000), 0.75)) AS bigint)"


@register("companding", f"{E} SELECT user_id, frame, {_LOG} AS log_q7, round(pow(2.0::double, {_LOG} / 128.0), 6) AS back, {_POWER} AS power, round(sign({_POWER}) * pow(abs({_POWER})::double, 1 / 0.75::double), 6) AS expanded FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    made = event_stream(s, d).select("user_id", "frame", to_log(F.col("q")).alias("log_q7"), power_compand(F.col("q") - 8000).alias("power"))
    return made.withColumns({"back": F.round(from_log(F.col("log_q7")), 6), "expanded": F.round(power_expand(F.col("power")), 6)})


# Prediction


_LAGS = ", ".join(f"lag(q, {k}) OVER w AS q{k}" for k in range(1, 5))


@register("fixed_residuals", f"""{E}, l AS (SELECT user_id, frame, q, {_LAGS} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, frame, q, q AS r0, q - q1 AS r1, q - 2 * q1 + q2 AS r2, q - 3 * q1 + 3 * q2 - q3 AS r3, q - 4 * q1 + 6 * q2 - 4 * q3 + q4 AS r4 FROM l""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.fixed_residuals(event_stream(s, d))


@register("fixed_restore", f"{E} SELECT user_id, frame, q AS x1, q AS x2, q AS x3, q AS x4 FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.restore_fixed(ordered.fixed_residuals(event_stream(s, d)))


@register("fixed_best_order", f"""{E}, l AS (SELECT user_id, frame, q, {_LAGS} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
a AS (SELECT user_id, frame // 64 AS block, sum(abs(q)) AS a0, sum(abs(q - q1)) AS a1, sum(abs(q - 2 * q1 + q2)) AS a2, sum(abs(q - 3 * q1 + 3 * q2 - q3)) AS a3, sum(abs(q - 4 * q1 + 6 * q2 - 4 * q3 + q4)) AS a4 FROM l WHERE q4 IS NOT NULL GROUP BY ALL)
SELECT user_id, block, CASE least(a0, a1, a2, a3, a4) WHEN a0 THEN 0 WHEN a1 THEN 1 WHEN a2 THEN 2 WHEN a3 THEN 3 ELSE 4 END AS best, cast(least(a0, a1, a2, a3, a4) AS bigint) AS cost FROM a""")
def _(s: SparkSession, d: str) -> DataFrame:
    r = ordered.fixed_residuals(event_stream(s, d)).where("r4 is not null")
    sums = r.groupBy("user_id", block_of(64).alias("block")).agg(*[F.sum(F.abs(f"r{k}")).alias(f"a{k}") for k in range(5)])
    best = F.array_min(F.array(*[F.struct(F.col(f"a{k}").alias("cost"), F.lit(k).alias("best")) for k in range(5)]))
    return sums.select("user_id", "block", best["best"].alias("best"), best["cost"].alias("cost"))


_AC = "list_sum(list_transform(range({0}, 64), lambda i: e[i + 1] * e[i + 1 - {0}]))"


def _autocorrelation(lag: str) -> str:
    return f"aggregate(sequence({lag}, 63), 0D, (a, i) -> a + e[i] * e[i - {lag}])"


@register("autocorrelation", f"{V} SELECT vec_id, label, cast(k AS int) AS lag, round({_AC.format('k')}, 6) AS r FROM v, range(13) AS t(k)")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", "label", "e", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("lag"))
    return made.select("vec_id", "label", "lag", F.round(F.expr(_autocorrelation("lag")), 6).alias("r"))


@register("pitch_lag", f"{V}, r AS (SELECT vec_id, k, round({_AC.format('k')}, 9) AS r FROM v, range(4, 33) AS t(k)) SELECT vec_id, cast(arg_max(k, (r, -k)) AS int) AS lag FROM r GROUP BY vec_id")
def _(s: SparkSession, d: str) -> DataFrame:
    best = F.expr(f"array_max(transform(sequence(4, 32), k -> named_struct('r', round({_autocorrelation('k')}, 9), 'm', -k)))")
    return vector_blocks(s, d).select("vec_id", (-best["m"]).cast("int").alias("lag"))


@register("levinson_o2", f"{V}, r AS (SELECT vec_id, {', '.join(f'{_AC.format(k)} AS r{k}' for k in range(3))} FROM v) SELECT vec_id, round(r1 * (r0 - r2) / (r0 * r0 - r1 * r1), 6) AS a1, round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 6) AS a2 FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    r = vector_blocks(s, d).select("vec_id", *[F.expr(_autocorrelation(str(k))).alias(f"r{k}") for k in range(3)])
    return r.selectExpr("vec_id", "round(r1 * (r0 - r2) / (r0 * r0 - r1 * r1), 6) AS a1", "round((r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1), 6) AS a2")


@register("block_energy", f"{V}, s AS (SELECT *, list_sum(list_transform(e, lambda x: x * x)) AS p FROM v) SELECT vec_id, round(p, 6) AS energy, round(sqrt(p / 64), 6) AS rms, round(list_max(list_transform(e, lambda x: abs(x))), 9) AS peak FROM s")
def _(s: SparkSession, d: str) -> DataFrame:
    p = F.expr("aggregate(e, 0D, (a, x) -> a + x * x)")
    return vector_blocks(s, d).withColumn("p", p).select("vec_id", F.round("p", 6).alias("energy"), F.round(F.sqrt(F.col("p") / 64), 6).alias("rms"), F.round(F.expr("array_max(transform(e, x -> abs(x)))"), 9).alias("peak"))


@register("normalise_unit", f"{V}, s AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS p FROM v) SELECT vec_id, i, round(e[i + 1] / p, 6) AS x FROM s, (SELECT cast(range AS int) AS i FROM range(64))")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).withColumn("p", F.sqrt(F.expr("aggregate(e, 0D, (a, x) -> a + x * x)")))
    return made.select("vec_id", "p", F.posexplode("e").alias("i", "x")).select("vec_id", "i", F.round(F.col("x") / F.col("p"), 6).alias("x"))


# Entropy coding

_RICE = f"""{E}, d AS (SELECT user_id, frame // 64 AS block, q - lag(q) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM e),
u AS (SELECT user_id, block, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u FROM d WHERE d IS NOT NULL),
c AS (SELECT user_id, block, cast(k AS int) AS k, cast(sum((u >> k) + 1 + k) AS bigint) AS bits FROM u, range(15) AS t(k) GROUP BY ALL)"""


@register("rice_cost_by_k", f"{_RICE} SELECT user_id, block, k, bits FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.rice_costs(ordered.rice_values(event_stream(s, d)), ["user_id", "block"])


@register("rice_best_k", f"{_RICE} SELECT user_id, block, arg_min(k, (bits, k)) AS k, min(bits) AS bits FROM c GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    costs = ordered.rice_costs(ordered.rice_values(event_stream(s, d)), ["user_id", "block"])
    best = F.min(F.struct("bits", "k")).alias("b")
    return costs.groupBy("user_id", "block").agg(best).select("user_id", "block", "b.k", "b.bits")


@register("symbol_entropy", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, n, round(-log2(n / (SELECT sum(n) FROM c)::double), 6) AS bits FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    c = _table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select("event_type", "n", F.round(-F.log2(F.col("n") / F.col("all")), 6).alias("bits"))


# Stereo

_PAIRS = f"{E}, n AS (SELECT user_id, frame, q AS l, lead(q) OVER (PARTITION BY user_id ORDER BY frame) AS r FROM e), p AS (SELECT user_id, frame // 2 AS frame, l, r FROM n WHERE frame % 2 = 0 AND r IS NOT NULL)"


@register("mid_side", f"{_PAIRS} SELECT user_id, frame, l, r, (l + r) >> 1 AS mid, l - r AS side, l AS left_back, r AS right_back FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.mid_side(ordered.pairs(event_stream(s, d)))


@register("stereo_cheapest", f"""{_PAIRS}, b AS (SELECT user_id, frame // 64 AS block, sum(abs(l)) AS l, sum(abs(r)) AS r, sum(abs((l + r) >> 1)) AS m, sum(abs(l - r)) AS s FROM p GROUP BY ALL)
SELECT user_id, block, CASE least(l + r, l + s, r + s, m + s) WHEN l + r THEN 0 WHEN l + s THEN 1 WHEN r + s THEN 2 ELSE 3 END AS mode, cast(least(l + r, l + s, r + s, m + s) AS bigint) AS cost FROM b""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.cheapest_stereo(ordered.pairs(event_stream(s, d)))


@register("sided_restored", f"{_PAIRS} SELECT user_id, frame, l, r, l AS left_back, r AS right_back FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    made = ordered.mid_side(ordered.pairs(event_stream(s, d))).select("user_id", "frame", "l", "r", "side")
    return ordered.restore_sided(made).select("user_id", "frame", "l", "r", "left_back", "right_back")


@register("stereo_coded", f"""{_PAIRS}, c AS (SELECT user_id, frame // 64 AS block, unnest(['l', 'r', 'm', 's']) AS ch, unnest([l, r, (l + r) >> 1, l - r]) AS v FROM p),
k AS (SELECT user_id, block, ch, k, sum(((CASE WHEN v < 0 THEN -2 * v - 1 ELSE 2 * v END) >> k) + 1 + k) AS bits FROM c, range(31) AS t(k) GROUP BY ALL),
b AS (SELECT user_id, block, ch, min(bits) + 5 AS bits FROM k GROUP BY ALL), w AS (SELECT user_id, block, max(bits) FILTER (ch = 'l') AS l, max(bits) FILTER (ch = 'r') AS r, max(bits) FILTER (ch = 'm') AS m, max(bits) FILTER (ch = 's') AS s FROM b GROUP BY ALL)
SELECT user_id, block, CASE least(l + r, l + s, r + s, m + s) WHEN l + r THEN 0 WHEN l + s THEN 1 WHEN r + s THEN 2 ELSE 3 END AS mode, cast(least(l + r, l + s, r + s, m + s) AS bigint) AS bits FROM w""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.coded_stereo(ordered.pairs(event_stream(s, d)))


@register("square_polar_inverse", f"""{V} SELECT vec_id, cast(i AS int) AS i,
round(CASE WHEN e[i + 1] > 0 AND e[i + 33] <= 0 THEN e[i + 1] + e[i + 33] WHEN e[i + 1] <= 0 AND e[i + 33] <= 0 THEN e[i + 1] - e[i + 33] ELSE e[i + 1] END, 9) AS mag,
round(CASE WHEN e[i + 33] <= 0 THEN e[i + 1] WHEN e[i + 1] > 0 THEN e[i + 1] - e[i + 33] ELSE e[i + 1] + e[i + 33] END, 9) AS ang FROM v, range(32) AS t(i)""")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "e").select("vec_id", "i", F.expr("e[i]").alias("m"), F.expr("e[i + 32]").alias("a"))
    m, a = F.col("m"), F.col("a")
    mag = F.when((m > 0) & (a <= 0), m + a).when((m <= 0) & (a <= 0), m - a).otherwise(m)
    return made.select("vec_id", "i", F.round(mag, 9).alias("mag"), F.round(F.when(a <= 0, m).when(m > 0, m - a).otherwise(m + a), 9).alias("ang"))


# Windows and transforms

_I = f"(i + 0.5) / 64 * {PI}"


@register("windows_64", f"""{V} SELECT vec_id, cast(i AS int) AS i, round(e[i + 1] * sin({_I}), 8) AS sine, round(e[i + 1] * (0.5 - 0.5 * cos(2 * {PI} * i / 64)), 8) AS hann, round(e[i + 1] * sin({PI} / 2 * pow(sin({_I}), 2)), 8) AS power_complementary,
round(e[i + 1] * CASE WHEN i < 16 THEN 0.5 - 0.5 * cos({PI} * i / 16) WHEN i >= 48 THEN 0.5 - 0.5 * cos({PI} * (63 - i) / 16) ELSE 1.0 END, 8) AS tukey FROM v, range(64) AS t(i)""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Blocks under each window."""
    return vector_blocks(s, d).select("vec_id", F.posexplode("e").alias("i", "x")).selectExpr(
        "vec_id", "i", f"round(x * sin((i + 0.5D) / 64 * {PI}D), 8) AS sine", f"round(x * (0.5D - 0.5D * cos(2 * {PI}D * i / 64)), 8) AS hann", f"round(x * sin({PI}D / 2 * pow(sin((i + 0.5D) / 64 * {PI}D), 2)), 8) AS power_complementary",
        f"round(x * CASE WHEN i < 16 THEN 0.5D - 0.5D * cos({PI}D * i / 16) WHEN i >= 48 THEN 0.5D - 0.5D * cos({PI}D * (63 - i) / 16) ELSE 1.0D END, 8) AS tukey",
    )


@register("overlap_add", f"""{V}, n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS b, e FROM v)
SELECT label, b * 32 + i AS frame, round(sum(e[i + 1] * pow(sin({_I}), 2)), 6) AS x FROM n, range(64) AS t(i) GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    n = halo.numbered(vector_blocks(s, d), "label", "vec_id", "b").select("label", "b", F.posexplode("e").alias("i", "x"))
    gain = F.pow(F.sin((F.col("i") + F.lit(0.5)) / 64 * F.lit(float(PI))), F.lit(2.0))
    return n.groupBy("label", (F.col("b") * 32 + F.col("i")).alias("frame")).agg(F.round(F.sum(F.col("x") * gain), 6).alias("x"))


_DFT = f"list_sum(list_transform(range(64), lambda i: e[i + 1] * {{}}(2 * {PI} * k * i / 64)))"


@register("dft_power", f"{V} SELECT vec_id, cast(k AS int) AS k, round(pow({_DFT.format('cos')}, 2) + pow({_DFT.format('sin')}, 2), 5) AS power FROM v, range(9) AS t(k)")
def _(s: SparkSession, d: str) -> DataFrame:
    part = lambda f: f"aggregate(sequence(0, 63), 0D, (a, i) -> a + e[i] * {f}(2 * {PI}D * k * i / 64))"
    made = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    return made.selectExpr("vec_id", "k", f"round(pow({part('cos')}, 2) + pow({part('sin')}, 2), 5) AS power")


@register("haar1", f"{V} SELECT vec_id, cast(i AS int) AS i, round((e[2 * i + 1] + e[2 * i + 2]) / sqrt(2), 9) AS low, round((e[2 * i + 1] - e[2 * i + 2]) / sqrt(2), 9) AS high FROM v, range(32) AS t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return made.selectExpr("vec_id", "i", "round((e[2 * i] + e[2 * i + 1]) / sqrt(2), 9) AS low", "round((e[2 * i] - e[2 * i + 1]) / sqrt(2), 9) AS high")


_BARK = "13 * atan(0.00076 * f) + 3.5 * atan(pow(f / 7500, 2))"


@register("psychoacoustic_curves", f"""WITH t AS (SELECT event_id, 20 + value * 40 AS f FROM events) SELECT event_id, round({_BARK}, 6) AS bark,
round(3.64 * pow(f / 1000, -0.8) - 6.5 * exp(-0.6 * pow(f / 1000 - 3.3, 2)) + 0.001 * pow(f / 1000, 4), 6) AS threshold,
round(20 * log10(pow(12194.0::double, 2) * pow(f, 4) / ((f * f + pow(20.6, 2)) * sqrt((f * f + pow(107.7, 2)) * (f * f + pow(737.9, 2))) * (f * f + pow(12194.0::double, 2)))) + 2.0, 6) AS a_weight FROM t""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Of frequencies: those that the events' values stand for."""
    t = _table(s, d, "events").selectExpr("event_id", "20 + value * 40 AS f")
    return t.selectExpr(
        "event_id", "round(13 * atan(0.00076D * f) + 3.5D * atan(pow(f / 7500, 2)), 6) AS bark", "round(3.64D * pow(f / 1000, -0.8D) - 6.5D * exp(-0.6D * pow(f / 1000 - 3.3D, 2)) + 0.001D * pow(f / 1000, 4), 6) AS threshold",
        "round(20 * log10(pow(12194D, 2) * pow(f, 4) / ((f * f + pow(20.6D, 2)) * sqrt((f * f + pow(107.7D, 2)) * (f * f + pow(737.9D, 2))) * (f * f + pow(12194D, 2)))) + 2.0D, 6) AS a_weight",
    )


@register("band_flatness", f"""{V}, x AS (SELECT vec_id, i // 16 AS band, pow(e[i + 1], 2) + 1e-12 AS p FROM v, range(64) AS t(i))
SELECT vec_id, cast(band AS int) AS band, round(avg(p), 9) AS energy, round(exp(avg(ln(p))) / avg(p), 6) AS flatness FROM x GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = vector_blocks(s, d).select("vec_id", F.posexplode("e").alias("i", "x")).selectExpr("vec_id", "cast(floor(i / 16) AS int) AS band", "x * x + 1e-12D AS p")
    return x.groupBy("vec_id", "band").agg(F.round(F.avg("p"), 9).alias("energy"), F.round(F.exp(F.avg(F.log("p"))) / F.avg("p"), 6).alias("flatness"))


@register("render_line", f"""{V}, s AS (SELECT vec_id, j, j * 8 AS x0, cast(round(e[j * 8 + 1] * 100) AS bigint) AS y0, cast(round(e[j * 8 + 9] * 100) AS bigint) AS y1 FROM v, range(7) AS t(j))
SELECT vec_id, x0 + i AS bin, y0 + CASE WHEN y1 >= y0 THEN ((y1 - y0) * i) // 8 ELSE -(((y0 - y1) * i) // 8) END AS y FROM s, range(8) AS u(i)""")
def _(s: SparkSession, d: str) -> DataFrame:
    v = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    seg = v.selectExpr("vec_id", "cast(j * 8 AS long) AS x0", "cast(round(e[j * 8] * 100) AS long) AS y0", "cast(round(e[j * 8 + 8] * 100) AS long) AS y1")
    bins = seg.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return bins.selectExpr("vec_id", "x0 + i AS bin", "y0 + CASE WHEN y1 >= y0 THEN ((y1 - y0) * i) div 8 ELSE -(((y0 - y1) * i) div 8) END AS y")


# Detection, gaps, positions


@register("transient_attack", f"""{E}, h AS (SELECT user_id, frame // 8 AS block, q - lag(q) OVER (PARTITION BY user_id ORDER BY frame) AS h FROM e),
b AS (SELECT user_id, block, cast(sum(h * h) AS bigint) AS energy FROM h GROUP BY ALL)
SELECT user_id, block, energy, coalesce(energy > 4 * lag(energy) OVER (PARTITION BY user_id ORDER BY block), false) AS attack FROM b""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.attacks(event_stream(s, d))


@register("activity_runs", f"{E}, a AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM e WHERE q >= 3200) SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM a GROUP BY user_id, g")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.activity_runs(event_stream(s, d))


@register("session_runs", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM r GROUP BY user_id, run""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("n")).select("user_id", "first", "n")


@register("gap_conceal", f"{E}, g AS (SELECT user_id, frame, CASE WHEN frame % 5 <> 4 THEN q END AS got FROM e) SELECT user_id, frame, coalesce(last_value(got IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS filled, got IS NULL AS lost FROM g")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.conceal(event_stream(s, d))


@register("crossfade", f"{V} SELECT vec_id, cast(i AS int) AS i, round(pow(sin((i + 0.5) / 32 * {PI} / 2), 2) * e[i + 33] + (1 - pow(sin((i + 0.5) / 32 * {PI} / 2), 2)) * e[i + 1], 9) AS x FROM v, range(32) AS t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    w = f"pow(sin((i + 0.5D) / 32 * {PI}D / 2), 2)"
    made = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return made.selectExpr("vec_id", "i", f"round({w} * e[i + 32] + (1 - {w}) * e[i], 9) AS x")


@register("seek_range", f"{E} SELECT user_id, frame, q FROM e WHERE frame >= 10 AND frame < 30")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).where("frame >= 10 and frame < 30").select("user_id", "frame", "q")


@register("gapless_trim", f"{E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, frame - 5 AS frame, q FROM n WHERE frame >= 5 AND frame < n - 7")
def _(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    n = e.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    return n.where("frame >= 5 and frame < n - 7").select("user_id", (F.col("frame") - 5).alias("frame"), "q")


@register("preskip_granule", f"""{E}, p AS (SELECT user_id, frame, 120 + q % 240 AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY frame) AS granule FROM p)
SELECT user_id, frame, cast(greatest(granule - n, 312) - 312 AS bigint) AS first, cast(least(greatest(granule - 312, 0), 9600) AS bigint) AS "end" FROM g""")
def _(s: SparkSession, d: str) -> DataFrame:
    g = halo.running_sums(event_stream(s, d).select("user_id", "frame", (F.col("q") % 240 + 120).alias("n")), {"granule": F.col("n")})
    return g.selectExpr("user_id", "frame", "greatest(granule - n, 312L) - 312 AS first", "least(greatest(granule - 312, 0L), 9600L) AS end")


@register("asof_lookup", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders), m AS (SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer JOIN o ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY c_custkey)
SELECT c_custkey, o_orderkey FROM m""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = _table(s, d, "orders").where("o_orderdate <= timestamp'1996-01-01'").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return _table(s, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


# Quality metrics

_T = f"{E}, s AS (SELECT user_id, frame, v AS s, cast(least(greatest(round(v * 128), -128), 127) AS bigint) / 128.0::double AS t FROM e)"


@register("snr_stream", f"{_T} SELECT user_id, CASE WHEN sum((s - t) * (s - t)) > 0 THEN round(10 * log10(sum(s * s) / sum((s - t) * (s - t))), 6) END AS snr_db, round(max(abs(s - t)), 9) AS peak_error FROM s GROUP BY user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.snr(metrics.requantised(event_stream(s, d)))


SNR_SEGMENTAL = f"""{_T}, b AS (SELECT user_id, frame // 20 AS block, count(*) AS n, sum(s * s) AS p, sum((s - t) * (s - t)) AS d FROM s GROUP BY ALL),
r AS (SELECT user_id, least(greatest(10 * log10(greatest(p, 1e-10) / greatest(d, 1e-10)), -10.0), 35.0) AS r FROM b WHERE n = 20) SELECT user_id, round(avg(r), 6) AS segmental_db, count(*) AS segments FROM r GROUP BY user_id"""


@register("snr_segmental", SNR_SEGMENTAL)
def snr_segmental(s: SparkSession, d: str) -> DataFrame:
    return metrics.segmental_snr(metrics.requantised(event_stream(s, d)))


@register("tone_fit", f"""{_T}, f AS (SELECT user_id, s, sin(frame * (2 * {PI} * 900::double / 48000)) AS a, cos(frame * (2 * {PI} * 900::double / 48000)) AS b FROM s),
g AS (SELECT user_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(s * a) AS xa, sum(s * b) AS xb FROM f GROUP BY user_id)
SELECT user_id, round(sqrt(pow((xa * bb - xb * ab) / (aa * bb - ab * ab), 2) + pow((xb * aa - xa * ab) / (aa * bb - ab * ab), 2)), 6) AS amplitude FROM g WHERE aa * bb - ab * ab > 1e-6""")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.tone_fit(metrics.requantised(event_stream(s, d)), 900.0, 48_000.0)


@register("first_mismatch", f"{_T} SELECT user_id, min(frame) AS first_frame, count(*) AS mismatches FROM s WHERE abs(s - t) > 0.003 GROUP BY user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.first_mismatch(metrics.requantised(event_stream(s, d)), 0.003)


# Headers and containers


@register("toc_decode", """SELECT doc_id, cast(b AS int) AS b, cast(b >> 3 AS int) AS config, cast(b & 3 AS int) AS code, (b & 4) <> 0 AS stereo,
CASE WHEN b >> 3 < 12 THEN 'silk' WHEN b >> 3 < 16 THEN 'hybrid' ELSE 'celt' END AS mode,
cast(CASE WHEN b >> 3 < 12 THEN [10000, 20000, 40000, 60000][1 + (b >> 3) % 4] WHEN b >> 3 < 16 THEN [10000, 20000][1 + (b >> 3) % 2] ELSE [2500, 5000, 10000, 20000][1 + (b >> 3) % 4] END AS int) AS micros FROM (SELECT doc_id, cast('0x' || substr(md5(coalesce(text, '')), 1, 2) AS int) AS b FROM documents)""")
def _(s: SparkSession, d: str) -> DataFrame:
    """First bytes of packets: those of the documents' digests."""
    packets = _table(s, d, "documents").selectExpr("doc_id", "unhex(md5(coalesce(text, ''))) AS packet")
    b = packets.selectExpr("doc_id", "cast(conv(hex(substring(packet, 1, 1)), 16, 10) AS int) AS b")
    t = b.selectExpr("doc_id", "b", "shiftright(b, 3) AS config", "b & 3 AS code", "(b & 4) <> 0 AS stereo")
    return t.selectExpr(
        "*", "CASE WHEN config < 12 THEN 'silk' WHEN config < 16 THEN 'hybrid' ELSE 'celt' END AS mode",
        "CASE WHEN config < 12 THEN array(10000, 20000, 40000, 60000)[config % 4] WHEN config < 16 THEN array(10000, 20000)[config % 2] ELSE array(2500, 5000, 10000, 20000)[config % 4] END AS micros",
    )


@register("sniff_extension", """SELECT page_id, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext, starts_with(coalesce(html, ''), '<!DOCTYPE') AS magic FROM pages""")
def _(s: SparkSession, d: str) -> DataFrame:
    path = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return _table(s, d, "pages").select("page_id", F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.startswith(F.coalesce("html", F.lit("")), F.lit("<!DOCTYPE")).alias("magic"))


@register("md5_text", "SELECT doc_id, md5(text) AS md5, octet_length(encode(text)) AS octets FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("octets"))


@register("crc_text")
def _(s: SparkSession, d: str) -> DataFrame:
    raw = _table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    kinds = {"crc8": checksums.CRC8, "crc16": checksums.CRC16, "crc16_side": checksums.CRC16_SIDE, "crc32_page": checksums.CRC32_PAGE}
    return raw.select("doc_id", *[checksums.crc(*k)("b").alias(n) for n, k in kinds.items()])


_BACK = f"{E} SELECT user_id, frame, q FROM e"


def _frames(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", (F.col("segment") * 32 + F.col("i")).alias("frame"), "q")


@register("wav_roundtrip", _BACK)
def _(s: SparkSession, d: str) -> DataFrame:
    return _frames(signals.scan_wav(signals.wav_files(signals.segments(event_stream(s, d), 32))))


_DEPTHS = f"""{E}, d AS (SELECT unnest([8, 16, 24, 32]) AS depth),
x AS (SELECT user_id, frame, depth, cast(CASE WHEN depth = 8 THEN q >> 8 ELSE q * (1::bigint << (depth - 16)) END AS bigint) AS a FROM e, d)
SELECT user_id, cast(depth AS int) AS depth, frame, 0 AS ch, a AS q FROM x UNION ALL SELECT user_id, cast(depth AS int), frame, 1, -1 - a FROM x"""


def _two_channels(s: SparkSession, d: str, depth: int) -> DataFrame:
    a = F.shiftright("q", 8) if depth == 8 else F.col("q") * (1 << (depth - 16))
    return event_stream(s, d).select("user_id", "frame", a.alias("a"), (-1 - a).alias("b"))


def _placed(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("user_id", "depth", (F.col("segment") * length + F.col("frame")).alias("frame"), "ch", "q")


@register("wav_depths", _DEPTHS)
def _(s: SparkSession, d: str) -> DataFrame:
    files = None
    for depth in (8, 16, 24, 32):
        parts = containers.interleave(_two_channels(s, d, depth), 31, depth, "little", depth == 8, "user_id")
        made = containers.wave_container(parts, depth, 48_000, "user_id", "segment")
        files = made if files is None else files.unionByName(made)
    return _placed(containers.scan_wave(files, "user_id", "segment"), 31)


@register("aifc_depths", _DEPTHS)
def _(s: SparkSession, d: str) -> DataFrame:
    files = None
    for depth, kind in ((8, "NONE"), (16, "sowt"), (24, "ni24"), (32, "twos")):
        parts = containers.interleave(_two_channels(s, d, depth), 31, depth, containers.AIFC_ORDER[kind], False, "user_id")
        made = containers.aifc_container(parts, depth, 44_100, kind, "user_id", "segment")
        files = made if files is None else files.unionByName(made)
    return _placed(containers.scan_aiff_chunks(files, "user_id", "segment"), 31)


@register("ogg_packets", """SELECT doc_id // 7 AS serial, row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1 AS packet,
octet_length(encode(coalesce(text, ''))) // 1020 + 1 AS pages, true AS whole, md5(coalesce(text, '')) AS md5 FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    said = _table(s, d, "documents").select(F.floor(F.col("doc_id") / 7).alias("serial"), F.col("doc_id").alias("packet"), F.col("text").cast("binary").alias("data"))
    back = packets.scan_packets(packets.packet_pages(said, 4).select("page"))
    return back.select("serial", "packet", "pages", "whole", F.md5("data").alias("md5"))


@register("pcm_roundtrip_le", _BACK)
def _(s: SparkSession, d: str) -> DataFrame:
    return _frames(signals.scan_raw(signals.segments(event_stream(s, d), 32), "little"))


@register("pcm_roundtrip_be", _BACK)
def _(s: SparkSession, d: str) -> DataFrame:
    return _frames(signals.scan_raw(signals.segments(event_stream(s, d), 32, "big"), "big"))


@register("aiff_roundtrip", _BACK)
def _(s: SparkSession, d: str) -> DataFrame:
    return _frames(signals.scan_aiff(signals.aiff_files(signals.segments(event_stream(s, d), 32, "big"))))


@register("ogg_roundtrip", _BACK)
def _(s: SparkSession, d: str) -> DataFrame:
    pages = signals.scan_ogg(signals.ogg_pages(signals.segments(event_stream(s, d), 32)))
    return _frames(signals.scan_raw(pages.where("good"), "little"))


@register("ogg_granules", f"""{E}, p AS (SELECT user_id, frame // 32 AS segment, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, segment, cast(CASE WHEN segment = 0 THEN 2 ELSE 0 END + CASE WHEN segment = max(segment) OVER (PARTITION BY user_id) THEN 4 ELSE 0 END AS int) AS flags,
cast(sum(n) OVER (PARTITION BY user_id ORDER BY segment) AS bigint) AS granule, true AS good FROM p""")
def _(s: SparkSession, d: str) -> DataFrame:
    return signals.scan_ogg(signals.ogg_pages(signals.segments(event_stream(s, d), 32))).drop("data")


for _name, _layout in (("mpeg_header_bits", bits.MPEG_AUDIO), ("adts_bits", bits.ADTS), ("flac_frame_bits", bits.FLAC_FRAME)):
    _digits = sum(w for _, w in _layout) // 4
    _each = ", ".join(f"(v >> {shift}) & {mask} AS {field}" for field, shift, mask in bits.shifts(_layout))

    @register(_name, f"WITH h AS (SELECT doc_id, cast('0x' || substr(md5(coalesce(text, '')), 1, {_digits}) AS bigint) AS v FROM documents) SELECT doc_id, {_each} FROM h")
    def _(s: SparkSession, d: str, layout: bits.Layout = _layout, digits: int = _digits) -> DataFrame:
        v = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")
        return _table(s, d, "documents").select("doc_id", v.alias("v")).select("doc_id", *bits.bit_fields(F.col("v"), layout))


# Streams


@register("stream_closed_windows", """WITH w AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(s: SparkSession, d: str) -> DataFrame:
    return blocks.run_to_end(blocks.closed_windows(blocks.read_events(s, d)), "windows")


@register("stream_full_blocks", f"{E} SELECT user_id, frame // 20 AS block, min(q) AS low, max(q) AS high, cast(sum(q) AS bigint) AS total FROM e GROUP BY ALL HAVING count(*) = 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return blocks.full_blocks(blocks.read_events(s, d, 4), "blocks")


@register("stream_all_blocks", f"{E} SELECT user_id, frame // 20 AS block, min(q) AS low, max(q) AS high, cast(sum(q) AS bigint) AS total FROM e GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    return blocks.full_blocks(blocks.read_events(s, d, 4), "blocks", flush=True)


# Roll-ups


@register("orders_grouping_sets", """SELECT r_name, o_orderstatus, cast(grouping(r_name) * 2 + grouping(o_orderstatus) AS bigint) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, o_orderstatus), (o_orderstatus))""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = _table(s, d, "orders").join(_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = o.groupingSets([["r_name", "o_orderstatus"], ["o_orderstatus"]], "r_name", "o_orderstatus")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("mismatched_frames", f"{_T} SELECT user_id, frame, s AS v FROM s EXCEPT SELECT user_id, frame, t FROM s")
def _(s: SparkSession, d: str) -> DataFrame:
    both = metrics.requantised(event_stream(s, d))
    return both.select("user_id", "frame", F.col("s").alias("v")).subtract(both.select("user_id", "frame", "t"))


@register("stream_summary", f"{E} SELECT user_id, count(*) AS frames, round(count(*) / 48000.0::double, 9) AS seconds, min(q) AS low, max(q) AS high, count(DISTINCT q) AS kinds FROM e GROUP BY user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).groupBy("user_id").agg(F.count("*").alias("frames"), F.round(F.count("*") / F.lit(48000.0), 9).alias("seconds"), F.min("q").alias("low"), F.max("q").alias("high"), F.countDistinct("q").alias("kinds"))


for _name, _sql in (("cube", "CUBE (r_name, o_orderstatus)"), ("rollup", "ROLLUP (r_name, o_orderstatus)")):

    @register(f"orders_{_name}", f"SELECT r_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY {_sql}")
    def _(s: SparkSession, d: str, how: str = _name) -> DataFrame:
        o = _table(s, d, "orders").join(_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return getattr(o, how)("r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("streams_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("streams_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "customer").join(_table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("loudest_frames", f"{E} SELECT user_id, frame, q FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY q DESC, frame) <= 3")
def _(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("q"), "frame")
    return event_stream(s, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "frame", "q")


@register("tumbling_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    g = _table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@register("sliding_half_overlap", f"{E} SELECT user_id, frame // 10 - k AS w, count(*) AS n, cast(sum(q) AS bigint) AS total FROM e, range(2) AS t(k) WHERE frame // 10 - k >= 0 GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d).withColumn("w", F.explode(F.array(block_of(10), block_of(10) - 1))).where("w >= 0")
    return e.groupBy("user_id", "w").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


# Further modules register theirs with ``register``.
from tonespark.plans import analysis_queries, code_queries, file_queries, framing_queries, scan_queries, spectra_queries  # noqa: E402, F401
