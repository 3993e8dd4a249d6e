"""Joins by order and range, linear prediction, header fields, helpers, redundancy and relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.functions import checksums
from tonespark.functions.lpc import with_predictor
from tonespark.operators import halo, metrics, ordered, relational
from tonespark.plans.catalogue import _T, PI, E, V, _table, register
from tonespark.sources.signals import event_stream, vector_blocks

# Joins by order and range


@register("asof_events", """WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_id % 3 <> 0), r AS (SELECT user_id, event_id, ts FROM events WHERE event_id % 3 = 0)
SELECT l.user_id, l.event_id, r.event_id AS last_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = _table(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("frame"), "event_id")
    made = relational.asof_join(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").withColumnRenamed("event_id", "last_id"), "last_id", "last_id", 7 * 86_400_000_000)
    return made.select("user_id", "event_id", "last_id")


@register("page_of_frame", f"""{E}, p AS (SELECT user_id, frame AS start FROM e WHERE q % 5 = 0) SELECT e.user_id, e.frame, p.start, e.frame - p.start AS discard FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.frame >= p.start""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    made = relational.asof_join(e.select("user_id", "frame"), e.where("q % 5 = 0").select("user_id", "frame", F.col("frame").alias("start")), "start", "start", halo.BLOCK)
    return made.select("user_id", "frame", "start", (F.col("frame") - F.col("start")).alias("discard"))


_BANDS = ((0, 4), (4, 8), (8, 13), (13, 21), (21, 34), (34, 64))


@register("band_gains", f"""{V}, b AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {z})' for k, (a, z) in enumerate(_BANDS))}) AS t(band, first, stop)), x AS (SELECT vec_id, cast(i AS int) AS i, e[i + 1] AS x FROM v, range(64) AS r(i))
SELECT vec_id, i, band, round(x * (band + 1) / 8.0::double, 9) AS scaled FROM x JOIN b ON i >= first AND i < stop""")
def _(s: SparkSession, d: str) -> DataFrame:
    bands = s.createDataFrame([(k, a, z) for k, (a, z) in enumerate(_BANDS)], "band int, first int, stop int")
    bins = vector_blocks(s, d).select("vec_id", F.posexplode("e").alias("i", "x"))
    made = relational.range_join(bins, bands, "i", "first", "stop", 16)
    return made.select("vec_id", "i", "band", F.round(F.col("x") * (F.col("band") + 1) / F.lit(8.0), 9).alias("scaled"))


_WORD = f"0.1 * cos({PI} * k * (i + 0.5) / 64)"


@register("nearest_codeword", f"""{V}, c AS (SELECT vec_id, k, list_sum(list_transform(range(64), lambda i: pow(e[i + 1] - {_WORD}, 2))) AS error FROM v, range(16) AS t(k))
SELECT vec_id, cast(arg_min(k, (round(error, 9), k)) AS int) AS word, round(min(error), 6) AS error FROM c GROUP BY vec_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    # The codebook is a rule of 16 words: each block is held against all, no pair leaves its row.
    word = f"0.1D * cos({PI}D * k * (i + 0.5D) / 64)"
    best = F.expr(f"array_min(transform(sequence(0, 15), k -> named_struct('error', round(aggregate(sequence(0, 63), 0D, (a, i) -> a + pow(e[i] - {word}, 2)), 9), 'k', k)))")
    return vector_blocks(s, d).select("vec_id", best.alias("b")).select("vec_id", F.col("b.k").alias("word"), F.round("b.error", 6).alias("error"))


@register("lockstep", f"{E} SELECT a.user_id, count(*) AS frames, cast(sum(a.q * b.q) AS bigint) AS product, cast(max(abs(a.q - b.q)) AS bigint) AS apart FROM e a JOIN e b ON b.user_id = a.user_id + 1 AND b.frame = a.frame GROUP BY a.user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d).select("user_id", "frame", "q")
    other = e.select((F.col("user_id") - 1).alias("user_id"), "frame", F.col("q").alias("b"))
    made = e.join(other, ["user_id", "frame"]).groupBy("user_id")
    return made.agg(F.count("*").alias("frames"), F.sum(F.col("q") * F.col("b")).alias("product"), F.max(F.abs(F.col("q") - F.col("b"))).alias("apart"))


@register("coupled_channels", """WITH c AS (SELECT label % 3 AS tag, vec_id AS source, 0.5 AS gain, embedding AS x FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT vec_id, label % 3 AS tag, embedding AS y FROM embeddings WHERE vec_id % 5 = 1)
SELECT vec_id, cast(i AS int) AS i, round(any_value(y[i + 1]::double) + sum(gain * x[i + 1]::double), 6) AS x FROM t JOIN c USING (tag), range(64) AS r(i) GROUP BY vec_id, i""")
def _(s: SparkSession, d: str) -> DataFrame:
    v = vector_blocks(s, d).withColumn("tag", F.col("label") % 3)
    # A tag's channels are summed before the join: a target meets one row.
    sums = v.where("vec_id % 50 = 0").select("tag", F.posexplode("e").alias("i", "x")).groupBy("tag", "i").agg(F.sum(F.col("x") * 0.5).alias("added"))
    targets = v.where("vec_id % 5 = 1").select("vec_id", "tag", F.posexplode("e").alias("i", "y"))
    return targets.join(sums, ["tag", "i"]).select("vec_id", "i", F.round(F.col("y") + F.col("added"), 6).alias("x"))


# Quality


@register("full_comparison", f"""{_T}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s), a AS (SELECT user_id, frame, s AS v FROM n), b AS (SELECT user_id, frame, t AS v FROM n WHERE frame < n - 3 UNION ALL SELECT user_id, frame + 1000000, 0.0 FROM n WHERE frame < 2),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.frame, b.frame) AS frame, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.user_id = b.user_id AND a.frame = b.frame)
SELECT user_id, min(CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) > 0.003 THEN frame END) AS first_frame, count(CASE WHEN abs(a - b) > 0.003 THEN 1 END) AS mismatches, count(*) - count(b) AS missing, count(*) - count(a) AS extra FROM j GROUP BY user_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    both = metrics.requantised(event_stream(s, d))
    size = both.groupBy("user_id").agg(F.count("*").alias("n"))
    test = both.join(size, "user_id").where("frame < n - 3").select("user_id", "frame", F.col("t").alias("v"))
    more = both.where("frame < 2").select("user_id", (F.col("frame") + 1_000_000).alias("frame"), F.lit(0.0).alias("v"))
    return relational.compare(both.select("user_id", "frame", F.col("s").alias("v")), test.unionByName(more), 0.003)


def _tone(x: str) -> str:
    return f"{x}(frame * (2 * {PI} * 900::double / 48000))"


@register("tone_purity", f"""{_T}, f AS (SELECT user_id, s, {_tone('sin')} AS a, {_tone('cos')} AS b FROM s),
g AS (SELECT user_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(s * a) AS xa, sum(s * b) AS xb, sum(s * s) AS xx FROM f GROUP BY user_id),
h AS (SELECT user_id, xx, xa * (xa * bb - xb * ab) / (aa * bb - ab * ab) + xb * (xb * aa - xa * ab) / (aa * bb - ab * ab) AS fit FROM g WHERE aa * bb - ab * ab > 1e-6)
SELECT user_id, round(fit / xx, 6) AS purity FROM h WHERE xx > 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.tone_purity(metrics.requantised(event_stream(s, d)), 900.0, 48_000.0)


_HANN, _F = f"(0.5 - 0.5 * cos(2 * {PI} * j / 32))", "(k * 1500.0::double)"
_A = f"pow(pow(12194.0::double, 2) * pow({_F}, 4) / (({_F} * {_F} + pow(20.6, 2)) * sqrt(({_F} * {_F} + pow(107.7, 2)) * ({_F} * {_F} + pow(737.9, 2))) * ({_F} * {_F} + pow(12194.0::double, 2))), 2)"


@register("a_weighted_snr", f"""{_T}, w AS (SELECT user_id, frame // 16 - h AS w, frame - (frame // 16 - h) * 16 AS j, s, s - t AS e FROM s, range(2) AS r(h)),
full_ AS (SELECT user_id, w FROM w GROUP BY ALL HAVING count(*) = 32 AND w >= 0),
p AS (SELECT user_id, w, k, pow(sum(s * {_HANN} * cos(2 * {PI} * k * j / 32)), 2) + pow(sum(s * {_HANN} * sin(2 * {PI} * k * j / 32)), 2) AS s2, pow(sum(e * {_HANN} * cos(2 * {PI} * k * j / 32)), 2) + pow(sum(e * {_HANN} * sin(2 * {PI} * k * j / 32)), 2) AS e2
  FROM w JOIN full_ USING (user_id, w), range(1, 17) AS r2(k) GROUP BY ALL)
SELECT user_id, round(10 * log10(sum(s2 * {_A}) / sum(e2 * {_A})), 5) AS snr_db FROM p GROUP BY user_id HAVING sum(e2 * {_A}) > 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    return metrics.a_weighted_snr(metrics.requantised(event_stream(s, d)), 32, 48_000.0)


@register("md5_of_samples", f"{E} SELECT user_id, md5(string_agg(format('{{:04x}}', q & 65535), '' ORDER BY frame)) AS md5 FROM e GROUP BY user_id")
def _(s: SparkSession, d: str) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex(F.col("q").bitwiseAND(F.lit(65535).cast("long"))), 4, "0"))
    rows = event_stream(s, d).select("user_id", "frame", hexed.cast("binary").alias("data"))
    return checksums.ordered_md5(rows, "user_id", "frame", "data")


# Prediction

_R = ", ".join(f"list_sum(list_transform(range({k}, 64), lambda i: (q[i + 1] * q[i + 1 - {k}])::double)) AS r{k}" for k in range(5))


def _levinson_sql(order: int) -> str:
    """The recursion written out, a step a table: coefficients a1 to a_order."""
    out, have = ["l0 AS (SELECT *, r0 AS err FROM r)"], []
    for m in range(1, order + 1):
        inner = " - ".join([f"r{m}", *(f"{a} * r{m - j}" for j, a in enumerate(have, 1))])
        new = [f"{a} - k{m} * {b}" for a, b in zip(have, reversed(have), strict=True)]
        names = [f"a{m}_{j}" for j in range(1, m)]
        out.append(f"k{m}_ AS (SELECT *, CASE WHEN err > 0 THEN ({inner}) / err ELSE 0 END AS k{m} FROM l{m - 1})")
        keep = ", ".join(["* EXCLUDE (err)", *(f"{x} AS {n}" for x, n in zip(new, names, strict=True)), f"k{m} AS a{m}_{m}", f"err * (1 - k{m} * k{m}) AS err"])
        out.append(f"l{m} AS (SELECT {keep} FROM k{m}_)")
        have = [*names, f"a{m}_{m}"]
    return ", ".join(out)


_COEFFICIENTS = f"""{V}, b AS (SELECT vec_id, list_transform(e, lambda x: cast(round(x * 4096) AS bigint)) AS q FROM v), r AS (SELECT vec_id, q, {_R} FROM b), {_levinson_sql(4)},
z AS (SELECT *, greatest(abs(a4_1), abs(a4_2), abs(a4_3), abs(a4_4)) AS top FROM l4),
y AS (SELECT *, cast(least(greatest(11 - (CASE WHEN top > 0 THEN floor(log2(top)) ELSE 0 END + 1), 0), 15) AS bigint) AS shift FROM z),
c1_ AS (SELECT *, a4_1 * pow(2.0::double, shift) AS u1, least(greatest(round(a4_1 * pow(2.0::double, shift)), -2048), 2047) AS c1 FROM y),
c2_ AS (SELECT *, u1 - c1 + a4_2 * pow(2.0::double, shift) AS u2, least(greatest(round(u1 - c1 + a4_2 * pow(2.0::double, shift)), -2048), 2047) AS c2 FROM c1_),
c3_ AS (SELECT *, u2 - c2 + a4_3 * pow(2.0::double, shift) AS u3, least(greatest(round(u2 - c2 + a4_3 * pow(2.0::double, shift)), -2048), 2047) AS c3 FROM c2_),
c4_ AS (SELECT *, least(greatest(round(u3 - c3 + a4_4 * pow(2.0::double, shift)), -2048), 2047) AS c4 FROM c3_),
c AS (SELECT vec_id, q, cast(c1 AS bigint) AS c1, cast(c2 AS bigint) AS c2, cast(c3 AS bigint) AS c3, cast(c4 AS bigint) AS c4, shift FROM c4_)"""


def _predicted(s: SparkSession, d: str) -> DataFrame:
    q = vector_blocks(s, d).select("vec_id", F.expr("transform(e, x -> cast(round(x * 4096) AS bigint))").alias("q"))
    r = F.expr("transform(sequence(0, 4), lag -> aggregate(sequence(lag, 63), 0D, (a, i) -> a + q[i] * q[i - lag]))")
    return with_predictor(q.select("vec_id", "q", r.alias("r")), 4, 12)


@register("lpc_coefficients", f"{_COEFFICIENTS} SELECT vec_id, c1, c2, c3, c4, shift FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d).select("vec_id", *[F.col("coefficients")[k].alias(f"c{k + 1}") for k in range(4)], "shift")


@register("lpc_residual", f"{_COEFFICIENTS} SELECT vec_id, cast(i AS int) AS i, q[i + 1] - ((c1 * q[i] + c2 * q[i - 1] + c3 * q[i - 2] + c4 * q[i - 3]) >> shift) AS residual FROM c, range(4, 64) AS t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    made = _predicted(s, d).withColumn("i", F.explode(F.sequence(F.lit(4), F.lit(63))))
    return made.select("vec_id", "i", F.expr("q[i] - shiftright(aggregate(sequence(0, 3), 0L, (a, k) -> a + coefficients[k] * q[i - 1 - k]), cast(shift AS int))").alias("residual"))


@register("fir_filter", f"{E} SELECT user_id, frame, 2 * q + 5 * lag(q, 1, 0) OVER w - 3 * lag(q, 2, 0) OVER w + lag(q, 3, 0) OVER w AS y FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)")
def _(s: SparkSession, d: str) -> DataFrame:
    taps = (2, 5, -3, 1)
    made = halo.looking_back(event_stream(s, d), 3, lambda w: {"y": sum((F.lag("q", k, 0).over(w) * c for k, c in enumerate(taps[1:], 1)), F.col("q") * taps[0])})
    return made.select("user_id", "frame", "y")


_PARTS = f"""{E}, d AS (SELECT user_id, frame, q - lag(q) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM e), u AS (SELECT user_id, frame // 64 AS block, frame % 64 AS i, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS u FROM d WHERE d IS NOT NULL),
c AS (SELECT user_id, block, o, i // (64 >> o) AS part, k, sum((u >> k) + 1 + k) AS bits FROM u, range(4) AS t(o), range(31) AS r(k) GROUP BY ALL),
m AS (SELECT user_id, block, o, part, min(bits) + 5 AS bits FROM c GROUP BY ALL), t AS (SELECT user_id, block, o, sum(bits) AS bits FROM m GROUP BY ALL)"""


@register("rice_partitions", f"{_PARTS} SELECT user_id, block, cast(arg_min(o, (bits, o)) AS int) AS partition_order, cast(min(bits) AS bigint) AS bits FROM t GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.rice_partitions(event_stream(s, d))


_WIDE_LAGS = ", ".join(f"lag(q, {k}) OVER w AS q{k}" for k in range(1, 5))


@register("cheapest_subframe", f"""{E}, l AS (SELECT user_id, frame, q, {_WIDE_LAGS} FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
r AS (SELECT user_id, frame // 64 AS block, frame % 64 AS i, q, [q, q - q1, q - 2 * q1 + q2, q - 3 * q1 + 3 * q2 - q3, q - 4 * q1 + 6 * q2 - 4 * q3 + q4] AS r FROM l),
u AS (SELECT user_id, block, o, CASE WHEN r[o + 1] >= 0 THEN 2 * r[o + 1] ELSE -2 * r[o + 1] - 1 END AS u FROM r, range(5) AS t(o) WHERE i >= o),
c AS (SELECT user_id, block, o, k, sum((u >> k) + 1 + k) AS bits FROM u, range(31) AS t2(k) GROUP BY ALL), f AS (SELECT user_id, block, o + 8 AS kind, min(bits) + 11 + 16 * o AS bits FROM c GROUP BY user_id, block, o),
w AS (SELECT user_id, block, count(*) AS n, min(q) = max(q) AS same FROM r GROUP BY ALL), a AS (SELECT * FROM f UNION ALL SELECT user_id, block, 1, 16 * n FROM w UNION ALL SELECT user_id, block, 0, 16 FROM w WHERE same)
SELECT user_id, block, cast(arg_min(kind, (bits, kind)) AS int) AS kind, cast(min(bits) AS bigint) AS bits FROM a GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.cheapest_subframes(event_stream(s, d))


# Header fields, from bytes that are put together here

#: Kilobits a second by index, of version 1 and of the lower versions; rates by index of version 1.
_KBPS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_RATES = (44100, 48000, 32000)
#: Rates by index of the ADTS header.
_ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def _ids(s: SparkSession, d: str, n: int) -> DataFrame:
    """The documents, and numbers below ``n`` of which their headers are made."""
    return _table(s, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("id"))


@register("mpeg_headers", f"""WITH h AS (SELECT doc_id, id % 3 AS v, 1 + id // 3 % 14 AS b, id // 42 % 3 AS r, id // 126 % 2 AS pad FROM (SELECT doc_id, doc_id % 252 AS id FROM documents) AS t WHERE doc_id % 10 <> 9),
k AS (SELECT *, CASE WHEN v = 0 THEN {list(_KBPS[1])}[b + 1] ELSE {list(_KBPS[2])}[b + 1] END AS kbps, {list(_RATES)}[r + 1] >> v AS rate FROM h)
SELECT doc_id, cast(kbps AS int) AS kbps, cast(rate AS int) AS rate, cast((CASE WHEN v = 0 THEN 1152 ELSE 576 END) * kbps * 125 // rate + pad AS int) AS frame_bytes FROM k""")
def _(s: SparkSession, d: str) -> DataFrame:
    from tonespark.functions.bits import MPEG_AUDIO, bit_fields

    version = "CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END"
    # Each tenth header is damaged: its sync has a bit less.
    made = _ids(s, d, 252).selectExpr("doc_id", f"((2047L - IF(doc_id % 10 = 9, 1, 0)) << 21) | (({version}) << 19) | (1 << 17) | (1 << 16) | ((1 + id div 3 % 14) << 12) | ((id div 42 % 3) << 10) | ((id div 126 % 2) << 9) AS v")
    f = made.select("doc_id", *bit_fields(F.col("v"), MPEG_AUDIO))
    lower = (F.col("version") != 3).cast("int")
    pick = lambda table, at: F.get(F.array(*[F.lit(x) for x in table]), at.cast("int"))
    kbps = F.when(lower == 0, pick(_KBPS[1], F.col("bitrate"))).otherwise(pick(_KBPS[2], F.col("bitrate")))
    halved = F.when(F.col("version") == 3, 1).when(F.col("version") == 2, 2).otherwise(4)
    f = f.where("sync = 2047 and version <> 1 and layer = 1 and bitrate between 1 and 14 and rate < 3").select("doc_id", "padding", lower.alias("lower"), kbps.alias("kbps"), F.floor(pick(_RATES, F.col("rate")) / halved).cast("int").alias("hz"))
    size = F.floor(F.when(F.col("lower") == 0, 1152).otherwise(576) * F.col("kbps") * 125 / F.col("hz")) + F.col("padding")
    return f.select("doc_id", "kbps", F.col("hz").alias("rate"), size.cast("int").alias("frame_bytes"))


@register("adts_headers", f"SELECT doc_id, cast(id % 4 + 1 AS int) AS object_type, cast({list(_ADTS_RATES)}[1 + id % 13] AS int) AS rate, cast(1 + id % 7 AS int) AS channels, cast(7 + id * 11 % 8000 AS int) AS frame_length, cast(CASE WHEN id % 2 = 0 THEN 9 ELSE 7 END AS int) AS header_bytes FROM (SELECT doc_id, doc_id % 500 AS id FROM documents) AS t WHERE doc_id % 10 <> 9")
def _(s: SparkSession, d: str) -> DataFrame:
    from tonespark.functions.bits import ADTS, bit_fields

    made = _ids(s, d, 500).selectExpr("doc_id AS n", "((4095L - IF(doc_id % 10 = 9, 1, 0)) << 44) | ((id % 2) << 40) | ((id % 4) << 38) | ((id % 13) << 34) | ((1 + id % 7) << 30) | ((7 + id * 11 % 8000) << 13) | (2047L << 2) AS v")
    f = made.select("n", *bit_fields(F.col("v"), ADTS)).where("sync = 4095 and layer = 0 and rate < 13")
    rate = F.get(F.array(*[F.lit(x) for x in _ADTS_RATES]), F.col("rate").cast("int"))
    return f.select(F.col("n").alias("doc_id"), (F.col("profile") + 1).cast("int").alias("object_type"), rate.alias("rate"), F.col("channels").cast("int").alias("channels"), F.col("frame_length").cast("int").alias("frame_length"), F.when(F.col("protection") == 1, 7).otherwise(9).alias("header_bytes"))


def _at(data: str, first: int, octets: int, little: bool = False) -> Column:
    """The unsigned integer at byte ``first`` (from 1)."""
    h = F.hex(F.substring(data, first, octets))
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(octets))]) if little else h, 16, 10).cast("long")


@register("flac_frames", "SELECT doc_id, cast(CASE id % 2 WHEN 0 THEN 1 + id * 7 % 256 ELSE 1 + id * 977 % 65536 END AS int) AS block_size, cast(1 + id % 8 AS int) AS channels, cast(CASE id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 24 END AS int) AS depth, id * 31 AS number, id % 10 <> 9 AS good FROM (SELECT doc_id, doc_id % 2000 AS id FROM documents) AS t")
def _(s: SparkSession, d: str) -> DataFrame:
    n, size = F.col("id") * 31, F.when(F.col("id") % 2 == 0, F.col("id") * 7 % 256).otherwise(F.col("id") * 977 % 65536)
    coded = F.when(n < 128, F.lpad(F.hex(n), 2, "0")).when(n < 2048, F.concat(F.hex(F.shiftright(n, 6) + 0xC0), F.hex(n % 64 + 0x80)))
    coded = coded.otherwise(F.concat(F.hex(F.shiftright(n, 12) + 0xE0), F.hex(F.shiftright(n, 6) % 64 + 0x80), F.hex(n % 64 + 0x80)))
    width = F.when(F.col("id") % 2 == 0, 2).otherwise(4)
    third = F.when(F.col("id") % 2 == 0, "6").otherwise("7")
    head = F.concat(F.lit("FFF8"), third, F.lit("9"), F.hex(F.col("id") % 8), F.when(F.col("id") % 3 == 0, "2").when(F.col("id") % 3 == 1, "8").otherwise("C"), coded, F.lpad(F.hex(size), width, "0"))
    made = _ids(s, d, 2000).select("doc_id", "id", F.unhex(head).alias("h"))
    made = made.withColumn("crc", checksums.crc(*checksums.CRC8)("h")).withColumn("data", F.concat("h", F.unhex(F.lpad(F.hex(F.when(F.col("id") % 10 == 9, (F.col("crc") + 1) % 256).otherwise(F.col("crc"))), 2, "0"))))
    # From here on only ``data`` is looked at.
    first = _at("data", 5, 1)
    octets = F.when(first < 0x80, 1).when(first < 0xE0, 2).otherwise(3)
    follow = lambda k: F.conv(F.hex(F.substr("data", F.lit(5 + k), F.lit(1))), 16, 10).cast("long") % 64
    number = F.when(octets == 1, first).when(octets == 2, first % 32 * 64 + follow(1)).otherwise(first % 16 * 4096 + follow(1) * 64 + follow(2))
    code = F.shiftright(_at("data", 3, 1), 4)
    wide = F.when(code == 6, 1).otherwise(2)
    size = F.conv(F.hex(F.substr("data", octets + 5, wide)), 16, 10).cast("long") + 1
    end = octets + 5 + wide
    parsed = made.select("doc_id", "data", size.cast("int").alias("block_size"), (F.shiftright(_at("data", 4, 1), 4) + 1).cast("int").alias("channels"), F.shiftright(_at("data", 4, 1), 1).bitwiseAND(F.lit(7).cast("long")).alias("depth_code"), number.alias("number"), F.substr("data", F.lit(1), end - 1).alias("covered"), F.conv(F.hex(F.substr("data", end, F.lit(1))), 16, 10).cast("long").alias("told"))
    depth = F.when(F.col("depth_code") == 1, 8).when(F.col("depth_code") == 4, 16).otherwise(24)
    return parsed.select("doc_id", "block_size", "channels", depth.alias("depth"), "number", (checksums.crc(*checksums.CRC8)("covered") == F.col("told")).alias("good"))


@register("stream_info", "SELECT doc_id, 16 + id AS least_block, 4096 + id AS most_block, cast(8000 + id * 97 AS bigint) AS rate, cast(1 + id % 8 AS bigint) AS channels, cast(4 + id % 29 AS bigint) AS depth, id * 1000003 AS frames FROM (SELECT doc_id, doc_id % 10000 AS id FROM documents) AS t")
def _(s: SparkSession, d: str) -> DataFrame:
    h = lambda x, n: F.lpad(F.hex(x), n, "0")
    i = F.col("id")
    packed = F.shiftleft(8000 + i * 97, 44) + F.shiftleft(i % 8, 41) + F.shiftleft(3 + i % 29, 36) + i * 1000003
    made = _ids(s, d, 10_000).select("doc_id", F.unhex(F.concat(h(i + 16, 4), h(i + 4096, 4), F.lit("0" * 12), h(packed, 16), F.lit("AB" * 16))).alias("data"))
    fields = {"rate": F.shiftright(_at("data", 11, 3), 4), "channels": F.shiftright(_at("data", 13, 1), 1) % 8 + 1, "depth": _at("data", 13, 1) % 2 * 16 + F.shiftright(_at("data", 14, 1), 4) + 1, "frames": _at("data", 14, 5) % (1 << 36)}
    return made.select("doc_id", _at("data", 1, 2).alias("least_block"), _at("data", 3, 2).alias("most_block"), *[c.alias(n) for n, c in fields.items()])


@register("opus_heads", "SELECT doc_id, cast(1 + id % 2 AS bigint) AS channels, 312 + id AS pre_skip, cast(48000 - id AS bigint) AS rate, cast(id % 600 - 300 AS bigint) AS gain_q8, 0::bigint AS family FROM (SELECT doc_id, doc_id % 40000 AS id FROM documents) AS t WHERE doc_id % 10 <> 9")
def _(s: SparkSession, d: str) -> DataFrame:
    from tonespark.functions.sample import little_endian_hex as le

    i, byte = F.col("id"), F.when(F.col("doc_id") % 10 == 9, "11").otherwise("01")  # a version from 16 on is refused
    made = _ids(s, d, 40_000).select("doc_id", F.unhex(F.concat(F.lit("4F70757348656164"), byte, le(1 + i % 2, 1), le(312 + i, 2), le(48000 - i, 4), le(i % 600 - 300, 2), F.lit("00"))).alias("data"))
    good = (F.hex(F.substring("data", 1, 8)) == "4F70757348656164") & (_at("data", 9, 1) < 16)
    gain = _at("data", 17, 2, True)
    return made.where(good).select("doc_id", _at("data", 10, 1).alias("channels"), _at("data", 11, 2, True).alias("pre_skip"), _at("data", 13, 4, True).alias("rate"), F.when(gain >= 1 << 15, gain - (1 << 16)).otherwise(gain).alias("gain_q8"), _at("data", 19, 1).alias("family"))


@register("opus_packets", """WITH p AS (SELECT doc_id, id % 256 AS b, id // 256 * 5 AS m FROM (SELECT doc_id, doc_id % 2560 AS id FROM documents) AS t), q AS (SELECT *, CASE WHEN b & 3 = 0 THEN 1 WHEN b & 3 < 3 THEN 2 ELSE m END AS frames,
CASE WHEN b >> 3 < 12 THEN [10000, 20000, 40000, 60000][1 + (b >> 3) % 4] WHEN b >> 3 < 16 THEN [10000, 20000][1 + (b >> 3) % 2] ELSE [2500, 5000, 10000, 20000][1 + (b >> 3) % 4] END AS micros FROM p)
SELECT doc_id, cast(frames AS int) AS frames, cast(frames * micros AS bigint) AS micros, frames BETWEEN 1 AND 48 AND frames * micros <= 120000 AS valid FROM q""")
def _(s: SparkSession, d: str) -> DataFrame:
    packet = F.unhex(F.concat(F.lpad(F.hex(F.col("id") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("id") / 256) * 5), 2, "0")))
    t = _ids(s, d, 2560).select("doc_id", packet.alias("data")).select("doc_id", F.shiftright(_at("data", 1, 1), 3).alias("config"), (_at("data", 1, 1) % 4).alias("code"), (_at("data", 2, 1) % 64).alias("told"))
    frames = F.when(F.col("code") == 0, 1).when(F.col("code") < 3, 2).otherwise(F.col("told"))
    micros = F.expr("CASE WHEN config < 12 THEN array(10000, 20000, 40000, 60000)[config % 4] WHEN config < 16 THEN array(10000, 20000)[config % 2] ELSE array(2500, 5000, 10000, 20000)[config % 4] END")
    made = t.select("doc_id", frames.cast("int").alias("frames"), micros.cast("long").alias("each"))
    return made.select("doc_id", "frames", (F.col("frames") * F.col("each")).alias("micros"), (F.col("frames").between(1, 48) & (F.col("frames") * F.col("each") <= 120_000)).alias("valid"))


# Helpers


@register("integer_helpers", f"""{E} SELECT user_id, frame, cast(floor(sqrt(abs(q))) AS bigint) AS root, cast(bit_count((1::bigint << (64 - length(ltrim(bit_string((abs(q))::bigint::bit, 64)::varchar, '0')))) - 1) AS int) AS leading,
cast(list_sum(list_transform(range(16), lambda b: ((q & 65535) >> b & 1) << (15 - b))) AS bigint) AS reversed, (q * 12345) >> 16 AS product,
round(1 / (1 + exp(-q / 4096.0::double)), 9) AS sigmoid, round_even(q / 100.0::double, 0) AS even, round(list_sum(list_transform(range(12), lambda k: pow(pow(q / 16384.0::double / 2, k) / list_product(list_transform(range(1, k + 1), lambda j: j::double)), 2))), 9) AS bessel,
round((CASE WHEN (q & 65535) & 32768 <> 0 THEN -1 ELSE 1 END) * ((q & 65535) & 1023) * pow(2.0::double, (((q & 65535) >> 10) & 31) - 20), 9) AS packed FROM e""".replace("list_product(list_transform(range(1, k + 1), lambda j: j::double))", "gamma(k + 1)").replace("cast(bit_count((1::bigint << (64 - length(ltrim(bit_string((abs(q))::bigint::bit, 64)::varchar, '0')))) - 1) AS int)", "cast(CASE WHEN q = 0 THEN 64 ELSE 63 - floor(log2(abs(q))) END AS int)"))
def _(s: SparkSession, d: str) -> DataFrame:
    q, low = F.col("q"), F.col("q").bitwiseAND(F.lit(65535).cast("long"))
    turned = F.conv(F.reverse(F.lpad(F.bin(low), 16, "0")), 2, 10).cast("long")
    bessel = F.expr("aggregate(sequence(0, 11), 0D, (a, k) -> a + pow(pow(q / 16384D / 2, k) / factorial(k), 2))")
    sign = F.when(low.bitwiseAND(F.lit(32768).cast("long")) != 0, -1).otherwise(1)
    packed = sign * low.bitwiseAND(F.lit(1023).cast("long")) * F.pow(F.lit(2.0), F.shiftright(low, 10).bitwiseAND(F.lit(31).cast("long")) - 20)
    leading = F.when(q == 0, 64).otherwise(64 - F.length(F.bin(F.abs(q))))
    return event_stream(s, d).select(
        "user_id", "frame", F.floor(F.sqrt(F.abs(q))).alias("root"), leading.alias("leading"), turned.alias("reversed"), F.shiftright(q * 12345, 16).alias("product"),
        F.round(1 / (1 + F.exp(-q / F.lit(4096.0))), 9).alias("sigmoid"), F.bround(q / F.lit(100.0), 0).alias("even"), F.round(bessel, 9).alias("bessel"), F.round(packed, 9).alias("packed"),
    )


@register("pulse_counts", f"{V}, w AS (SELECT n, k, CASE WHEN k = 0 THEN 1::bigint ELSE list_sum(list_transform(range(1, least(n, k) + 1), lambda j: (pow(2, j) * gamma(n + 1) / gamma(j + 1) / gamma(n - j + 1) * gamma(k) / gamma(j) / gamma(k - j + 1))::bigint))::bigint END AS ways FROM range(1, 9) AS a(n), range(9) AS b(k)), b AS (SELECT vec_id, g, cast(least(8, list_sum(list_transform(range(8), lambda i: abs(round(e[g * 8 + i + 1] * 8))))) AS int) AS k FROM v, range(8) AS t(g)) SELECT vec_id, cast(g AS int) AS band, b.k, ways FROM b JOIN w ON w.k = b.k AND n = 8")
def _(s: SparkSession, d: str) -> DataFrame:
    # Row by row of the recursion V(n, k) = V(n - 1, k) + V(n, k - 1) + V(n - 1, k - 1), an array over k for each n.
    first = "array(transform(sequence(0, 8), k -> IF(k = 0, 1L, 2L)))"
    row = "aggregate(sequence(1, 8), array(1L), (a, k) -> concat(a, array(element_at(rows, -1)[k] + a[k - 1] + element_at(rows, -1)[k - 1])))"
    made = s.range(0, 1, 1, 1).select(F.posexplode(F.expr(f"aggregate(sequence(2, 8), {first}, (rows, n) -> concat(rows, array({row})))")).alias("i", "p"))
    ways = made.select((F.col("i") + 1).alias("n"), F.posexplode("p").alias("k", "ways")).where("n = 8").drop("n")
    # Bands of 8 values with the pulses that they take: how many vectors of so many pulses there are.
    band = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("band"))
    pulses = band.selectExpr("vec_id", "band", "cast(least(8D, aggregate(slice(e, band * 8 + 1, 8), 0D, (a, x) -> a + abs(round(x * 8)))) AS int) AS k")
    return pulses.join(F.broadcast(ways), "k").select("vec_id", "band", "k", "ways")


@register("gain_track", f"{E}, g AS (SELECT user_id, frame, sum(q % 7 - 3) OVER (PARTITION BY user_id ORDER BY frame) AS g FROM e) SELECT user_id, frame, cast(least(greatest(g, -20), 20) AS bigint) AS level, round(pow(10.0::double, least(greatest(g, -20), 20) / 20.0::double), 9) AS gain FROM g")
def _(s: SparkSession, d: str) -> DataFrame:
    made = halo.running_sums(event_stream(s, d).select("user_id", "frame", (F.col("q") % 7 - 3).alias("x")), {"g": F.col("x")})
    level = F.least(F.greatest("g", F.lit(-20)), F.lit(20)).cast("long")
    return made.select("user_id", "frame", level.alias("level"), F.round(F.pow(F.lit(10.0), level / F.lit(20.0)), 9).alias("gain"))


@register("short_blocks", f"{V} SELECT vec_id, cast(i AS int) AS i, round(e[1 + (i % 3) * 21 + i // 3], 9) AS x FROM v, range(63) AS t(i)")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    return made.select("vec_id", "i", F.round(F.expr("e[i % 3 * 21 + i div 3]"), 9).alias("x"))


@register("alias_butterflies", f"""{V}, b AS (SELECT vec_id, e, j, m, 1 / sqrt(1 + pow(0.6 / (m + 1), 2)) AS cs, 0.6 / (m + 1) / sqrt(1 + pow(0.6 / (m + 1), 2)) AS ca FROM v, range(1, 4) AS r(j), range(8) AS t(m))
SELECT vec_id, cast(j * 16 - 1 - m AS int) AS low, round(e[j * 16 - m] * cs - e[j * 16 + m + 1] * ca, 9) AS x, round(e[j * 16 + m + 1] * cs + e[j * 16 - m] * ca, 9) AS y FROM b""")
def _(s: SparkSession, d: str) -> DataFrame:
    made = vector_blocks(s, d).select("vec_id", "e", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("m"))
    made = made.selectExpr("vec_id", "j * 16 - 1 - m AS low", "e[j * 16 - 1 - m] AS a", "e[j * 16 + m] AS b", "0.6D / (m + 1) AS c").selectExpr("*", "1 / sqrt(1 + c * c) AS cs", "c / sqrt(1 + c * c) AS ca")
    return made.selectExpr("vec_id", "low", "round(a * cs - b * ca, 9) AS x", "round(b * cs + a * ca, 9) AS y")


@register("predicted_side", f"{E}, p AS (SELECT user_id, frame, q, lag(q, 1, 0) OVER w + 2 * q + lead(q, 1, 0) OVER w AS low FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)) SELECT user_id, frame, (low * 2731) >> 15 AS side, q + ((low * 2731) >> 15) AS l, q - ((low * 2731) >> 15) AS r FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    back = halo.looking_back(event_stream(s, d).select("user_id", "frame", "q"), 1, lambda w: {"b": F.lag("q", 1, 0).over(w)})
    both = halo.looking_ahead(back, 1, lambda w: {"a": F.lead("q", 1, 0).over(w)})
    side = F.shiftright((F.col("b") + 2 * F.col("q") + F.col("a")) * 2731, 15)
    return both.select("user_id", "frame", side.alias("side"), (F.col("q") + side).alias("l"), (F.col("q") - side).alias("r"))


# Losses, redundancy, ends


@register("missing_frames", f"{E}, g AS (SELECT user_id, frame FROM e WHERE q % 11 <> 0), n AS (SELECT user_id, frame, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM g) SELECT user_id, b + 1 AS first, frame - b - 1 AS n FROM n WHERE frame > b + 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return ordered.missing_frames(event_stream(s, d).where("q % 11 <> 0"))


@register("redundant_frames", f"{E}, a AS (SELECT user_id, frame, CASE WHEN q % 4 <> 0 THEN q END AS own, lead(CASE WHEN q % 4 <> 0 THEN q END) OVER (PARTITION BY user_id ORDER BY frame) IS NOT NULL AS after, q FROM e) SELECT user_id, frame, coalesce(own, CASE WHEN after THEN (q >> 4) << 4 END) AS q, own IS NULL AND after AS recovered FROM a")
def _(s: SparkSession, d: str) -> DataFrame:
    # A packet carries its frame and a coarse copy of the one before; every fourth kind of packet is lost.
    lost = F.col("q") % 4 == 0
    sent = halo.looking_back(event_stream(s, d).select("user_id", "frame", "q"), 1, lambda w: {"copy": F.shiftleft(F.shiftright(F.lag("q").over(w), 4), 4)})
    got = sent.select("user_id", "frame", F.when(~lost, F.col("q")).alias("own"), F.when(~lost, F.col("copy")).alias("copy"))
    made = halo.looking_ahead(got, 1, lambda w: {"next_copy": F.lead("copy").over(w)})
    return made.select("user_id", "frame", F.coalesce("own", "next_copy").alias("q"), (F.col("own").isNull() & F.col("next_copy").isNotNull()).alias("recovered"))


@register("held_back", f"{E} SELECT user_id, frame, q, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) IS NULL AS last FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    return halo.looking_ahead(event_stream(s, d).select("user_id", "frame", "q"), 1, lambda w: {"last": F.lead("frame").over(w).isNull()})


@register("primed_and_capped", f"{E}, p AS (SELECT user_id, frame // 16 AS packet, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT *, sum(CASE WHEN packet = 0 THEN 0 ELSE n END) OVER (PARTITION BY user_id ORDER BY packet) AS granule FROM p) SELECT user_id, packet, cast(greatest(least(granule, 40) - (granule - n), 0) AS bigint) AS frames FROM g WHERE packet > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    p = event_stream(s, d).groupBy("user_id", F.floor(F.col("frame") / 16).cast("long").alias("frame")).agg(F.count("*").alias("n"))
    g = halo.running_sums(p, {"granule": F.when(F.col("frame") == 0, 0).otherwise(F.col("n"))})
    return g.where("frame > 0").select("user_id", F.col("frame").alias("packet"), F.greatest(F.least("granule", F.lit(40)) - (F.col("granule") - F.col("n")), F.lit(0)).cast("long").alias("frames"))


# Relational forms


@register("streams_anti_year", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
def _(s: SparkSession, d: str) -> DataFrame:
    year = _table(s, d, "orders").where(F.year("o_orderdate") == 1995).select("o_custkey")
    return _table(s, d, "customer").join(year, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("json_fields", "SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k, len(json_keys(props)) AS fields FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("fields"))


@register("approximate_counts", "SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    a = _table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("u"), F.countDistinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", 0.5).alias("p"))
    return a.select("event_type", (F.abs(F.col("u") - F.col("n")) <= 0.1 * F.col("n")).alias("users_near"), (F.abs(F.col("m") - F.col("p")) <= 0.02 * F.col("p") + 1).alias("median_near"))


_CTE = """WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), mean AS (SELECT avg(total) AS m FROM totals)
SELECT c_custkey, round(total, 2) AS total FROM totals JOIN customer ON c_custkey = o_custkey WHERE total > (SELECT m FROM mean) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"""


@register("above_the_mean", _CTE)
def _(s: SparkSession, d: str) -> DataFrame:
    names = {t: _table(s, d, t) for t in ("orders", "customer", "nation")}
    return s.sql(_CTE.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("FROM nation", "FROM {nation}"), **names)


@register("largest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@register("scraped_pivot", "WITH n AS (SELECT doc_id % 10 AS crate, coalesce(source, '') AS source, coalesce(try_cast(regexp_extract(text, '([0-9]+)', 1) AS bigint), 0) AS n FROM documents) SELECT crate, count(*) AS docs, cast(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS bigint) AS \"even\", cast(sum(CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END) AS bigint) AS odd FROM n GROUP BY crate")
def _(s: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.regexp_extract("text", "([0-9]+)", 1).try_cast("bigint"), F.lit(0))
    rows = _table(s, d, "documents").select((F.col("doc_id") % 10).alias("crate"), F.when(n % 2 == 0, "even").otherwise("odd").alias("kind"))
    made = rows.groupBy("crate").pivot("kind", ["even", "odd"]).count().na.fill(0)
    return made.select("crate", (F.col("even") + F.col("odd")).alias("docs"), "even", "odd")
