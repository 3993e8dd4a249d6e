"""Queries of recurrences and cheapest paths over event streams, against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.operators import scans
from tonespark.plans.catalogue import E, register
from tonespark.sources.signals import event_stream

#: Frames of a block: small, so that the streams of the given tables are several blocks of several levels.
BLOCK = 16


def _recursive(first: str, then: str, out: str, more: str = "SELECT * FROM e") -> str:
    """``first`` gives the state of frame 0, ``then`` that of the next frame from the state r and the row s."""
    return f"{E.replace('WITH e', 'WITH RECURSIVE e', 1)}, s AS ({more}), r AS (SELECT s.user_id, s.frame, {first} FROM s WHERE s.frame = 0 UNION ALL SELECT s.user_id, s.frame, {then} FROM r JOIN s ON s.user_id = r.user_id AND s.frame = r.frame + 1) SELECT {out} FROM r"


@register("smoothed_level", _recursive("0.1::double * abs(s.q) AS y", "r.y + 0.1::double * (abs(s.q) - r.y)", "user_id, frame, round(y, 5) AS y"))
def _(s: SparkSession, d: str) -> DataFrame:
    made = scans.scan(event_stream(s, d).select("user_id", "frame", F.abs("q").cast("double").alias("x")), scans.smoothing(0.1), ["x"], ["y"], BLOCK)
    return made.select("user_id", "frame", F.round("y", 5).alias("y"))


@register("iir_biquad", _recursive("0.2::double * s.v AS y, 0::double AS y1", "0.2::double * s.v + 0.3::double * s.v1 + 0.1::double * s.v2 + 0.5::double * r.y - 0.2::double * r.y1, r.y", "user_id, frame, round(y, 8) AS y", "SELECT *, coalesce(lag(v, 1) OVER w, 0) AS v1, coalesce(lag(v, 2) OVER w, 0) AS v2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame)"))
def _(s: SparkSession, d: str) -> DataFrame:
    made = scans.scan(event_stream(s, d).select("user_id", "frame", "v"), scans.iir([0.2, 0.3, 0.1], [-0.5, 0.2]), ["v"], ["y"], BLOCK)
    return made.select("user_id", "frame", F.round("y", 8).alias("y"))


@register("noise_floor", _recursive("greatest(abs(s.q), 1)::double AS y", "least(1.0437219::double * r.y, greatest(abs(s.q), 1))", "user_id, frame, round(y, 3) AS y"))
def _(s: SparkSession, d: str) -> DataFrame:
    x = event_stream(s, d).select("user_id", "frame", F.greatest(F.abs("q"), F.lit(1)).cast("double").alias("x"))
    return scans.scan(x, scans.Floor(1.0437219), ["x"], ["y"], BLOCK).select("user_id", "frame", F.round("y", 3).alias("y"))


@register("gain_track_carried", _recursive("least(greatest(0 + s.q - 8000, -12000), 12000) AS gain", "least(greatest(r.gain + s.q - 8000, -12000), 12000)", "user_id, frame, cast(gain AS bigint) AS gain"))
def _(s: SparkSession, d: str) -> DataFrame:
    x = event_stream(s, d).select("user_id", "frame", (F.col("q") - 8000).alias("x"))
    return scans.scan(x, scans.Clamped(-12_000, 12_000), ["x"], ["gain"], BLOCK)


_NOISE = _recursive("(42 * 1664525::bigint + 1013904223) % 4294967296 AS x", "(r.x * 1664525 + 1013904223) % 4294967296", "user_id, frame, (x - 2147483648) / 2147483648.0::double AS v")


@register("noise_lcg", f"SELECT user_id, frame, round(v / sqrt(avg(v * v) OVER (PARTITION BY user_id)), 9) AS x FROM ({_NOISE})")
def _(s: SparkSession, d: str) -> DataFrame:
    """Noise of level 1 for each frame of each stream: values of one generator, each stream from its start."""
    step = event_stream(s, d).select("user_id", "frame", F.lit(1_013_904_223).cast("long").alias("x"))
    v = scans.scan(step, scans.Congruential(1_664_525, 42), ["x"], ["y"], BLOCK).select("user_id", "frame", ((F.col("y") - (1 << 31)) / (1 << 31)).alias("v"))
    level = v.groupBy("user_id").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("level"))
    return v.join(level, "user_id").select("user_id", "frame", F.round(F.col("v") / F.col("level"), 9).alias("x"))


LEVELS, MOVES = (2000, 8000, 14_000), ((0, 150, 300), (150, 0, 150), (300, 150, 0))
_COST = [f"abs(s.q - {x}) // 16" for x in LEVELS]
_THROUGH = [[f"r.c{i} + {MOVES[i][j]}" for i in range(3)] for j in range(3)]
_PATHS = _recursive(
    ", ".join([f"{c} AS c{j}" for j, c in enumerate(_COST)] + [f"[{j}] AS p{j}" for j in range(3)]),
    ", ".join([f"least({', '.join(t)}) + {c}" for t, c in zip(_THROUGH, _COST, strict=True)] + [f"list_append(CASE WHEN {t[0]} <= least({t[1]}, {t[2]}) THEN r.p0 WHEN {t[1]} <= {t[2]} THEN r.p1 ELSE r.p2 END, {j})" for j, t in enumerate(_THROUGH)]),
    "user_id, frame, CASE WHEN c0 <= least(c1, c2) THEN p0 WHEN c1 <= c2 THEN p1 ELSE p2 END AS p",
)


@register("cheapest_levels", f"SELECT user_id, unnest(range(len(p))) AS frame, cast(unnest(p) AS bigint) AS state FROM (SELECT * FROM ({_PATHS}) QUALIFY frame = max(frame) OVER (PARTITION BY user_id))")
def _(s: SparkSession, d: str) -> DataFrame:
    """The level of each frame, where changes cost: the cheapest path, by a min-plus scan over blocks."""
    x = event_stream(s, d).select("user_id", "frame", *[F.floor(F.abs(F.col("q") - level) / 16).alias(f"c{k}") for k, level in enumerate(LEVELS)])
    return scans.cheapest_path(x, [list(m) for m in MOVES], ["c0", "c1", "c2"], BLOCK)
