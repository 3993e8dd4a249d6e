"""Queries of lapped transforms, resampling and spectra against their formulas in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.operators import spectra
from tonespark.plans.catalogue import E, PI, V, register
from tonespark.sources.signals import event_stream, vector_blocks

#: Frames of a chunk: few, so that streams of the given tables are several chunks.
CHUNK = 64


def _stream(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).select("user_id", "frame", F.col("v").alias("x"))


@register("mdct_blocks", f"""{E}, b AS (SELECT user_id, unnest(range(max(frame) // 32 + 2)) AS block FROM e GROUP BY user_id)
SELECT b.user_id, block, cast(k AS int) AS k, round(coalesce(sum(v * sin((i + 0.5) / 64 * {PI}) * cos({PI} / 32 * (i + 16.5) * (k + 0.5))), 0), 7) AS c
FROM b, range(32) AS t(k) LEFT JOIN (SELECT user_id, frame, v, o, frame + 32 - (frame // 32 + o) * 32 AS i, frame // 32 + o AS at FROM e, range(2) AS r(o)) f ON f.user_id = b.user_id AND f.at = b.block GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    made = spectra.lapped(_stream(s, d), 32, "sine", CHUNK)
    return made.select("user_id", "block", F.posexplode("c").alias("k", "c")).select("user_id", "block", "k", F.round("c", 7).alias("c"))


@register("mdct_restored", f"{E} SELECT user_id, frame, cast(round(v * 102400) AS bigint) AS hundredths FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    """Blocks of 256 frames, forth and back: aliases of neighbours cancel."""
    back = spectra.unlapped(spectra.lapped(_stream(s, d), 128, "kbd", 128), 128, "kbd", 128)
    known = event_stream(s, d).select("user_id", "frame")
    return known.join(back, ["user_id", "frame"]).select("user_id", "frame", F.round(F.col("x") * 102_400).cast("long").alias("hundredths"))


def _resampled(up: int, down: int, zeros: int) -> str:
    cut = min(1.0, up / down)
    t = f"(m * {down}::double / {up} - frame)"
    h = f"{cut}::double * (CASE WHEN abs({t}) < 1e-12 THEN 1 ELSE sin({PI} * {cut} * {t}) / ({PI} * {cut} * {t}) END) * (0.5 + 0.5 * cos({PI} * {t} * {cut} / {zeros}))"
    return f"""{E}, o AS (SELECT user_id, unnest(range(max(frame) * {up} // {down} + 1)) AS m FROM e GROUP BY user_id)
SELECT o.user_id, m AS frame, round(sum(v * {h}), 8) AS x FROM o JOIN e ON e.user_id = o.user_id AND abs({t}) < {zeros / cut} GROUP BY ALL"""


@register("resample_half", _resampled(1, 2, 16))
def _(s: SparkSession, d: str) -> DataFrame:
    return spectra.resample(_stream(s, d), 1, 2, 16, CHUNK).select("user_id", "frame", F.round("x", 8).alias("x"))


@register("resample_three_halves", _resampled(3, 2, 8))
def _(s: SparkSession, d: str) -> DataFrame:
    return spectra.resample(_stream(s, d), 3, 2, 8, CHUNK).select("user_id", "frame", F.round("x", 8).alias("x"))


_DFT = f"list_sum(list_transform(range(64), lambda i: e[i + 1] * {{}}(2 * {PI} * k * i / 64)))"


@register("dft_power_all", f"{V} SELECT vec_id, cast(k AS int) AS k, round(pow({_DFT.format('cos')}, 2) + pow({_DFT.format('sin')}, 2), 6) AS power FROM v, range(33) AS t(k)")
def _(s: SparkSession, d: str) -> DataFrame:
    return spectra.power_spectra(vector_blocks(s, d), "vec_id", "e").select("vec_id", "k", F.round("power", 6).alias("power"))
