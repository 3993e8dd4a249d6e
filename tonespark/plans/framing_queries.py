"""Queries over framed byte streams made of documents: damaged headers, junk between frames and false headers in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.functions import bits
from tonespark.plans.catalogue import _table, register
from tonespark.sources import framing

#: Documents of a stream, and samples of a frame.
STREAM, SAMPLES = 40, 1152
FALSE = {"mpeg": b"\xff\xfb\xea\x00", "adts": b"\xff\xf1\x50\x80\xff\xff\xfc"}


def _streams(s: SparkSession, d: str, framing_of: str, head: Column, length: Column) -> DataFrame:
    """``stream, content``: a frame a document, its text cut or filled up with spaces; each 11th header is damaged, after
    each 7th frame stands junk, each 5th holds a false header."""
    i = F.col("doc_id")
    text = F.concat(F.when(i % 5 == 2, F.lit(FALSE[framing_of])).otherwise(F.lit(b"")), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    whole = F.substring(F.rpad(F.concat(head, text), length, F.lit(b" ")), F.lit(1), length)
    whole = F.when(i % 11 == 5, F.concat(F.lit(b"\x00"), F.substring(whole, F.lit(2), length))).otherwise(whole)
    made = _table(s, d, "documents").select(i, F.floor(i / STREAM).alias("stream"), F.concat(whole, F.when(i % 7 == 3, F.lit(b"x" * 100)).otherwise(F.lit(b""))).alias("x"))
    rows = made.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.hex("x").alias("x")))).alias("s"))
    return rows.select("stream", F.unhex(F.concat_ws("", F.transform("s", lambda r: r["x"]))).alias("content"))


def _octets(*values: Column) -> Column:
    """Bytes of 0 to 255."""
    return F.unhex(F.concat(*[F.lpad(F.hex(v.cast("long")), 2, "0") for v in values]))


def _mpeg(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    b, r, p = 1 + i % 14, i % 3, F.floor(i / 3) % 2
    kbps, hz = (F.array(*map(F.lit, x)) for x in (framing.MPEG_KBPS[0], framing.MPEG_HZ))
    length = (F.floor(SAMPLES * F.get(kbps, (b - 1).cast("int")) * 125 / F.get(hz, r.cast("int"))) + p).cast("int")
    content = _streams(s, d, "mpeg", _octets(F.lit(255), F.lit(0xFB), b * 16 + r * 4 + p * 2, i % 256), length)
    return framing.split_frames(framing.content_chunks(content, "stream", "mpeg", 1 << 13), "mpeg")


def _adts(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = 7 + i * 37 % 3000
    head = _octets(F.lit(255), F.lit(0xF1), i % 4 * 64 + i % 13 * 4, 128 + F.floor(n / 2048), F.floor(n / 8) % 256, n % 8 * 32 + 31, F.lit(0xFC))
    content = _streams(s, d, "adts", head, n.cast("int"))
    return framing.split_frames(framing.content_chunks(content, "stream", "adts", 1 << 13), "adts")


def _expected(length: str, head: str, columns: str) -> str:
    """Frames as a reader finds them: in step after a good frame without junk, or by a header at the frame's end."""
    return f"""WITH d AS (SELECT doc_id, doc_id // {STREAM} AS stream, 1 + doc_id % 14 AS b, doc_id % 3 AS r, (doc_id // 3) % 2 AS p, 7 + doc_id * 37 % 3000 AS n FROM documents),
l AS (SELECT *, cast({length} AS bigint) AS length, cast({head} AS bigint) AS head, doc_id % 11 <> 5 AS good, doc_id % 7 = 3 AS junk FROM d),
a AS (SELECT *, cast(coalesce(sum(length + CASE WHEN junk THEN 100 ELSE 0 END) OVER (PARTITION BY stream ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS place,
  NOT junk AND coalesce(lead(good) OVER w, true) AS sure, coalesce(lag(good AND NOT junk) OVER w, false) AS in_step FROM l WINDOW w AS (PARTITION BY stream ORDER BY doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY doc_id) - 1 AS frame FROM a WHERE good AND (sure OR in_step)) SELECT {columns}"""


_MPEG = ("(1152 * ([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320])[b] * 125) // ([44100, 48000, 32000])[1 + r] + p", "255 * 16777216::bigint + 251 * 65536 + (b * 16 + r * 4 + p * 2) * 256 + doc_id % 256")
_ADTS = ("n", "255 * (1::bigint << 48) + 241 * (1::bigint << 40) + (doc_id % 4 * 64 + doc_id % 13 * 4) * (1::bigint << 32) + (128 + n // 2048) * (1::bigint << 24) + n // 8 % 256 * 65536 + (n % 8 * 32 + 31) * 256 + 252")


@register("mpeg_stream_frames", _expected(*_MPEG, "stream, frame, place AS \"at\", length, head FROM f"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _mpeg(s, d)


@register("adts_stream_frames", _expected(*_ADTS, "stream, frame, place AS \"at\", length, head FROM f"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _adts(s, d)


@register("mpeg_stream_headers", _expected(*_MPEG, "stream, frame, b AS bitrate, r AS rate, p AS padding, doc_id % 256 // 64 AS mode, doc_id % 4 AS emphasis FROM f"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _mpeg(s, d).select("stream", "frame", *[c for c, (n, _) in zip(bits.bit_fields(F.col("head"), bits.MPEG_AUDIO), bits.MPEG_AUDIO, strict=True) if n in ("bitrate", "rate", "padding", "mode", "emphasis")])


@register("adts_stream_headers", _expected(*_ADTS, "stream, frame, doc_id % 4 AS profile, doc_id % 13 AS rate, 2 AS channels, n AS frame_length FROM f").replace("2 AS channels", "cast(2 AS bigint) AS channels"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _adts(s, d).select("stream", "frame", *[c for c, (n, _) in zip(bits.bit_fields(F.col("head"), bits.ADTS), bits.ADTS, strict=True) if n in ("profile", "rate", "channels", "frame_length")])


@register("framed_seek", _expected(*_MPEG, f"stream, frame, place AS \"at\", 20000 - frame * {SAMPLES} AS skip FROM f WHERE frame = 20000 // {SAMPLES}"))
def _(s: SparkSession, d: str) -> DataFrame:
    """Where to read for the sample 20000 of each stream: its frame's first byte, and the samples to leave out."""
    return _mpeg(s, d).where(F.col("frame") == 20_000 // SAMPLES).select("stream", "frame", "at", (20_000 - F.col("frame") * SAMPLES).alias("skip"))
