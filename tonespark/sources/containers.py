"""RIFF/WAVE and AIFF/AIFC contents with other chunks around, several channels, and samples of 8 to 32 bits or floats.

A small helper lists a content's chunks, fields are read by column expressions, and samples by ``decode``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonespark.functions.sample import big_endian_hex, little_endian_hex
from tonespark.sources.decode import samples

#: The last 14 bytes of an extensible format's identifier, and the byte order of each AIFC kind of integer samples; kinds of big-endian floats.
EXTENSIBLE_TAIL = "000000001000800000AA00389B71"
AIFC_ORDER = {"NONE": "big", "twos": "big", "in24": "big", "in32": "big", "sowt": "little", "ni24": "little"}
AIFC_FLOATS = ("FL32", "fl32", "FL64", "fl64")


def chunk_list(order: str) -> Callable:
    """A pandas UDF from contents to their chunks; sizes beyond the end (unknown, or cut off) reach to the end."""

    @F.pandas_udf("array<struct<id:string,start:int,size:int>>")
    def run(contents: pd.Series) -> pd.Series:
        def walk(data: bytes | None) -> list[dict] | None:
            if data is None:
                return None
            at, found = 12, []
            while at + 8 <= len(data):
                size = int.from_bytes(data[at + 4 : at + 8], order)
                found.append({"id": data[at : at + 4].decode("latin-1"), "start": at + 8, "size": min(size, len(data) - at - 8)})
                at += 8 + size + size % 2
            return found

        return contents.map(walk)

    return run


def first_chunk(name: str) -> Column:
    return F.get(F.filter("chunks", lambda c: c["id"] == name), F.lit(0))


def number(data: Column, at: Column, octets: int, order: str) -> Column:
    """The unsigned integer at byte ``at``; null past the end."""
    h = F.hex(F.substr(data, at + 1, F.lit(octets)))
    if order == "little":
        h = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(octets))])
    return F.conv(h, 16, 10).cast("long")


def _magic(first: int) -> Column:
    """Four bytes of a content as hex; no more of it is looked at."""
    return F.hex(F.substring("content", first, 4))


def _placed(found: DataFrame, *keys: str) -> DataFrame:
    """``keys, depth, frame, ch, q, x``: samples as integers (null for floats) and of full scale 1."""
    read, channels = samples(found, *keys, "depth", "channels"), F.col("channels")
    return read.select(*keys, "depth", F.floor(F.col("i") / channels).cast("long").alias("frame"), (F.col("i") % channels).cast("int").alias("ch"), "q", "x")


def scan_wave(files: DataFrame, *keys: str) -> DataFrame:
    """``keys, depth, frame, ch, q, x`` from the WAVE contents (``content``) of integers or floats, plain or extensible.

    ``fmt `` has to come before ``data``; other chunks are passed over. Null, damaged and big-endian contents give no
    rows (``files.content_headers`` says why); a frame that is cut off is left out.
    """
    content = F.col("content")
    magic = (_magic(1) == "52494646") & (_magic(9) == "57415645")
    walked = files.where(magic).withColumn("chunks", chunk_list("little")("content")).withColumn("f", first_chunk("fmt ")).withColumn("d", first_chunk("data"))
    at = F.col("f.start")
    kind = number(content, at, 2, "little")
    extended = (kind == 0xFFFE) & (F.col("f.size") >= 40) & (F.hex(F.substr(content, at + 27, F.lit(14))) == EXTENSIBLE_TAIL)
    kind = F.when(extended, number(content, at + 24, 2, "little")).otherwise(kind)
    good = walked.where((at < F.col("d.start")) & (F.col("f.size") >= 16) & kind.isin(1, 3))
    found = good.select(*keys, (kind == 3).alias("real"), number(content, at + 2, 2, "little").cast("int").alias("channels"), number(content, at + 14, 2, "little").cast("int").alias("depth"), "d", "content")
    found = found.where("channels > 0 and case when real then depth in (32, 64) else depth in (8, 16, 24, 32) end").withColumn("octets", (F.col("depth") / 8).cast("int"))
    n = F.floor(F.col("d.size") / (F.col("octets") * F.col("channels"))) * F.col("channels")
    return _placed(found.select(*keys, "channels", "depth", "octets", "real", n.alias("n"), F.lit(True).alias("little"), (F.col("depth") == 8).alias("offset"), F.substr("content", F.col("d.start") + 1, F.col("d.size")).alias("data")), *keys)


def scan_aiff_chunks(files: DataFrame, *keys: str) -> DataFrame:
    """``keys, depth, frame, ch, q, x`` from AIFF and AIFC contents of integers or floats; COMM and SSND in either order.

    Null, damaged and compressed contents give no rows; frames that are cut off or beyond COMM's count are left out.
    """
    content, form = F.col("content"), _magic(9)
    walked = files.where((_magic(1) == "464F524D") & form.isin("41494646", "41494643")).withColumn("chunks", chunk_list("big")("content")).withColumn("c", first_chunk("COMM")).withColumn("s", first_chunk("SSND"))
    at = F.col("c.start")
    kind = F.when(form == "41494646", F.lit("NONE")).otherwise(F.decode(F.substr(content, at + 19, F.lit(4)), "ISO-8859-1"))
    good = walked.where((F.col("c.size") >= 18) & (F.col("s.size") >= 8)).select(
        *keys, "content", number(content, at, 2, "big").cast("int").alias("channels"), number(content, at + 2, 4, "big").alias("told"), number(content, at + 6, 2, "big").cast("int").alias("depth"),
        kind.alias("kind"), (F.col("s.start") + 8 + number(content, F.col("s.start"), 4, "big")).alias("first"), (F.col("s.start") + F.col("s.size")).alias("end"),
    )
    good = good.withColumn("real", F.col("kind").isin(*AIFC_FLOATS)).where(F.col("kind").isin(*AIFC_ORDER, *AIFC_FLOATS) & F.expr("channels > 0 and case when real then depth in (32, 64) else depth in (8, 16, 24, 32) end and first <= end")).withColumn("octets", (F.col("depth") / 8).cast("int"))
    frames = F.least("told", F.floor((F.col("end") - F.col("first")) / (F.col("octets") * F.col("channels"))))
    little = F.col("kind").isin(*[k for k, order in AIFC_ORDER.items() if order == "little"])
    return _placed(good.select(*keys, "channels", "depth", "octets", "real", (frames * F.col("channels")).alias("n"), little.alias("little"), F.lit(False).alias("offset"), F.substr("content", (F.col("first") + 1).cast("int"), (F.col("end") - F.col("first")).cast("int")).alias("data")), *keys)


def interleave(frames: DataFrame, length: int, depth: int, order: str, offset: bool, *keys: str) -> DataFrame:
    """``keys, segment, n, data``: the channels ``a`` and ``b`` of up to ``length`` frames as bytes; groups are bounded."""
    pack, shift = (little_endian_hex if order == "little" else big_endian_hex), 1 << (depth - 1) if offset else 0
    both = F.concat(*[pack(F.col(c) + F.lit(shift).cast("long"), depth // 8) for c in ("a", "b")])
    rows = frames.groupBy(*keys, F.floor(F.col("frame") / length).cast("long").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("frame", both.alias("x")))).alias("s"))
    return rows.select(*keys, "segment", F.size("s").cast("long").alias("n"), F.unhex(F.concat_ws("", F.transform("s", lambda r: r["x"]))).alias("data"))


def wave_container(parts: DataFrame, depth: int, rate: int, *keys: str) -> DataFrame:
    """Two-channel WAVE contents: a chunk of odd size, the format, the samples (padded to even)."""
    le, size = little_endian_hex, F.octet_length("data").cast("long")
    note, frame = "4C495354" + "05000000" + "494E464F21" + "00", depth // 4
    head = F.concat(
        F.lit("52494646"), le(size + size % 2 + 50, 4), F.lit("57415645" + note + "666D7420" + "10000000" + "0100" + "0200"), le(F.lit(rate).cast("long"), 4),
        le(F.lit(rate * frame).cast("long"), 4), le(F.lit(frame).cast("long"), 2), le(F.lit(depth).cast("long"), 2), F.lit("64617461"), le(size, 4),
    )
    return parts.select(*keys, F.unhex(F.concat(head, F.hex("data"), F.when(size % 2 == 1, "00").otherwise(""))).alias("content"))


def aifc_container(parts: DataFrame, depth: int, rate: int, kind: str, *keys: str) -> DataFrame:
    """Two-channel AIFC contents of this kind of samples, the sound before the common chunk."""
    be, size, top = big_endian_hex, F.octet_length("data").cast("long"), rate.bit_length() - 1
    extended = f"{0x3FFF + top:04X}{rate << (63 - top):016X}"  # the rate as an 80-bit float
    sound = F.concat(F.lit("53534E44"), be(size + 8, 4), F.lit("00000000" * 2), F.hex("data"), F.when(size % 2 == 1, "00").otherwise(""))
    common = F.concat(F.lit("434F4D4D" + "00000018" + "0002"), be(F.col("n"), 4), F.lit(f"{depth:04X}{extended}{kind.encode().hex().upper()}0000"))
    head = F.concat(F.lit("464F524D"), be(size + size % 2 + 52, 4), F.lit("41494643"))
    return parts.select(*keys, F.unhex(F.concat(head, sound, common)).alias("content"))
