"""Signal views of tables: streams of frames, planar blocks, and PCM containers as byte columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonespark.functions.checksums import CRC32_PAGE, crc, crc_once
from tonespark.functions.sample import big_endian_hex, float_to_int, little_endian_hex
from tonespark.operators.halo import numbered
from tonespark.sources.decode import samples


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, frame, v, q``: one mono stream per user, 16-bit samples in q."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    e = numbered(e, "user_id", "event_id", "frame").select("user_id", "frame", (F.col("value") / 1024).alias("v"))
    return e.withColumn("q", float_to_int(F.col("v"), 16))


def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, e``: one planar block of doubles per row."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))


def segments(stream: DataFrame, frames: int, order: str = "little") -> DataFrame:
    """``user_id, segment, n, data``: 16-bit samples of up to ``frames`` frames as bytes; groups are bounded."""
    part = stream.withColumn("segment", F.floor(F.col("frame") / frames).cast("long"))
    packed = little_endian_hex(F.col("q"), 2) if order == "little" else big_endian_hex(F.col("q"), 2)
    rows = part.groupBy("user_id", "segment").agg(F.sort_array(F.collect_list(F.struct("frame", packed.alias("x")))).alias("s"))
    return rows.select("user_id", "segment", F.size("s").cast("long").alias("n"), F.unhex(F.concat_ws("", F.transform("s", lambda r: r["x"]))).alias("data"))


def wav_files(parts: DataFrame, rate: int = 48_000) -> DataFrame:
    """``segments`` in little-endian order, each as a whole mono 16-bit RIFF/WAVE file (``content``)."""
    le = little_endian_hex
    size = F.octet_length("data").cast("long")
    fmt = "666D7420" + "10000000" + "0100" + "0100"
    head = F.concat(
        F.lit("52494646"), le(size + 36, 4), F.lit("57415645" + fmt), le(F.lit(rate).cast("long"), 4), le(F.lit(2 * rate).cast("long"), 4), F.lit("0200" + "1000"), F.lit("64617461"), le(size, 4)
    )
    return parts.select("user_id", "segment", F.concat(F.unhex(head), F.col("data")).alias("content"))


def scan_wav(files: DataFrame) -> DataFrame:
    """``user_id, segment, i, q`` from 16-bit mono WAVE contents with a 44-byte header; others give no rows."""
    hexed = F.hex(F.substring("content", 1, 44))
    good = (F.substring(hexed, 1, 8) == "52494646") & (F.substring(hexed, 17, 8) == "57415645") & (F.substring(hexed, 73, 8) == "64617461")
    told = F.conv(F.concat(*[F.substring(hexed, 81 + 2 * k, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    size = F.octet_length("content") - 44
    rows = files.where(good).select("user_id", "segment", F.substr("content", F.lit(45), size).alias("data"), F.floor(F.least(told, size.cast("long")) / 2).alias("n"))
    return _samples(rows.where("n > 0"), "little")


def scan_raw(parts: DataFrame, order: str) -> DataFrame:
    """``user_id, segment, i, q`` from raw 16-bit samples (``data``); a trailing odd byte is left out."""
    return _samples(parts.withColumn("n", F.floor(F.octet_length("data") / 2)).where("n > 0"), order)


def _samples(rows: DataFrame, order: str) -> DataFrame:
    kind = {"octets": F.lit(2), "little": F.lit(order == "little"), "offset": F.lit(False), "real": F.lit(False)}
    read = samples(rows.select("user_id", "segment", "data", "n", *[c.alias(n) for n, c in kind.items()]), "user_id", "segment")
    return read.select("user_id", "segment", "i", "q")


def aiff_files(parts: DataFrame, rate: int = 48_000) -> DataFrame:
    """``segments`` in big-endian order, each as a whole mono 16-bit AIFF file (``content``)."""
    be, size, top = big_endian_hex, F.octet_length("data").cast("long"), rate.bit_length() - 1
    extended = f"{0x3FFF + top:04X}{rate << (63 - top):016X}"  # the rate as an 80-bit float
    common = F.concat(F.lit("434F4D4D" + "00000012" + "0001"), be(F.col("n"), 4), F.lit("0010" + extended))
    sound = F.concat(F.lit("53534E44"), be(size + 8, 4), F.lit("00000000" * 2))
    head = F.concat(F.lit("464F524D"), be(size + 46, 4), F.lit("41494646"), common, sound)
    return parts.select("user_id", "segment", F.concat(F.unhex(head), F.col("data")).alias("content"))


def scan_aiff(files: DataFrame) -> DataFrame:
    """``user_id, segment, i, q`` from 16-bit mono AIFF contents whose COMM and SSND chunks come first; others give no rows."""
    hexed = F.hex(F.substring("content", 1, 54))
    marks = ((1, "464F524D"), (17, "41494646"), (25, "434F4D4D00000012"), (41, "0001"), (53, "0010"), (77, "53534E44"))
    good = [F.substring(hexed, at, len(mark)) == mark for at, mark in marks]
    told = F.conv(F.substring(hexed, 45, 8), 16, 10).cast("long")
    n = F.least(told, F.floor((F.octet_length("content") - 54) / 2))
    rows = files.where(good[0] & good[1] & good[2] & good[3] & good[4] & good[5]).select("user_id", "segment", F.substr("content", F.lit(55), F.octet_length("content") - 54).alias("data"), n.alias("n"))
    return _samples(rows.where("n > 0"), "big")


def ogg_pages(parts: DataFrame) -> DataFrame:
    """``segments`` of up to 65,024 bytes, each as a page of one packet (``page``): serial user_id, granule the frames so far."""
    le, size = little_endian_hex, F.octet_length("data").cast("long")
    long = F.raise_error(F.lit("a page of one packet holds 65,024 bytes; packet_pages splits longer ones")).cast("int")
    whole = F.when(size <= 65_024, F.floor(size / 255).cast("int")).otherwise(long)
    last = F.col("segment") == F.max("segment").over(Window.partitionBy("user_id"))
    flags = F.when(F.col("segment") == 0, 2).otherwise(0) + F.when(last, 4).otherwise(0)
    granule = F.sum("n").over(Window.partitionBy("user_id").orderBy("segment"))
    before = F.concat(F.lit("4F67675300"), le(flags.cast("long"), 1), le(granule, 7), F.lit("00"), le(F.col("user_id").cast("long"), 4), le(F.col("segment"), 4))
    after = F.concat(le((whole + 1).cast("long"), 1), F.repeat(F.lit("FF"), whole), le(size % 255, 1))
    made = parts.select("user_id", "segment", before.alias("before"), after.alias("after"), F.hex("data").alias("body"))
    made = made.withColumn("check", crc_once(*CRC32_PAGE)(F.unhex(F.concat("before", F.lit("00000000"), "after", "body"))))
    return made.select("user_id", "segment", F.unhex(F.concat("before", le(F.col("check"), 4), "after", "body")).alias("page"))


def scan_ogg(pages: DataFrame) -> DataFrame:
    """``user_id, segment, flags, granule, good, data`` of pages: serial and sequence number from the header; ``good`` tells whether the checksum holds."""
    hexed = F.hex("page")
    read = lambda at, octets: F.conv(F.concat(*[F.substring(hexed, 2 * (at + k) + 1, 2) for k in reversed(range(octets))]), 16, 10).cast("long")
    blank = F.unhex(F.concat(F.substring(hexed, 1, 44), F.lit("00000000"), F.expr("substring(hex(page), 53)")))
    found = pages.where(F.substring(hexed, 1, 10) == "4F67675300").select(
        read(14, 4).alias("user_id"), read(18, 4).alias("segment"), read(5, 1).cast("int").alias("flags"), read(6, 7).alias("granule"),
        (crc(*CRC32_PAGE)(blank) == read(22, 4)).alias("good"), read(26, 1).alias("laces"), "page",
    )
    return found.select("user_id", "segment", "flags", "granule", "good", F.substr("page", F.col("laces").cast("int") + 28).alias("data"))
