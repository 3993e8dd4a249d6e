"""Ogg packets over several pages: a native sink and scan; only the page checksum is a function of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespark.functions.checksums import CRC32_PAGE, crc, crc_once
from tonespark.functions.sample import little_endian_hex


def packet_pages(packets: DataFrame, laces: int = 255) -> DataFrame:
    """``serial, page_no, page`` from ``serial, packet, data``: each packet begins a page and takes as many as it needs.

    A page holds up to ``laces`` lacing values of 255 bytes. The granule counts packets; pages that end none have -1.
    Null data count as empty.
    """
    order, le = Window.partitionBy("serial").orderBy("packet"), little_endian_hex
    data = F.coalesce("data", F.lit(b""))
    sized = packets.select("serial", "packet", data.alias("data"), F.octet_length(data).cast("long").alias("size"))
    sized = sized.withColumn("total", F.floor(F.col("size") / 255) + 1).withColumn("pages", F.ceil(F.col("total") / laces).cast("long"))
    # Numbers come from sizes alone: the window moves no data.
    numbers = sized.select("serial", "packet", (F.sum("pages").over(order) - F.col("pages")).alias("first"), F.row_number().over(order).cast("long").alias("granule"), F.lead("packet").over(order).isNull().alias("last"))
    each = sized.join(numbers, ["serial", "packet"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    ends, own = F.col("k") == F.col("pages") - 1, F.least(F.lit(laces).cast("long"), F.col("total") - F.col("k") * laces)
    flags = (F.col("k") > 0).cast("int") + F.when(F.col("first") + F.col("k") == 0, 2).otherwise(0) + F.when(F.col("last") & ends, 4).otherwise(0)
    table = F.concat(F.repeat(F.lit("FF"), F.when(ends, own - 1).otherwise(own).cast("int")), F.when(ends, le(F.col("size") % 255, 1)).otherwise(""))
    body = F.hex(F.substr("data", (F.col("k") * laces * 255 + 1).cast("int"), F.lit(laces * 255)))
    page_no = F.col("first") + F.col("k")
    granule = F.when(ends, F.concat(le(F.col("granule"), 7), F.lit("00"))).otherwise("FF" * 8)
    head = F.concat(F.lit("4F67675300"), le(flags.cast("long"), 1), granule, le(F.col("serial").cast("long"), 4), le(page_no, 4))
    made = each.select("serial", page_no.alias("page_no"), head.alias("head"), F.concat(le(own, 1), table, body).alias("rest"))
    made = made.withColumn("check", crc_once(*CRC32_PAGE)(F.unhex(F.concat("head", F.lit("00000000"), "rest"))))
    return made.select("serial", "page_no", F.unhex(F.concat("head", le(F.col("check"), 4), "rest")).alias("page"))


def split_pages(files: DataFrame, *keys: str) -> DataFrame:
    """``keys, at, page``: the Ogg pages of each content (``content``) and the byte where each begins.

    Bytes that begin no page are passed over up to the next capture pattern; a page that is cut off at the end is given
    as far as it goes. Null contents have none. A helper walks page heads; pages leave it in bounded batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("content")
            own = [batch.schema.get_field_index(k) for k in keys]

            def give(rows: list[tuple[int, int, bytes]], batch: pa.RecordBatch = batch, own: list[int] = own) -> pa.RecordBatch:
                take = pa.array([r for r, _, _ in rows], pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in own), pa.array([a for _, a, _ in rows], pa.int64()), pa.array([x for *_, x in rows], pa.binary())], [*keys, "at", "page"])

            found: list[tuple[int, int, bytes]] = []
            for row in range(batch.num_rows):
                data = batch.column(place)[row].as_py() or b""
                at = data.find(b"OggS")
                while at >= 0:
                    laces = data[at + 27 : at + 27 + data[at + 26]] if at + 27 <= len(data) else b""
                    end = at + 27 + len(laces) + sum(laces)
                    found.append((row, at, data[at:end]))
                    at = data.find(b"OggS", end)
                    if len(found) >= 1000:
                        yield give(found)
                        found = []
            yield give(found)

    made = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + ["at long", "page binary"])
    return files.select(*keys, "content").mapInArrow(run, made)


def good_pages(pages: DataFrame) -> DataFrame:
    """The rows whose ``page`` has the checksum that it tells."""
    blank = F.concat(F.substring("page", 1, 22), F.unhex(F.lit("00000000")), F.substr("page", F.lit(27), F.octet_length("page")))
    told = F.hex(F.substring("page", 23, 4))
    value = F.conv(F.concat(*[F.substring(told, 2 * k + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    return pages.where(crc(*CRC32_PAGE)(blank) == value)


def scan_packets(pages: DataFrame) -> DataFrame:
    """``serial, packet, pages, whole, data`` from Ogg pages (``page``), in any order.

    A packet goes on in the next page if that is marked as continued and follows in number. ``whole`` is false where a
    beginning or an end is missing. Contents that are no pages are passed over; ``good_pages`` leaves out those with a
    wrong checksum, which are then missing. Only page counts pass the window of a serial; bytes meet by packet.
    """
    h = F.hex(F.substr("page", F.lit(1), F.lit(27)))
    read = lambda at, octets: F.conv(F.concat(*[F.substring(h, 2 * (at + k) + 1, 2) for k in reversed(range(octets))]), 16, 10).cast("long")
    table = F.hex(F.substr("page", F.lit(28), F.col("n")))
    found = pages.where((F.hex(F.substring("page", 1, 5)) == "4F67675300") & (F.octet_length("page") >= 27)).select(read(14, 4).alias("serial"), read(18, 4).alias("page_no"), (read(5, 1) % 2 == 1).alias("continued"), read(26, 1).cast("int").alias("n"), "page")
    laces = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.conv(F.substr(table, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    found = found.where("n > 0").withColumn("laces", laces)
    found = found.withColumn("ends", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("laces", k) < 255)).withColumn("open", F.get("laces", F.col("n") - 1) == 255)

    order = Window.partitionBy("serial").orderBy("page_no")
    goes_on = F.col("continued") & (F.lag("page_no").over(order) == F.col("page_no") - 1)
    told = found.select("serial", "page_no", "continued", "open", F.size("ends").cast("long").alias("count")).withColumn("goes_on", F.coalesce(goes_on & F.lag("open").over(order), F.lit(False)))
    told = told.withColumn("cut", (F.coalesce(F.lag("open").over(order), F.lit(False)) & ~F.col("goes_on")).cast("long"))
    told = told.select("serial", "page_no", "goes_on", (F.sum(F.col("count") + F.col("cut")).over(order) - F.col("count")).alias("base"))
    placed = found.join(told, ["serial", "page_no"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.size("ends"))))
    a = F.when(F.col("j") == 0, 0).otherwise(F.get("ends", F.col("j") - 1) + 1)
    b = F.coalesce(F.get("ends", F.col("j")), F.col("n") - 1)
    placed = placed.withColumn("a", a).withColumn("b", b).where("b >= a")
    total = lambda first, count: F.aggregate(F.slice("laces", first, count), F.lit(0), lambda x, y: x + y)
    start, size = total(F.lit(1), F.col("a")), total(F.col("a") + 1, F.col("b") - F.col("a") + 1)
    part = placed.select(
        "serial", (F.col("base") + F.col("j")).alias("packet"), "page_no", (F.col("j") < F.size("ends")).alias("ended"),
        ((F.col("j") > 0) | ~F.col("continued") | F.col("goes_on")).alias("begun"), F.substr("page", 28 + F.col("n") + start, size).alias("part"), size.alias("size"),
    )
    part = part.withColumn("full", F.octet_length("part") == F.col("size"))
    rows = part.groupBy("serial", "packet").agg(F.sort_array(F.collect_list(F.struct("page_no", F.hex("part").alias("x")))).alias("s"), F.max("ended").alias("ended"), F.min("begun").alias("begun"), F.min("full").alias("full"))
    return rows.select("serial", "packet", F.size("s").cast("long").alias("pages"), (F.col("ended") & F.col("begun") & F.col("full")).alias("whole"), F.unhex(F.concat_ws("", F.transform("s", lambda r: r["x"]))).alias("data"))
