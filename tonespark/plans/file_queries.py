"""Queries over files of samples that they write to the shared folder, and over contents; their SQL makes the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.plans.catalogue import E, _table, register
from tonespark.sources import datasource, files, packets
from tonespark.sources.signals import event_stream
from tonespark.streaming.blocks import shared_path


def _hex(x: str, octets: int, little: bool) -> str:
    h = f"upper(format('{{:0{2 * octets}x}}', {x}))"
    return " || ".join(f"substr({h}, {2 * k + 1}, 2)" for k in reversed(range(octets))) if little else h


def _written(s: SparkSession, d: str, form: str, depth: int, **how: bool) -> tuple[str, DataFrame]:
    """A folder with a file for each event stream, and the list of its files."""
    folder, e = shared_path(s, form), event_stream(s, d)
    channel = F.col("v") if how.get("real") else F.shiftleft("q", depth - 16)
    return folder, files.write_files(e.select("user_id", "frame", channel.alias("a")), folder, form, 48_000, depth, "a", **how)


def _user(df: DataFrame) -> DataFrame:
    return df.withColumn("user_id", files.stream_of(F.col("path")).cast("long"))


def _bytes(s: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    read = files.few_tasks(s.read.format("binaryFile").load(folder).select("path", F.md5("content").alias("md5"), F.col("length").alias("bytes")))
    return _user(read).join(written.select("user_id", "frames", F.col("bytes").alias("told")), "user_id").where("told = bytes").select("user_id", "frames", "bytes", "md5")


_LE16 = f"{E}, b AS (SELECT user_id, count(*) AS n, string_agg({_hex('q & 65535', 2, True)}, '' ORDER BY frame) AS h FROM e GROUP BY user_id)"
_WAVE = f"'52494646' || {_hex('2 * n + 36', 4, True)} || '57415645666D74201000000001000100' || '80BB00000077010002001000' || '64617461' || {_hex('2 * n', 4, True)} || h"
_WAVE_BYTES = f"{_LE16} SELECT user_id, n AS frames, 2 * n + 44 AS bytes, md5(unhex({_WAVE})) AS md5 FROM b"


@register("wave_file_bytes", _WAVE_BYTES)
def _(s: SparkSession, d: str) -> DataFrame:
    return _bytes(s, *_written(s, d, "wave", 16))


@register("aifc_file_bytes", f"""{E}, b AS (SELECT user_id, count(*) AS n, string_agg({_hex('(q * 256) & 16777215', 3, False)}, '' ORDER BY frame) AS h FROM e GROUP BY user_id)
SELECT user_id, n AS frames, 3 * n + n % 2 + 72 AS bytes, md5(unhex('464F524D' || {_hex('3 * n + n % 2 + 64', 4, False)} || '4149464346564552' || '00000004A2805140' || '434F4D4D000000180001' || {_hex('n', 4, False)}
|| '0018400EBB80000000000000' || '74776F730000' || '53534E44' || {_hex('3 * n + 8', 4, False)} || '0000000000000000' || h || CASE WHEN n % 2 = 1 THEN '00' ELSE '' END)) AS md5 FROM b""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _bytes(s, *_written(s, d, "aifc", 24, little=False))


@register("raw_file_bytes", f"{E}, b AS (SELECT user_id, count(*) AS n, string_agg({_hex('q & 65535', 2, False)}, '' ORDER BY frame) AS h FROM e GROUP BY user_id) SELECT user_id, n AS frames, 2 * n AS bytes, md5(unhex(h)) AS md5 FROM b")
def _(s: SparkSession, d: str) -> DataFrame:
    return _bytes(s, *_written(s, d, "raw", 16, little=False))


@register("aifc_file_scan", f"{E} SELECT user_id, frame, 0 AS ch, q * 256 AS q, round(q / 32768.0::double, 9) AS x FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "aifc", 24, little=False)
    made = files.scan(files.read_headers(files.list_files(s, folder)), frames=25)
    return _user(made).select("user_id", "frame", "ch", "q", F.round("x", 9).alias("x"))


@register("wave_float_scan", f"{E} SELECT user_id, frame, round(v, 6) AS x FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "wave", 64, real=True)
    return _user(files.scan(files.read_headers(files.list_files(s, folder)))).select("user_id", "frame", F.round("x", 6).alias("x"))


@register("raw_file_scan", f"{E} SELECT user_id, frame // 2 AS frame, cast(frame % 2 AS int) AS ch, q FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e) WHERE frame < n - n % 2")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "raw", 16, little=False)  # read as two channels
    return _user(files.scan(files.raw_headers(files.list_files(s, folder), 2, 16, little=False), frames=7)).select("user_id", "frame", "ch", "q")


@register("file_seek", f"{E} SELECT user_id, frame, q FROM e WHERE frame >= 10 AND frame < 30")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "wave", 16)
    return _user(files.scan(files.read_headers(files.list_files(s, folder)), 10, 30, frames=16)).select("user_id", "frame", "q")


@register("file_blocks", f"{E} SELECT user_id, frame // 16 AS block, count(*) AS n, round(sum(q / 32768.0::double), 5) AS total FROM e GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "wave", 16)
    made = _user(files.scan_blocks(files.read_headers(files.list_files(s, folder)), block=16))
    return made.select("user_id", F.floor(F.col("first") / 16).alias("block"), F.size("x").cast("long").alias("n"), F.round(F.expr("aggregate(x, 0D, (a, v) -> a + v)"), 5).alias("total"))


@register("file_metadata", f"""{E} SELECT user_id, 'ok' AS status, 'aifc' AS format, 1 AS channels, 48000.0::double AS rate, 24 AS depth, false AS real, count(*) AS frames, round(count(*) / 48000.0::double, 9) AS seconds FROM e GROUP BY user_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "aifc", 24, little=False)
    return _user(files.read_headers(files.list_files(s, folder))).select("user_id", "status", "format", "channels", "rate", "depth", "real", "frames", F.round("seconds", 9).alias("seconds"))


@register("content_status", f"""{E}, n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, ['ok', 'truncated', 'no container', 'empty', 'no samples', 'no format chunk'][1 + user_id % 6] AS status, CASE user_id % 6 WHEN 0 THEN n WHEN 1 THEN greatest(n - 5, 0) END AS frames FROM n""")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "wave", 16)
    content = _user(s.read.format("binaryFile").load(folder).select("path", "content"))
    kind, whole = F.col("user_id") % 6, F.hex("content")
    cut = F.when(kind == 0, whole).when(kind == 1, F.substr(whole, F.lit(1), F.length(whole) - 20)).when(kind == 2, F.concat(F.lit("52494658"), F.substr(whole, F.lit(9))))
    cut = cut.when(kind == 3, "").when(kind == 4, F.substring(whole, 1, 72)).otherwise(F.substring(whole, 1, 24))
    return files.content_headers(content.select("user_id", F.unhex(cut).alias("content")), "user_id").select("user_id", "status", "frames")


@register("transcode_wave16", _WAVE_BYTES)
def _(s: SparkSession, d: str) -> DataFrame:
    folder, _ = _written(s, d, "aifc", 24, little=False)
    read, out = _user(files.scan(files.read_headers(files.list_files(s, folder)))), shared_path(s, "transcoded")
    q = F.least(F.greatest(F.round(F.col("x") * 32768), F.lit(-32768.0)), F.lit(32767.0)).cast("long")
    return _bytes(s, out, files.write_files(read.select("user_id", "frame", q.alias("a")), out, "wave", 48_000, 16, "a"))


_HEADS = ("524946460000000057415645", "464F524D0000000041494646", "464F524D0000000041494643", "664C6143", "4F67675300" + "00" * 23 + "4F70757348656164", "4F67675300" + "00" * 23 + "01766F72626973", "4F67675300", "FFF1", "494433", "FFFB", "")
_NAMES = ("wave", "aiff", "aifc", "flac", "opus", "vorbis", "ogg", "adts", "mp3", "mp3", "raw")


@register("sniff_content", f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE [{', '.join(repr(n) for n in _NAMES)}][1 + doc_id % 11] END AS format FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in _HEADS])
    content = F.concat(F.get(heads, (F.col("doc_id") % 11).cast("int")), F.lit(b" "), F.col("text").cast("binary"))
    return _table(s, d, "documents").select("doc_id", files.sniff(content).alias("format"))


@register("ogg_file_packets", """SELECT doc_id // 7 AS serial, row_number() OVER (PARTITION BY doc_id // 7 ORDER BY doc_id) - 1 AS packet,
octet_length(encode(coalesce(text, ''))) // 1020 + 1 AS pages, true AS whole, md5(coalesce(text, '')) AS md5 FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    said = _table(s, d, "documents").select(F.floor(F.col("doc_id") / 7).alias("serial"), F.col("doc_id").alias("packet"), F.col("text").cast("binary").alias("data"))
    # A file a serial: its pages in order, other bytes before the first.
    pages = packets.packet_pages(said, 4).groupBy("serial").agg(F.sort_array(F.collect_list(F.struct("page_no", F.hex("page").alias("x")))).alias("s"))
    content = pages.select(F.concat(F.lit(b"junk"), F.unhex(F.concat_ws("", F.transform("s", lambda r: r["x"])))).alias("content"))
    back = packets.scan_packets(packets.good_pages(packets.split_pages(content)))
    return back.select("serial", "packet", "pages", "whole", F.md5("data").alias("md5"))


def _saved(s: SparkSession, d: str, form: str, depth: int, **how: bool) -> str:
    """A folder that the registered format wrote, a file for each event stream."""
    datasource.register(s)
    folder, e = shared_path(s, form), event_stream(s, d)
    channel = F.col("v") if how.get("real") else F.shiftleft("q", depth - 16)
    ordered = files.dealt(e.select("user_id", "frame", channel.alias("a")), "user_id").sortWithinPartitions("user_id", "frame")
    ordered.write.format(form).options(rate=48_000, depth=depth, **how).mode("append").save(folder)
    return folder


@register("wave_source_bytes", _WAVE_BYTES)
def _(s: SparkSession, d: str) -> DataFrame:
    folder = _saved(s, d, "wave", 16)
    read = _user(files.few_tasks(s.read.format("binaryFile").load(folder).select("path", F.md5("content").alias("md5"), F.col("length").alias("bytes"))))
    counted = _user(s.read.format("wave").schema("path string, frame long").load(folder).groupBy("path").agg(F.count("*").alias("frames"))).select("user_id", "frames")
    return read.join(counted, "user_id").select("user_id", "frames", "bytes", "md5")


@register("wave_source_range", f"{E} SELECT user_id, frame, 0 AS ch, q FROM e WHERE frame >= 10 AND frame < 30 AND user_id % 2 = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    made = _user(s.read.format("wave").option("pushFilters", True).schema("path string, frame long, ch int, q long").load(_saved(s, d, "wave", 16)))
    return made.where("frame >= 10 and frame < 30 and ch = 0 and user_id % 2 = 1").select("user_id", "frame", "ch", "q")


@register("aiff_source_blocks", f"{E} SELECT user_id, frame // 16 AS block, count(*) AS n, round(sum(q / 32768.0::double), 4) AS total FROM e GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    made = _user(s.read.format("aiff").option("block", 16).option("partitionBytes", 1 << 16).load(_saved(s, d, "aiff", 24)))
    return made.select("user_id", F.floor(F.col("first") / 16).alias("block"), F.size("x").cast("long").alias("n"), F.round(F.expr("aggregate(x, 0D, (a, v) -> a + v)"), 4).alias("total"))


@register("pcm_source_scan", f"{E} SELECT user_id, frame, cast(round(v * 102400) AS bigint) AS hundredths FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = _saved(s, d, "pcm", 32, real=True, little=False)
    made = s.read.format("pcm").options(depth=32, real=True, little=False).load(folder)
    return _user(made).select("user_id", "frame", F.round(F.col("x") * 102400).cast("long").alias("hundredths"))


def _grow(folder: str, share: float):
    """Writes the first ``share`` of the bytes of each file again, below ``folder``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, base = files._open(folder)
                system.create_dir(base, recursive=True)
                name = path.rpartition("/")[2]
                with system.open_output_stream(f"{base}/.{name}") as f:
                    f.write(content[: int(len(content) * share)])
                system.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return run


@register("wave_source_stream", f"{E} SELECT user_id, frame, q FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    """Files grow between two runs of a stream: those of the first end within a frame or the head."""
    written, folder = _saved(s, d, "wave", 16), shared_path(s, "growing")
    content = files.few_tasks(s.read.format("binaryFile").load(written).select("path", "content"))
    for share in (0.37, 1.0):
        content.mapInArrow(_grow(folder, share), "n long").agg(F.sum("n")).collect()
        stream = s.readStream.format("wave").schema("path string, frame long, q long").load(folder)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").start(f"{folder}-rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return _user(s.read.schema("path string, frame long, q long").parquet(f"{folder}-rows")).select("user_id", "frame", "q")
