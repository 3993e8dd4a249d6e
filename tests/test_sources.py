"""Containers that are damaged or odd, header fields of known headers, and streams in several micro-batches."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonespark.functions import bits
from tonespark.functions.checksums import CRC32_PAGE, crc_table
from tonespark.sources import containers, files, packets, signals
from tonespark.streaming import blocks


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(u, i, (i * 7919 * (u + 1)) % 65536 - 32768) for u in (1, 2) for i in range(70)]
    return spark.createDataFrame(rows, "user_id long, frame long, q long"), rows


def values(df):
    return sorted((r.user_id, r.segment * 32 + r.i, r.q) for r in df.collect())


def test_aiff(parts):
    stream, rows = parts
    files = signals.aiff_files(signals.segments(stream, 32, "big"), 44_100)
    assert values(signals.scan_aiff(files)) == sorted(rows)
    head = bytes(files.where("user_id = 1 and segment = 0").first().content)
    assert head[:4] == b"FORM" and int.from_bytes(head[4:8]) == len(head) - 8 and head[28:38].hex() == "400eac44000000000000"
    short = files.withColumn("content", F.expr("substring(content, 1, 54 + 9)"))
    assert signals.scan_aiff(short).where("user_id = 1 and segment = 0").count() == 4
    assert signals.scan_aiff(files.withColumn("content", F.expr("cast('FORM' as binary)"))).count() == 0
    assert signals.scan_aiff(files.where("false")).count() == 0


def test_ogg(parts):
    stream, rows = parts
    pages = signals.ogg_pages(signals.segments(stream, 32))
    got = signals.scan_ogg(pages)
    assert values(signals.scan_raw(got, "little")) == sorted(rows)
    table = crc_table(*CRC32_PAGE[:2])
    for p in pages.collect():
        raw, c = bytearray(p.page), 0
        told, raw[22:26] = int.from_bytes(raw[22:26], "little"), bytes(4)
        for b in raw:
            c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
        assert c == told
    assert [(r.flags, r.granule, r.good) for r in got.where("user_id = 2").orderBy("segment").collect()] == [(2, 32, True), (0, 64, True), (4, 70, True)]
    bad = pages.withColumn("page", F.concat(F.expr("substring(page, 1, 40)"), F.lit(b"\x55"), F.expr("substring(page, 42)")))
    assert not any(r.good for r in signals.scan_ogg(bad).collect()) and signals.scan_ogg(pages.where("false")).count() == 0
    wide = signals.scan_ogg(signals.ogg_pages(signals.segments(stream, 1000))).collect()
    assert [(r.good, len(r.data)) for r in wide] == [(True, 140)] * 2


def test_header_fields(spark):
    df = spark.createDataFrame([(0xFFFB9064, 0xFFF15080043FFC, 0xFFF8C9A8), (None, None, None)], "m long, a long, f long")
    one = df.select(*bits.bit_fields(F.col("m"), bits.MPEG_AUDIO)).collect()
    assert (one[0].sync, one[0].version, one[0].layer, one[0].bitrate, one[0].rate, one[0].mode) == (0x7FF, 3, 1, 9, 0, 1) and one[1].sync is None
    two = df.select(*bits.bit_fields(F.col("a"), bits.ADTS)).first()
    assert (two.sync, two.profile, two.rate, two.channels, two.frame_length) == (0xFFF, 1, 4, 2, 33)
    three = df.select(*bits.bit_fields(F.col("f"), bits.FLAC_FRAME)).first()
    assert (three.sync, three.block_code, three.rate_code, three.channel_code, three.depth_code) == (0x3FFE, 12, 9, 10, 4)


def test_blocks_fill_across_batches(spark, tmp_path):
    rows = [(i, float(i % 400), i % 3 or None) for i in range(300)]
    for k in range(3):
        own = spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "event_id long, value double, user_id long")
        own.coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    os.mkdir(tmp_path / "events.parquet")
    for k in range(3):
        (file,) = (tmp_path / f"part{k}").glob("*.parquet")
        os.utime(file.rename(tmp_path / "events.parquet" / f"{k}.parquet"), (1000 + k, 1000 + k))
    made = lambda n: sorted(tuple(r) for r in blocks.full_blocks(blocks.read_events(spark, str(tmp_path), n), "test").collect())
    q = {u: [round(v / 1024 * 32768) for _, v, w in rows if w == u] for u in (1, 2)}
    want = sorted((u, b, min(p), max(p), sum(p)) for u, x in q.items() for b in range(len(x) // 20) for p in [x[b * 20 : b * 20 + 20]])
    assert made(1) == want and made(None) == want
    rest = [(u, len(x) // 20, min(p), max(p), sum(p)) for u, x in q.items() if (p := x[len(x) // 20 * 20 :])]
    assert sorted(tuple(r) for r in blocks.full_blocks(blocks.read_events(spark, str(tmp_path), 1), "test", flush=True).collect()) == sorted(want + rest)


def test_pages_split_from_files(spark):
    said = [(1, i, bytes(range(256)) * k) for i, k in enumerate((0, 1, 9, 5))]
    pages = [bytes(r.page) for r in packets.packet_pages(spark.createDataFrame(said, "serial int, packet int, data binary"), 2).orderBy("page_no").collect()]
    hurt = pages[3][:40] + b"?" + pages[3][41:]
    contents = {1: b"Og" + b"".join(pages), 2: b"".join(pages[:3]) + b"junk" + hurt + b"".join(pages[4:]), 3: b"".join(pages)[:-3], 4: b"", 5: None, 6: b"OggS"}
    df = spark.createDataFrame([(k, c, "x") for k, c in contents.items()], "k int, content binary, page string").drop("page")
    got = {}
    for r in packets.split_pages(df, "k").orderBy("k", "at").collect():
        got.setdefault(r.k, []).append(bytes(r.page))
        assert contents[r.k][r.at : r.at + len(r.page)] == r.page
    assert got == {1: pages, 2: [*pages[:3], hurt, *pages[4:]], 3: [*pages[:-1], pages[-1][:-3]], 6: [b"OggS"]}
    good = packets.good_pages(packets.split_pages(df, "k"))
    assert {r.k: r["count"] for r in good.groupBy("k").count().collect()} == {1: len(pages), 2: len(pages) - 1, 3: len(pages) - 1}
    back = packets.scan_packets(good.where("k = 2").select("page")).orderBy("packet").collect()
    assert [r.whole for r in back].count(False) == 2 and len(back) == 5  # the damaged page was the middle of one packet


def test_files_of_many_kinds(spark, tmp_path):
    rows = [(u, i, (i * 7919 * (u + 1)) % 65536 - 32768, (i * 31 * u) % 999 - 500) for u in (1, 2, 3) for i in range(50 * u + 1)]
    df = spark.createDataFrame(rows, "user_id long, frame long, a long, b long")
    n = 0
    for form, depth, how in [("wave", 8, {}), ("wave", 16, {}), ("wave", 24, {}), ("wave", 32, {}), ("wave", 32, {"real": True}), ("wave", 64, {"real": True}), ("aifc", 16, {}), ("aifc", 24, {}), ("aifc", 16, {"little": False}), ("aifc", 32, {}), ("aifc", 32, {"real": True}), ("aifc", 64, {"real": True}), ("raw", 24, {"little": False}), ("raw", 8, {})]:
        n, real, folder = n + 1, how.get("real", False), f"{tmp_path}/files {n}"
        scaled = df.select("user_id", "frame", *[(F.col(c) / 32768 if real else F.shiftright(c, 8) if depth == 8 else F.shiftleft(F.col(c), depth - 16)).alias(c) for c in "ab"])
        written = files.write_files(scaled, folder, form, 44_100, depth, "a", "b", **how)
        listed = files.list_files(spark, folder)
        assert sorted((r.frames, r.bytes) for r in written.collect()) == sorted((50 * u + 1, r.length) for u, r in enumerate(listed.orderBy("length").collect(), 1))
        heads = files.raw_headers(listed, 2, depth, how.get("little", True), real, 44_100.0) if form == "raw" else files.read_headers(listed)
        assert {(r.status, r.channels, r.depth, r.rate, r.real) for r in heads.collect()} == {("ok", 2, depth, 44_100.0, real)}
        got = files.scan(heads, frames=7).select(files.stream_of(F.col("path")).cast("long").alias("u"), "frame", "ch", F.round(F.col("x") * 32768).alias("x"))
        want = [(u, i, k, float(x >> 8 << 8 if depth == 8 else x)) for u, i, *both in rows for k, x in enumerate(both)]
        assert sorted(map(tuple, got.collect())) == want
        blocks_ = files.scan_blocks(heads, block=16).selectExpr("path", "first", "ch", "posexplode(x) AS (i, x)")
        assert sorted((int(r.u), r.frame, r.ch, r.x) for r in blocks_.select(files.stream_of(F.col("path")).alias("u"), (F.col("first") + F.col("i")).alias("frame"), "ch", F.round(F.col("x") * 32768).alias("x")).collect()) == want
        assert files.scan_blocks(heads, 10, 40, 16).where("ch = 0 and path like '%/1.%'").selectExpr("first", "size(x) AS n").orderBy("first").collect() == [(10, 6), (16, 16), (32, 8)]
        assert files.scan(heads, 45, 60, frames=16).select("frame").distinct().count() == 15
    assert files.scan(heads, 1000).count() == 0


def test_headers_of_damaged_contents(spark):
    head, data = files.wave_head(4, 1, 8000, 16, False), bytes(range(8))
    aifc = files.aifc_head(4, 1, 8000, 16, b"twos")
    contents = {
        "ok": head + data, "ok aifc": aifc + data, "truncated": head + data[:5], "truncated aifc": aifc + data[:4], "empty": b"", "no container": b"RIFX" + head[4:] + data,
        "no samples": head[:36], "no format chunk": head[:12], "samples before the format": head[:12] + head[36:44] + data, "unsupported samples": head[:20] + b"\x55" + head[21:] + data,
        "no channels": head[:22] + b"\0" + head[23:] + data, "no rate": head[:24] + bytes(4) + head[28:] + data, "no common chunk": aifc[:24] + aifc[56:] + data, "empty null": None,
    }
    df = spark.createDataFrame(list(contents.items()), "k string, content binary")
    got = {r.k: r for r in files.content_headers(df, "k").collect()}
    assert {k: r.status for k, r in got.items()} == {k: k.removesuffix(" aifc").removesuffix(" null") for k in contents}
    assert [got[k].frames for k in ("ok", "ok aifc", "truncated", "truncated aifc", "empty")] == [4, 4, 2, 2, None] and got["ok"].seconds == 0.0005
    known = {"wave": head, "aifc": aifc, "flac": b"fLaC", "mp3": b"ID3\4", "raw": b"hello"}
    made = spark.createDataFrame([*known.items(), ("none", None)], "k string, c binary").select("k", files.sniff(F.col("c")).alias("f"))
    assert {r.k: r.f for r in made.collect()} == {**{k: k for k in known}, "none": None}


def test_windows_close_under_the_watermark(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, h) as ts, 'a' as event_type, 1.5D as value from values (0), (0), (1), (5), (null) as t(h)")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = blocks.run_to_end(blocks.closed_windows(blocks.read_events(spark, str(tmp_path))), "test").collect()
    assert sorted((r.hour.hour, r.n, r.total) for r in got) == [(0, 2, 3.0), (1, 1, 1.5)]


def test_odd_waves(spark):
    fmt = lambda kind, ch, depth, more=b"": b"fmt " + (16 + len(more)).to_bytes(4, "little") + b"".join(x.to_bytes(n, "little") for x, n in ((kind, 2), (ch, 2), (8000, 4), (8000 * ch * depth // 8, 4), (ch * depth // 8, 2), (depth, 2))) + more
    guid = bytes.fromhex("16001000000000000100" + containers.EXTENSIBLE_TAIL)
    data = lambda raw, size=None: b"data" + (len(raw) if size is None else size).to_bytes(4, "little") + raw
    riff = lambda *parts: b"RIFF\0\0\0\0WAVE" + b"".join(parts)
    contents = {
        1: riff(b"LIST\3\0\0\0abc\0", fmt(1, 1, 8), data(b"\x00\x80\xff")),
        2: riff(fmt(1, 1, 24), data(b"\xff\xff\xff\x00\x00\x80\x01", 0xFFFFFFFF)),
        3: riff(data(b"\1\2"), fmt(1, 1, 16)),
        4: riff(fmt(3, 1, 32), data(bytes(8))),
        5: riff(fmt(0xFFFE, 2, 16, (22).to_bytes(2, "little") + guid[:6] + guid[8:]), data(b"\1\0\2\0\3\0")),
        6: b"RIFF", 7: b"", 8: None, 9: riff(fmt(1, 0, 16), data(b"\1\2")), 10: riff(fmt(1, 1, 16), data(b"")),
        11: riff(fmt(1, 1, 16), data(b"".join((i % 999).to_bytes(2, "little") for i in range(1000)))),
    }
    files = spark.createDataFrame(list(contents.items()), "k int, content binary")
    got = {}
    for r in containers.scan_wave(files, "k").orderBy("k", "frame", "ch").collect():
        got.setdefault(r.k, []).append((r.depth, r.frame, r.ch, r.q))
    assert got.pop(11) == [(16, i, 0, i % 999) for i in range(1000)]
    assert got.pop(4) == [(32, 0, 0, None), (32, 1, 0, None)]  # floats have no integers
    assert got == {1: [(8, 0, 0, -128), (8, 1, 0, 0), (8, 2, 0, 127)], 2: [(24, 0, 0, -1), (24, 1, 0, -(1 << 23))], 5: [(16, 0, 0, 1), (16, 0, 1, 2)]}
    assert containers.scan_aiff_chunks(files, "k").count() == 0 and containers.scan_wave(files.where("false"), "k").count() == 0


def test_packets_over_pages(spark):
    said = [b"", b"x" * 254, b"y" * 255, bytes(range(256)) * 5, None]
    sent = spark.createDataFrame([(3, i, x) for i, x in enumerate(said)], "serial int, packet int, data binary")
    pages = packets.packet_pages(sent, 2)
    assert all(r.good for r in signals.scan_ogg(pages).collect())
    back = lambda df: [(r.packet, r.pages, r.whole, bytes(r.data)) for r in packets.scan_packets(df.select("page")).orderBy("packet").collect()]
    assert back(pages) == [(i, n, True, x or b"") for i, (n, x) in enumerate(zip((1, 1, 1, 3, 1), said, strict=True))]
    # The long packet has pages 3 to 5.
    whole = lambda df: [(r[2], len(r[3])) for r in back(df)]
    assert whole(pages.where("page_no <> 3")) == [(True, 0), (True, 254), (True, 255), (False, 770), (True, 0)]
    assert whole(pages.where("page_no <> 4")) == [(True, 0), (True, 254), (True, 255), (False, 510), (False, 260), (True, 0)]
    assert whole(pages.where("page_no <> 5")) == [(True, 0), (True, 254), (True, 255), (False, 1020), (True, 0)]
    assert back(pages.where("false")) == []
    # Several packets in one page.
    one = b"OggS\0\2" + bytes(8) + (9).to_bytes(4, "little") + bytes(8) + b"\3\2\0\3" + b"abcde"
    assert back(spark.createDataFrame([(one,), (b"OggS",), (None,)], "page binary")) == [(0, 1, True, b"ab"), (1, 1, True, b""), (2, 1, True, b"cde")]


def test_small_streams_are_written_at_once_and_gathered(tmp_path):
    """A stream that fits in memory makes one file; batches of small files are read together, with all their rows."""
    made, system = [], files._open(str(tmp_path))[0]

    class Counted:
        def __getattr__(self, name):
            return getattr(system, name)

        def open_output_stream(self, path):
            made.append(path)
            return system.open_output_stream(path)

    for n, streams in ((5, 1), (files.COPY_BYTES * 3 + 7, 2)):
        made.clear()
        held = files.Held(Counted(), f"{tmp_path}/part")
        for k in range(0, n, 1000):
            held.write(bytes([k // 1000 % 256]) * min(1000, n - k))
        held.save(f"{tmp_path}/whole", b"head", 1)
        want = b"head" + b"".join(bytes([k // 1000 % 256]) * min(1000, n - k) for k in range(0, n, 1000)) + b"\0"
        assert (tmp_path / "whole").read_bytes() == want and len(made) == streams and not (tmp_path / "part").exists()
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k])], ["k"]) for k in range(100_000)]
    got = list(files.gathered(iter(batches)))
    assert len(got) == 4 and [x for b in got for x in b.column(0).to_pylist()] == [k for k in range(100_000) for _ in range(2)]


def test_stream_names_come_from_the_file_name(spark):
    paths = [("/a.b/12.wav",), ("file:/x/y.z/k.1.aifc",), ("7.raw",), ("/none",), (None,)]
    assert [r[0] for r in spark.createDataFrame(paths, "p string").select(files.stream_of(F.col("p"))).collect()] == ["12", "k.1", "7", "", None]


def test_checksums_of_written_pages_are_made_once_a_reading(spark):
    """Filters on a page that is read back don't make its checksum again, in a second Python worker of the task."""
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    pages = packets.packet_pages(spark.createDataFrame([(3, 0, b"x" * 300)], "serial int, packet int, data binary"), 4).select("page")
    assert steps(pages) == 1 and steps(packets.scan_packets(pages)) == 2  # pages are read twice: for their numbers and their bytes
    parts = spark.createDataFrame([(1, 0, 2, b"abcd")], "user_id long, segment long, n long, data binary")
    made = signals.ogg_pages(parts)
    assert steps(made) == 1 and steps(signals.scan_ogg(made)) == 2  # one is the reader's
    assert [(r.good, bytes(r.data)) for r in signals.scan_ogg(made).collect()] == [(True, b"abcd")]
