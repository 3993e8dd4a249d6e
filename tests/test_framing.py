"""Frames of damaged byte streams by chunks against a reader that goes through the stream from its first byte."""

import random

import numpy as np
import pytest

from tonespark.sources import files, framing


def mpeg_frame(r, false_syncs):
    two, three = 0xE0 | r.choice((0x1B, 0x13, 0x03)), r.randrange(1, 15) << 4 | r.randrange(3) << 2 | r.randrange(2) << 1
    head = bytes([0xFF, two, three, r.randrange(256)])
    _, (n, *_) = framing._mpeg(np.frombuffer(head, np.uint8))
    return body(r, head, int(n), false_syncs)


def adts_frame(r, false_syncs):
    n = r.choice((9, 20, 300, 8191))
    head = bytes([0xFF, 0xF0 | r.choice((0, 8)) | 1, r.randrange(4) << 6 | r.randrange(13) << 2, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC])
    return body(r, head, n, false_syncs)


def body(r, head, n, false_syncs):
    data = bytearray(head + bytes(r.randrange(255) for _ in range(n - len(head))))
    for _ in range(r.randrange(3) if false_syncs else 0):
        if n > 3 * len(head):
            k = r.randrange(len(head), n - len(head))
            data[k : k + len(head)] = head
    return bytes(data)


def stream_of(r, make, n, false_syncs=True):
    out = [bytes(r.randrange(256) for _ in range(r.choice((0, 0, 500, 9000))))]
    for _ in range(n):
        frame = bytearray(make(r, false_syncs))
        kind = r.random()
        if kind < 0.1:
            frame[r.randrange(2)] ^= 0x55  # a lost header
        elif kind < 0.15:
            del frame[len(frame) // 2 :]
        elif kind < 0.2:
            frame += bytes(r.randrange(256) for _ in range(r.choice((1, 70, 5000))))
        out.append(bytes(frame))
    return b"".join(out) + r.choice((b"", b"\xff", out[-1][:-1]))


def walk(data, f):
    """Frames (first byte, length) of a sequential reader."""
    at, length = f.find(np.frombuffer(data, np.uint8))
    heads = {p: n for p, n in zip(at.tolist(), length.tolist(), strict=True) if p + n <= len(data)}
    sure = sorted(p for p, n in heads.items() if p + n in heads or p + n == len(data))
    out, now = [], None
    while True:
        if now not in heads:
            now = next((p for p in sure if now is None or p >= now), None)
            if now is None:
                return out
        out.append((now, heads[now]))
        now += heads[now]


@pytest.mark.parametrize(("kind", "make"), [("mpeg", mpeg_frame), ("adts", adts_frame)])
def test_frames_equal_a_sequential_walk(spark, kind, make):
    r, f = random.Random(6), framing.FRAMINGS[kind]
    streams = {k: stream_of(r, make, n) for k, n in enumerate((0, 1, 2, 30, 30, 60, 60))}
    streams |= {20: b"", 21: None, 22: b"\xff" * 30_000, 23: bytes(40_000), 24: stream_of(r, make, 3) + bytes(60_000) + stream_of(r, make, 20)}
    df = spark.createDataFrame([(k, c, "x") for k, c in streams.items()], "k long, content binary, stream string")
    for chunk in (f.most, 10_000, 1 << 22):
        made = framing.split_frames(framing.content_chunks(df.repartition(4), "k", kind, chunk), kind)
        got = {}
        for x in made.orderBy("stream", "frame").collect():
            assert x.frame == len(got.setdefault(x.stream, [])) and x.head == int.from_bytes(streams[x.stream][x.at : x.at + f.head], "big")
            got[x.stream].append((x.at, x.length))
        assert got == {k: w for k, c in streams.items() if (w := walk(c or b"", f))}
    assert sum(map(len, got.values())) > 150 and framing.split_frames(framing.content_chunks(df.where("false"), "k", kind), kind).count() == 0
    with pytest.raises(ValueError, match="at least"):
        framing.split_frames(framing.content_chunks(df, "k", kind, 1000), kind)


def test_one_file_is_many_tasks(spark, tmp_path):
    r = random.Random(9)
    streams = {k: stream_of(r, mpeg_frame, 400) for k in range(2)}
    for k, c in streams.items():
        (tmp_path / f"{k}.mp3").write_bytes(c)
    chunks = framing.file_chunks(files.list_files(spark, str(tmp_path)), 4096)
    assert chunks.count() > 60 and chunks.rdd.getNumPartitions() > 1
    got = {}
    for x in framing.split_frames(chunks, "mpeg").orderBy("stream", "frame").collect():
        got.setdefault(int(x.stream[-5]), []).append((x.at, x.length))
    assert got == {k: walk(c, framing.FRAMINGS["mpeg"]) for k, c in streams.items()} and len(got[0]) > 250
