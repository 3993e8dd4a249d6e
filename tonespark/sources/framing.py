"""Framed byte streams split at verified frame boundaries, one stream by many tasks; nothing is decoded.

A frame's header tells its length. A reader that is in step takes the header at the end of a frame as the next one; where
there is none it looks for the next header whose frame ends at a header or at the end of the stream. Which headers are
frames so depends on all that comes before, yet each header has one successor, whoever comes to it:

1. each task looks at a chunk of bytes (and a little of what follows): it finds all headers, true and false, their
   successors, and for each way to enter the chunk where that leaves it;
2. ways through chunks are followed from the first by pointer doubling, log(chunks) joins of a few rows a chunk;
3. each chunk, now told how it is entered, gives its frames.

Chunks come from files by ranges (``file_chunks``) or from byte columns (``content_chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonespark.sources.files import _open, dealt
from tonespark.streaming.blocks import shared_path

CHUNK = 4 << 20
#: Where a way ends.
END = -(1 << 62)

#: Kilobits a second by index, of MPEG-1 and of the lower rates, Layer III; samples a second by index.
MPEG_KBPS = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
MPEG_HZ = (44_100, 48_000, 32_000)
#: Fixed value: samples a second by index, of ADTS.
ADTS_HZ = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)


@dataclass(frozen=True)
class Framing:
    """``find`` gives places and lengths of all headers in bytes, of ``head`` bytes each; no frame is longer than ``most``."""

    head: int
    most: int
    find: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _mpeg(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(b[: max(0, len(b) - 3)] == 0xFF)
    two, three = b[at + 1].astype(np.int64), b[at + 2].astype(np.int64)
    good = ((two & 0xF0 == 0xF0) | (two & 0xFE == 0xE2)) & (two >> 1 & 3 == 1) & (three >> 4 != 0) & (three >> 4 != 15) & (three >> 2 & 3 != 3)
    at, two, three = at[good], two[good], three[good]
    first = two & 8 != 0
    kbps = np.array(MPEG_KBPS)[np.where(first, 0, 1), (three >> 4) - 1]
    hz = np.array(MPEG_HZ)[three >> 2 & 3] >> (~first).astype(np.int64) >> (two & 16 == 0).astype(np.int64)
    return at, np.where(first, 1152, 576) * kbps * 125 // hz + (three >> 1 & 1)


def _adts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(b[: max(0, len(b) - 6)] == 0xFF)
    h = [b[at + k].astype(np.int64) for k in range(6)]
    length = (h[3] & 3) << 11 | h[4] << 3 | h[5] >> 5
    good = (h[1] & 0xF6 == 0xF0) & (h[2] >> 2 & 15 < len(ADTS_HZ)) & (length >= 9 - 2 * (h[1] & 1))
    return at[good], length[good]


FRAMINGS = {"mpeg": Framing(4, 1441, _mpeg), "adts": Framing(7, 8191, _adts)}


def file_chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the files ``files`` (path, length), whose bytes the tasks read themselves."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk)))
    rows = files.where("length > 0").select(F.col("path").alias("stream"), F.col("length").alias("size"), F.lit(chunk).cast("long").alias("width"), parts.alias("chunk"), F.lit(None).cast("binary").alias("data"))
    return dealt(rows, "stream", "chunk")


def content_chunks(rows: DataFrame, key: str, framing: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the byte column ``content`` of ``rows``, one row a stream named by ``key``; null contents are empty."""
    f = FRAMINGS[framing]
    size = F.octet_length("content").cast("long")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / chunk)))
    cut = rows.where(size > 0).select(F.col(key).alias("stream"), size.alias("size"), F.lit(chunk).cast("long").alias("width"), parts.alias("chunk"), "content")
    return cut.select("stream", "size", "width", "chunk", F.substring("content", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk + 2 * f.most + f.head)).alias("data"))


def _v(chunk: int, beyond: bool) -> int:
    """The way into a chunk that looks for a frame from its first byte on, or from ``most`` bytes later."""
    return -2 * chunk - 1 - beyond


def survey(data: bytes, f: Framing, size: int, chunk: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Headers of a chunk, their lengths and successors; and ways into it: a header's place or ``_v``, the first frame
    (END: none here), where the way leaves the chunk, past how many frames."""
    a, b = chunk * width, min(size, (chunk + 1) * width)
    at, length = f.find(np.frombuffer(data, np.uint8))
    at = at + a
    fits = at + length <= size
    at, end = at[fits], at[fits] + length[fits]
    i = np.searchsorted(at, end)
    exact = at[np.minimum(i, max(0, len(at) - 1))] == end if len(at) else np.zeros(0, bool)
    sure = at[(exact | (end == size)) & (at < b + f.most)]
    after = _v(chunk + 1, True) if b < size else END
    own = at < b
    at, end, exact = at[own], end[own], exact[own]
    j = np.searchsorted(sure, end)
    found = np.concatenate([sure, [after]])[j]
    succ = np.where(end == size, END, np.where(exact, end, found))
    # Within the chunk successors are followed by doubling, to where each way leaves it.
    n = len(at)
    inside = (succ >= 0) & (succ < b)
    to = np.concatenate([np.where(inside, np.searchsorted(at, succ), np.arange(n)), [n]]).astype(np.int64)
    steps = np.concatenate([inside.astype(np.int64), [0]])
    while True:
        onward = to[to]
        if (onward == to).all():
            break
        steps, to = steps + steps[to], onward
    leaves, frames = succ[to[:n]], steps[:n] + 1
    ways = [(int(at[k]), int(at[k]), int(leaves[k]), int(frames[k])) for k in np.flatnonzero(at < a + f.most)]
    for beyond in (False, True):
        k = int(np.searchsorted(sure, a + f.most * beyond))
        first = int(sure[k]) if k < len(sure) else after
        if 0 <= first < b:
            p = int(np.searchsorted(at, first))
            ways.append((_v(chunk, beyond), first, int(leaves[p]), int(frames[p])))
        else:  # no frame begins here
            ways.append((_v(chunk, beyond), END, first, 0))
    return at, end - at, succ, ways


def _surveyed(chunks: DataFrame, framing: str) -> DataFrame:
    f, kind = FRAMINGS[framing], chunks.schema["stream"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                stream, size, width, chunk, data = (batch.column(c)[k] for c in range(5))
                size, width, chunk = size.as_py(), width.as_py(), chunk.as_py()
                if data.is_valid:
                    raw = data.as_buffer()
                else:
                    system, path = _open(stream.as_py())
                    with system.open_input_file(path) as file:
                        file.seek(chunk * width)
                        raw = file.read(width + 2 * f.most + f.head)
                at, length, succ, ways = survey(raw, f, size, chunk, width)
                head = np.array([int.from_bytes(bytes(raw[p : p + f.head]), "big") for p in (at - chunk * width).tolist()], np.int64)
                columns = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (at, length, succ, head)]
                lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*ways, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(3).slice(k, 1), batch.column(2).slice(k, 1), *columns, *lists], ["stream", "chunk", "width", "at", "length", "succ", "head", "ways", "firsts", "outs", "counts"])

    return chunks.select("stream", "size", "width", "chunk", "data").mapInArrow(run, f"stream {kind}, chunk long, width long, at binary, length binary, succ binary, head binary, ways array<long>, firsts array<long>, outs array<long>, counts array<long>")


def _keep(df: DataFrame, path: str, name: str) -> DataFrame:
    df.write.parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def reached(ways: DataFrame, path: str) -> DataFrame:
    """The ``ways`` (stream, way, out) that are followed from a stream's first, by pointer doubling."""
    jumps = ways.select("stream", "way", "out")
    now = _keep(ways.where(F.col("way") == _v(0, False)).select("stream", "way"), path, "reached-0")
    n, k = now.count(), 0
    while True:
        k += 1
        onward = now.join(jumps.where(F.col("out") != END), ["stream", "way"]).select("stream", F.col("out").alias("way"))
        now = _keep(now.unionByName(onward).repartition("stream", "way").distinct(), path, f"reached-{k}")
        if (m := now.count()) == n:
            return now
        n = m
        then = jumps.select("stream", F.col("way").alias("out"), F.col("out").alias("last"))
        jumps = _keep(jumps.where(F.col("out") != END).join(then, ["stream", "out"]).select("stream", "way", F.col("last").alias("out")), path, f"jumps-{k}")


def split_frames(chunks: DataFrame, framing: str) -> DataFrame:
    """``stream, frame, at, length, head`` of each frame of ``chunks`` (of one width): its number, first byte and length,
    and its header as one integer.

    Bytes between frames (junk, damaged frames, false headers) are passed over, as a reader would that goes through the
    stream from its first byte. A frame that the stream's end cuts is none. Streams without frames give no rows; a width
    has to be at least as long as the longest frame.
    """
    f, path = FRAMINGS[framing], shared_path(chunks.sparkSession, "framing")
    kind = chunks.schema["stream"].dataType.simpleString()
    made = _keep(_surveyed(chunks, framing), path, "chunks")
    if not made.where(F.col("width") < f.most).isEmpty():
        raise ValueError(f"chunks have to be {f.most} bytes at least")
    each = made.select("stream", "chunk", F.explode(F.arrays_zip("ways", "firsts", "outs", "counts")).alias("w"))
    ways = _keep(each.select("stream", "chunk", F.col("w.ways").alias("way"), F.col("w.firsts").alias("first"), F.col("w.outs").alias("out"), F.col("w.counts").alias("n")), path, "ways")
    entered = ways.join(reached(ways, path), ["stream", "way"]).select("stream", "chunk", "first", "n")
    before = Window.partitionBy("stream").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    entered = entered.select("stream", "chunk", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, length, succ, head = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i8") for c in (1, 2, 3, 4))
                now, base = (batch.column(c)[k].as_py() for c in (5, 6))
                place, onward, frames = {p: i for i, p in enumerate(at.tolist())}, succ.tolist(), []
                while (i := place.get(now)) is not None:
                    frames.append(i)
                    now = onward[i]
                own = np.array(frames, np.int64)
                stream = pa.array([batch.column(0)[k].as_py()] * len(own), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([stream, pa.array(base + np.arange(len(own))), *(pa.array(x[own]) for x in (at, length, head))], ["stream", "frame", "at", "length", "head"])

    both = made.join(entered, ["stream", "chunk"]).select("stream", "at", "length", "succ", "head", "first", "base")
    return both.mapInArrow(run, f"stream {kind}, frame long, at long, length long, head long")
