"""Files of PCM samples: WAVE, AIFF, AIFC and raw, read by ranges of frames and written one a stream.

Headers are read alone (``read_headers``): a small helper looks at chunk heads, never at samples. A scan deals ranges of
frames to tasks, and each task reads the bytes of its ranges, so a long file is many tasks and frames that are not asked
for are not read. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.sources.decode import decode, decode_float, encode

RANGE_FRAMES = 1 << 18
#: Rows, and bytes, that small batches are gathered to: each has a cost of its own on its way to Spark.
GATHER_ROWS, GATHER_BYTES = 1 << 16, 4 << 20
#: Bytes of a stream that a writer holds.
COPY_BYTES = 1 << 20
#: Kinds of AIFC samples (little-endian, float), and the identifier tail of an extensible WAVE format.
AIFC_KINDS = {
    b"NONE": (False, False), b"twos": (False, False), b"in24": (False, False), b"in32": (False, False), b"sowt": (True, False), b"ni24": (True, False),
    b"FL32": (False, True), b"fl32": (False, True), b"FL64": (False, True), b"fl64": (False, True),
}
EXTENSIBLE_TAIL = bytes.fromhex("000000001000800000AA00389B71")
#: The time stamp of the AIFC version that FVER names.
AIFC_VERSION = 0xA2805140
HEADER = "status string, format string, channels int, rate double, depth int, real boolean, little boolean, offset boolean, data_start long, frames long"
Read = Callable[[int, int], bytes]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    return (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GATHER_ROWS rows or GATHER_BYTES bytes; longer ones are passed on."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHER_ROWS or size >= GATHER_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Held:
    """Samples of a stream until its head can be written: up to COPY_BYTES in memory, more in a file of their own."""

    def __init__(self, system: fs.FileSystem, part: str):
        self.system, self.part, self.own, self.waiting, self.size, self.out = system, part, [], 0, 0, None

    def write(self, raw: bytes) -> None:
        self.own.append(raw)
        self.waiting, self.size = self.waiting + len(raw), self.size + len(raw)
        if self.waiting > COPY_BYTES:
            self.out = self.out or self.system.open_output_stream(self.part)
            self.out.write(b"".join(self.own))
            self.own, self.waiting = [], 0

    def save(self, path: str, head: bytes, pad: int) -> None:
        if self.out is not None:
            self.out.close()
        with self.system.open_output_stream(path) as whole:
            whole.write(head)
            if self.out is not None:
                with self.system.open_input_stream(self.part) as samples:
                    while data := samples.read(COPY_BYTES):
                        whole.write(data)
            whole.write(b"".join([*self.own, bytes(pad)]))
        if self.out is not None:
            self.system.delete_file(self.part)


class Damaged(ValueError):
    """What is wrong with a content, as its status."""


def _chunks(read: Read, size: int, order: str) -> Iterator[tuple[bytes, int, int, bool]]:
    """Name, start and size of each chunk, and whether it is all there; sizes beyond the end reach to the end."""
    at = 12
    while at + 8 <= size:
        head = read(at, 8)
        told = int.from_bytes(head[4:], order)
        own = min(told, size - at - 8)
        yield head[:4], at + 8, own, own == told or told == 0xFFFFFFFF
        at += 8 + own + own % 2


def _wave(read: Read, size: int) -> tuple:
    form = None
    for name, at, own, whole in _chunks(read, size, "little"):
        if name == b"fmt ":
            if own < 16:
                raise Damaged("format chunk too short")
            form = read(at, min(own, 40))
        elif name == b"data":
            if form is None:
                raise Damaged("samples before the format")
            kind, channels, rate, _, align, depth = struct.unpack("<HHIIHH", form[:16])
            if kind == 0xFFFE and len(form) >= 40 and form[26:40] == EXTENSIBLE_TAIL:
                kind = int.from_bytes(form[24:26], "little")
            return _checked("wave", kind in (1, 3), kind == 3, channels, float(rate), depth, True, depth == 8 and kind == 1, at, own, whole, None)
    raise Damaged("no samples" if form else "no format chunk")


def _aiff(read: Read, size: int, compressed: bool) -> tuple:
    common = sound = None
    for name, at, own, whole in _chunks(read, size, "big"):
        if name == b"COMM" and own >= 18:
            common = read(at, min(own, 22))
        elif name == b"SSND" and own >= 8:
            skip = int.from_bytes(read(at, 4), "big")
            sound = at + 8 + skip, max(0, own - 8 - skip), whole
    if not common or not sound:
        raise Damaged("no samples" if common else "no common chunk")
    channels, told, depth = struct.unpack(">HIH", common[:8])
    sign, high = struct.unpack(">HQ", common[8:18])
    little, real = AIFC_KINDS.get(common[18:22] if compressed else b"NONE", (None, False))
    return _checked("aifc" if compressed else "aiff", little is not None, real, channels, high * 2.0 ** ((sign & 0x7FFF) - 16446), depth, bool(little), False, *sound, told)


def _checked(form: str, known: bool, real: bool, channels: int, rate: float, depth: int, little: bool, offset: bool, start: int, size: int, whole: bool, told: int | None) -> tuple:
    if not known or depth not in ((32, 64) if real else (8, 16, 24, 32)):
        raise Damaged("unsupported samples")
    if not channels or rate <= 0:
        raise Damaged("no channels" if not channels else "no rate")
    frames = size // (channels * depth // 8)
    status = "ok" if whole and (told is None or told <= frames) else "truncated"
    return status, form, channels, rate, depth, real, little, offset, start, frames if told is None else min(told, frames)


def header_of(read: Read, size: int) -> tuple:
    """The fields of HEADER; ``status`` is ok, truncated (the frames that are there can be read) or what is wrong."""
    magic = read(0, 12)
    try:
        if magic[:4] == b"RIFF" and magic[8:] == b"WAVE":
            return _wave(read, size)
        if magic[:4] == b"FORM" and magic[8:] in (b"AIFF", b"AIFC"):
            return _aiff(read, size, magic[8:] == b"AIFC")
        raise Damaged("no container" if magic else "empty")
    except Damaged as e:
        return str(e), *(None,) * 9


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return few_tasks(found.select("path", "length"))


def few_tasks(files: DataFrame) -> DataFrame:
    """``files`` in no more tasks than a shuffle has: Spark deals small files by a few tens to a task."""
    return files.coalesce(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_header(rows: DataFrame, head: Callable[[dict[str, Any]], tuple], *keys: str) -> DataFrame:
    names = [c.split()[0] for c in HEADER.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}[c.split()[1]] for c in HEADER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [head({c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}) for i in range(batch.num_rows)]
            columns = list(zip(*made, strict=True)) if made else [()] * len(names)
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, *names])

    made = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [HEADER])
    return rows.mapInArrow(run, made).withColumn("seconds", F.col("frames") / F.col("rate"))


def read_headers(files: DataFrame) -> DataFrame:
    """``path``, the fields of HEADER and ``seconds`` of each file (path, length), from its chunk heads alone.

    A file that can't be read as a container keeps its row: ``status`` says why and the fields are null.
    """

    def head(row: dict[str, Any]) -> tuple:
        system, path = _open(row["path"].as_py())
        with system.open_input_file(path) as f:

            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            return header_of(read, f.size())

    return _with_header(files.select("path"), head, "path")


def content_headers(files: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the same fields of contents in a byte column (``content``); null contents are empty."""

    def head(row: dict[str, Any]) -> tuple:
        data = memoryview(row["content"].as_buffer()) if row["content"].is_valid else memoryview(b"")
        return header_of(lambda at, n: bytes(data[at : at + n]), len(data))

    return _with_header(files.select(*keys, "content"), head, *keys)


def raw_headers(files: DataFrame, channels: int, depth: int, little: bool = True, real: bool = False, rate: float = 48_000.0) -> DataFrame:
    """Headers of raw files (path, length), which have none: all is told by the caller."""
    frames = F.floor(F.col("length") / (channels * depth // 8)).cast("long")
    told = {"status": F.lit("ok"), "format": F.lit("raw"), "channels": F.lit(channels), "rate": F.lit(rate), "depth": F.lit(depth), "real": F.lit(real), "little": F.lit(little), "offset": F.lit(False), "data_start": F.lit(0).cast("long"), "frames": frames}
    return files.select("path", *[c.alias(n) for n, c in told.items()]).withColumn("seconds", F.col("frames") / F.col("rate"))


def dealt(work: DataFrame, *by: str) -> DataFrame:
    """Small rows that stand for much work, dealt to as many tasks as a shuffle has: a number of its own keeps adaptive
    execution from joining partitions by the few bytes that these rows have."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _ranges(headers: DataFrame, first: int, end: int | None, frames: int, make: Callable[[dict[str, Any], bytes], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` gives for each range of up to ``frames`` frames (its row and bytes)."""
    stop = F.col("frames") if end is None else F.least(F.col("frames"), F.lit(end).cast("long"))
    good = headers.where(F.col("status").isin("ok", "truncated")).withColumn("stop", stop).where(F.col("stop") > first)
    part = F.explode(F.sequence(F.lit(first // frames).cast("long"), F.floor((F.col("stop") - 1) / frames)))
    work = good.select("path", "channels", (F.col("depth") / 8).cast("int").alias("octets"), "little", "offset", "real", "data_start", "stop", part.alias("part"))
    begin = F.greatest(F.col("part") * frames, F.lit(first))
    work = work.select("path", "channels", "octets", "little", "offset", "real", "data_start", begin.alias("begin"), (F.least(F.col("stop"), (F.col("part") + 1) * frames) - begin).alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["begin"]))
            for path, own in groupby(rows, key=lambda r: r["path"]):  # a file is opened once a batch
                system, plain = _open(path)
                with system.open_input_file(plain) as f:
                    for row in own:
                        align = row["channels"] * row["octets"]
                        f.seek(row["data_start"] + row["begin"] * align)
                        raw = f.read(row["n"] * align)
                        yield make(row, raw[: len(raw) // align * align])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(read(batches))

    return dealt(work, "path", "begin").mapInArrow(run, schema)


def scan(headers: DataFrame, first: int = 0, end: int | None = None, frames: int = RANGE_FRAMES) -> DataFrame:
    """``path, frame, ch, q, x`` of the frames from ``first`` to before ``end``: samples as integers (null for floats)
    and of full scale 1.

    Each task reads ranges of up to ``frames`` frames, and no bytes beside them. Files without status ok or truncated
    give no rows.
    """

    def make(row: dict[str, Any], raw: bytes) -> pa.RecordBatch:
        q, x = decode(raw, row["octets"], row["little"], row["offset"], row["real"])
        i = np.arange(len(q))
        return pa.RecordBatch.from_arrays(
            [pa.array([row["path"]] * len(q), pa.string()), pa.array(row["begin"] + i // row["channels"]), pa.array((i % row["channels"]).astype(np.int32)), pa.array(q, mask=np.full(len(q), row["real"])), pa.array(x)],
            ["path", "frame", "ch", "q", "x"],
        )

    return _ranges(headers, first, end, frames, make, "path string, frame long, ch int, q long, x double")


def scan_blocks(headers: DataFrame, first: int = 0, end: int | None = None, block: int = 4096) -> DataFrame:
    """``path, first, ch, x`` of the same frames: up to ``block`` values of full scale 1 of a channel as one array of
    floats, which is several times as fast as a row a sample. Blocks begin at multiples of ``block``, or at ``first``."""

    def make(row: dict[str, Any], raw: bytes) -> pa.RecordBatch:
        x = decode_float(raw, row["octets"], row["little"], row["offset"], row["real"])
        n = len(x) // row["channels"]
        to_edge = -row["begin"] % block
        cuts = sorted({0, *range(to_edge, n, block), n})
        by_channel = x.reshape(n, row["channels"]).T
        size = np.tile(np.diff(cuts), row["channels"])
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.ascontiguousarray(by_channel).ravel()))
        starts = np.tile(np.array(cuts[:-1], np.int64), row["channels"])
        return pa.RecordBatch.from_arrays(
            [pa.array([row["path"]] * len(size), pa.string()), pa.array(row["begin"] + starts), pa.array(np.repeat(np.arange(row["channels"]), len(cuts) - 1).astype(np.int32)), values], ["path", "first", "ch", "x"]
        )

    return _ranges(headers, first, end, max(block, RANGE_FRAMES // block * block), make, "path string, first long, ch int, x array<float>")


def wave_head(n: int, channels: int, rate: int, depth: int, real: bool) -> bytes:
    size, align = n * channels * depth // 8, channels * depth // 8
    form = struct.pack("<HHIIHH", 3 if real else 1, channels, rate, rate * align, align, depth)
    return b"RIFF" + struct.pack("<I", min(size + size % 2 + 36, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", min(size, 0xFFFFFFFF))


def aifc_head(n: int, channels: int, rate: int, depth: int, kind: bytes) -> bytes:
    size, top = n * channels * depth // 8, rate.bit_length() - 1
    common = struct.pack(">HIH", channels, n, depth) + struct.pack(">HQ", 0x3FFF + top, rate << (63 - top)) + kind + b"\0\0"
    body = b"FVER" + struct.pack(">II", 4, AIFC_VERSION) + b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">IQ", size + 8, 0)
    return b"FORM" + struct.pack(">I", len(body) + size + size % 2 + 4) + b"AIFC" + body


def write_files(frames: DataFrame, folder: str, form: str, rate: int, depth: int, *channels: str, real: bool = False, little: bool = True, key: str = "user_id") -> DataFrame:
    """Write a file a stream and return ``key, path, frames, bytes``: ``frames`` has the key, ``frame`` and a column a
    channel, integers of ``depth`` bits or, if ``real``, floats of full scale 1.

    ``form`` is wave (little-endian), aifc or raw. A stream is written in order of its frames by one task, as it comes,
    and gets its name when it is whole: a task that runs twice writes the same file. Null keys are left out.
    """
    rows = dealt(frames.select(key, "frame", *channels).where(F.col(key).isNotNull()), key).sortWithinPartitions(key, "frame")
    little, octets = little or form == "wave", depth // 8
    # Kinds of AIFC samples that scans read.
    kind = (b"fl32" if depth == 32 else b"fl64") if real else {True: {16: b"sowt", 24: b"ni24"}, False: {}}[little].get(depth, b"twos")
    if form == "aifc":
        little = AIFC_KINDS[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        now, held, done = None, None, []

        def close() -> None:
            n, pad = held.size // (octets * len(channels)), held.size % 2 if form != "raw" else 0
            head = {"wave": lambda: wave_head(n, len(channels), rate, depth, real), "aifc": lambda: aifc_head(n, len(channels), rate, depth, kind), "raw": lambda: b""}[form]()
            whole, name = f"{base}/.{now}.{uuid.uuid4().hex}", f"{base}/{now}.{'wav' if form == 'wave' else form}"
            held.save(whole, head, pad)
            system.move(whole, name)
            done.append((now, name, n, len(head) + held.size + pad))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(cut, cut[1:], strict=False):
                if held is None or ids[a] != now:
                    if held is not None:
                        close()
                    now, held = ids[a], Held(system, f"{base}/.{ids[a]}.{uuid.uuid4().hex}.samples")
                values = np.stack([batch.column(2 + k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in range(len(channels))], 1).ravel()
                held.write(encode(values, octets, little, form == "wave" and depth == 8 and not real, real))
        if held is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind_of), *(pa.array([d[k] for d in done], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64())))], [key, "path", "frames", "bytes"])

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[frames.schema[key].dataType.simpleString()]
    made = rows.mapInArrow(run, f"`{key}` {frames.schema[key].dataType.simpleString()}, path string, frames long, bytes long")
    made.write.parquet(f"{folder}-written")
    return frames.sparkSession.read.schema(made.schema).parquet(f"{folder}-written")


def stream_of(path: Column) -> Column:
    """The stream that ``write_files`` wrote to this path."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"([^/]+)\.[a-z]+$", 1)  # a pattern over the path tries each place


#: How contents of each format begin, as hex from the first byte; ``.`` is any digit.
MAGICS = {
    "wave": "^52494646.{8}57415645", "aiff": "^464F524D.{8}41494646", "aifc": "^464F524D.{8}41494643", "flac": "^664C6143",
    "opus": "^4F676753.{48}.*4F70757348656164", "vorbis": "^4F676753.{48}.*01766F72626973", "ogg": "^4F676753",
    "adts": "^FFF[0189]", "mp3": "^(494433|FF[EF][2-7ABEF])",
}


def sniff(content: Column) -> Column:
    """The format that a content's first bytes tell, ``raw`` if none; null for null."""
    head, found = F.hex(F.substring(content, 1, 64)), F.when(content.isNull(), None)
    for name, pattern in MAGICS.items():
        found = found.when(head.rlike(pattern), name)
    return found.otherwise("raw")
