"""``wave``, ``aiff`` and ``pcm`` as formats of Spark: batch reader, writer, and a stream reader that follows growing files.

After ``register(spark)``, ``spark.read.format("wave").load(folder)`` gives a row a sample (SAMPLES), or with
``option("block", n)`` up to ``n`` values of a channel as an array (BLOCKS). A schema of fewer of these columns, in any
order, makes no others. Of the frames from option ``firstFrame`` to before ``endFrame`` only the bytes are read; with
option ``pushFilters`` filters on ``path``, ``ch`` and ``frame`` (``first`` of blocks) are taken to the files likewise.
That has to be asked for, and each query to load the files anew: Spark 4.1 keeps what was pushed to a Python source with
the loaded DataFrame, and a later query of it without such a filter would see the first one's rows alone.

The driver lists names and sizes alone. Partitions are ranges of bytes, and a task reads the header of a file itself; a
frame belongs to the range that holds its first byte. Files that are no container give no rows (``read_headers`` tells
what is wrong with them); of truncated ones the whole frames are read.

A stream's offset is the size of each file. A batch gives the frames that were completed between two sizes, so one that
is split between two batches comes with the later one, and none is lost or repeated.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from tonespark.sources.decode import decode, decode_float, encode
from tonespark.sources.files import AIFC_KINDS, Held, _open, aifc_head, gathered, header_of, wave_head

SAMPLES = "path string, frame long, ch int, q long, x float"
BLOCKS = "path string, first long, ch int, x array<float>"
PARTITION_BYTES = 64 << 20
#: Bytes that are read and decoded at once.
READ_BYTES = 4 << 20
#: Files of a piece; opening one counts as so large a part of a piece's bytes.
PIECE_FILES = 1024


@dataclass
class Piece(ds.InputPartition):
    """Ranges of bytes of files: (path, first byte, end, size that the file is taken to have)."""

    ranges: list[tuple[str, int, int, int]] = field(default_factory=list)


@dataclass
class Wanted:
    """What filters leave: frames from ``low`` to before ``high``, paths and channels (None: all)."""

    low: int = 0
    high: int = 1 << 62
    paths: frozenset | None = None
    channels: frozenset | None = None

    def take(self, f: ds.Filter, frame: str) -> bool:
        """Narrow down by a filter; False if it is of another kind."""
        name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
        if isinstance(f, ds.IsNotNull):
            return name in ("path", "ch", frame)
        whole = isinstance(value, int) and not isinstance(value, bool)
        if name == frame and whole and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
            if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
            if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                self.high = min(self.high, value + (not isinstance(f, ds.LessThan)))
            return True
        values = [value] if isinstance(f, ds.EqualTo) else list(value) if isinstance(f, ds.In) else None
        if values is None or any(v is None for v in values) or name not in ("path", "ch"):
            return False
        kept = "paths" if name == "path" else "channels"
        own = getattr(self, kept)
        setattr(self, kept, frozenset(values) if own is None else own & frozenset(values))
        return True


def _files(options: dict[str, str]) -> list[tuple[str, int]]:
    """Names and sizes below ``path`` (files whose names begin with _ or . apart), in order of names."""
    system, base = _open(options["path"])
    scheme = options["path"].partition("://")[0] if "://" in options["path"] else "file"
    here = system.get_file_info(base)
    if here.type == fs.FileType.NotFound:
        raise FileNotFoundError(options["path"])
    found = [here] if here.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in posixpath.relpath(p, base).split("/") if x != ".")
    named = lambda p: p if scheme == "file" else f"{scheme}://{p}"
    return sorted((named(i.path), i.size) for i in found if i.is_file and not hidden(i.path))


def _root(options: dict[str, str]) -> str:
    """What the names of the files of a folder begin with."""
    return (options["path"] if "://" in options["path"] and not options["path"].startswith("file:") else _open(options["path"])[1]).rstrip("/") + "/"


def _pack(ranges: Sequence[tuple[str, int, int, int]], most: int) -> list[Piece]:
    """Pieces of about ``most`` bytes and up to PIECE_FILES ranges; long ranges are cut."""
    out, size, opening = [Piece()], 0, most // PIECE_FILES
    for path, first, end, whole in ranges:
        for a in range(first, end, most):
            b = min(a + most, end)
            if size and size + b - a + opening > most:
                out.append(Piece())
                size = 0
            out[-1].ranges.append((path, a, b, whole))
            size += b - a + opening
    return [p for p in out if p.ranges]


class Scan:
    """Reads pieces of files of one format as batches of the columns of ``schema``."""

    def __init__(self, source: Samples, schema: T.StructType):
        self.options, self.columns, self.names = source.options, [(f.name, f.dataType) for f in schema], source.formats
        self.block = int(source.options.get("block", 0))
        known = {c.split()[0]: c.split()[1] for c in (BLOCKS if self.block else SAMPLES).split(", ")}
        for name, kind in self.columns:
            if {"bigint": "long"}.get(kind.simpleString(), kind.simpleString()) != known.get(name):
                raise ValueError(f"no column {name} {kind.simpleString()}; there are {known}")
        self.most = int(source.options.get("partitionBytes", PARTITION_BYTES))

    def header(self, read, size: int) -> tuple:
        if "raw" not in self.names:
            return header_of(read, size)
        told = lambda k, d: self.options.get(k, d)
        channels, depth = int(told("channels", 1)), int(told("depth", 16))
        yes = lambda k, d: str(told(k, d)).lower() == "true"
        return "ok", "raw", channels, float(told("rate", 48_000)), depth, yes("real", "false"), yes("little", "true"), yes("offset", "false"), 0, size // (channels * depth // 8)

    def read(self, piece: Piece | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """The frames whose first bytes are in the piece's ranges, those of small files in batches together."""
        return gathered(self.each(piece, wanted))

    def each(self, piece: Piece | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        for path, first, end, size in piece.ranges if piece else ():  # no partition at all is one of None
            if wanted.paths is not None and path not in wanted.paths:
                continue
            system, plain = _open(path)
            with system.open_input_file(plain) as f:

                def at(begin: int, n: int, f: pa.NativeFile = f) -> bytes:
                    f.seek(begin)
                    return f.read(n)

                status, form, channels, _, depth, real, little, offset, start, frames = self.header(at, size)
                if status not in ("ok", "truncated") or form not in self.names:
                    continue
                align = channels * depth // 8
                unit = self.block or 1  # what begins in the range, blocks as a whole
                low, high = (-(-max(0, b - start) // (align * unit)) * unit for b in (first, end))
                low, high = max(low, wanted.low), min(high, frames, wanted.high)
                step = max(1, READ_BYTES // (align * unit)) * unit
                while low < high:  # reads end at multiples of the step, so that blocks begin at multiples of theirs
                    stop = min(high, (low // step + 1) * step)
                    raw = at(start + low * align, (stop - low) * align)
                    n = len(raw) // align
                    if not n:
                        break
                    yield from self.rows(path, low, channels, wanted, raw[: n * align], (depth // 8, little, offset, real))
                    low += n

    def rows(self, path: str, low: int, channels: int, wanted: Wanted, raw: bytes, kind: tuple) -> Iterator[pa.RecordBatch]:
        n = len(raw) // (kind[0] * channels)
        own = [c for c in range(channels) if wanted.channels is None or c in wanted.channels]
        names = {c for c, _ in self.columns}
        pick = lambda v: np.ascontiguousarray(v.reshape(n, channels)[:, own]) if len(own) < channels else v.reshape(n, channels)
        x = pick(decode_float(raw, *kind)) if "x" in names else None
        if not own:
            return
        if self.block:
            cuts = np.array(sorted({0, *range(-low % self.block, n, self.block), n}))
            size = np.tile(np.diff(cuts), len(own))
            made = {"path": lambda: _same(path, len(size)), "first": lambda: pa.array(np.tile(low + cuts[:-1], len(own))), "ch": lambda: pa.array(np.repeat(own, len(cuts) - 1).astype(np.int32))}
            made["x"] = lambda: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.ascontiguousarray(x.T).ravel()))
        else:
            made = {"path": lambda: _same(path, n * len(own)), "frame": lambda: pa.array(np.repeat(np.arange(low, low + n), len(own))), "ch": lambda: pa.array(np.tile(np.array(own, np.int32), n)), "x": lambda: pa.array(x.ravel())}
            made["q"] = lambda: pa.nulls(n * len(own), pa.int64()) if kind[3] else pa.array(pick(decode(raw, *kind)[0]).ravel())
        yield pa.RecordBatch.from_arrays([made[c]() for c, _ in self.columns], [c for c, _ in self.columns])


def _same(text: str, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([text])).cast(pa.string())


class BatchReader(ds.DataSourceReader):
    def __init__(self, scan: Scan):
        self.scan, self.wanted = scan, Wanted(int(scan.options.get("firstFrame", 0)), int(scan.options.get("endFrame", 1 << 62)))

    def partitions(self) -> list[Piece]:
        w = self.wanted
        if w.low >= w.high:
            return []
        return _pack([(p, 0, size, size) for p, size in _files(self.scan.options) if w.paths is None or p in w.paths], self.scan.most)

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        yield from self.scan.read(partition, self.wanted)


class PushingReader(BatchReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Of blocks, a filter on ``first`` only narrows what is read by whole blocks, and Spark applies it again."""
        for f in filters:
            if self.scan.block and getattr(f, "attribute", ("",))[0] == "first":
                whole = Wanted()
                if whole.take(f, "first"):  # blocks that begin in the range, to their ends
                    self.wanted.low = max(self.wanted.low, whole.low)
                    self.wanted.high = min(self.wanted.high, whole.high - 1 + self.scan.block)
                yield f
            elif not self.wanted.take(f, "frame"):
                yield f


class StreamReader(ds.DataSourceStreamReader):
    """Offsets are the sizes of files by their names below the folder; a file may grow, and new ones may come."""

    def __init__(self, scan: Scan):
        self.scan, self.root = scan, _root(scan.options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p.removeprefix(self.root): size for p, size in _files(self.scan.options)}

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        """What has been added to the files, in pieces as of batches; the first range of a file reaches back to its head,
        as a frame may have been begun before. Offsets of former versions have whole names."""
        old = {p.removeprefix(self.root): size for p, size in start.items()}
        named = lambda p: p if p.startswith("/") or "://" in p else self.root + p
        grown = {named(p): (old.get(p, 0), size) for p, size in sorted((p.removeprefix(self.root), size) for p, size in end.items()) if size > old.get(p, 0)}
        pieces = _pack([(p, a, b, b) for p, (a, b) in grown.items()], self.scan.most)
        return [Grown([(p, grown[p][0], 0 if a == grown[p][0] else a, b, size) for p, a, b, size in piece.ranges]) for piece in pieces]

    def read(self, partition: Grown | None) -> Iterator[pa.RecordBatch]:
        return gathered(self.each(partition))

    def each(self, partition: Grown | None) -> Iterator[pa.RecordBatch]:
        """Frames complete at the new size that were not at the old one."""
        for path, old, first, end, new in partition.ranges if partition else ():
            system, plain = _open(path)
            with system.open_input_file(plain) as f:

                def at(begin: int, n: int, f: pa.NativeFile = f) -> bytes:
                    f.seek(begin)
                    return f.read(n)

                done = [self.scan.header(lambda a, n, s=size, at=at: at(a, max(0, min(n, s - a))), size) for size in (old, new)]
            frames = [h[9] if h[0] in ("ok", "truncated") else 0 for h in done]
            if frames[1] > frames[0]:
                yield from self.scan.each(Piece([(path, first, end, new)]), Wanted(frames[0], frames[1]))


@dataclass
class Grown(ds.InputPartition):
    """Ranges of files that have grown: (path, old size, first byte, end, new size)."""

    ranges: list[tuple[str, int, int, int, int]]


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(ds.DataSourceArrowWriter):
    """Writes a file a stream. The first column names the stream, ``frame`` orders it, all others are channels.

    A stream's rows have to be in one task and in ascending frames (``repartition`` and ``sortWithinPartitions`` by the
    two), else the job fails; null streams and frames are an error too. Tasks write below ``_temporary``; files get their
    names when all tasks are done, so a task that runs twice leaves one. A task that still runs when its job fails may leave
    files there, which readers pass over.
    """

    def __init__(self, source: Samples, schema: T.StructType, overwrite: bool):
        self.form, self.options, self.overwrite = source.formats[-1], source.options, overwrite
        self.key, self.channels = schema[0].name, [f.name for f in schema if f.name not in (schema[0].name, "frame")]
        if "frame" not in schema.names or not self.channels:
            raise ValueError("the columns are the stream, frame, and the channels")
        told = lambda k, d: str(source.options.get(k, d)).lower()
        self.rate, self.depth, self.real, self.little = int(told("rate", 48_000)), int(told("depth", 16)), told("real", "false") == "true", told("little", "true") == "true" or self.form == "wave"
        kinds = {(True, 32): b"fl32", (True, 64): b"fl64", (False, 24, True): b"ni24", (False, 16, True): b"sowt"}
        self.kind = kinds.get((self.real, self.depth), kinds.get((self.real, self.depth, self.little), b"twos"))
        if self.form == "aifc":
            self.little = AIFC_KINDS[self.kind][0]
        self.job = uuid.uuid4().hex

    def head(self, n: int) -> bytes:
        if self.form == "wave":
            return wave_head(n, len(self.channels), self.rate, self.depth, self.real)
        return aifc_head(n, len(self.channels), self.rate, self.depth, self.kind) if self.form == "aifc" else b""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _open(self.options["path"])
        work = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(work, recursive=True)
        name, held, n, last, done = None, None, 0, None, []

        def close() -> None:
            made = f"{work}/{len(done)}"
            held.save(made, self.head(n), held.size % 2 if self.form != "raw" else 0)
            done.append((made, f"{base}/{name}.{'wav' if self.form == 'wave' else self.form}"))

        for batch in iterator:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            if column[self.key].null_count or column["frame"].null_count:
                raise ValueError("a row without stream or frame")
            ids, frames = column[self.key].to_pylist(), column["frame"].to_numpy()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else [0]
            values = np.stack([column[c].to_numpy(zero_copy_only=False) for c in self.channels], 1)
            for a, b in zip(cut, cut[1:], strict=False):
                if held is None or ids[a] != name:
                    if held is not None:
                        close()
                    name, n, last, held = ids[a], 0, None, Held(system, f"{work}/{len(done)}.samples")
                own = frames[a:b]
                if (np.diff(own) <= 0).any() or last is not None and own[0] <= last:
                    raise ValueError(f"frames of {name} are not in order: sort within partitions by {self.key} and frame")
                held.write(encode(values[a:b].ravel(), self.depth // 8, self.little, self.form == "wave" and self.depth == 8 and not self.real, self.real))
                n, last = n + b - a, own[-1]
        if held is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.options["path"])
        files = [f for m in messages if m is not None for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a stream was written by two tasks: repartition by it")
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for path, _ in _files({"path": base}):
                system.delete_file(path)
        for made, to in files:
            system.move(made, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _open(self.options["path"])
        if system.get_file_info(f"{base}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary/{self.job}")


class Samples(ds.DataSource):
    """Options: ``path``; ``block`` (values of an array), ``firstFrame``, ``endFrame``, ``pushFilters``, ``partitionBytes``; of pcm and
    of writers ``channels``, ``rate``, ``depth``, ``real``, ``little``."""

    formats: tuple[str, ...] = ()

    def schema(self) -> str:
        return BLOCKS if int(self.options.get("block", 0)) else SAMPLES

    def reader(self, schema: T.StructType) -> BatchReader:
        return (PushingReader if str(self.options.get("pushFilters", "")).lower() == "true" else BatchReader)(Scan(self, schema))

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(Scan(self, schema))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self, schema, overwrite)


class Wave(Samples):
    formats = ("wave",)

    @classmethod
    def name(cls) -> str:
        return "wave"


class Aiff(Samples):
    """AIFF and AIFC are read, AIFC is written."""

    formats = ("aiff", "aifc")

    @classmethod
    def name(cls) -> str:
        return "aiff"


class Pcm(Samples):
    formats = ("raw",)

    @classmethod
    def name(cls) -> str:
        return "pcm"


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let Spark hand filters to Python sources."""
    for source in (Wave, Aiff, Pcm):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
