"""Lapped transforms and resampling of long streams: chunks with halos, all blocks of a task transformed at once.

Streams are ``user_id, frame, x`` with frames from 0; frames that are missing count as 0. A chunk gets the frames that it
needs of its neighbours, and a task takes the chunks of any streams that are dealt to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 13
#: Values that a task holds at once.
PART_ROWS = 1 << 18


def sine(n: int) -> np.ndarray:
    return np.sin((np.arange(n) + 0.5) / n * math.pi)


def power_complementary(n: int) -> np.ndarray:
    return np.sin(math.pi / 2 * sine(n) ** 2)


def kaiser_bessel_derived(n: int, alpha: float = 4.0) -> np.ndarray:
    """Half of it rises by running sums of a Kaiser window; squares of both halves add up to 1."""
    k = np.kaiser(n // 2 + 1, math.pi * alpha)
    rise = np.sqrt(np.cumsum(k)[:-1] / k.sum())
    return np.concatenate([rise, rise[::-1]])


WINDOWS = {"sine": sine, "power": power_complementary, "kbd": kaiser_bessel_derived}


def _dealt(stream: DataFrame, chunk: int, before: int, after: int, values: int = 1) -> DataFrame:
    """``stream`` with its ``_chunk`` and ``_part``, of rows of about PART_ROWS values (``values`` a row); frames within
    ``before`` of the next chunk go to that too, those within ``after`` of the one before to that."""
    at, own = F.col("frame") % chunk, F.floor(F.col("frame") / chunk)
    to = F.array(own, F.when(at >= chunk - before, own + 1), F.when((at < after) & (own > 0), own - 1))
    n = stream.count()
    spread = stream.withColumn("_chunk", F.explode(F.array_compact(to)))
    return spread.withColumn("_part", F.pmod(F.xxhash64("user_id", "_chunk"), F.lit(max(1, n * values // PART_ROWS))))


def _chunks(table: pa.Table, frame: str = "frame") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row of the stream's name, chunk, and rows and frames of each chunk."""
    who = table["user_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    chunk, at = table["_chunk"].to_numpy(), table[frame].to_numpy()
    order = np.lexsort((at, chunk, who))
    cut = np.flatnonzero((np.diff(who[order], prepend=-2) != 0) | (np.diff(chunk[order], prepend=-1) != 0))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        rows = order[a:b]
        yield int(rows[0]), int(chunk[rows[0]]), rows, at[rows]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    size = [len(r) for r in rows]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def mdct(blocks: np.ndarray) -> np.ndarray:
    """Coefficients of rows of 2 n windowed values: n each, by one transform of complex numbers."""
    n = blocks.shape[1] // 2
    i, k = np.arange(2 * n), np.arange(n)
    turned = np.fft.fft(blocks * np.exp(-1j * math.pi * i / (2 * n)), axis=1)[:, :n]
    return (turned * np.exp(-1j * math.pi / n * (0.5 + n / 2) * (k + 0.5))).real


def inverse_mdct(coefficients: np.ndarray) -> np.ndarray:
    """Rows of 2 n values with their time-domain aliases, which windowed halves of neighbours cancel."""
    n = coefficients.shape[1]
    i, k, shift = np.arange(2 * n), np.arange(n), 0.5 + n / 2
    padded = np.zeros((len(coefficients), 2 * n), complex)
    padded[:, :n] = coefficients * np.exp(1j * math.pi * shift * k / n)
    return (np.fft.ifft(padded, axis=1) * 2 * n * np.exp(1j * math.pi * (i + shift) / (2 * n))).real * (2 / n)


def lapped(stream: DataFrame, n: int, window: str = "sine", chunk: int = CHUNK) -> DataFrame:
    """``user_id, block, c``: the ``n`` MDCT coefficients of each block of 2 n frames, which begins n frames after the one
    before; the first block holds the first n frames in its second half.

    A stream of frames up to m has blocks 0 to m // n + 1. n is even, and a power of two is fastest. Null values count as
    0; an empty table gives no rows.
    """
    chunk = max(chunk // n, 1) * n
    w, who = WINDOWS[window](2 * n), stream.schema["user_id"].dataType.simpleString()
    dealt = _dealt(stream.select("user_id", "frame", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")), chunk, n, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        x, names, blocks, parts = table["x"].to_numpy(), [], [], []

        def flush() -> pa.RecordBatch:
            who = table["user_id"].take(pa.array(names, pa.int64())).combine_chunks()
            made = pa.RecordBatch.from_arrays([who, pa.array(np.concatenate(blocks)), _lists(list(mdct(np.concatenate(parts))))], ["user_id", "block", "c"])
            for own in (names, blocks, parts):
                own.clear()
            return made

        for name, c, rows, at in _chunks(table):
            own = at >= c * chunk  # without them, the chunk is the last block's alone: the halo of the one before
            last = int(at[-1]) // n + 1 if own.any() else c * chunk // n
            first, end = c * chunk // n, min((c + 1) * chunk // n - 1, last)
            line = np.zeros((end - first + 2) * n)  # from n frames before the chunk on
            place = at - (first - 1) * n
            line[place[place < len(line)]] = x[rows[place < len(line)]]
            parts.append(np.lib.stride_tricks.sliding_window_view(line, 2 * n)[::n] * w)
            names += [name] * (end - first + 1)
            blocks.append(np.arange(first, end + 1))
            if len(names) * n >= PART_ROWS:  # of short streams, blocks hold many more values than there are frames
                yield flush()
        if names:
            yield flush()

    return dealt.groupBy("_part").applyInArrow(run, f"user_id {who}, block bigint, c array<double>")


def unlapped(blocks: DataFrame, n: int, window: str = "sine", chunk: int = CHUNK) -> DataFrame:
    """``user_id, frame, x`` of the blocks that ``lapped`` gives (user_id, block, c), from frame 0 on to the end of the
    last block's first half. Missing blocks count as 0."""
    each = max(chunk // n, 1)
    w, who = WINDOWS[window](2 * n), blocks.schema["user_id"].dataType.simpleString()
    dealt = _dealt(blocks.select("user_id", F.col("block").alias("frame"), "c"), each, 0, 1, n)

    def run(table: pa.Table) -> pa.Table:
        out = inverse_mdct(table["c"].combine_chunks().flatten().to_numpy().reshape(-1, n)) * w
        names, frames, values = [], [], []
        for name, c, rows, at in _chunks(table):
            own = at[at < (c + 1) * each]
            if not len(own):
                continue
            line = np.zeros((min(each, int(at[-1]) - c * each) + 1) * n)  # from the chunk's first frame on: second halves, and first halves of the next
            for r, b in zip(rows.tolist(), (at - c * each).tolist(), strict=True):
                if b < each:
                    line[b * n : b * n + n] += out[r, n:]
                if b:
                    line[b * n - n : b * n] += out[r, :n]
            size = (min(each, int(at[-1]) - c * each)) * n
            names.append(np.full(size, name))
            frames.append(c * each * n + np.arange(size))
            values.append(line[:size])
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        return pa.table({"user_id": table["user_id"].take(pa.array(join(names, np.int64))), "frame": pa.array(join(frames, np.int64)), "x": pa.array(join(values, float))})

    return dealt.groupBy("_part").applyInArrow(run, f"user_id {who}, frame bigint, x double")


def taps(up: int, down: int, zeros: int) -> tuple[np.ndarray, int]:
    """The filter by phase (rows: place of an output between two inputs, in ``up`` steps), and how many inputs it reaches
    back and ahead: a sinc of ``zeros`` zero crossings a side under a raised cosine, cut off at the lower of both rates."""
    cut = min(1.0, up / down)
    reach = math.ceil(zeros / cut)
    t = np.arange(up)[:, None] / up - np.arange(-reach + 1, reach + 1)[None]
    inside = np.abs(t) < zeros / cut
    return np.where(inside, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(math.pi * t * cut / zeros)), 0.0), reach


def resample(stream: DataFrame, up: int, down: int, zeros: int = 16, chunk: int = CHUNK) -> DataFrame:
    """``user_id, frame, x`` at ``up / down`` times the rate: output m lies at input m * down / up.

    A stream of frames up to m has outputs up to m * up / down; beyond its ends are zeros. The output of a chunk's inputs
    needs up to ``zeros`` inputs (times down / up, if that is more) on both sides, its halo.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    h, reach = taps(up, down, zeros)
    chunk, who = max(chunk, reach), stream.schema["user_id"].dataType.simpleString()
    dealt = _dealt(stream.select("user_id", "frame", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")), chunk, reach, reach)

    def run(table: pa.Table) -> pa.Table:
        x, names, frames, values = table["x"].to_numpy(), [], [], []
        for name, c, rows, at in _chunks(table):
            first = c * chunk
            end = min(first + chunk, int(at[-1]) + 1)  # inputs whose outputs are made here
            if not (at >= first).any() or end <= first:
                continue
            line = np.zeros(chunk + 2 * reach)
            line[at - first + reach] = x[rows]
            last = int(at[-1]) < first + chunk  # no frame of the next chunk: the stream ends here
            m = np.arange(-(-first * up // down), (end - 1) * up // down + 1 if last else -(-end * up // down))
            i, phase = m * down // up - first, m * down % up
            view = np.lib.stride_tricks.sliding_window_view(line, 2 * reach)
            names.append(np.full(len(m), name))
            frames.append(m)
            values.append(np.einsum("ij,ij->i", view[i + 1], h[phase]))
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        return pa.table({"user_id": table["user_id"].take(pa.array(join(names, np.int64))), "frame": pa.array(join(frames, np.int64)), "x": pa.array(join(values, float))})

    return dealt.groupBy("_part").applyInArrow(run, f"user_id {who}, frame bigint, x double")


def power_spectra(blocks: DataFrame, key: str, values: str) -> DataFrame:
    """``key, k, power``: all bins of the DFT of each row's array ``values``, rows of one length at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().fill_null(0).to_numpy()
            for n in np.unique(size[size > 0]).tolist():
                rows = pa.array(np.flatnonzero(size == n))
                x = batch.column(1).take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                power = np.abs(np.fft.rfft(x, axis=1)) ** 2
                bins = power.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows).take(pa.array(np.repeat(np.arange(len(rows)), bins))), pa.array(np.tile(np.arange(bins, dtype=np.int32), len(rows))), pa.array(power.ravel())], [key, "k", "power"])

    return blocks.select(key, values).mapInArrow(run, f"`{key}` {blocks.schema[key].dataType.simpleString()}, k int, power double")
