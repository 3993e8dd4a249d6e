"""Samples as bytes and back, a slice of rows at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that are decoded at once.
SLICE = 1 << 20


def decode(raw: bytes, octets: int, little: bool, offset: bool, real: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signed integers (zeros for floats) and values of full scale 1; ``offset``: integers are unsigned about the middle."""
    order = "<" if little else ">"
    if real:
        x = np.frombuffer(raw, f"{order}f{octets}").astype(float)
        return np.zeros(len(x), np.int64), x
    half = 1 << (8 * octets - 1)
    if octets == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        low, middle, high = (b[:, k] for k in ((0, 1, 2) if little else (2, 1, 0)))
        q = low | middle << 8 | high << 16
    else:
        q = np.frombuffer(raw, f"{order}u{octets}").astype(np.int64)
    q = q - half if offset else (q ^ half) - half
    return q, q / half


def decode_float(raw: bytes, octets: int, little: bool, offset: bool, real: bool) -> np.ndarray:
    """Values of full scale 1 in single precision alone, by one pass."""
    order = "<" if little else ">"
    if real:
        return np.frombuffer(raw, f"{order}f{octets}").astype(np.float32)
    if octets == 3:  # as the upper bytes of 32 bits
        q = np.zeros((len(raw) // 3, 4), np.uint8)
        q[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)[:, :: 1 if little else -1]
        q = q.view("<i4").ravel() ^ np.int32(-(1 << 31) if offset else 0)
        return np.multiply(q, np.float32(2.0**-31), dtype=np.float32, casting="unsafe")
    q = np.frombuffer(raw, f"{order}u{octets}" if offset else f"{order}i{octets}")
    if offset:
        return (q.astype(np.int64) - (1 << (8 * octets - 1))).astype(np.float32) * np.float32(0.5 ** (8 * octets - 1))
    return np.multiply(q, np.float32(0.5 ** (8 * octets - 1)), dtype=np.float32, casting="unsafe")


def encode(values: np.ndarray, octets: int, little: bool, offset: bool, real: bool) -> bytes:
    """The bytes that ``decode`` reads."""
    order = "<" if little else ">"
    if real:
        return values.astype(f"{order}f{octets}").tobytes()
    q = values.astype(np.int64) + ((1 << (8 * octets - 1)) if offset else 0)
    if octets == 3:
        b = q.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :3]
        return np.ascontiguousarray(b if little else b[:, ::-1]).tobytes()
    return (q & ((1 << (8 * octets)) - 1)).astype(f"{order}u{octets}").tobytes()


def samples(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, octets, i, q, x`` from ``data``: its first ``n`` samples of ``octets`` bytes, ``little``-endian or not,
    unsigned about the middle (``offset``) or not, floats (``real``, with a null q) or not.

    What ``data`` lacks gives no rows. Rows are decoded together in slices; a long one is cut.
    """
    kinds = ("octets", "little", "offset", "real")
    made = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + ["octets int", "i long", "q long", "x double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            n, of = column["n"].to_pylist(), list(zip(*(column[c].to_pylist() for c in kinds), strict=True))
            waiting: dict[tuple, list[tuple[int, int, bytes]]] = {}
            for row, kind in enumerate(of):
                if column["data"][row].is_valid and n[row] and n[row] > 0:
                    data, octets = memoryview(column["data"][row].as_buffer()), kind[0]
                    whole, step = min(n[row], len(data) // octets), SLICE // octets
                    for first in range(0, whole, step):
                        waiting.setdefault(kind, []).append((row, first, data[first * octets : min(first + step, whole) * octets]))
                        if sum(len(x) for *_, x in waiting[kind][-64:]) >= SLICE:
                            yield give(batch, kind, waiting.pop(kind))
            for kind, parts in waiting.items():
                yield give(batch, kind, parts)

    def give(batch: pa.RecordBatch, kind: tuple, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        size = np.array([len(x) // kind[0] for *_, x in parts])
        q, x = decode(b"".join(x for *_, x in parts), *kind)
        take = pa.array(np.repeat([row for row, *_ in parts], size))
        i = np.arange(size.sum()) + np.repeat([first for _, first, _ in parts] - (np.cumsum(size) - size), size)
        own = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keys]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(q), kind[0], np.int32)), pa.array(i, pa.int64()), pa.array(q, mask=np.full(len(q), kind[3])), pa.array(x)], [*keys, "octets", "i", "q", "x"])

    return rows.select(*keys, "data", "n", *kinds).mapInArrow(run, made)
