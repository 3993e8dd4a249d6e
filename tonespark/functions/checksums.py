"""Checksums of byte columns as vectorised functions: the table-driven CRCs that Spark lacks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that one chunk holds (a power of two), and about so many that are worked on at once.
CHUNK, SLICE = 64, 1 << 22


def crc_table(width: int, polynomial: int) -> list[int]:
    """What each byte adds to a most-significant-bit-first CRC."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given by what each value of each of their bytes (the lowest first) becomes."""
    out = tables[0][c & 255]
    for k in range(1, len(tables)):
        out = out ^ tables[k][(c >> np.uint32(8 * k)) & 255]
    return out


def _advance(c: np.ndarray, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC after ``count`` steps of a linear map, by the map's powers of two."""
    count = count.copy()
    while count.any():
        odd = np.flatnonzero(count & 1)
        c[odd] = _apply(tables, c[odd])
        count >>= 1
        tables = _apply(tables, tables)
    return c


def crc_rows(rows: list[bytes], width: int, polynomial: int, start: int = 0) -> np.ndarray:
    """The CRC of each row. A CRC is linear: rows are cut into chunks from their ends (zeros before a row change nothing
    if the CRC starts at 0), all chunks advance together, and each is moved to its place and added."""
    table = np.array(crc_table(width, polynomial), np.uint32)
    mask, top = np.uint32((1 << width) - 1), np.uint32(width - 8)
    size = np.array([len(x) for x in rows], np.int64)
    chunks = np.maximum(1, -(-size // CHUNK))
    first = np.cumsum(chunks) - chunks
    padded = np.frombuffer(b"".join(bytes(int(n)) + x for n, x in zip(chunks * CHUNK - size, rows, strict=True)), np.uint8).reshape(-1, CHUNK)
    c = np.zeros(len(padded), np.uint32)
    for k in range(CHUNK):
        c = ((c << np.uint32(8)) & mask) ^ table[(c >> top) ^ padded[:, k]]
    values = np.arange(256, dtype=np.uint32) << (8 * np.arange(width // 8, dtype=np.uint32))[:, None]
    byte = ((values << np.uint32(8)) & mask) ^ table[values >> top]
    chunk = byte
    for _ in range(CHUNK.bit_length() - 1):
        chunk = _apply(chunk, chunk)
    after = np.repeat(first + chunks, chunks) - np.arange(len(c)) - 1
    out = np.bitwise_xor.reduceat(_advance(c, after, chunk), first) if len(rows) else c
    return out ^ _advance(np.full(len(rows), start, np.uint32), size, byte)


def crc(width: int, polynomial: int, start: int = 0) -> Callable:
    """A pandas UDF from bytes to the CRC, null for null; first bit is the most significant, nothing is inverted."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        out, there = pd.array([None] * len(values), "Int64"), np.flatnonzero(values.notna())
        rows = [values.iat[i] for i in there.tolist()]
        ends, a = np.cumsum([len(x) for x in rows]), 0
        while a < len(rows):  # rows of about SLICE bytes, one at least
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
            out[there[a:b]] = crc_rows(rows[a:b], width, polynomial, start).astype(np.int64)
            a = b
        return pd.Series(out)

    return run


def crc_once(width: int, polynomial: int, start: int = 0) -> Callable:
    """``crc`` for bytes that are made with it: give it a column of its own. Spark would else move filters on those bytes
    below it and run it for them once more, in Python workers of their own; it does not move them past what it is told
    to be nondeterministic."""
    return crc(width, polynomial, start).asNondeterministic()


#: Widths, polynomials and start values of the frame, page and side-information checksums.
CRC8 = (8, 0x07, 0)
CRC16 = (16, 0x8005, 0)
CRC16_SIDE = (16, 0x8005, 0xFFFF)
CRC32_PAGE = (32, 0x04C11DB7, 0)


def ordered_md5(rows: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """``key, md5``: the digest of each key's bytes ``data`` one after the other by ``order``, null ones left out.

    A key's rows are sorted and streamed through one task, which holds a digest's state alone: bytes of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def given(keys: list, digests: list[str], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests, pa.string())], [key, "md5"])

        kind = None
        for batch in batches:
            kind, keys, done = batch.schema.field(0).type, batch.column(0).to_pylist(), []
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
            for a, b in zip(cut, cut[1:], strict=False):
                if digest is None or keys[a] != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = keys[a], hashlib.md5()
                digest.update(b"".join(x for x in batch.column(2).slice(a, b - a).to_pylist() if x is not None))
            if done:
                yield given(*map(list, zip(*done, strict=True)), kind)
        if digest is not None:
            yield given([now], [digest.hexdigest()], kind)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, data).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"`{key}` {kind}, md5 string")
