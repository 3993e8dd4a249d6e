"""Vectorised splitting and hashing of the words in Arrow string columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are 64-bit: blocks of 8 bytes are mixed in one after the
other, all words at once; of words of more than LONG bytes it is a BLAKE2 digest. Hashes find words; where words have to
be told apart for certain, ``word_ids`` compares bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 1 << 21
LONG = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def release() -> None:
    """Give freed memory back to the system: workers live on, and their neighbours need it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (buf[off[0] : off[-1]], off - off[0]) if len(column) else (buf[:0], np.zeros(1, np.int64))


def slices(column, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes (one row at least): first row, end row, bytes, offsets."""
    buf, off = text_bytes(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    release()


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and ``n + 1`` positions: row ``i`` has words ``at[i]:at[i + 1]``."""
    n = len(buf)
    blank = space[buf]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = blank
    after[: n - 1 if n else 0] = blank[1:]
    before[off[:-1]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts = np.flatnonzero(~blank & before[:n])
    ends = np.flatnonzero(~blank & after[:n]) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, m in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(m)
    return x ^ (x >> np.uint64(33))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; what lies past the end is 0."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``.

    Words of up to 8 bytes and one length never collide; others may, so who needs certainty compares bytes.
    """
    size, odd = ends - starts, np.uint64(_MULTIPLIERS[which])
    out = size.astype(np.uint64) * np.uint64(_MULTIPLIERS[1 - which])
    eights, live = _eights(buf), np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = size[live] - k
        x = (out[live] ^ (eights[starts[live] + k] & _MASKS[np.minimum(left, 8)])) * odd
        out[live] = x ^ (x >> np.uint64(32))
        live = live[left > 8]
        if not len(live):
            break
    if len(long := np.flatnonzero(size > LONG)):
        key = bytes([which])
        for i, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(buf[s:e], digest_size=8, key=key).digest(), "little")
    return mix(out)


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the same bytes as word ``other[i]``."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    eights, live = _eights(buf), np.flatnonzero(other != np.arange(len(other)))
    for k in range(0, LONG, 8):
        left = size[live] - k
        if ((eights[starts[live] + k] ^ eights[starts[other[live]] + k]) & _MASKS[np.minimum(left, 8)]).any():
            return False
        live = live[left > 8]
        if not len(live):
            return True
    raw = memoryview(np.ascontiguousarray(buf))
    return all(raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]] for i, j in zip(live.tolist(), other[live].tolist(), strict=True))


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word and the number of every word; equal numbers are equal bytes, for certain."""
    _, first, which = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
    if not same_bytes(buf, starts, ends, first[which]):  # words that share a hash
        raw, found, first = buf.tobytes(), {}, []
        which = np.empty(len(starts), np.int64)
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            which[i] = k = found.setdefault(raw[s:e], len(found))
            if k == len(first):
                first.append(i)
        first = np.array(first, np.int64)
    return first, which


def windows(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``width`` values of ``h``, in order of its start (``len(h) - width + 1`` of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.random.default_rng(which).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * odd[k]
    return mix(out)


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of every word, from the positions that ``spans`` gives."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i + 1]]``, 0 for empty rows."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key, 0 to ``n - 1``: equal ranges of the 64-bit values, so bucket order is key order."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def cut(sorted_keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Non-empty buckets of sorted keys, with their places."""
    b = buckets(sorted_keys, n)
    ends = np.flatnonzero(np.diff(b, append=-1)) + 1
    a = 0
    for e in ends:
        yield int(b[e - 1]), slice(a, int(e))
        a = int(e)
