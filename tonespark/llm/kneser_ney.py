"""Interpolated modified Kneser-Ney n-gram model of any order.

Words and n-grams are counted in Spark: tasks sum what they read, ranges of hashes are summed again, and each range is
written to the shared folder as sorted arrays. A word's id is its place in the sorted array of the 128-bit keys of all words, which no two words share. An
n-gram goes to the range of its first word, of its context if that word is frequent, and n-grams whose context has
frequent words only are spread by their last word too; the sums of such a context are gathered in a second step. The distinct n-grams of a range give the counts of
the next lower order. Workers memory-map the arrays and find what a slice of texts asks by binary search. The driver
gets a row per range of words, of which there are WORD_RANGES at most, and a few sums of all.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonespark.llm.scratch import mapped_dir
from tonespark.llm.wordids import key_of, word_keys
from tonespark.llm.words import LOWER, buckets, cut, mix, slices, spans

ORDER = 3
#: The end's key is that of a space, which no word is.
END = key_of(b" ")
RANGE_WORDS, WORD_RANGES = 1_000_000, 4096
RANGE_GRAMS = 1_000_000
#: At most so many ranges are told apart at once; more take two steps.
FAN = 512
CONTEXT = np.dtype([("one", "<u4"), ("two", "<u4"), ("more", "<u4"), ("spare", "<u4"), ("total", "<u8")])
#: Sums of contexts of more n-grams than this are stored, those of others are taken when asked for.
SHORT = 8
#: Parts from here on hold the sums of spread contexts, part -1 the numbers of n-grams by count.
SPREAD = 1 << 40
ROWS = "part long, kind int, ids binary, few binary, large binary"


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Written whole or not at all: a task that runs twice writes the same. Arrays begin at multiples of 8 bytes."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        f.write(np.array([x.nbytes for x in arrays], "<i8").tobytes())
        for x in arrays:
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
    os.replace(part, f"{folder}/{name}")


@lru_cache(4096)
def _mapped(path: str, kinds: tuple[Any, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a file; empty ones if there is none."""
    if not os.path.exists(path):
        return tuple(np.zeros(0, k) for k in kinds)
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    at, out = 8 * len(kinds), []
    for size, kind in zip(raw[:at].view("<i8").tolist(), kinds, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return tuple(out)


def _pack(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as single bytes, 255 standing for the next of the large ones."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def _unpack(few: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = few.astype(np.int64)
    out[few == 255] = large
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _summed_words(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for keys of words, sorted as pairs."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _word_rows(keys: np.ndarray, counts: np.ndarray, ranges: int, step: int) -> list[tuple]:
    """Rows of sorted keys by range; with ``step`` over 1, by groups of so many ranges."""
    return [_row(b, 0, np.ascontiguousarray(keys[own]), counts[own]) for b, own in _by(buckets(keys[:, 0], ranges) // step * step)]


def _read_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed_words(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table["ids"]]), _read_counts(table))


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of integers, all first bytes, then all second ones ..."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _joined(planes: np.ndarray) -> np.ndarray:
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


class Ids:
    """Integers of ``width`` bytes one after the other, ``n`` of them from byte ``at``; 8 bytes or more follow the last."""

    def __init__(self, raw: np.ndarray, at: int, n: int, width: int):
        self.values = np.ndarray((n,), "<u4" if width <= 4 else "<u8", raw, at, (width,)) if n else np.zeros(0, np.uint32)
        self.mask = self.values.dtype.type((1 << (8 * width)) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.values[i] & self.mask).astype(np.int64)

    def __len__(self) -> int:
        return len(self.values)


def _read_counts(table: pa.Table) -> np.ndarray:
    return np.concatenate([_unpack(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.int64)) for a, b in zip(table["few"], table["large"], strict=True)])


def _read_grams(table: pa.Table, k: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The ``k`` columns of ids and the counts of all rows; equal n-grams of several rows stand apart."""
    blocks = [[_joined(x) for x in np.frombuffer(row.as_buffer(), np.uint8).reshape(k, width, -1)] for row in table["ids"]]
    columns = [np.concatenate([b[i] if i else np.cumsum(b[i]) for b in blocks]) for i in range(k)]
    return columns, _read_counts(table)


def _row(part: int, kind: int, ids: np.ndarray | bytes, counts: np.ndarray | None = None) -> tuple:
    few, large = _pack(counts) if counts is not None else (b"", b"")
    return part, kind, bytes(memoryview(ids)), bytes(memoryview(few)), bytes(memoryview(large))


def _rows(rows: list[tuple]) -> dict[str, pa.Array]:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return {n.split()[0]: pa.array(c, t) for n, c, t in zip(ROWS.split(", "), zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)}


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3, from the numbers of things counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([0.0, *(min(max(d, 0.0), k + 0.999) for k, d in enumerate(raw))])


def _off(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - d[np.minimum(counts, 3)], 0.0)


def tokens(words: np.ndarray, at: np.ndarray, end: Any) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row and ``end`` after them, and the ``n + 1`` places where rows begin."""
    n = len(at) - 1
    out = np.empty(len(words) + n, words.dtype)
    last = at[1:] + np.arange(n)
    own = np.ones(len(out), bool)
    own[last] = False
    out[own], out[last] = words, end
    return out, at + np.arange(n + 1)


def before(values: np.ndarray, at: np.ndarray, back: int, start: Any) -> np.ndarray:
    """The value ``back`` places before each in its row, ``start`` where the row has none."""
    i = np.arange(len(values)) - back
    return np.where(i >= np.repeat(at[:-1], np.diff(at)), values[np.maximum(i, 0)], start)


def _within(values: np.ndarray | Ids, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where ``x[i]`` is, or would be, in the sorted ``values[low[i]:high[i]]``."""
    out, live = low.copy(), np.flatnonzero(low < high)
    low, high, x = low[live], high[live], x[live]
    while len(live):
        middle = (low + high) >> 1
        less = values[middle] < x
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        left = low < high
        if not left.all():
            done = ~left
            out[live[done]] = low[done]
            live, low, high, x = live[left], low[left], high[left], x[left]
    return out


#: Arrays of a file of n-grams.
GRAMS = (np.int64, np.uint32, np.uint8, np.uint8, np.int64, np.int64, np.uint32, CONTEXT)


class Grams:
    """A range of n-grams in the order of their ids: the distinct first ids and where each starts, columns of the other
    ids, counts (255: in ``large``), and the sums of long contexts by their start."""

    def __init__(self, firsts: np.ndarray, starts: np.ndarray, ids: np.ndarray, few: np.ndarray, at: np.ndarray, large: np.ndarray, long_starts: np.ndarray, long_sums: np.ndarray, k: int, width: int):
        self.firsts, self.starts, self.few, self.at, self.large, self.long_starts, self.long_sums = firsts, starts, few, at, large, long_starts, long_sums
        *self.middle, self.words = (Ids(ids, j * len(few) * width, len(few), width) for j in range(k - 1))

    def counts(self, i: np.ndarray) -> np.ndarray:
        c = self.few[i].astype(np.int64)
        if (much := c == 255).any():
            c[much] = self.large[np.searchsorted(self.at, i[much])]
        return c

    def sums(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of contexts, given by where their n-grams are."""
        out, size = np.zeros(len(low), CONTEXT), high - low
        long = np.flatnonzero(size > SHORT)
        if len(long):
            out[long] = self.long_sums[np.searchsorted(self.long_starts, low[long])]
        short = np.flatnonzero((size > 0) & (size <= SHORT))
        if len(short):
            n = size[short]
            begin = np.cumsum(n) - n
            c = self.counts(np.repeat(low[short] - begin, n) + np.arange(n.sum()))
            for name, x in (("one", c == 1), ("two", c == 2), ("more", c > 2), ("total", c)):
                out[name][short] = np.add.reduceat(x.astype(np.int64), begin)
        return out


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and what is known of all."""

    folder: str
    order: int
    ranges: int
    gram_ranges: int
    offsets: tuple[int, ...]  # id of the first word of each range, and the number of words
    total: int  # training tokens
    range_words: int = RANGE_WORDS
    range_grams: int = RANGE_GRAMS
    fan: int = FAN
    discounts: tuple[tuple[float, ...], ...] = ()  # by order, from that of single words
    kinds: int = 0  # distinct pairs, or tokens if there are only single words
    rest: float = 1.0

    @property
    def words(self) -> int:
        """Distinct words; the next id is that of a text's start."""
        return self.offsets[-1]

    @property
    def many(self) -> int:
        """A word is frequent from so many occurrences; a context that has a word of fewer fits into a range."""
        return self.range_grams // 4

    @property
    def width(self) -> int:
        """Bytes of an id."""
        return (self.words.bit_length() + 7) // 8 or 1

    def sorted_order(self, columns: list[np.ndarray]) -> np.ndarray:
        """The order of n-grams by their ids, the first column first; as many ids as fit make one key."""
        bits, keys = max(1, self.words.bit_length()), []
        for first in range(0, len(columns), each := max(1, 63 // bits)):
            key = columns[first].astype(np.int64)
            for c in columns[first + 1 : first + each]:
                key = key << bits | c.astype(np.int64)
            keys.append(key)
        return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")

    def look_up(self, word_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of distinct words, by their keys."""
        order = np.argsort(word_key[:, 0])
        ids, counts = np.full(len(order), -1, np.int64), np.zeros(len(order), np.int64)
        for b, s in cut(word_key[order, 0], self.ranges):
            keys, more, n = self._words(b)
            asked, own = word_key[order[s]], order[s]
            i = np.searchsorted(keys, asked[:, 0])
            while len(own):  # once, unless keys agree in their first halves
                held = i < len(keys)
                own, i, asked = own[held], i[held], asked[held]
                held = keys[i] == asked[:, 0]
                own, i, asked = own[held], i[held], asked[held]
                hit = more[i] == asked[:, 1]
                ids[own[hit]], counts[own[hit]] = self.offsets[b] + i[hit], n[i[hit]]
                own, i, asked = own[~hit], i[~hit] + 1, asked[~hit]
        return ids, counts

    def _words(self, b: int) -> tuple[np.ndarray, ...]:
        return _mapped(f"{self.folder}/words-{b}", (np.uint64, np.uint64, np.int64))

    def frequent(self, ids: np.ndarray) -> np.ndarray:
        """Whether words are frequent; a text's start always is."""
        kinds, which = np.unique(ids, return_inverse=True)
        out, where = np.ones(len(kinds), bool), np.searchsorted(self.offsets, kinds, "right") - 1
        for b in np.unique(where[where < self.ranges]).tolist():
            x, y = np.searchsorted(where, [b, b + 1])
            out[x:y] = self._words(b)[2][kinds[x:y].astype(np.int64) - self.offsets[b]] >= self.many
        return out[which]

    def ids_of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and training counts of the tokens of each row, and the places where rows begin."""
        starts, ends, at = spans(buf, off)
        keys, which = word_keys(LOWER[buf], starts, ends)
        ids, counts = self.look_up(np.concatenate([keys, END]))
        which, at = tokens(which, at, len(keys))
        return ids[which], counts[which], at

    def context(self, columns: list[np.ndarray]) -> np.ndarray:
        """The key of the words before an n-gram's last: their ids where these fit into 64 bits, else a hash of them."""
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            if len(columns) == 2 and self.width <= 4:
                key = (key << np.uint64(32)) | c.astype(np.uint64)
            else:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        return key

    def ranges_of(self, k: int) -> int:
        """Ranges of n-grams of ``k`` words; of single words, ranges of ids."""
        return max(1, self.gram_ranges >> (self.order - k)) if k > 1 else self.words // self.range_words + 1

    def spots(self, columns: list[np.ndarray], frequent: list[np.ndarray]) -> np.ndarray:
        """Where n-grams go, as 32-bit values: by their first word, if that is frequent by their context, and if all of
        that is, by their last word too. What has to stay together fits into a range."""
        context = self.context(columns[:-1])
        spread = context + mix(columns[-1].astype(np.uint64) + np.uint64(1))
        x = np.where(np.all(frequent, axis=0), spread, np.where(frequent[0], context, columns[0].astype(np.uint64)))
        return mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)

    def part(self, spots: np.ndarray, k: int) -> np.ndarray:
        return ((spots * np.uint64(self.ranges_of(k))) >> np.uint64(32)).astype(np.int64)

    def gram_rows(self, columns: list[np.ndarray], counts: np.ndarray, frequent: list[np.ndarray]) -> list[tuple]:
        """Rows of n-grams, summed, by part; of more than FAN parts, by groups of parts."""
        k, order = len(columns), self.sorted_order(columns)
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        first = np.flatnonzero(new)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        columns, frequent = [c[first] for c in columns], [f[order][first] for f in frequent]
        rows = []
        for b, own in _by(self.parts_of(columns, frequent) // self.step(k) * self.step(k)):
            ids = [columns[0][own].astype(np.int64), *(c[own] for c in columns[1:])]
            ids[0] = np.diff(ids[0], prepend=0)  # sorted, so that what is stored is small
            rows.append(_row(b, k, np.stack([_planes(c, self.width) for c in ids]), counts[own]))
        return rows

    def parts_of(self, columns: list[np.ndarray], frequent: list[np.ndarray]) -> np.ndarray:
        """The range of each n-gram."""
        if len(columns) == 1:
            return columns[0].astype(np.int64) // self.range_words
        return self.part(self.spots(columns, frequent), len(columns))

    def step(self, k: int) -> int:
        """Parts of a group in the first of two steps; 1 if one step will do."""
        return -(-self.ranges_of(k) // self.fan)

    def level(self, columns: list[np.ndarray], ranks: list[np.ndarray], frequent: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """P(last column | columns before) from that with one column less; ids below 0 are unknown. ``ranks`` sort like
        the ids and are small."""
        k, d = len(columns), np.array(self.discounts[len(columns) - 1])
        known = np.flatnonzero(np.all([c >= 0 for c in columns[:-1]], axis=0))
        # In the order in which they are stored, neighbours ask for neighbours.
        known = known[_order([c[known] for c in ranks])]
        before_last, last = [c[known] for c in columns[:-1]], columns[-1][known]
        often = [f[known] for f in frequent[:-1]]
        spread, context = np.all(often, axis=0), self.context(before_last)
        spots = self.spots([*before_last, np.maximum(last, 0)], often)
        sums, count = np.zeros(len(known), CONTEXT), np.zeros(len(known), np.int64)
        for b, own in _by(self.part(spots, k)):
            g = self.grams(k, b)
            if not len(g.firsts):
                continue
            # Neighbours of one context look it up once.
            new = np.ones(len(own), bool)
            new[1:] = np.any([c[own[1:]] != c[own[:-1]] for c in before_last], axis=0)
            which, one = np.cumsum(new) - 1, own[new]
            i = np.minimum(np.searchsorted(g.firsts, before_last[0][one]), len(g.firsts) - 1)
            known_here = np.flatnonzero(g.firsts[i] == before_last[0][one])
            i, one = i[known_here], one[known_here]
            low, high = g.starts[i].astype(np.int64), np.full(len(i), len(g.words))
            high[i + 1 < len(g.starts)] = g.starts[i[i + 1 < len(g.starts)] + 1]
            for c, ids in zip(before_last[1:], g.middle, strict=True):
                low, end = _within(ids, low, high, c[one]), high
                there = np.flatnonzero(low < end)
                there = there[ids[low[there]] == c[one[there]]]
                one, low, end, known_here = one[there], low[there], end[there], known_here[there]
                high = _within(ids, low, near := np.minimum(low + SHORT, end), c[one] + 1)
                more = np.flatnonzero((high == near) & (near < end))  # contexts are short, most of them
                high[more] = _within(ids, high[more], end[more], c[one[more]] + 1)
            at = np.full(int(new.sum()), -1)
            at[known_here] = np.arange(len(known_here))
            which = at[which]
            own, which = own[which >= 0], which[which >= 0]
            sums[own] = g.sums(low, high)[which]
            j, high = _within(g.words, low[which], high[which], last[own]), high[which]
            met = np.flatnonzero(j < high)
            met = met[g.words[j[met]] == last[own[met]]]
            count[own[met]] = g.counts(j[met])
        gathered = np.flatnonzero(spread)
        for b, own in _by(self.part(mix(context[gathered]) >> np.uint64(32), k)):
            keys, found = self.spread_sums(k, b)
            own = gathered[own]
            sums[own] = 0
            if len(keys):
                i = np.minimum(np.searchsorted(keys, context[own]), len(keys) - 1)
                hit = keys[i] == context[own]
                sums[own[hit]] = found[i[hit]]
        total = sums["total"].astype(float)
        there = total > 0
        spare = np.divide(d[1] * sums["one"] + d[2] * sums["two"] + d[3] * sums["more"], total, out=np.ones(len(known)), where=there)
        out = lower.copy()
        out[known] = np.divide(_off(count, d), total, out=np.zeros(len(known)), where=there) + spare * lower[known]
        return out

    def grams(self, k: int, b: int) -> "Grams":
        return Grams(*_mapped(f"{self.folder}/grams{k}-{b}", GRAMS), k, self.width)

    def spread_sums(self, k: int, b: int) -> tuple[np.ndarray, ...]:
        return _mapped(f"{self.folder}/spread{k}-{b}", ("<u8", CONTEXT))

    def singles(self, ids: np.ndarray) -> np.ndarray:
        """P(token) by the number of distinct words before it; all unknown words share one probability."""
        follows, where = np.zeros(len(ids), np.int64), np.where(ids >= 0, ids // self.range_words, -1)
        for b, own in _by(where):
            if b >= 0 and len(f := _mapped(f"{self.folder}/single-{b}", (np.int64,))[0]):
                follows[own] = f[ids[own] - b * self.range_words]
        d = np.array(self.discounts[0]) if self.discounts else np.zeros(4)
        return self.rest / (self.words + 1) + _off(follows, d) / max(1, self.kinds)

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(token | tokens before); ``counts`` are the training counts of the tokens."""
        out = self.singles(ids)
        if self.discounts:
            frequent = counts >= self.many
            kinds, rank = np.unique(ids, return_inverse=True)
            for k in range(2, self.order + 1):
                columns, ranks = ([before(c, at, b, first) if b else c for b in range(k - 1, -1, -1)] for c, first in ((ids, self.words), (rank, len(kinds))))
                out = self.level(columns, ranks, [before(frequent, at, b, True) if b else frequent for b in range(k - 1, -1, -1)], out)
        return out


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of small numbers, the first column first; equal rows in any."""
    bits = max(1, max(int(c.max(initial=0)) for c in columns).bit_length())
    if bits * len(columns) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key << bits | c
    return np.argsort(key)


def _by(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``parts`` and where it stands."""
    if len(parts):
        low = int(parts.min())
        order = np.argsort((parts - low).astype(np.uint16) if int(parts.max()) - low < 1 << 16 else parts, kind="stable")
        first = np.flatnonzero(np.diff(parts[order], prepend=low - 1))
        for a, e in zip(first.tolist(), [*first[1:].tolist(), len(parts)], strict=True):
            yield int(parts[order[a]]), order[a:e]


def fit(docs: DataFrame, train: Column, order: int = ORDER, range_words: int = RANGE_WORDS, range_grams: int = RANGE_GRAMS, fan: int = FAN) -> Model:
    """Count the words and n-grams of all texts of ``docs`` for which ``train`` holds; null texts count as empty.

    ``order`` is the number of words of an n-gram, from 2. Texts begin after ``order - 1`` start symbols, which are no
    words. Rows of a range are dealt to tasks by their range alone, a bounded number of rows from each slice.
    """
    folder = mapped_dir(docs.sparkSession, "kneser-ney")
    learned = docs.where(train).select("text")
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(WORD_RANGES, max(1, size // 30 // range_words))
    step = -(-ranges // fan)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: list[tuple[np.ndarray, np.ndarray]] = []
            for _, _, buf, off in slices(batch.column(0)):
                starts, ends, at = spans(buf, off)
                keys, which = word_keys(LOWER[buf], starts, ends)
                sums.append((np.concatenate([keys, END]), np.bincount(tokens(which, at, len(keys))[0], minlength=len(keys) + 1)))
            if sums:
                yield pa.RecordBatch.from_pydict(_rows(_word_rows(*_summed_words(*(np.concatenate(x) for x in zip(*sums, strict=True))), ranges, step)))

    def split_words(table: pa.Table) -> pa.Table:
        return pa.table(_rows(_word_rows(*_read_words(table), ranges, 1)))

    def save_words(table: pa.Table) -> pa.Table:
        b = table["part"][0].as_py()
        keys, counts = _read_words(table)
        _save(folder, f"words-{b}", np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), counts)
        return pa.table({"part": [b], "n": [len(keys)], "total": [int(counts.sum())]})

    n, total = np.zeros(ranges, np.int64), 0
    counted = learned.mapInArrow(count_words, ROWS)
    if step > 1:  # groups of ranges first, a group's rows dealt to several tasks
        counted = counted.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(fan))).groupBy("part", "deal").applyInArrow(split_words, ROWS)
    for r in counted.groupBy("part").applyInArrow(save_words, "part long, n long, total long").toLocalIterator():
        n[r.part], total = r.n, total + r.total
    model = Model(folder, order, ranges, max(1, size // 10 // range_grams), tuple(np.concatenate([[0], np.cumsum(n)]).tolist()), total, range_words, range_grams, fan)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0), 4 << 20):
                ids, counts, at = model.ids_of(buf, off)
                frequent = counts >= model.many
                often = [before(frequent, at, b, True) for b in range(order - 1, 0, -1)]
                columns = [before(ids, at, b, model.words) if b else ids for b in range(order - 1, -1, -1)]
                yield pa.RecordBatch.from_pydict(_rows(model.gram_rows(columns, np.ones(len(ids), np.int64), often)))

    grams = learned.mapInArrow(count_grams, ROWS)
    for k in range(order, 0, -1):
        if model.step(k) > 1:  # groups of parts first, a group's rows dealt to several tasks
            grams = grams.withColumn("deal", F.pmod(F.xxhash64("few", "ids"), F.lit(fan))).groupBy("part", "deal").applyInArrow(_split(model, k), ROWS)
        grams = grams.repartition(max(2, model.ranges_of(k)), "part").groupBy("part").applyInArrow(_save_level(model, k), ROWS)
    sums = np.zeros((order + 1, 6), np.int64)
    for r in grams.select("ids").toLocalIterator():
        x = np.frombuffer(r.ids, np.int64).reshape(-1, 7)
        np.add.at(sums, x[:, 0], x[:, 1:])
    d = [discounts(x[:4]) for x in sums[1:]]
    spare, kinds = float(d[0][1] * sums[1, 0] + d[0][2] * sums[1, 1] + d[0][3] * sums[1, 4]), int(sums[1, 5])
    return replace(model, discounts=tuple(tuple(x) for x in d), kinds=kinds, rest=spare / kinds if kinds else 1.0)


def _sums(k: int, counts: np.ndarray) -> tuple:
    """A row of the numbers of n-grams counted 1 to 4 times and from 3 times, and the sum of counts."""
    return _row(-1, 0, np.array([k, *((counts == c).sum() for c in range(1, 5)), (counts > 2).sum(), counts.sum()], np.int64))


def _split(model: Model, k: int) -> Callable[[pa.Table], pa.Table]:
    """Rows of a group of parts as rows of its parts."""

    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() != k:
            return table.select([c.split()[0] for c in ROWS.split(", ")])
        columns, counts = _read_grams(table, k, model.width)
        return pa.table(_rows(replace(model, fan=1 << 60).gram_rows(columns, counts, [model.frequent(c) for c in columns[:-1]])))

    return run


def _save_level(model: Model, k: int) -> Callable[[pa.Table], pa.Table]:
    """Writes a range of n-grams of ``k`` words, and gives the rows of the next lower order, the sums of the range's
    spread contexts and its numbers of n-grams by count; parts of other kinds are written or passed on."""

    def spread_sums(table: pa.Table, b: int) -> None:
        parts = [np.frombuffer(x.as_buffer(), np.dtype([("key", "<u8"), ("sums", CONTEXT)])) for x in table["ids"]]
        both = np.concatenate(parts)
        both = both[np.argsort(both["key"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], both["key"][1:] != both["key"][:-1]]))
        out = np.zeros(len(first), CONTEXT)
        for c in ("one", "two", "more", "total"):
            out[c] = np.add.reduceat(both["sums"][c].astype(np.int64), first)
        _save(model.folder, f"spread{k + 1}-{b}", both["key"][first], out)

    def singles(table: pa.Table, b: int) -> list[tuple]:
        (ids,), counts = _read_grams(table, 1, model.width)
        out = np.zeros(min(model.range_words, model.words - b * model.range_words), np.int64)
        np.add.at(out, ids.astype(np.int64) - b * model.range_words, counts)
        _save(model.folder, f"single-{b}", out)
        return [_sums(1, out)]

    def grams(table: pa.Table, b: int) -> list[tuple]:
        columns, counts = _read_grams(table, k, model.width)
        order = model.sorted_order(columns)
        columns, counts = [c[order] for c in columns], counts[order]
        apart = np.ones(len(order), bool)
        apart[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
        first = np.flatnonzero(np.concatenate([apart[:1], apart[1:] | (columns[-1][1:] != columns[-1][:-1])]))
        columns, counts, start = [c[first] for c in columns], np.add.reduceat(counts, first), np.flatnonzero(apart[first])
        found = np.zeros(len(start), CONTEXT)
        for name, x in (("one", counts == 1), ("two", counts == 2), ("more", counts > 2), ("total", counts)):
            found[name] = np.add.reduceat(x.astype(np.int64), start)
        head = np.flatnonzero(np.diff(columns[0], prepend=-1))
        long = np.flatnonzero(np.diff(start, append=len(first)) > SHORT)
        few, large = _pack(counts)
        ids = np.frombuffer(b"".join(np.ascontiguousarray(_planes(c, model.width).T).tobytes() for c in columns[1:]) + bytes(8), np.uint8)
        _save(model.folder, f"grams{k}-{b}", columns[0][head], head.astype(np.uint32), ids, few, np.flatnonzero(few == 255), large, start[long].astype(np.uint32), found[long])
        frequent = [model.frequent(c) for c in columns[:-1]]
        spread = np.flatnonzero(np.all([f[start] for f in frequent], axis=0))
        out = [_sums(k, counts)]
        keys = model.context([c[start[spread]] for c in columns[:-1]])
        for r, own in _by(model.part(mix(keys) >> np.uint64(32), k)):
            both = np.zeros(len(own), np.dtype([("key", "<u8"), ("sums", CONTEXT)]))
            both["key"], both["sums"] = keys[own], found[spread[own]]
            out.append(_row(SPREAD + r, -k, both.tobytes()))
        return out + model.gram_rows(columns[1:], np.ones(len(first), np.int64), frequent[1:])

    def run(table: pa.Table) -> pa.Table:
        b = table["part"][0].as_py()
        if b < 0:
            all_ = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 7) for x in table["ids"]])
            sums = [all_[all_[:, 0] == j, 1:].sum(axis=0) for j in range(1, model.order + 1)]
            rows = [_row(-1, 0, np.concatenate([[j], x])) for j, x in enumerate(sums, 1)]
        elif b >= SPREAD:
            spread_sums(table, b - SPREAD)
            rows = []
        else:
            rows = singles(table, b) if k == 1 else grams(table, b)
        return pa.table(_rows(rows))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of every text of ``docs`` (doc_id, text), a row per row.

    Tokens are the words, A to Z in lower case, and one end; null and empty texts are the end alone. n_known counts
    tokens met in training, train_tokens those trained on; base_score is that of single words with half a count added;
    perplexity is 10 ** (-score / n_tokens). Nulls in doc_id and repeated rows pass through, other columns are not read,
    an empty table gives no rows, and a model of nothing gives unknown words all probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1), 3 << 20):
                ids, counts, at = model.ids_of(buf, off)
                base = np.log10((counts + 0.5) / (model.total + 0.5 * (model.words + 1)))
                own = np.log10(model.probabilities(ids, counts, at))
                sums = [np.add.reduceat(x, at[:-1]) for x in ((counts > 0).astype(np.int64), base, own)]
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums[0]), pa.array(np.full(b - a, model.total, np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10 ** (-sums[2] / n))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
