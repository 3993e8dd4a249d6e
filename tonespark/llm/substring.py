"""Substring dedup by difference-cover anchors.

Windows of WINDOW words are compared without hashing all of them. Only runs of ANCHOR words that begin at cover
positions, counted from the document's start modulo PERIOD, are hashed everywhere. The cover is a perfect difference
set: for any two positions some shift below PERIOD puts both on the cover, so two equal windows share an anchor at the
same shift. Where an anchor repeats it is extended: the windows that contain it are compared, word by word within a unit
of documents of a few MB and by 96-bit BLAKE2 digests of their words between units. Each distinct window of a unit is
sent once, which keeps what one window gathers far below the number of its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespark.llm.scratch import free_names, with_order
from tonespark.llm.words import cut, hashes, row_of, spans, text_bytes, windows, word_ids

WINDOW, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)
UNIT_BYTES = 4 << 20
#: Hashes of a bucket, about, and buckets of a task: what a task reads doesn't grow with the table.
BUCKET_HASHES, TASK_BUCKETS = 500_000, 4
assert WINDOW - ANCHOR + 1 >= PERIOD
assert all(any((c - d) % PERIOD == r for c in COVER for d in COVER) for r in range(PERIOD))
_LAST = (1 << 63) - 1


class Unit:
    """The documents of a unit in order of doc_id (null last) and text, and their words."""

    def __init__(self, table: pa.Table):
        ids = table["key"]
        none = ids.is_null().combine_chunks().to_numpy(zero_copy_only=False)
        key = ids.fill_null(_LAST).combine_chunks().to_numpy()
        order = np.lexsort((key, none))
        if ((key[order][1:] == key[order][:-1]) & (none[order][1:] == none[order][:-1])).any():
            texts = table["text"].to_pylist()
            order = np.array(sorted(range(len(texts)), key=lambda i: (none[i], key[i], texts[i] or "")))
        self.table = table.take(order)
        self.key, self.none = key[order], none[order]
        same = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            if self.key[i] == self.key[i - 1] and self.none[i] == self.none[i - 1]:
                same[i] = same[i - 1] + 1
        self.turn = (same + (self.none.astype(np.int64) << 30)).astype(np.int32)
        self.buf, off = text_bytes(self.table["text"])
        self.off = off
        self.starts, self.ends, self.at = spans(self.buf, off)
        self.h = hashes(self.buf, self.starts, self.ends)
        self.row = row_of(self.at)
        self.place = np.arange(len(self.row)) - self.at[self.row]
        self.left = self.at[self.row + 1] - np.arange(len(self.row))  # words from here to the document's end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of anchors, in documents that have a window."""
        if len(self.h) < ANCHOR:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        long = np.diff(self.at)[self.row] >= WINDOW
        i = np.flatnonzero(long & (self.left >= ANCHOR) & np.isin(self.place % PERIOD, COVER))
        return i, windows(self.h, ANCHOR)[i]

    def classes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each kind of window at ``starts`` (ascending), and every window's kind; kinds are told apart by
        their words, not by hashes."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = word_ids(self.buf, self.starts, self.ends)[1]
        _, first, which = np.unique(windows(self.h, WINDOW)[starts], return_index=True, return_inverse=True)
        again = np.flatnonzero(first[which] != np.arange(len(starts)))
        a, b = starts[again], starts[first[which[again]]]
        if all((words[a + k] == words[b + k]).all() for k in range(WINDOW)):
            return first, which
        kind, most = words, len(words)  # windows that share a hash
        for k in range(1, WINDOW):
            kind = np.unique(kind[:-1] * most + words[k:], return_inverse=True)[1]
        return np.unique(kind[starts], return_index=True, return_inverse=True)[1:]

    def digests(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First 64 and other 32 bits of the digest of each window's words, joined by one space."""
        raw = self.buf.tobytes()
        rows = (b" ".join(raw[a:b].split()) for a, b in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True))
        text = memoryview(b" ".join(filter(None, rows)))
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        made = [hashlib.blake2b(text[a:b], digest_size=12).digest() for a, b in zip(at[starts].tolist(), (at[starts + WINDOW] - 1).tolist(), strict=True)]
        both = np.frombuffer(b"".join(made), np.dtype([("one", "<u8"), ("two", "<u4")]))
        return both["one"].astype(np.uint64), both["two"].astype(np.uint32)


def _blobs(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table[column])])


def _counts(table: pa.Table, column: str) -> np.ndarray:
    return np.array([len(x.as_buffer()) // 8 for x in table[column]], np.int64)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the text without the words that repeat, and ``n_words``, ``n_removed``.

    A word is removed if a window that covers it has the same words as one that starts earlier: in a row of smaller
    doc_id, or in the same row further left. Windows are judged on the input. doc_ids may be of any type that has an
    order; rows of equal doc_id go by their texts, null doc_ids come last. The words left are joined by one space; null
    texts have no words and become empty. Other columns stay; where one is named n_words or n_removed, the new one is
    the first free of name_2, name_3 ... An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    added = free_names(docs.columns, "n_words", "n_removed")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-size // UNIT_BYTES))
    n = max(1, size // 6 * len(COVER) // PERIOD // BUCKET_HASHES)
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    carried = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    rows = with_order(docs.select(F.pmod(spot, F.lit(units)).alias("unit"), "doc_id", "text", carried.alias("rest")))

    def anchors(table: pa.Table) -> pa.Table:
        unit = Unit(table)
        keys, counts = np.unique(unit.anchors()[1], return_counts=True)
        out = [(b, table["unit"][0].as_py(), keys[s].tobytes(), np.packbits(counts[s] > 1).tobytes()) for b, s in cut(keys, n)]
        b, u, k, m = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "unit": pa.array(u, pa.int64()), "keys": pa.array(k, pa.binary()), "many": pa.array(m, pa.binary())})

    def repeated(table: pa.Table) -> pa.Table:
        keys, counts = _blobs(table, "keys", np.uint64), _counts(table, "keys")
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=c).astype(bool) for x, c in zip(table["many"], counts.tolist(), strict=True)])
        order = np.argsort(keys, kind="stable")
        ks = keys[order]
        same = np.zeros(len(ks), bool)
        same[1:] = ks[1:] == ks[:-1]
        same[:-1] |= same[1:]
        again = np.zeros(len(ks), bool)
        again[order] = same
        again |= many
        ends = np.cumsum(counts)
        u, k = [], []
        for unit, a, e in zip(table["unit"].to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            if again[a:e].any():
                u.append(unit)
                k.append(keys[a:e][again[a:e]].tobytes())
        return pa.table({"unit": pa.array(u, pa.int64()), "keys": pa.array(k, pa.binary())})

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("bucket", "unit", "one", "two", "key", "turn", "place", "many")
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            unit = Unit(left)
            at, h = unit.anchors()
            at = at[np.isin(h, _blobs(right, "keys", np.uint64))]
            edge = np.zeros(len(unit.h) + 1, np.int64)
            np.add.at(edge, np.maximum(at - (WINDOW - ANCHOR), unit.at[unit.row[at]]), 1)
            np.add.at(edge, at + 1, -1)
            starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (unit.left >= WINDOW))
            first, which = unit.classes(starts)
            many, starts = np.bincount(which, minlength=len(first)) > 1, starts[first]
            one, two = unit.digests(starts)
            order = np.lexsort((two, one))
            one, two, starts, many = one[order], two[order], starts[order], many[order]
            row = unit.row[starts]
            for b, s in cut(one, n):
                out.append((b, left["unit"][0].as_py(), one[s].tobytes(), two[s].tobytes(), unit.key[row[s]].tobytes(), unit.turn[row[s]].tobytes(), starts[s].astype(np.uint32).tobytes(), many[s].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.table({c: pa.array(x, pa.int64() if c in ("bucket", "unit") else pa.binary()) for c, x in zip(names, columns, strict=True)})

    def winners(table: pa.Table) -> pa.Table:
        one, two = _blobs(table, "one", np.uint64), _blobs(table, "two", np.uint32)
        key, turn, place = (_blobs(table, c, kind) for c, kind in (("key", np.int64), ("turn", np.int32), ("place", np.uint32)))
        many, counts = _blobs(table, "many", bool), _counts(table, "one")
        order = np.lexsort((place, turn & ((1 << 30) - 1), key, turn >> 30, two, one))
        o, t = one[order], two[order]
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
        group = np.cumsum(first) - 1
        again = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0) if len(o) else np.zeros(0, bool)
        wins, told = np.zeros(len(o), bool), np.zeros(len(o), bool)
        wins[order] = first
        told[order] = again[group]
        ends = np.cumsum(counts)
        rows = []
        for unit, a, e in zip(table["unit"].to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            if (m := told[a:e]).any():
                rows.append((unit, place[a:e][m].tobytes(), wins[a:e][m].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.table({c: pa.array(x, pa.int64() if c == "unit" else pa.binary()) for c, x in zip(("unit", "place", "wins"), columns, strict=True)})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", left.schema.field("doc_id").type), ("text", pa.string()), ("rest", left.schema.field("rest").type), ("n_words", pa.int64()), ("n_removed", pa.int64()))})
        unit = Unit(left)
        gone = np.zeros(len(unit.h), bool)
        if right.num_rows:
            # Places are those of the first window of each told kind; the unit finds the others of the kind itself.
            place, wins = _blobs(right, "place", np.uint32).astype(np.int64), _blobs(right, "wins", bool)
            h, starts = windows(unit.h, WINDOW), np.flatnonzero(unit.left >= WINDOW)
            known = np.unique(h[place])
            starts = starts[known[np.minimum(np.searchsorted(known, h[starts]), len(known) - 1)] == h[starts]]
            first, which = unit.classes(starts)
            told, win = np.zeros(len(first), bool), np.zeros(len(first), bool)
            kind = which[np.searchsorted(starts, place)]
            told[kind], win[kind] = True, wins
            stay = ~told[which] | (win[which] & (first[which] == np.arange(len(starts))))
            edge = np.zeros(len(unit.h) + 1, np.int64)
            edge[starts[~stay]] += 1
            edge[starts[~stay] + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
        raw, texts, lost = unit.buf.tobytes(), [], np.zeros(len(unit.key), np.int64)
        for k in range(len(unit.key)):
            words, mask = raw[unit.off[k] : unit.off[k + 1]].split(), gone[unit.at[k] : unit.at[k + 1]]
            if mask.any():
                lost[k] = mask.sum()
                words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            texts.append(b" ".join(words).decode())
        return pa.table({"doc_id": unit.table["doc_id"], "text": pa.array(texts, pa.string()), "rest": unit.table["rest"], "n_words": pa.array(np.diff(unit.at)), "n_removed": pa.array(lost)})

    by_unit = rows.groupBy("unit")
    first = by_unit.applyInArrow(anchors, "bucket long, unit long, keys binary, many binary")
    tasks = -(-n // TASK_BUCKETS)
    first = first.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(repeated, "unit long, keys binary")
    found = by_unit.cogroup(first.groupBy("unit")).applyInArrow(extend, "bucket long, unit long, one binary, two binary, key binary, turn binary, place binary, many binary")
    found = found.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(winners, "unit long, place binary, wins binary")
    made = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), rows.schema["rest"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = by_unit.cogroup(found.groupBy("unit")).applyInArrow(remove, made)
    where = {c: F.col("rest")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[where[c].alias(c) for c in docs.columns], F.col("n_words").alias(added[0]), F.col("n_removed").alias(added[1]))
