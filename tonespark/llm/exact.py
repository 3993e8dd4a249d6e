"""Exact dedup by a minimal perfect hash over the distinct digests of a historical part.

Digests fall into shards. A shard's historical digests get a minimal perfect hash (hash and displace): a bucket's seed
sends each of its digests to a slot of its own, and slots hold the full digest and where its first row is. A shard is
one row of arrays, which the new digests of its shard meet once: each computes its slot, the digest there is compared
byte by byte, members add to their slot, and the others are groups of their own. Nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespark.llm.scratch import keep

PRIME = 2147483647
SHARD_DIGESTS = 20_000
BUCKET_DIGESTS = 3


def text_digest(text: Column) -> Column:
    """SHA-256 of the text (32 bytes), null as empty, each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def displace(h0: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket, and the slot of each key: a bijection onto 0 to n - 1.

    Slot = ``(h1 + seed * h2) mod PRIME mod n``; of a bucket of one key, seed ``-1 - slot``.
    """
    n = len(h0)
    size = buckets_of(n)
    bucket = h0 % size
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(size + 1))
    counts = np.diff(starts)
    seeds, slots, taken = np.zeros(size, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] < 2:
            break
        keys = order[starts[b] : starts[b + 1]]
        first = 0
        while True:
            tries = np.arange(first, first + 64)
            at = np.sort((h1[keys] + tries[:, None] * h2[keys]) % PRIME % n, axis=1)
            good = ~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
            if good.any():
                break
            first += 64
            if first > 1 << 22:
                raise ValueError("digests that no seed separates")
        seeds[b] = tries[int(np.argmax(good))]
        slots[keys] = (h1[keys] + seeds[b] * h2[keys]) % PRIME % n
        taken[slots[keys]] = True
    single = np.flatnonzero(counts == 1)
    free = np.flatnonzero(~taken)
    seeds[single] = -1 - free
    slots[order[starts[single]]] = free
    return seeds, slots


def buckets_of(n: int) -> int:
    return max(1, math.ceil(n / BUCKET_DIGESTS))


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _places(digests: np.ndarray) -> list[np.ndarray]:
    """The 28-bit values from which bucket and slot are made."""
    words = np.ascontiguousarray(digests).view("<u4")
    return [(words[:, k] & ((1 << 28) - 1)).astype(np.int64) for k in range(3)]


def find(seeds: np.ndarray, slots: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The slot of each asked digest, -1 where the digest there (``slots``) is another."""
    n = len(slots)
    if not n:
        return np.full(len(asked), -1, np.int64)
    h0, h1, h2 = _places(asked)
    seed = seeds[h0 % buckets_of(n)]
    at = np.where(seed < 0, -1 - seed, (h1 + seed * h2) % PRIME % n)
    return np.where((slots[at] == asked).all(axis=1), at, -1)


def groups_of(rows: DataFrame) -> DataFrame:
    """Digests of ``rows`` (digest, doc_id, row), each with its first row (smallest doc_id, null last) and count."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")
    return rows.groupBy("digest").agg(first, F.count("*").alias("n")).select("digest", F.col("f.doc_id").alias("doc_id"), F.col("f.row").alias("row"), "n")


def digests_of(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, digest and a number for each row of ``docs``, written once."""
    return keep(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), name)


class History:
    """A minimal perfect hash over the distinct digests of ``groups`` (digest, doc_id, row, n), in ``shards`` rows."""

    def __init__(self, groups: DataFrame, shards: int):
        self.shards, self.kind = shards, groups.schema["doc_id"].dataType

        def build(table: pa.Table) -> pa.Table:
            digests = _bytes_of(table["digest"])
            seeds, slots = displace(*_places(digests))
            order = np.argsort(slots)
            own = table.take(order)
            lists = {f"{c}s": pa.array([own[c].to_pylist()], pa.list_(own[c].type)) for c in ("doc_id", "row", "n")}
            return pa.table({"shard": table["shard"][:1], "seeds": pa.array([seeds.tobytes()], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary()), **lists})

        made = f"shard long, seeds binary, digests binary, doc_ids array<{self.kind.simpleString()}>, rows array<long>, ns array<long>"
        self.table = keep(self.placed(groups).groupBy("shard").applyInArrow(build, made), "perfect-hash")

    def placed(self, groups: DataFrame) -> DataFrame:
        return groups.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard"), "digest", "doc_id", "row", "n")

    def look_up(self, groups: DataFrame, here: bool) -> DataFrame:
        """All groups (digest, keep_id, first_row, group_size, here): the slots, with what ``groups`` adds to them, and
        the digests of ``groups`` that no slot holds. ``here``: the history is part of the same rows, so that the first
        row of a group may be in either; else it stays the history's, and the group is marked as not here."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("digest", "keep_id", "first_row", "group_size", "here")}
            kind, digests, ids, rows, ns, seeds = left.schema.field("doc_ids").type.value_type, np.zeros((0, 32), np.uint8), [], [], [], np.zeros(1, np.int64)
            if left.num_rows:
                digests, seeds = (np.frombuffer(left[c][0].as_buffer(), x) for c, x in (("digests", np.uint8), ("seeds", np.int64)))
                digests, (ids, rows, ns) = digests.reshape(-1, 32), (left[c][0].as_py() for c in ("doc_ids", "rows", "ns"))
            asked = _bytes_of(right["digest"])
            at = find(seeds, digests, asked)
            new = list(zip(*(right[c].to_pylist() for c in ("doc_id", "row", "n")), strict=True))
            for k in np.flatnonzero(at >= 0).tolist():
                slot, (i, row, n) = int(at[k]), new[k]
                ns[slot] += n
                if here and (ids[slot] is None, ids[slot], rows[slot]) > (i is None, ids[slot] if i is None else i, row):
                    ids[slot], rows[slot] = i, row
            apart = np.flatnonzero(at < 0).tolist()
            fresh = [new[k] for k in apart]
            for c, old, more in (("digest", map(bytes, digests), (bytes(asked[k]) for k in apart)), ("keep_id", ids, (x[0] for x in fresh)), ("first_row", rows, (x[1] for x in fresh)), ("group_size", ns, (x[2] for x in fresh)), ("here", [here] * len(ids), [True] * len(fresh))):
                out[c] = [*old, *more]
            types = {"digest": pa.binary(), "keep_id": kind, "first_row": pa.int64(), "group_size": pa.int64(), "here": pa.bool_()}
            return pa.table({c: pa.array(out[c], t) for c, t in types.items()})

        made = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", self.kind), T.StructField("first_row", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("here", T.BooleanType())])
        return self.table.groupBy("shard").cogroup(self.placed(groups).groupBy("shard")).applyInArrow(run, made)


def decide(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` (doc_id, text) are rows that came before: a text of theirs is not kept again, whatever its doc_id,
    keep_id is their smallest doc_id of it, and group_size counts them. If None, half of the rows of ``docs`` comes
    before the rest, which changes no result. The row with the smallest doc_id of equal texts stays; of repeated rows
    that share it, one. doc_ids may be of any type that has an order. Null texts count as empty; a null doc_id comes
    last, and keep_id is null if no row of the group has one. An empty table gives no rows; other columns are not read.
    """
    return _decide(docs, history).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _decide(docs: DataFrame, history: DataFrame | None) -> DataFrame:
    rows = digests_of(docs, "digests")
    if history is None:
        old = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
        before, new = rows.where(old), rows.where(~old)
    else:
        same = history.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
        before, new = digests_of(same, "history-digests"), rows
    past, asked = keep(groups_of(before), "history"), keep(groups_of(new), "asked")
    shards = max(1, math.ceil(max(past.count(), asked.count()) / SHARD_DIGESTS))
    groups = History(past, shards).look_up(asked, history is None)
    kept = F.col("here") & (F.col("row") == F.col("first_row"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_rows(docs: DataFrame, decided: DataFrame, mark: Callable[[Column], Column]) -> DataFrame:
    """``docs`` without the rows that ``decided`` (doc_id, mark, kept) drops, found by doc_id and ``mark`` of the text.

    Of repeated rows that share both and of which one is kept, one stays. All columns stay, whatever their names.
    """
    decided = keep(decided, "decided")
    pick = lambda kept, *names: decided.where(F.col("kept") == kept).select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1])).distinct()
    lost, stay = pick(False, "i", "m"), pick(True, "i2", "m2")
    both = F.col("i").eqNullSafe(F.col("i2")) & (F.col("m") == F.col("m2"))
    gone, twice = lost.join(stay, both, "left_anti"), keep(lost.join(stay, both, "left_semi"), "repeated")
    marked = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("own_id"), mark(F.col("text")).alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_mark") == F.col("m"))
    out = marked.join(gone, same, "left_anti")
    if not twice.isEmpty():
        once = out.join(twice, same, "left_semi").dropDuplicates(["own_id", "own_mark"])
        out = out.join(twice, same, "left_anti").unionByName(once)
    return out.select("whole.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``decide`` drops; of repeated rows that share doc_id and text, one stays."""
    made = _decide(docs, None).select("doc_id", F.col("digest").alias("mark"), "kept")
    return drop_rows(docs, made, text_digest)
