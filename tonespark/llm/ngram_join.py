"""Near-duplicate self-join on the Jaccard similarity of word n-grams, by a MinHash LSH forest.

Texts with equal sets of n-grams form a copy class, and only classes are compared. A class's signature gives each of
TREES trees a label of DEPTH min-hashes; sorted labels are the tree's prefix trie. Classes are matched by whole labels
first and by shorter and shorter prefixes, until what was found tells that the target recall is reached, and never
beyond the length that promises it for any pair at the threshold. Pairs of small trie nodes are tied if their whole
signatures agree enough, the children of large nodes one to another. Tied classes form components; in these all pairs
are compared exactly, blocks of members against blocks, and only counts of links and a spanning tree leave a task: the
pairs of a large node or component are never rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.llm.components import components
from tonespark.llm.exact import drop_rows
from tonespark.llm.scratch import keep
from tonespark.llm.words import SLICE, buckets, mix, row_of, slices, spans, windows, word_ids

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, BITS, RECALL = 24, 8, 8, 0.9999
#: Nodes of so many members give their pairs, at most (PAIRED - 1) / 2 a member; larger ones a tie a member.
PAIRED = 8
#: Tied pairs of small nodes stay if their signatures agree as much as the threshold's do less so many deviations.
DEVIATIONS = 5
#: Members of a block: a 16th of the component within these bounds.
BLOCK, BLOCK_MOST = 128, 512
BUCKET_LABELS = 1_000_000


def found_share(s: float, depth: int, trees: int = TREES) -> float:
    """The share of pairs of similarity ``s`` whose labels agree in the first ``depth`` values in one tree at least."""
    same = s + (1 - s) / (1 << BITS)
    return 1 - (1 - same**depth) ** trees


def least_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which ``trees`` trees find a pair of this similarity with the target recall.

    An error if not even prefixes of one value do.
    """
    for d in range(depth, 0, -1):
        if found_share(threshold, d, trees) >= recall:
            return d
    raise ValueError(f"{trees} trees miss the recall {recall} at the threshold {threshold} even with prefixes of one value")


def matched_depth(found: Iterable[tuple[int, float, int]], threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How far prefixes are shortened, by what was ``found``: pairs by depth of their longest common prefix and
    similarity (depth, similarity, pairs).

    Prefixes are shortened while, in some band of similarity, the pairs found are less than ``recall`` of those that
    there should be: each stands for one over its chance to be found.
    """
    found, least = [x for x in found if x[1] >= threshold], least_depth(threshold, recall)
    for d in range(DEPTH, least, -1):
        own = [(int((s - threshold) * 20), s, n) for depth, s, n in found if depth >= d]
        shares = [sum(n for k, _, n in own if k == band) / sum(n / found_share(s, d) for k, s, n in own if k == band) for band in {k for k, _, _ in own}]
        if own and min(shares) >= recall:
            return d
    return least


def shingles(buf: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct n-grams of each row, sorted; a text of fewer words has one, of all its words.

    The hash is made of 128-bit BLAKE2 digests of the words, each distinct word digested once.
    """
    starts, ends, at = spans(buf, off)
    first, which = word_ids(buf, starts, ends)
    raw = memoryview(np.ascontiguousarray(buf))
    digest = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), "<u8").reshape(-1, 2).astype(np.uint64)
    one, two, row, count = digest[which, 0], digest[which, 1], row_of(at), np.diff(at)
    grams = lambda k: mix(windows(one, k) + windows(two, k, 1))
    left = at[row + 1] - np.arange(len(row)) if len(row) else np.zeros(0, np.int64)
    full = np.flatnonzero(left >= n)
    rows, found = [row[full]], [grams(n)[full] if len(full) else np.zeros(0, np.uint64)]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            rows.append(few)
            found.append(grams(k)[at[few]])
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def set_digests(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Sizes and 16-byte digests of each row's set."""
    at, raw = np.searchsorted(row, np.arange(n + 1)), memoryview(h.astype("<u8").tobytes())
    return np.diff(at), [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def labels(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Labels by row and tree: DEPTH min-hashes of BITS bits, the first in the highest bits; 0 for empty sets."""
    at = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((n, TREES), np.uint64)
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
    if len(full):
        for k in range(TREES * DEPTH):
            x = (h ^ salt[k]) * odd[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum.reduceat(x >> np.uint64(16), at[full])
            out[full, k // DEPTH] |= (least & np.uint64((1 << BITS) - 1)) << np.uint64(64 - BITS * (1 + k % DEPTH))
    return out


def trie_ties(label: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ties of sorted labels (u, v, depth, wide): each pair of a node of at most PAIRED members at the depth where the
    two part, and of wider nodes each child's first with the node's first."""
    n, out = len(label), []
    differ = label[1:] ^ label[:-1]
    depth = np.full(n, -1, np.int64)  # of the prefix shared with the next
    depth[:-1] = sum((differ >> np.uint64(64 - BITS * k) == 0).astype(np.int64) for k in range(1, DEPTH + 1))
    heads, sizes = {}, {}
    for d in range(least, DEPTH + 1):
        first = np.flatnonzero(np.concatenate([[True], depth[:-1] < d]))
        size = np.diff(first, append=n)
        heads[d], sizes[d] = np.repeat(first, size), np.repeat(size, size)
        wide = np.flatnonzero((depth == d) & (sizes[d] > PAIRED))
        out.append((heads[d][wide], wide + 1, np.full(len(wide), d), np.ones(len(wide), bool)))
    shared = np.full(n, DEPTH)
    for apart in range(1, min(PAIRED, n)):
        shared = np.minimum(shared[: n - apart], depth[apart - 1 : n - 1])
        for d in range(least, DEPTH + 1):
            i = np.flatnonzero((shared == d) & (sizes[d][: n - apart] <= PAIRED))
            out.append((i, i + apart, np.full(len(i), d), np.zeros(len(i), bool)))
    return out


def forest_ties(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ties ``u, v`` between ``classes`` (digest, size, labels) that may be near."""
    least, ranges = least_depth(threshold), max(1, classes.count() // BUCKET_LABELS)
    beyond = np.uint64(64 - BITS * least)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = np.array([*batch.column(0).to_pylist(), b""], object)[:-1]
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, TREES)
            for t in range(TREES if len(label) else 0):
                where = buckets(label[:, t] >> beyond << beyond, ranges)
                order = np.argsort(where, kind="stable")
                ends = np.searchsorted(where[order], np.arange(ranges + 1))
                rows = [(t * ranges + r, label[i, t].tobytes(), b"".join(digest[i])) for r in range(ranges) if len(i := order[ends[r] : ends[r + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "labels", "digests"])

    def match(table: pa.Table) -> pa.Table:
        label = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["labels"]])
        digest = np.frombuffer(b"".join(table["digests"].to_pylist()), "S16")
        order = np.argsort(label, kind="stable")
        u, v, depth, wide = (np.concatenate(x) for x in zip(*trie_ties(label[order], least), strict=True))
        u, v = (digest[order[x]] for x in (u, v))
        binary = lambda x: pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        up = (u > v)[:, None]
        both = np.where(up, np.stack([v, u], 1), np.stack([u, v], 1))
        return pa.table({"u": binary(both[:, 0]), "v": binary(both[:, 1]), "depth": pa.array(depth, pa.int32()), "wide": pa.array(wide)})

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for i in (4, 5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((a == b).sum(axis=1).astype(np.int32))], ["u", "v", "depth", "wide", "same"])

    planted = classes.where("size > 0").select("digest", "labels").mapInArrow(plant, "bucket long, labels binary, digests binary")
    ties = planted.groupBy("bucket").applyInArrow(match, "u binary, v binary, depth int, wide boolean")
    ties = ties.groupBy("u", "v").agg(F.max("depth").alias("depth"), F.max("wide").alias("wide"))
    of = lambda c: classes.select(F.col("digest").alias(c), F.col("labels").alias(f"{c}_labels"))
    both = ties.join(of("u"), "u").join(of("v"), "v").select("u", "v", "depth", "wide", "u_labels", "v_labels")
    rated = keep(both.mapInArrow(rate, "u binary, v binary, depth int, wide boolean, same int"), "ties")
    likeness = lambda same: (same / (TREES * DEPTH) - 1 / (1 << BITS)) / (1 - 1 / (1 << BITS))
    # At most DEPTH times the number of values of a signature are counted apart.
    depth = matched_depth([(r.depth, likeness(r.same), r["count"]) for r in rated.groupBy("depth", "same").count().collect()], threshold)
    least_same = TREES * DEPTH * (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)))
    return rated.where((F.col("depth") >= depth) & (F.col("wide") | (F.col("same") >= least_same))).select("u", "v")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest and size of the set, labels and row of each row of ``docs``, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1), SLICE // 2):
                row, h = shingles(buf, off)
                size, digest = set_digests(row, h, b - a)
                raw = labels(row, h, b - a).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in (0, 2)), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array([raw[8 * TREES * i : 8 * TREES * (i + 1)] for i in range(b - a)], pa.binary())],
                    ["doc_id", "text_hash", "digest", "size", "labels"],
                )

    signed = _read(docs).mapInArrow(sign, f"doc_id {kind}, text_hash long, digest binary, size long, labels binary")
    return keep(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, copy_id, n_copies, n_shingles, and text_hash, row.

    Texts are compared as sets of WORDS-word n-grams (fewer words: one of all). ``copy_id`` is the smallest doc_id of
    those with the same set, ``n_links`` the number of different sets with a Jaccard similarity of ``threshold`` or more,
    and ``class_id`` the smallest doc_id of all tied by links. Thresholds too low for the trees are an error. Null and empty texts have the empty set and form one class
    without links; null doc_ids come last, and class_id is null if all of a class are. Repeated rows are copies. An
    empty table gives no rows; other columns are not read.
    """
    least_depth(threshold)
    text, signed = _read(docs), signatures(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row")).alias("f")
    classes = signed.groupBy("digest").agg(first, F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("labels").alias("labels"))
    classes = keep(classes.select("digest", "n_copies", "size", "labels", F.col("f.doc_id").alias("copy_id"), F.col("f.text_hash").alias("first_hash"), F.col("f.none").alias("none")), "classes")

    tied = components(forest_ties(classes, threshold))

    size = F.count("*")
    own_block = F.least(F.greatest(size / F.lit(16.0), F.lit(float(BLOCK))), F.lit(float(BLOCK_MOST)))
    blocks = tied.groupBy("root").agg(F.ceil(size / own_block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = tied.join(blocks, "root").select(F.col("node").alias("digest"), "root", own.alias("own"), "blocks")
    members = members.join(classes.select("digest", "copy_id", "first_hash"), "digest")
    wanted = members.select("digest", "root", "own", "blocks", F.col("copy_id").alias("id"), F.col("first_hash").alias("hash"))
    read = text.join(wanted, text["doc_id"].eqNullSafe(wanted["id"]) & text["text_hash"].eqNullSafe(wanted["hash"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(0), SLICE // 2):
                row, h = shingles(buf, off)
                at = np.searchsorted(row, np.arange(b - a + 1))
                data = [h[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *(batch.column(i).slice(a, b - a) for i in range(1, 5))], ["grams", "digest", "root", "own", "blocks"])

    grams = read.select("text", "digest", "root", "own", "blocks").mapInArrow(sets, "grams binary, digest binary, root binary, own int, blocks int")
    # Each pair of blocks of a component is a group of its own.
    spread = grams.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "digest", "grams")

    def verify(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        for i, d in enumerate(table["digest"].to_pylist()):
            seen.setdefault(d, i)  # repeated rows bring their set again
        digest, at = list(seen), list(seen.values())
        links, root = link(
            [np.frombuffer(table["grams"][i].as_buffer(), np.uint64) for i in at], np.array([table["own"][i].as_py() for i in at]),
            table["low"][0].as_py() != table["high"][0].as_py(), threshold,
        )
        hit = np.flatnonzero(links).tolist()
        return pa.table({"digest": pa.array([digest[i] for i in hit], pa.binary()), "links": pa.array(links[hit], pa.int64()), "root": pa.array([digest[root[i]] for i in hit], pa.binary())})

    linked = keep(spread.groupBy("root", "low", "high").applyInArrow(verify, "digest binary, links long, root binary"), "links")
    final = components(linked.select(F.col("digest").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "digest"})
    counts = linked.groupBy("digest").agg(F.sum("links").alias("n_links"))
    known = classes.select("digest", "copy_id", "none", "n_copies", "size").join(final, "digest", "left").join(counts, "digest", "left")
    known = known.withColumn("root", F.coalesce("root", "digest"))
    heads = known.groupBy("root").agg(F.min(F.struct("none", "copy_id")).alias("h")).select("root", F.col("h.copy_id").alias("class_id"))
    known = known.join(heads, "root").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copy_id", "n_copies", F.col("size").alias("n_shingles"), F.col("root").alias("class_key"))
    return signed.select("doc_id", "text_hash", "row", "digest").join(known, "digest").select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "n_shingles", "text_hash", "row", "class_key")


def link(sets: list[np.ndarray], own: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, and the least set it is tied to; ``across``: only between sets of different blocks."""
    n, size = len(sets), np.array([len(s) for s in sets], np.float64)
    common = np.zeros((n, n), np.float32)
    kinds, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]  # n-grams of one set join nothing
    row = np.repeat(np.arange(n), size.astype(np.int64))
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        common += part @ part.T
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(near, False)
    if across:
        near &= own[:, None] != own[None, :]
    root = np.arange(n)
    while True:
        low = np.where(near, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id."""
    made = keep(near_duplicates(docs), "near")
    first = made.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f"))
    first = first.select("class_key", F.col("f.row").alias("first_row"))
    decided = made.join(first, "class_key").select("doc_id", F.coalesce("text_hash", F.lit(0)).alias("mark"), (F.col("row") == F.col("first_row")).alias("kept"))
    return drop_rows(docs, decided, lambda text: F.coalesce(F.xxhash64(text), F.lit(0)))
