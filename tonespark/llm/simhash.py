"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked at few differing bits through BK-trees.

Fingerprints are linked once each, however many documents share them. Those that differ in up to RADIUS of their 64 bits
agree in at least BLOCKS - RADIUS of BLOCKS blocks of bits, so each fingerprint goes to one shard for every such choice
of blocks, named by the choice and the bits in it. A shard of one fingerprint has no partner. Others become BK-trees, in
which a node's children are keyed by their Hamming distance to it; a shard of more than TREE fingerprints is dealt into
several trees. Trees go to all fingerprints of their shard (broadcast, if all trees together are small; else joined by
shard), which follow only edges within RADIUS of their own distance to a node. Batches of trees are built and searched
level by level, all at once.

What a batch finds is passed on as ties of its connected fingerprints, never as all pairs, so it grows with the
fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonespark.llm.components import components
from tonespark.llm.scratch import keep
from tonespark.llm.words import LOWER, SPACE, slices, spans

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 5
#: Fingerprints of a tree.
TREE = 1024
#: Nodes of all trees together up to which they are broadcast (16 bytes each).
SENT_NODES = 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17
#: Pairs of a fingerprint and a node that are looked at at once.
FRONT = 1 << 18


def masks() -> list[int]:
    """The bits of each choice of blocks, as signed integers."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    whole = [sum(c) for c in combinations(bits, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words one after the other, each followed by one space, with their new starts and ends."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
    out = buf[np.minimum(at, len(buf) - 1)]
    out[to[1:] - 1] = 32
    return out, to[:-1], to[1:] - 1


def _bit_counts(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the hashes ``h[first[i] : first[i] + n[i]]`` (rows one after the other, none empty) have each bit."""
    out = np.zeros((len(first), 64), np.int64)
    row = np.repeat(np.arange(len(first)), n)
    for a in range(0, len(h), CHUNK):
        part = np.unpackbits(h[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[a : a + CHUNK]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[begin]] += np.add.reduceat(part, begin, axis=0, dtype=np.int32)
    return out


def fingerprints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    found = []
    for _, _, buf, off in slices(column):
        starts, ends, at = spans(buf, off, SPACE)
        words = np.diff(at)
        out = np.zeros(len(words), np.uint64)
        if len(starts):
            raw, starts, ends = _joined(LOWER[buf], starts, ends)
            n = np.where(words, np.maximum(words - SHINGLE + 1, 1), 0)
            to = np.concatenate([[0], np.cumsum(n)])
            first = np.repeat(at[:-1] - to[:-1], n) + np.arange(to[-1])
            last = first + np.minimum(np.repeat(words, n), SHINGLE) - 1
            data, digest, h = raw.tobytes(), xxhash.xxh64_intdigest, np.empty(len(first), np.uint64)
            for a in range(0, len(h), CHUNK):
                b = slice(a, a + CHUNK)
                h[b] = [digest(data[s:e], SEED) for s, e in zip(starts[first[b]].tolist(), ends[last[b]].tolist(), strict=True)]
            full = np.flatnonzero(n)
            counts = _bit_counts(h, to[full], n[full])
            bits = (2 * counts > n[full, None]).astype(np.uint8)
            out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        found.append(out)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (a signed 64-bit integer) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)  # of signed values it would count those of the magnitude


def build(prints: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of distinct fingerprints, each of the tree of its number (0 to n - 1, ascending, none empty).

    Nodes in order of tree, level, parent and distance to it; for each its fingerprint and its key, 128 times the parent's
    place plus the distance (for a root 128 times its own), so that keys ascend.
    """
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    nodes, keys, trees = [prints[roots]], [np.arange(len(roots)) * 128], [tree[roots]]
    rest = np.ones(len(prints), bool)
    rest[roots] = False
    left, parent, made, flat = np.flatnonzero(rest), tree[rest], len(roots), nodes[0]
    while len(left):
        key = parent * 128 + distance(prints[left], flat[parent])
        children, first, which = np.unique(key, return_index=True, return_inverse=True)
        nodes.append(prints[left[first]])
        keys.append(children)
        trees.append(tree[left[first]])
        flat = np.concatenate(nodes)
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, parent, made = left[rest], made + which[rest], made + len(children)
    keys, order = np.concatenate(keys), np.argsort(np.concatenate(trees), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return flat[order], (place[keys // 128] * 128 + keys % 128)[order]


def search(nodes: np.ndarray, keys: np.ndarray, asked: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of an asked fingerprint and a node within ``radius``, by their places, below the node ``root`` of each; and
    how many nodes were looked at."""
    found, seen = [], 0
    waiting = [(np.arange(a, min(a + FRONT, len(asked))), root[a : a + FRONT]) for a in range(0, len(asked), FRONT)]
    while waiting:
        q, node = waiting.pop()
        seen += len(q)
        d = distance(asked[q], nodes[node])
        hit = d <= radius
        found.append((q[hit], node[hit]))
        low = np.searchsorted(keys, node * 128 + np.maximum(d - radius, 1))  # not a root, whose distance is 0
        n = np.searchsorted(keys, node * 128 + d + radius, "right") - low
        for a in range(0, len(q), FRONT // 4):
            b = slice(a, a + FRONT // 4)
            if total := int(n[b].sum()):
                to = np.cumsum(n[b]) - n[b]
                waiting.append((np.repeat(q[b], n[b]), np.repeat(low[b] - to, n[b]) + np.arange(total)))
    q, node = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return q, node, seen


def ties(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of the pairs but the least of its component, with that least one."""
    values, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = which[: len(a)], which[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(values)))
    return values[rest], values[label[rest]]


def _list(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, pa.int64()))


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of which ``column`` has up to about 2^17 values."""
    for batch in batches:
        size = np.cumsum(batch.column(batch.schema.get_field_index(column)).value_lengths().to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (1 << 17), "right")))
            yield batch.slice(a, b - a)
            a = b


def grow_trees(shards: DataFrame) -> DataFrame:
    """``shards`` (choice, bits, tree, prints) with the ``nodes`` and ``keys`` of a BK-tree for ``prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, "prints"):
            column = batch.column(3)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            nodes, keys = build(column.flatten().to_numpy(), np.repeat(np.arange(len(size)), size))
            own = keys - np.repeat(np.cumsum(size) - size, size) * 128  # by place within the tree
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _list(nodes, size), _list(own, size)], ["choice", "bits", "tree", "nodes", "keys"])

    return shards.select("choice", "bits", "tree", "prints").mapInArrow(run, "choice int, bits bigint, tree int, nodes array<bigint>, keys array<bigint>")


def _links(asked: DataFrame) -> DataFrame:
    """``u, v``: ties of the fingerprints in ``prints`` and the trees (``nodes, keys``) that each row has."""
    all_masks = np.array(masks(), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, "prints"):
            prints, nodes, keys = (batch.column(k) for k in range(3))
            size, many = (c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in (prints, nodes))
            flat, own = nodes.flatten().to_numpy(), keys.flatten().to_numpy()
            begin = np.cumsum(many) - many
            q = prints.flatten().to_numpy()
            a, b, _ = search(flat, own + np.repeat(begin, many) * 128, q, np.repeat(begin, size))
            x, y = q[a], flat[b]
            x, y = x[x != y], y[x != y]
            first = ((x ^ y)[:, None] & all_masks == 0).argmax(axis=1)  # a pair counts in the first shard that it shares
            here = first == batch.column(3).to_numpy()[np.searchsorted(np.cumsum(size), a[q[a] != flat[b]], "right")]
            u, v = ties(x[here], y[here])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return asked.select("prints", "nodes", "keys", "choice").mapInArrow(run, "u bigint, v bigint")


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: ties that connect the fingerprints ``print`` (distinct) which differ in up to RADIUS bits, and no others."""
    choices = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(masks())])).alias("c")
    spread = prints.select("print", choices).select("c.choice", "c.bits", "print")
    shared = keep(spread.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").select(F.col("choice").alias("of"), F.col("bits").alias("at"), "n"), "shards")
    number = F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / TREE)).cast("int")
    member = spread.join(shared, (F.col("choice") == F.col("of")) & (F.col("bits") == F.col("at"))).select("choice", "bits", "n", number.alias("tree"), "print")
    # Dealt by tree too: else the join's dealing by shard would do, and one task would gather a whole shard.
    shards = keep(member.repartition("choice", "bits", "tree").groupBy("choice", "bits", "n", "tree").agg(F.collect_list("print").alias("prints")), "members")
    trees = keep(grow_trees(shards), "trees")
    nodes = trees.agg(F.sum(F.size("nodes"))).first()[0] or 0
    # A tree is asked by its own members and those of the trees before it in its shard.
    last = F.ceil(F.col("n") / TREE).cast("int") - 1
    asking = shards.select(F.col("choice").alias("of"), F.col("bits").alias("at"), "prints", F.explode(F.sequence("tree", last)).alias("asks"))
    same = (F.col("choice") == F.col("of")) & (F.col("bits") == F.col("at")) & (F.col("tree") == F.col("asks"))
    return _links(asking.join(F.broadcast(trees) if nodes <= SENT_NODES else trees, same))


def hex_print(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Texts are taken
    whole, of any length. Repeated rows give a row each. ``component_id`` is the smallest doc_id that links reach, of
    whatever type doc_id is; null ids are reached but never the smallest (null only where no other is reached). An empty
    table gives no rows; other columns are not read.
    """
    made = keep(with_fingerprints(docs), "fingerprints")
    prints = keep(made.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(prints.select("print")))
    tied = keep(found.join(prints, F.col("node") == F.col("print")).select("node", "root", "least"), "tied")
    roots = keep(tied.groupBy("root").agg(F.min("least").alias("component")).select(F.col("root").alias("top"), "component"), "roots")
    named = keep(tied.join(roots, F.col("root") == F.col("top")).select("node", "component"), "named")
    labels = keep(prints.join(named, F.col("print") == F.col("node"), "left").select(F.col("print").alias("own"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id")), "labels")
    return made.join(labels, F.col("print") == F.col("own")).select("doc_id", hex_print(F.col("print")).alias("fingerprint"), "component_id")
