"""I-Match fingerprints over randomised lexicon subsets.

A term is a run of ASCII letters and digits and of non-ASCII bytes, ASCII letters in lower case. The lexicon holds the
terms found in at least LOW and at most HIGH of all documents, so its size is bounded by the mean number of distinct
terms of a document over LOW, whatever the corpus: that is what makes it small enough to send to the workers. A
document's distinct lexicon terms are sorted, and those in each random subset of the lexicon are hashed. The same is
done with all its terms: short texts and texts of a rare language or subject have few or none in the lexicon.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.llm.scratch import with_order
from tonespark.llm.wordids import word_digests
from tonespark.llm.words import LOWER, cut, mix, row_of, row_sums, slices, spans

LOW, HIGH = 1 / 1000, 1 / 8
#: Subsets: each family draws its own, and keeps a term with probability 2 ** -level. All terms (level 0) are one more.
FAMILIES, LEVELS = 8, range(1, 11)
WIDTH = FAMILIES * len(LEVELS)
#: Texts are judged by lexicon terms alone if they have so many and these are such a share of their terms.
ENOUGH, SHARE = 8, 1 / 4
BUCKET_TERMS = 2_000_000
#: More terms than this are not sent to the workers, but an error: LOW has to be raised for texts of so many terms.
MOST_TERMS = 4_000_000
#: Rows are sorted in ranges of doc_id, of about so many bytes; they are streamed, so a larger one is only slower.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16
#: Bytes of texts that are unpacked and edited at once.
EDIT_BYTES = 4 << 20
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of each term's BLAKE2 digest, for which no two terms can be made to meet at will."""
    digest, which = word_digests(buf, starts, ends)
    return digest[which, 0]


def distinct_terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct terms of each row, sorted by row and hash."""
    starts, ends, at = spans(buf, off, NOT_TERM)
    row, h = row_of(at), hashes(LOWER[buf], starts, ends)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band of document frequency, counted over all rows of ``docs`` (text).

    A term of the lexicon is in two documents at least. Terms are counted within each batch before the shuffle.
    """
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, (size or 0) // 12 // BUCKET_TERMS)
    least, most = max(2, low * total), max(2, high * total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [distinct_terms(buf, off)[1] for _, _, buf, off in slices(batch.column(0))]
            keys, counts = np.unique(np.concatenate(terms or [np.zeros(0, np.uint64)]), return_counts=True)
            rows = [(b, keys[s].tobytes(), np.minimum(counts[s], 255).astype(np.uint8).tobytes(), counts[s][counts[s] > 254].astype(np.int64).tobytes()) for b, s in cut(keys, n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "keys", "counts", "large"])

    def total_up(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]])
        counts = []
        for few, large in zip(table["counts"], table["large"], strict=True):
            c = np.frombuffer(few.as_buffer(), np.uint8).astype(np.int64)
            c[c == 255] = np.frombuffer(large.as_buffer(), np.int64)
            counts.append(c)
        order = np.argsort(keys)
        keys, counts = keys[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        df = np.add.reduceat(counts, first)
        good = keys[first][(df >= least) & (df <= most)]
        return pa.table({"terms": pa.array([good.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "bucket long, keys binary, counts binary, large binary")
    found, terms = parts.groupBy("bucket").applyInArrow(total_up, "terms binary"), [np.zeros(0, np.uint64)]
    for r in found.toLocalIterator():
        terms.append(np.frombuffer(r.terms, np.uint64))
        if sum(map(len, terms)) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms are in at least {low} of all documents: raise that share")
    return np.sort(np.concatenate(terms))


def size_codes(size: np.ndarray) -> np.ndarray:
    """Sizes in steps of an eighth of a power of two, from 1; 0 for 0."""
    return np.where(size > 0, 1 + np.round(8 * np.log2(np.maximum(size, 1))), 0).astype(np.uint8)


def coded_sizes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 2 ** ((codes.astype(float) - 1) / 8), 0)


def subsets(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of each row's terms, sorted by row and hash: hash (32 bits) and size (as ``size_codes``) of each random subset, and
    hash (64 bits) and number of all."""
    out, sizes = np.zeros((n, WIDTH), np.uint32), np.zeros((n, WIDTH), np.uint8)
    whole = row_sums(mix(h), np.searchsorted(row, np.arange(n + 1)))
    for f in range(FAMILIES):
        draw = mix(h ^ np.uint64(0x5851F42D4C957F2D * (f + 1) % (1 << 64)))
        own_row, own_h = row, h
        for k, level in enumerate(LEVELS):
            keep = draw < np.uint64(1 << (64 - level))
            draw, own_row, own_h = draw[keep], own_row[keep], own_h[keep]
            if not len(own_h):
                break
            first = np.flatnonzero(np.diff(own_row, prepend=-1))
            size = np.diff(first, append=len(own_row))
            place = np.arange(len(own_row)) - np.repeat(first, size)
            sums = np.add.reduceat(mix(own_h + place.astype(np.uint64)), first)
            out[own_row[first], f * len(LEVELS) + k] = sums >> np.uint64(32)
            sizes[own_row[first], f * len(LEVELS) + k] = size_codes(size)
    return out, sizes, whole, np.bincount(row, minlength=n).astype(np.uint32)


def fingerprints(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``subsets`` gives, by text and source: 0 for its lexicon terms, 1 for all its terms."""
    parts = []
    for a, b, buf, off in slices(texts):
        row, h = distinct_terms(buf, off)
        known = terms[np.minimum(np.searchsorted(terms, h), len(terms) - 1)] == h if len(terms) else np.zeros(len(h), bool)
        both = zip(subsets(row[known], h[known], b - a), subsets(row, h, b - a), strict=True)
        parts.append([np.stack(x, axis=1) for x in both])
    none = [np.zeros((0, 2, WIDTH), np.uint32), np.zeros((0, 2, WIDTH), np.uint8), np.zeros((0, 2), np.uint64), np.zeros((0, 2), np.uint32)]
    return tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Share of subsets with equal hashes, of those with terms in either; small subsets weigh more: the reciprocal of
    their larger size. All terms are a subset too, so texts of different terms are never wholly alike; texts without
    any term are. Lexicon terms are compared where both texts have enough of them, else all terms."""
    enough = [(x[3][:, 0] >= ENOUGH) & (x[3][:, 0] >= SHARE * x[3][:, 1]) for x in (a, b)]
    i, source = np.arange(len(a[0])), np.where(enough[0] & enough[1], 0, 1)
    (hash_a, size_a, whole_a, n_a), (hash_b, size_b, whole_b, n_b) = ([y[i, source] for y in x] for x in (a, b))
    size = np.concatenate([coded_sizes(np.maximum(size_a, size_b)), np.maximum(n_a, n_b)[:, None]], axis=1)
    same = np.concatenate([(hash_a == hash_b) & (size_a == size_b), ((whole_a == whole_b) & (n_a == n_b))[:, None]], axis=1)
    weight = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    total = weight.sum(axis=1)
    return np.divide((weight * same).sum(axis=1), total, out=np.ones(len(total)), where=total > 0)


def as_text(f: tuple[np.ndarray, ...]) -> list[str]:
    """By source, lexicon terms first: number (8 hex digits) and hash (16) of all terms, then size (2) and hash (8) of
    each subset."""
    n = len(f[0])
    each = np.concatenate([f[1][..., None], f[0].astype(">u4").view(np.uint8).reshape(*f[0].shape, 4)], axis=3).reshape(n, 2, 5 * WIDTH)
    both = np.concatenate([f[3].astype(">u4").view(np.uint8).reshape(n, 2, 4), f[2].astype(">u8").view(np.uint8).reshape(n, 2, 8), each], axis=2)
    return [row.tobytes().hex() for row in both]


OUT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), of its edited text and their likeness: a row per row.

    The edited text has the last third of the code points replaced by as many first ones of the next document's text, in
    descending doc_id of any type that has an order (null last; equal ids in a fixed order of their texts). Null texts count as empty. An empty table
    gives no rows; other columns are not read. Rows move once, to ranges of doc_id; the first row of each range also
    goes to the range before it.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    terms = spark.sparkContext.broadcast(lexicon(docs))
    rows = with_order(docs.select("doc_id", "text")).select("doc_id", "text", F.coalesce("key", F.lit(-(1 << 63))).alias("key"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    moved = "range long, own int, key long, doc_id {}, packed binary".format(kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(2).to_numpy()
            packer = zstandard.ZstdCompressor(level=1)
            packed = [packer.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key, "right").astype(np.int64)), pa.array(np.ones(len(key), np.int32)), batch.column(2), batch.column(0), pa.array(packed, pa.binary())], ["range", "own", "key", "doc_id", "packed"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, top = np.unique(np.searchsorted(bounds, batch.column(0).to_numpy(), "right"), return_inverse=True)
            best = np.full(len(r), -(1 << 63), np.int64)
            np.maximum.at(best, top, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(best)], ["range", "first"])

    firsts = sorted(rows.select("key").mapInArrow(ranges, "range long, first long").groupBy("range").agg(F.max("first").alias("first")).collect())
    heads = [(firsts[i - 1].first, firsts[i].range) for i in range(len(firsts))]  # the next of the lowest range is the highest id
    to = spark.createDataFrame(heads, "head long, range long")
    own = rows.mapInArrow(place, moved)
    packed = rows.join(F.broadcast(to), rows["key"] == to["head"]).select("doc_id", "text", "key", "range")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packer = zstandard.ZstdCompressor(level=1)
            data = [packer.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(2), batch.column(0), pa.array(data, pa.binary())], ["range", "own", "key", "doc_id", "packed"])

    both = own.unionByName(packed.mapInArrow(head, moved)).repartition("range").sortWithinPartitions("range", F.desc("own"), F.desc("key"), "packed")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), []
        for batch in batches:
            for a, b in _few(batch.column(4)):
                part = batch.slice(a, b - a)
                new = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), (unpack.decompress(x.as_buffer()).decode() for x in part.column(4)), strict=True)
                held += new
                if out := _edited(held, terms.value, part.schema.field(3).type):
                    yield out
                held = [held[-1]] if held[-1][1] else []

    return both.mapInArrow(edit, OUT.format(id=kind))


def _few(packed: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) whose texts unpack to about EDIT_BYTES, one row at least."""
    size = np.cumsum([max(0, zstandard.frame_content_size(x.as_buffer())) for x in packed] or [0])
    a = 0
    while a < len(packed):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + EDIT_BYTES, "right")))
        yield a, b
        a = b


def _edited(rows: list[tuple], terms: np.ndarray, kind: pa.DataType) -> pa.RecordBatch | None:
    """Rows that another follows in their range, with what OUT lists."""
    now = [i for i in range(len(rows) - 1) if rows[i][1] and rows[i][0] == rows[i + 1][0]]
    if not now:
        return None
    texts = [r[3] for r in rows]
    edited = []
    for i in now:
        k = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
    plain = fingerprints(pa.array(texts, pa.large_string()), terms)
    changed = fingerprints(pa.array(edited, pa.large_string()), terms)
    here, there = np.array(now), np.array(now) + 1
    mine, after = tuple(x[here] for x in plain), tuple(x[there] for x in plain)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in now], kind), pa.array([len(texts[i]) for i in now], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(as_text(mine)), pa.array(as_text(changed)),
            pa.array(likeness(mine, changed)), pa.array(likeness(mine, after)),
        ],
        [c.split()[0] for c in OUT.split(", ")],
    )
