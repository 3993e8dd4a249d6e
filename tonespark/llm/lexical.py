"""Ranked lexical search: shards of documents as CSR postings with integer impacts, scored a term at a time.

An index is a table of shards. A shard holds about SHARD bytes of text: its distinct terms, for each of them the postings
(places of documents in the shard, ascending, and impacts), and the ids of its documents. An impact is the integer part
of a score that depends on the document alone, given the numbers of documents and of terms of all; the term's weight is
multiplied in when a query is scored, so that an index is built by one pass without a shuffle of terms.

A search asks all shards: queries travel with the tasks (in blocks of bounded size, each of which reads the index). For
each query a shard's dense accumulator takes the postings of one term after the other; the best are picked by partition,
with all that tie with the last, and ordered. A task merges the shards it reads, and what tasks found is merged in two
steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespark.llm.scratch import keep
from tonespark.llm.words import LOWER, release, slices, spans, word_ids

#: What ends a term is any ASCII character but letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = False
TOP = 10
#: Bytes of text of a shard.
SHARD = 8 << 20
#: Bytes of the queries of a block.
QUERY_BYTES = 8 << 20
#: Parts into which what tasks found for a query is merged first.
PARTS = 16


@dataclass
class Index:
    """``shards``: docs array, terms and places binary, see ``build``; ``documents`` with a term and ``terms`` of all."""

    shards: DataFrame
    documents: int
    terms: int


def _counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = total = 0
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                n = np.diff(spans(buf, off, BETWEEN)[2])
                full, total = full + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([total])], ["n", "l"])

    r = docs.select("text").mapInArrow(run, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return r[0] or 0, r[1] or 0


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's m from its number of terms."""
    if int(n.max(initial=0)) * documents * 75 < 1 << 63:
        return 100 - 75 + (75 * documents * n) // max(1, terms)
    return np.array([100 - 75 + (75 * k * documents) // terms for k in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _shard(buf: np.ndarray, off: np.ndarray, documents: int, terms: int) -> tuple[dict[str, bytes], np.ndarray]:
    """The CSR arrays of the documents of a slice that have terms, and which rows these are.

    Terms stand one after the other, each ended by a space, in the order of their postings.
    """
    starts, ends, at = spans(buf, off, BETWEEN)
    n = np.diff(at)
    rows = np.flatnonzero(n)
    if not len(rows):
        return {}, rows
    lowered = LOWER[buf]
    first, which = word_ids(lowered, starts, ends)
    doc = np.repeat(np.arange(len(rows)), n[rows])
    pairs, tf = np.unique(which * len(rows) + doc, return_counts=True)
    term, place = pairs // len(rows), pairs % len(rows)
    m = lengths(n[rows].astype(np.int64), documents, terms)
    raw = lowered.tobytes()
    said = b"".join(raw[s:e] + b" " for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True))
    begin = np.searchsorted(term, np.arange(len(first) + 1))
    gaps = place.copy()  # from the posting before, small numbers pack well
    gaps[1:] -= place[:-1]
    heads = begin[:-1]
    gaps[heads] = place[heads]
    return {"terms": said, "sizes": np.diff(begin).astype("<i4").tobytes(), "gaps": gaps.astype("<i4").tobytes(), "impacts": impacts(tf.astype(np.int64), m[place]).astype("<i4").tobytes()}, rows


PLANES = ("terms", "sizes", "gaps", "impacts")


def _planes(data: bytes) -> bytes:
    """Bytes of equal weight together, for compression."""
    return np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def build(docs: DataFrame, shard: int = SHARD) -> Index:
    """The index of all rows of ``docs`` (doc_id, text), written to the shared folder.

    Null texts and texts without terms are in no shard. doc_ids may be of any type that has an order; repeated ones are
    documents of their own.
    """
    documents, terms = _counts(docs)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def give() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            for a, b, buf, off in slices(table["text"], shard):
                made, rows = _shard(buf, off, documents, terms)
                if made:
                    ids = table["doc_id"].slice(a, b - a).take(pa.array(rows)).combine_chunks()
                    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([own, *(pa.array([made[c] if c == "terms" else _planes(made[c])], pa.binary()) for c in PLANES)], ["docs", *PLANES])

        for batch in batches:
            waiting.append(batch)
            size += batch.column(1).nbytes
            if size >= shard:
                yield from give()
                waiting, size = [], 0
        if waiting:
            yield from give()
        release()

    made = T.StructType([T.StructField("docs", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in PLANES)])
    return Index(keep(docs.select("doc_id", "text").mapInArrow(run, made), "postings"), documents, terms)


def terms_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), BETWEEN)
    raw = LOWER[data].tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Postings:
    """A shard as arrays, of the terms in ``number`` alone."""

    def __init__(self, row: dict, number: dict[bytes, int]):
        said = row["terms"].split(b" ")[:-1]
        at = [(number[t], k) for k, t in enumerate(said) if t in number]
        sizes = _unplaned(row["sizes"])
        ends = np.cumsum(sizes)
        self.span = {i: (int(ends[k] - sizes[k]), int(ends[k])) for i, k in at}
        self.gaps, self.impacts = _unplaned(row["gaps"]), _unplaned(row["impacts"])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Places of the documents that hold a term, and impacts."""
        if (span := self.span.get(term)) is None:
            return None
        return np.cumsum(self.gaps[slice(*span)]), self.impacts[slice(*span)]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(batch.schema.get_field_index(c))[i].as_py() if c != "docs" else batch.column(batch.schema.get_field_index(c))[i].values for c in columns}


def document_frequencies(index: Index, number: dict[bytes, int]) -> np.ndarray:
    """How many documents hold each of the numbered terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for row in _rows(batches, "terms", "sizes"):
            sizes = _unplaned(row["sizes"])
            for k, t in enumerate(row["terms"].split(b" ")[:-1]):
                if (i := number.get(t)) is not None:
                    total[i] += sizes[k]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["term", "n"])

    out = np.zeros(len(number), np.int64)
    found = index.shards.select("terms", "sizes").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row for each term of the queries at most
        out[r.term] = r.n
    return out


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores over 0, equal ones by their rank in ``ids``."""
    over = np.flatnonzero(scores > 0)
    if len(over) > most:
        last = np.partition(scores[over], len(over) - most)[len(over) - most]
        over = over[scores[over] >= last]  # with all that tie with the last
    return over[np.lexsort((ids[over], -scores[over]))][:most]


def _ask(index: Index, queries: list[Row], most: int) -> DataFrame:
    """``query, doc_id, score``: the best documents of each task for each of ``queries`` (query, text)."""
    asked = [(r.query, Counter(terms_of(r.text))) for r in queries]
    number = {t: i for i, t in enumerate(sorted({t for _, c in asked for t in c}))}
    holding = document_frequencies(index, number)
    weights = [weight(index.documents, int(h)) if h else 0 for h in holding]
    wanted = [(q, [(number[t], k * weights[number[t]]) for t, k in c.items() if weights[number[t]]]) for q, c in asked]
    kind = index.shards.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for row in _rows(batches, "docs", *PLANES):
            ids, postings = row["docs"], Postings(row, number)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            known: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
            scores = np.zeros(len(ids), np.int64)
            for k, (_, terms) in enumerate(wanted):
                scores[:] = 0
                for t, w in terms:
                    if t not in known:
                        known[t] = postings.of(t)
                    if (p := known[t]) is not None:
                        scores[p[0]] += w * p[1]
                top = best(scores, rank, most)
                if len(top):
                    own, who = scores[top], ids.take(pa.array(top))
                    if k in held:
                        own, who = np.concatenate([held[k][0], own]), pa.concat_arrays([held[k][1], who])
                        order = np.empty(len(own), np.int64)
                        order[pc.sort_indices(who, null_placement="at_end").to_numpy()] = np.arange(len(own))
                        both = best(own, order, most)
                        own, who = own[both], who.take(pa.array(both))
                    held[k] = own, who
            release()
        for k, (own, who) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([wanted[k][0]] * len(own), pa.int64()), who, pa.array(own)], ["query", "doc_id", "score"])

    made = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    return index.shards.mapInArrow(run, made)


def _place(keys: list[str], most: int) -> F.Column:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def search(index: Index, queries: DataFrame, most: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``most`` best documents of each row of ``queries`` (item_id, text): item_id, rank, doc_id, score.

    Equal scores are ranked by doc_id, null last; of repeated doc_ids each counts. A row whose text is null or has no
    term that a document holds gives no rows, and rows that share an item_id each have their own. Queries are held by
    the driver and by tasks in blocks of about ``query_bytes``, each of which reads the index again; a text of more is a
    block of its own.
    """
    numbered = keep(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").alias("text")), "queries")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // query_bytes)
    found = None
    for k in range(max(1, blocks)):
        rows = numbered.select("query", "text").where(F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))) == k).collect()
        own = _ask(index, rows, most)
        found = own if found is None else found.unionByName(own)
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    part = part.withColumn("rank", _place(["query", "part"], most)).where(F.col("rank") <= most).drop("rank", "part")
    last = part.withColumn("rank", _place(["query"], most)).where(F.col("rank") <= most)
    return last.join(numbered.select(F.col("query").alias("of"), "item_id"), F.col("query") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, most: int = TOP) -> DataFrame:
    """``search`` of an index of all ``docs`` (doc_id, text). Nulls and texts of any length are defined there and in
    ``build``; empty tables give no rows; other columns are not read."""
    return search(build(docs), queries, most)
