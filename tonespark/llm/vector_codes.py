"""Vector code compression: product codes whose codebooks are fitted by Lloyd rounds with Hamerly's bounds.

A vector is cut into PARTS equal parts; each part position has a codebook of up to ENTRIES entries. All vectors are
assigned in every round. A round persists, for each part, its entry, one upper bound of the distance to it and one lower
bound of the distance to the second-nearest entry. In the next round the bounds are moved by how far the entries went;
where the upper one stays strictly below the lower one (or below half the way to the entry's nearest neighbour), the
entry is kept without a look at the others. Otherwise the part is compared with all entries in exact integers, of equal
distances the lower index. Bounds are rounded away from each other, so a kept entry is the one a full scan would find.

Codebooks (PARTS * ENTRIES entries, a bounded size) travel with the tasks; sums of entries are taken by task before they
are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonespark.llm.scratch import discard, keep

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
#: Vectors that are compared at once.
ROWS = 2048


@dataclass
class Codebooks:
    """``entries``: integers by part position, entry and place within the part."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def most(size: int) -> int:
    """The largest component of vectors of ``size`` components whose squared distances fit 64 bits."""
    return math.isqrt((1 << 60) // max(1, size))


def kept_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the vectors of ``rows`` (vec_id, embedding, label) that are finite as a whole, as integers."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, parts x rows x entries, of ``x`` (parts x rows x places)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[2] * (2 * top) ** 2 < 1 << 53:  # integers that doubles hold
        a, b = x.astype(float), entries.astype(float)
        d = (a * a).sum(axis=2)[:, :, None] + (b * b).sum(axis=2)[:, None] - 2 * (a @ b.transpose(0, 2, 1))
        return d.astype(np.int64)
    d = np.zeros((x.shape[0], x.shape[1], entries.shape[1]), np.int64)
    for k in range(x.shape[2]):
        d += (x[:, :, k, None] - entries[:, None, :, k]) ** 2
    return d


def _above(d: np.ndarray) -> np.ndarray:
    """Single-precision roots that are no smaller than those of the integers ``d``."""
    return np.nextafter(np.nextafter(np.sqrt(d.astype(float)), np.inf).astype(np.float32), np.float32(np.inf))


def _below(d: np.ndarray) -> np.ndarray:
    """The same, no larger."""
    root = np.nextafter(np.sqrt(d.astype(float)), -np.inf).astype(np.float32)
    return np.maximum(np.nextafter(root, np.float32(-np.inf)), np.float32(0))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part of ``x`` (parts x rows x places), and both bounds."""
    d = squared(x, entries)
    at = d.argmin(axis=2)  # the first of equal ones
    upper = _above(np.take_along_axis(d, at[:, :, None], 2)[:, :, 0])
    if entries.shape[1] < 2:
        return at, upper, np.full(at.shape, np.inf, np.float32)
    np.put_along_axis(d, at[:, :, None], np.iinfo(np.int64).max, 2)
    return at, upper, _below(d.min(axis=2))


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry went at most, and for each entry how far any other did (parts x entries)."""
    far = _above(((new - old) ** 2).sum(axis=2))
    far[(new == old).all(axis=2)] = 0
    others = np.zeros_like(far)
    if far.shape[1] > 1:
        two = np.sort(far, axis=1)[:, -2:]
        others = np.where(far == two[:, 1:], two[:, :1], two[:, 1:])
    return far, others


def half_ways(entries: np.ndarray) -> np.ndarray:
    """At most half the distance from each entry to its nearest other one."""
    if entries.shape[1] < 2:
        return np.full(entries.shape[:2], np.inf, np.float32)
    d = squared(entries, entries)
    d[:, np.arange(d.shape[1]), np.arange(d.shape[1])] = np.iinfo(np.int64).max
    return np.nextafter(_below(d.min(axis=2)) / np.float32(2), np.float32(-np.inf))


def assign(x: np.ndarray, entries: np.ndarray, state: tuple[np.ndarray, ...], gone: tuple[np.ndarray, ...], half: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """The state (entries and bounds) of the parts from that of the round before, and how many parts were scanned."""
    at, upper, lower = state
    far, others = gone
    part, inf = np.arange(len(x))[:, None], np.float32(np.inf)
    upper = np.nextafter(upper + far[part, at], inf)
    lower = np.maximum(np.nextafter(lower - others[part, at], -inf), np.float32(0))
    limit, at, n = np.maximum(lower, half[part, at]), at.copy(), 0
    for k in range(len(x)):
        rows = np.flatnonzero(upper[k] >= limit[k])
        if len(rows):  # the distance itself may do
            upper[k, rows] = _above(((x[k, rows] - entries[k, at[k, rows]]) ** 2).sum(axis=1))
            rows = rows[upper[k, rows] >= limit[k, rows]]
        if len(rows):
            found = scan(x[k : k + 1, rows], entries[k : k + 1])
            at[k, rows], upper[k, rows], lower[k, rows] = (f[0] for f in found)
            n += len(rows)
    return (at, upper, lower), n


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


STATE = "vec_id {id}, label {label}, v array<bigint>, at array<smallint>, upper array<float>, lower array<float>, error bigint, scanned int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def encode(rows: DataFrame, books: Codebooks, before: Codebooks | None = None, last: bool = False) -> DataFrame:
    """``rows`` (vec_id, label, v, and with ``before`` their state) with their state under ``books``; ``last``: with the
    exact error.

    Vectors of another length than the codebooks' have null for it.
    """
    entries = books.entries
    parts, _, places = entries.shape
    gone = moves(before.entries, entries) if before is not None else None
    half = half_ways(entries)
    bound = most(parts * places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            own = column["v"].value_lengths().to_numpy() == parts * places
            fit = np.flatnonzero(own)
            x = np.clip(_arrays(column["v"].take(pa.array(fit))).astype(np.int64), -bound, bound).reshape(len(fit), parts, places).transpose(1, 0, 2)
            if before is None:
                state, n = scan(x, entries), x.shape[0] * x.shape[1]
            else:
                old = [_arrays(column[c].take(pa.array(fit))).reshape(len(fit), parts).T for c in ("at", "upper", "lower")]
                state, n = assign(x, entries, (old[0].astype(np.int64), *old[1:]), gone, half)
            at, upper, lower = state
            error = ((x - entries[np.arange(parts)[:, None], at]) ** 2).sum(axis=(0, 2)) if last else np.zeros(len(fit), np.int64)
            scanned = np.zeros(len(fit), np.int64)
            scanned[:1] = n
            back = np.full(len(own), -1)
            back[fit] = np.arange(len(fit))
            take = pa.array(back, mask=~own)
            made = [_lists(at.T, pa.int16()), _lists(upper.T, pa.float32()), _lists(lower.T, pa.float32()), pa.array(error, pa.int64(), mask=np.full(len(fit), not last)), pa.array(scanned, pa.int32())]
            yield pa.RecordBatch.from_arrays([column["vec_id"], column["label"], column["v"], *(m.take(take) for m in made)], ["vec_id", "label", "v", "at", "upper", "lower", "error", "scanned"])

    kinds = {c: rows.schema[n].dataType.simpleString() for c, n in (("id", "vec_id"), ("label", "label"))}
    names = ["vec_id", "label", "v", *(("at", "upper", "lower") if before is not None else ())]
    return rows.select(*names).mapInArrow(run, STATE.format(**kinds))


def improve(state: DataFrame, books: Codebooks) -> Codebooks:
    """The componentwise floors of the means of each entry's parts; entries without parts stay."""
    parts, count, places = books.entries.shape
    bound = most(parts * places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * count, places), object), np.zeros(parts * count, np.int64)
        for batch in _blocks(batches):
            batch = batch.filter(batch.column(1).is_valid())
            at = _arrays(batch.column(1)).reshape(-1, parts).astype(np.int64) + np.arange(parts) * count
            x = np.clip(_arrays(batch.column(0)).astype(np.int64), -bound, bound).reshape(at.size, places)
            order = np.argsort(at.ravel(), kind="stable")
            keys, first = np.unique(at.ravel()[order], return_index=True)
            if len(keys):
                sums[keys] += np.add.reduceat(x[order], first, axis=0).astype(object)
                n[keys] += np.diff([*first, len(order)])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, places), pa.int32()), pa.array(np.tile(np.arange(places), len(used)), pa.int32()), pa.array([str(s) for s in sums[used].ravel()], pa.string()), pa.array(np.repeat(n[used], places), pa.int64())],
            ["slot", "place", "total", "n"],
        )

    each = state.select("v", "at").mapInArrow(run, "slot int, place int, total string, n bigint")
    total = each.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.entries.copy().reshape(parts * count, places)
    for r in total.collect():  # a row for each component of the codebooks
        new[r.slot, r.place] = int(r.total) // r.n
    return Codebooks(new.reshape(parts, count, places))


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the ``entries`` vectors of the smallest vec_ids (null last, equal ids by their components)."""
    rows = vectors.select("v", F.col("vec_id").isNull().alias("none"), "vec_id").orderBy("none", "vec_id", "v").limit(entries).collect()
    size = len(rows[0].v) if rows else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    own = [r.v for r in rows if len(r.v) == size]
    top = most(size)
    x = np.clip(np.array(own, np.int64).reshape(len(own), parts, size // parts), -top, top)
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)))


def fit_and_encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The coded state of every vector of ``rows`` (vec_id, embedding, label) and the codebooks after ``rounds`` rounds.

    All vectors take part in each round. The state of a round is written to the shared folder and the one before deleted.
    """
    vectors = kept_vectors(rows)
    books = first_books(vectors, parts, entries)
    if not books.entries.shape[1]:
        return encode(vectors.limit(0), Codebooks(np.zeros((parts, 1, 0), np.int64))), books
    state = keep(encode(vectors, books, last=not rounds), "codes")
    for k in range(rounds):
        new = improve(state, books)
        after = keep(encode(state, new, books, k == rounds - 1), "codes")
        discard(state)
        state, books = after, new
    return state, books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector of ``rows`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out; repeated rows give a row each. Components
    become floor(256 * x), clamped where squared distances would leave 64 bits (about 1.3e8 for 64 components). Vectors of
    another length than that of the smallest vec_id have a null code and error; that length has to be a multiple of
    ``parts``, else ValueError. Fewer vectors than ``entries`` make a smaller codebook. Null vec_ids come last, null
    labels are a label of their own (a label whose vectors have no code has a null error). An empty table gives no rows;
    other columns are not read.
    """
    state, books = fit_and_encode(rows, parts, entries, rounds)
    # Sums by label are written first: a join of two plain shuffles can split the many rows of one label.
    sums = keep(state.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"), "labels")
    code = F.concat_ws("", F.transform("at", lambda k: F.lower(F.lpad(F.hex(k.cast("long")), 2, "0"))))
    coded = state.select("vec_id", F.when(F.col("at").isNotNull(), code).alias("code"), "error", "label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
