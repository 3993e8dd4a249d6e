"""Multi-stage codebooks: trained by rounds over all vectors, searched with a beam.

A vector is the sum of one entry of each stage, as near as may be. A stage's codebook is trained on what the stages before
leave of each vector: all vectors are assigned in each round, sums are taken by task before they are shuffled, and the
driver gets a row an entry. Codebooks travel with the tasks, so their size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of all stages' codebooks that are sent to tasks; more are an error.
MOST_BYTES = 64 << 20
#: Values of distances that are held at once.
CELLS = 1 << 22


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have ``size`` finite values, and these values."""
    length = column.value_lengths().fill_null(0).to_numpy()
    rows = np.flatnonzero(length == size)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def _checked(books: list[np.ndarray]) -> list[np.ndarray]:
    if sum(b.nbytes for b in books) > MOST_BYTES:
        raise ValueError(f"codebooks of more than {MOST_BYTES} bytes are not sent to tasks")
    return books


def search(x: np.ndarray, books: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (an entry a stage) and squared errors of the rows of ``x``: after each stage the ``beam`` best choices go on,
    of equal ones those with lower words. A beam of all choices finds the best of all."""
    n, size = x.shape
    left, words = x[:, None, :], np.zeros((n, 1, 0), np.int64)
    for book in books:
        d = ((left[:, :, None, :] - book[None, None]) ** 2).sum(axis=3).reshape(n, -1)
        k = min(beam, d.shape[1])
        pick = np.sort(np.argsort(d, axis=1, kind="stable")[:, :k], axis=1)  # again in the order of words
        path, entry = pick // len(book), pick % len(book)
        left = np.take_along_axis(left, path[:, :, None], 1) - book[entry]
        words = np.concatenate([np.take_along_axis(words, path[:, :, None], 1), entry[:, :, None]], axis=2)
        error = np.take_along_axis(d, pick, 1)
    best = error.argmin(axis=1)
    return words[np.arange(n), best], error[np.arange(n), best]


def encode(vectors: DataFrame, books: list[np.ndarray], beam: int = 4) -> DataFrame:
    """``vec_id, words, error`` of each row of ``vectors`` (vec_id, x); rows that are null, of another length or not finite
    have null for both."""
    size, widest = _checked(books)[0].shape[1], max(len(b) for b in books)
    step = max(1, CELLS // (beam * widest * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch.column(1), size)
            found = [search(x[a : a + step], books, beam) for a in range(0, len(x), step)]
            words, error = (np.concatenate(f) if f else np.zeros(s) for f, s in zip(zip(*found, strict=True) if found else ((), ()), ((0, len(books)), 0), strict=True))
            back = np.full(batch.num_rows, -1)
            back[rows] = np.arange(len(rows))
            take = pa.array(back, mask=back < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(books), pa.int32()), pa.array(words.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.take(take), pa.array(error).take(take)], ["vec_id", "words", "error"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, words array<int>, error double")


def _round(vectors: DataFrame, before: list[np.ndarray], book: np.ndarray) -> tuple[np.ndarray, float]:
    """The means of what each entry is nearest to of the vectors' remainders (entries without any stay), and the summed
    error before."""
    size = book.shape[1]
    step = max(1, CELLS // (len(book) * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, total = np.zeros(book.shape), np.zeros(len(book), np.int64), 0.0
        for batch in batches:
            _, x = _vectors(batch.column(0), size)
            for a in range(0, len(x), step):
                part = x[a : a + step]
                for b in before:
                    part = part - b[search(part, [b], 1)[0][:, 0]]
                words, error = search(part, [book], 1)
                np.add.at(sums, words[:, 0], part)
                n += np.bincount(words[:, 0], minlength=len(book))
                total += float(error.sum())
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.concat_arrays([lists, pa.array([[]], lists.type)]), pa.array(np.append(n[used], 0)), pa.array(np.append(np.zeros(len(used)), total))], ["entry", "sums", "n", "error"])

    parts = vectors.select("x").mapInArrow(run, "entry int, sums array<double>, n bigint, error double")
    error = parts.agg(F.sum("error")).first()[0] or 0.0
    place = parts.where("entry >= 0").select("entry", "n", F.posexplode("sums").alias("k", "s"))
    total = place.groupBy("entry", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new = book.copy()
    for r in total.collect():  # a row for each value of the codebook
        new[r.entry, r.k] = r.s / r.n
    return new, error


def train(vectors: DataFrame, entries: int, stages: int = 2, rounds: int = 4) -> tuple[list[np.ndarray], list[list[float]]]:
    """Codebooks by stage for ``vectors`` (vec_id, x), and the summed squared errors before each round of each stage.

    A stage begins with the remainders of the ``entries`` vectors of the smallest vec_ids. All vectors take part in each
    round; rows that are null, not finite or of another length than the first's are left out.
    """
    good = vectors.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    first = [np.array(r.x, float) for r in good.orderBy("vec_id").limit(entries).collect()]
    if not first:
        return [np.zeros((0, 0))] * stages, [[]] * stages
    start = np.stack([x for x in first if len(x) == len(first[0])])
    _checked([start] * stages)
    books, errors = [], []
    for _ in range(stages):
        left = start
        for b in books:
            left = left - b[search(left, [b], 1)[0][:, 0]]
        book, told = left.copy(), []
        for _ in range(rounds):
            book, error = _round(good, books, book)
            told.append(error)
        books.append(book)
        errors.append(told)
    return books, errors
