"""Cost-balanced packing of token pieces into sequences of a fixed length.

A sequence's cost is the sum over its pieces of a linear part and a quadratic part (attention within the piece).
Documents gather in groups within a task; whole sequences are cut from long ones, and the pieces left are given,
longest first, to the cheapest sequence that has room, and are cut where none has. A group's sequences hold exactly its
tokens: the last are powers of two, which need no padding. Groups don't meet, so nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tonespark.llm.wordids import Memo, slice_ids
from tonespark.llm.words import slices

LENGTH = 2048
GROUP_TOKENS = 1 << 19
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
MEMO_WORDS = 300_000
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"


def capacities(tokens: int, length: int) -> list[int]:
    """Full sequences, then powers of two: their sum is ``tokens``."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and no padding."""
    room = np.array(capacities(sum(lengths), length), np.int64)
    full, out, rest = int((room == length).sum()), [], []
    cost, used, number = np.zeros(len(room)), np.zeros(len(room), np.int64), 0
    weigh = lambda n: LINEAR * n + QUADRATIC * n * n

    def put(doc: int, start: int, n: int, k: int) -> None:
        out.append((doc, start, n, k, int(used[k])))
        used[k] += n
        room[k] -= n
        cost[k] += weigh(n)

    for doc, n in enumerate(lengths):
        whole = n // length
        for k in range(whole):
            put(doc, k * length, length, number)
            number += 1
        if n % length:
            rest.append((n % length, doc, whole * length))
    assert number <= full
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            open_ = fits if len(fits) else np.flatnonzero(room)
            k = int(open_[np.argmin(cost[open_])])
            m = min(n, int(room[k]))
            put(doc, start, m, k)
            start, n = start + m, n - m
    return out


@lru_cache(2)
def word_memo(path: str) -> Memo:
    """Ids of words by a tokenizer that never joins across ASCII white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def make(words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 1000):  # many words as one text: a token belongs to the word in which it begins
            part = [w.decode() for w in words[k : k + 1000]]
            made = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.searchsorted(np.array([o[0] for o in made.offsets], np.int64), np.cumsum([len(w) + 1 for w in part]))
            ids = np.array(made.ids, "<u4")
            out += [ids[x:y].tobytes() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    return Memo(make, MEMO_WORDS)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` tokens; a row per piece.

    A document's tokens are its text's ids and ``end_id`` (null and empty texts: that alone). ``sequence_id`` is the
    task's partition and a number within it; pieces fill a sequence from offset 0 without gaps. Partitions and the order
    of their rows decide which documents meet, so ``docs`` has to be a stored table (or the result has to be stored
    before it is read twice): a shuffle that runs again may give other sequences. Null doc_ids and
    repeated rows are packed like any other; an empty table gives no pieces; other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = word_memo(tokenizer_path), [c.split()[0] for c in SCHEMA.split(", ")]
        first = TaskContext.get().partitionId() << 32
        keys, texts, tokens, kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal first
            pieces = pack([len(t) // 4 for t in texts], length)
            sizes = np.zeros(1 + max(p[3] for p in pieces), np.int64)
            costs = np.zeros(len(sizes))
            for _, _, n, k, _ in pieces:
                sizes[k] += n
                costs[k] += LINEAR * n + QUADRATIC * n * n
            columns = [
                pa.array([keys[d] for d, *_ in pieces], kind), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(texts[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces], pa.int64()),
                pa.array([len(texts[d]) // 4 for d, *_ in pieces], pa.int64()), pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()), pa.array(sizes[[p[3] for p in pieces]]), pa.array(costs[[p[3] for p in pieces]]),
            ]
            first += len(sizes)
            return pa.RecordBatch.from_arrays(columns, names)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, buf, off in slices(batch.column(1)):
                ids, at = slice_ids(buf, off, memo)
                for i, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    keys.append(key)
                    texts.append(ids[at[i] : at[i + 1]].tobytes() + end)
                    tokens += len(texts[-1]) // 4
                    if tokens >= group_tokens:
                        yield flush()
                        keys, texts, tokens = [], [], 0
        if keys:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=id_type))
