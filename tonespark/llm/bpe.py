"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

After each byte of a piece, the merges' encoding of what was read so far ends in exactly one token: the one whose pair
with the token before it is stable under the merges. A state holds, for each position where a token may have begun, the
bytes since and the token that ends there; a transition tells the token that ends after its byte. Tokens are emitted
when no token can have begun earlier, or the piece ends. States and transitions are made when first met and kept within
a bound.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tonespark.llm.scratch import free_names
from tonespark.llm.wordids import Memo, slice_ids
from tonespark.llm.words import SPACE, slices

MEMO_PIECES, MEMO_WORDS = 300_000, 600_000
MEMO_STATES = 400_000
LOOKAHEAD = 256
START = 1 << 31
REJECT = 8


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[int]:
    """The definition: join the adjacent pair of lowest rank under ``below``, leftmost first, while there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes pieces, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # The tokens as a trie: children by node and byte, the token that ends at a node (or -1), whether it has children.
        self.child, self.ends, self.inner = {}, [-1], [True]
        for token, number in ranks.items():
            node = 0
            for b in token:
                if (to := self.child.get(node << 8 | b)) is None:
                    to = self.child[node << 8 | b] = len(self.ends)
                    self.inner[node] = True
                    self.ends.append(-1)
                    self.inner.append(False)
                node = to
            self.ends[node] = number
        self._reset()

    def _reset(self) -> None:
        self.states = [(0, START)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int, bool]] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice if it is a byte, None if the merges never make it."""
        if token not in self.split:
            raw = self.token[token]
            got = [token, token] if len(raw) == 1 else merge(raw, self.ranks, token)
            self.split[token] = (got[0], got[1]) if len(got) == 2 else None
        return self.split[token]

    def _stable(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are.

        Their merges are undone from the last to the first. If the tokens that then meet make a token of lower rank than
        the merge undone last, they'd have merged before it (of equal ranks, the left merge comes first).
        """
        if len(self.pairs) > MEMO_STATES:
            self.pairs.clear()
        good = self._parts(right) is not None if left == START else self._meet(left, right)
        self.pairs[left << 32 | right] = good
        return good

    def _meet(self, left: int, right: int) -> bool:
        if self._parts(left) is None or self._parts(right) is None:
            return False
        until = 1 << 62
        while True:
            made = self.ranks.get(self.token[left] + self.token[right])
            if made is not None and made < until:
                return False
            a, b = self._parts(left)[1], self._parts(right)[0]
            if a == left and b == right:
                return True
            if b == right or (a != left and left > right):
                left, until = a, left
            else:
                right, until = b, right + 1

    def _move(self, number: int, byte: int) -> tuple[int, int, bool]:
        """The next state, the token that ends after this byte, and whether all before it is certain."""
        last, live, child, pairs = -1, [], self.child, self.pairs
        state = self.states[number]
        for i in range(0, len(state), 2):
            node = child.get(state[i] << 8 | byte)
            if node is None:
                continue
            left = state[i + 1]
            if last < 0 and (right := self.ends[node]) >= 0:
                good = pairs.get(left << 32 | right)
                if self._stable(left, right) if good is None else good:
                    last = right
            if self.inner[node]:
                live += (node, left)
        if last < 0:
            raise ValueError("no token ends here: the ranks lack single bytes")
        key = (*live, 0, last)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.moves[number << 8 | byte] = to, last, not live
        return made

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece, as ``merge`` gives them."""
        if len(self.states) > MEMO_STATES:
            self._reset()
        at, ends, out, get = 0, [], [], self.moves.get
        for b in piece:
            at, last, certain = get(at << 8 | b) or self._move(at, b)
            ends.append(last)
            if certain and len(ends) >= LOOKAHEAD:
                out += self._emit(ends)
                ends = []
        return out + self._emit(ends) if out else self._emit(ends)

    def _emit(self, ends: list[int]) -> list[int]:
        """The tokens that lead to the last position, first one first."""
        out, i, size = [], len(ends), self.size
        while i:
            t = ends[i - 1]
            out.append(t)
            i -= size[t]
        out.reverse()
        return out


def odd_spaces(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows where white space stands beside white space, at an end, or is not ASCII: words can't be taken alone there."""
    n = len(off) - 1
    space = SPACE[buf]
    odd = np.zeros(n, bool)
    full = np.flatnonzero(np.diff(off))
    odd[full] = space[off[full]] | space[off[full + 1] - 1]
    two = np.flatnonzero(space[1:] & space[:-1])
    spots = [two, np.flatnonzero((buf >= 0x1C) & (buf <= 0x1F))]
    wide = np.concatenate([buf, np.zeros(3, np.uint8)])
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        i = np.flatnonzero(buf == lead)
        b, c = wide[i + 1], wide[i + 2]
        match lead:
            case 0xC2:
                i = i[(b == 0x85) | (b == 0xA0)]
            case 0xE1:
                i = i[(b == 0x9A) & (c == 0x80)]
            case 0xE2:
                i = i[((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))]
            case 0xE3:
                i = i[(b == 0x80) & (c == 0x80)]
        spots.append(i)
    odd[np.searchsorted(off, np.concatenate(spots), "right") - 1] = True
    return odd


class Encoder:
    """Ids of texts: each match of the pattern on its own, a match that is a token whole, by the transducer otherwise."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find, self.transducer = regex.compile(pattern), Transducer(ranks)
        self.pieces = Memo(lambda made: [self._piece(p) for p in made], MEMO_PIECES)
        self.words = Memo(self._texts, MEMO_WORDS)

    def _piece(self, raw: bytes) -> bytes:
        whole = self.transducer.ranks.get(raw)
        return np.array([whole] if whole is not None else self.transducer.encode(raw), "<u4").tobytes()

    def _texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; a piece that several of them have is looked up once."""
        find = self.find.findall
        found = [[p.encode() for p in find(t.decode())] for t in texts]
        own = list(dict.fromkeys(chain.from_iterable(found)))
        known = dict(zip(own, self.pieces.look_up(own), strict=True))
        return [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in found]

    def text(self, text: str) -> bytes:
        return self._texts([text.encode()])[0]

    def rows(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each row. White space of one character between words ends a match before it, so that words, each with
        the character before it, can be encoded alone; rows with other white space are encoded whole."""
        ids, at = slice_ids(buf, off, self.words, with_space=True)
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd_spaces(buf, off)).tolist():
            out[i] = np.frombuffer(self.text(buf[off[i] : off[i + 1]].tobytes().decode()), "<u4")
        return out


def utf8_moves() -> np.ndarray:
    """Next state by state and byte. 0: between code points; 1 to 3: as many bytes to come; 4 to 7: after E0, ED, F0, F4, whose next byte has a narrower range; REJECT."""
    to = np.full((9, 256), REJECT, np.uint8)
    to[0, :0x80] = 0
    for low, high, state in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        to[0, low : high + 1] = state
    for state, low, high, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        to[state, low : high + 1] = then
    return to


class Decoder:
    """Turns ids into bytes; a state machine over whole tokens follows UTF-8 across chunks."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for t, i in ranks.items():
            self.token[i] = t
        self.to = utf8_moves()
        self.closed = np.array([self.run(0, t) == 0 for t in self.token])
        self.state, self.rest = 0, b""

    def run(self, state: int, data: bytes) -> int:
        for b in data:
            state = int(self.to[state, b])
        return state

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def valid(self, ids: np.ndarray) -> bool:
        """Whether the ids' bytes are whole UTF-8. Tokens of whole code points can only stand between code points."""
        state, last = 0, -1
        for i in np.flatnonzero(~self.closed[ids]).tolist():
            if state and i != last + 1:
                return False
            state, last = self.run(state, self.token[ids[i]]), i
        return state == 0

    def push(self, ids: Iterable[int]) -> str:
        """Text of the code points that these ids complete; malformed bytes become U+FFFD."""
        data = self.rest + b"".join(self.token[i] for i in ids)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                state = self.run(0, data[-back:])
                keep = back if state not in (0, REJECT) else 0
                break
            if lead < 0x80:
                keep = 0
                break
        else:
            keep = 0
        self.rest = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


@lru_cache(2)
def coder(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """What a worker needs, made once; the vocabulary file is on every machine."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return Encoder(ranks, pattern), Decoder(ranks)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text`` as the array column ``out``; null counts as empty.

    All rows and columns stay; if ``df`` has a column named ``out``, the new one is the first free of ``out``_2, _3 ...
    An empty table gives no rows.
    """
    (out,) = free_names(df.columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [row.astype(np.int32) for _, _, buf, off in slices(batch.column(text)) for row in coder(ranks_path, pattern)[0].rows(buf, off)]
            off = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids as ``out``, decoded in chunks; bytes that aren't UTF-8 become U+FFFD, null stays.

    All rows and columns stay, and ``out`` is named as in ``encode``. An empty table gives no rows.
    """
    (out,) = free_names(df.columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(ranks_path, pattern)[1]
        for batch in batches:
            texts = [None if x is None else "".join(decoder.push(x[k : k + 4096]) for k in range(0, len(x), 4096)) + decoder.finish() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) and decode the ids again; a row per row, in no set order.

    Null and empty texts have no tokens. Nulls in doc_id and repeated rows pass through; other columns are not read.
    Ids aren't returned but digested in the task: doc_id, n_tokens, ids_sha256, decoded_sha256, whole_utf8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(ranks_path, pattern)
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                rows = []
                for ids in encoder.rows(buf, off):
                    digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoder.bytes_of(ids)).hexdigest()
                    rows.append((len(ids), *digests, decoder.valid(ids)))
                n, x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(x), pa.array(y), pa.array(z)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole_utf8"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, whole_utf8 boolean")
