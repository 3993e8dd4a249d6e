"""Ids of the words of whole slices of rows: each distinct word of a slice is looked up once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from tonespark.llm.words import _MASKS, _eights, LONG, mix, spans, word_ids


class Memo(dict):
    """Bytes of little-endian 32-bit ids by word; about ``most`` words stay, those met lately."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int):
        self.make, self.most, self.old = make, most, {}

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        get, old = self.get, self.old
        out = [get(w) or old.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(missing, self.make([words[i] for i in missing]), strict=True):
            out[i] = x
        if len(words) <= self.most:
            self.update(zip(words, out, strict=True))
        return out


def _digested(words: list[bytes]) -> list[bytes]:
    return [hashlib.blake2b(w, digest_size=16).digest() for w in words]


_DIGESTS = Memo(_digested, 1 << 18)


def word_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2 digests of the distinct words, as two integers each, and the number of every word.

    Words are told apart by their bytes first; each distinct one is digested once, and those met lately are remembered.
    """
    first, which = word_ids(buf, starts, ends)
    raw, out = buf.tobytes(), np.zeros((len(first), 2), np.uint64)
    long = (ends - starts)[first] > LONG
    for own, make in ((np.flatnonzero(~long), _DIGESTS.look_up), (np.flatnonzero(long), _digested)):
        at = first[own]
        found = make([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        out[own] = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
    return out, which


def key_of(word: bytes) -> np.ndarray:
    return word_keys(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]


def word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct words, as two integers each, and the number of every word; equal keys are equal words.

    A word of up to 15 bytes is its own key, with its length in the highest byte: only longer ones are digested (to 120
    bits, and a length that no other has). The first half is then mixed with the second, so that it spreads evenly.
    """
    size = ends - starts
    eights = _eights(buf)
    one = eights[starts] & _MASKS[np.minimum(size, 8)]
    two = eights[np.minimum(starts + 8, len(buf))] & _MASKS[np.clip(size - 8, 0, 7)]
    two |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    if len(long := np.flatnonzero(size > 15)):
        raw = buf.tobytes()
        found = b"".join(_digested([raw[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]))
        digest = np.frombuffer(found, "<u8").reshape(-1, 2)
        one[long], two[long] = digest[:, 0], digest[:, 1] | np.uint64(255 << 56)
    one = mix(one ^ mix(two))
    order = np.argsort(one)
    new = np.ones(len(order), bool)
    new[1:] = one[order[1:]] != one[order[:-1]]
    if not (new[1:] | (two[order[1:]] == two[order[:-1]])).all():  # other words with the same first half
        order = np.lexsort((two, one))
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.stack([one[order[new]], two[order[new]]], axis=1), which


def slice_ids(buf: np.ndarray, off: np.ndarray, memo: Memo, with_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the ``n + 1`` places where rows begin; ``with_space``: a word has the byte before it in its row."""
    starts, ends, at = spans(buf, off)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    if with_space:
        row_starts = np.repeat(off[:-1], np.diff(at))
        starts = np.where(starts > row_starts, starts - 1, starts)
    first, which = word_ids(buf, starts, ends)
    raw = buf.tobytes()
    found = memo.look_up([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begins = np.cumsum(sizes) - sizes
    own = sizes[which]
    to = np.concatenate([[0], np.cumsum(own)])
    ids = flat[np.repeat(begins[which] - to[:-1], own) + np.arange(to[-1])]
    return ids, to[at]
