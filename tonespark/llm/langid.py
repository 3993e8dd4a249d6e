"""Language spans of mixed-language text.

A word's script (that of most of its letters, by ranges of code points) narrows the languages it may be in; the word is
scored for each by naive Bayes over hashed byte trigrams and the hashed word; and the cheapest labelling of a where each change of language costs SWITCH, gives its spans (Viterbi, over all texts of a slice at once).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespark.llm.scratch import free_names
from tonespark.llm.words import LOWER, SPACE, hashes, row_of, row_sums, slices, spans

#: At most about so many labelled rows are learned from; they are chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
FEATURES = 1 << 16
#: A model takes half a MB a language.
MOST_LANGUAGES = 256
SWITCH = 10.0
OUTSIDE = -30.0
SMOOTH = 0.2
#: Scripts by ranges of code points, first to last.
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x373), (0x376, 0x37D), (0x37F, 0x3E1), (0x3F0, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x481), (0x48A, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA66E), (0xA680, 0xA69D)),
    "Armenian": ((0x531, 0x556), (0x559, 0x588), (0xFB13, 0xFB17)),
    "Hebrew": ((0x5D0, 0x5F2), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x620, 0x64A), (0x66E, 0x6D3), (0x6D5, 0x6EF), (0x6FA, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8C9), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC)),
    "Syriac": ((0x710, 0x74F),),
    "Thaana": ((0x780, 0x7B1),),
    "NKo": ((0x7CA, 0x7EA),),
    "Devanagari": ((0x900, 0x963), (0x970, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9E3), (0x9F0, 0x9F1)),
    "Gurmukhi": ((0xA00, 0xA65), (0xA70, 0xA7F)),
    "Gujarati": ((0xA80, 0xAE5), (0xAF9, 0xAFF)),
    "Oriya": ((0xB00, 0xB65), (0xB71, 0xB71)),
    "Tamil": ((0xB80, 0xBE5),),
    "Telugu": ((0xC00, 0xC65),),
    "Kannada": ((0xC80, 0xCE5), (0xCF1, 0xCF3)),
    "Malayalam": ((0xD00, 0xD65), (0xD7A, 0xD7F)),
    "Sinhala": ((0xD80, 0xDE5),),
    "Thai": ((0xE01, 0xE3A), (0xE40, 0xE4E)),
    "Lao": ((0xE80, 0xECF), (0xEDC, 0xEDF)),
    "Tibetan": ((0xF00, 0xF00), (0xF40, 0xFBC)),
    "Myanmar": ((0x1000, 0x103F), (0x1050, 0x108F), (0xAA60, 0xAA7F)),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0xAC00, 0xD7FB), (0xFFA0, 0xFFDC)),
    "Ethiopic": ((0x1200, 0x135A), (0x1380, 0x138F), (0x2D80, 0x2DDE), (0xAB01, 0xAB2E)),
    "Cherokee": ((0x13A0, 0x13FD), (0xAB70, 0xABBF)),
    "Canadian": ((0x1401, 0x166C), (0x166F, 0x167F), (0x18B0, 0x18F5)),
    "Khmer": ((0x1780, 0x17D3), (0x17D7, 0x17DC)),
    "Mongolian": ((0x1820, 0x18AA),),
    "Glagolitic": ((0x2C00, 0x2C5F),),
    "Coptic": ((0x3E2, 0x3EF), (0x2C80, 0x2CE4)),
    "Tifinagh": ((0x2D30, 0x2D6F),),
    "Kana": ((0x3041, 0x3096), (0x309D, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "Bopomofo": ((0x3105, 0x312F), (0x31A0, 0x31BF)),
    "Han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x3FFFF)),
    "supplementary": ((0x10000, 0x1CFFF), (0x1D400, 0x1D7CB), (0x1E000, 0x1EFFF)),
}
_RANGES = sorted((a, b, k) for k, own in enumerate(SCRIPTS.values(), 1) for a, b in own)
_FIRST, _LAST, _SCRIPT = (np.array(x) for x in zip(*_RANGES, strict=True))
N_SCRIPTS = len(SCRIPTS)


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 begins at these places."""
    wide = np.concatenate([buf, np.zeros(3, np.uint8)])
    b = [wide[at + k].astype(np.int64) for k in range(4)]
    low = [x & 63 for x in b]
    two, three = (b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]
    return np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])


def scripts_of(buf: np.ndarray) -> np.ndarray:
    """The script (from 1) at the first byte of each letter, 0 elsewhere."""
    out = np.zeros(len(buf), np.uint8)
    lower = buf | 32
    out[(lower >= 97) & (lower <= 122)] = 1
    at = np.flatnonzero(buf >= 0xC2)
    kinds, which = np.unique(code_points(buf, at), return_inverse=True)
    i = np.searchsorted(_FIRST, kinds, "right") - 1
    script = np.where((i >= 0) & (kinds <= _LAST[i]), _SCRIPT[i], 0)
    out[at] = script[which]
    return out


def word_scripts(scripts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of most letters of each word, of equally many the first; 0 without letters."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    most, least = (f.reduceat(np.where(scripts, scripts, none), starts) for f, none in ((np.maximum, 0), (np.minimum, 255)))
    out = most.astype(np.int64)
    mixed = np.flatnonzero((most > 0) & (least != most))
    if len(mixed):
        size = ends[mixed] - starts[mixed]
        which = np.repeat(np.arange(len(mixed)), size)
        at = np.repeat(starts[mixed] - (np.cumsum(size) - size), size) + np.arange(len(which))
        keys, counts = np.unique(which * 256 + scripts[at], return_counts=True)
        keys, counts = keys[keys % 256 > 0], counts[keys % 256 > 0]
        order = np.lexsort((-(keys % 256), counts, keys // 256))
        out[mixed[keys[order] // 256]] = keys[order] % 256  # the last of a word stays
    return out


def trigrams(buf: np.ndarray) -> np.ndarray:
    """A feature for each byte, from it and its neighbours; white space counts as spaces, letters in lower case."""
    b = np.full(len(buf) + 2, 32, np.uint32)
    b[1:-1] = np.where(SPACE[buf], 32, LOWER[buf])
    return (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (hashes(LOWER[buf], starts, ends) >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    """Languages, log-probabilities by feature and language, and which scripts each language is written in."""

    languages: list[str]
    tri: np.ndarray = field(repr=False)
    word: np.ndarray = field(repr=False)
    allowed: np.ndarray = field(repr=False)


def fit(docs: DataFrame, good: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and lang of the rows of ``docs`` for which ``good`` holds and neither is null.

    Beyond ``rows`` of them, those with the smallest hashes of doc_id and text are taken, so that about ``rows`` remain.
    """
    known = docs.where(good & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                own = batch.column(1).filter(pa.array(langs == lang))
                sums = np.zeros((2, FEATURES), np.int64)
                scripts = np.zeros(FEATURES, np.int64)
                for _, _, buf, off in slices(own):
                    starts, ends, _ = spans(buf, off)
                    sums[0] += np.bincount(trigrams(buf)[~SPACE[buf]], minlength=FEATURES)
                    sums[1] += np.bincount(word_features(buf, starts, ends), minlength=FEATURES)
                    scripts += np.bincount(scripts_of(buf), minlength=FEATURES)
                for kind, x in enumerate((*sums, scripts)):
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([kind], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([x[at].tobytes()])], ["lang", "kind", "at", "n"])

    def total(table: pa.Table) -> pa.Table:
        x = np.zeros(FEATURES, np.int64)
        for at, n in zip(table["at"], table["n"], strict=True):
            x[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int64)
        return pa.table({"lang": table["lang"][:1], "kind": table["kind"][:1], "n": pa.array([x.tobytes()])})

    parts = known.select("lang", "text").mapInArrow(count, "lang string, kind int, at binary, n binary")
    sums = {(r.lang, r.kind): np.frombuffer(r.n, np.int64) for r in parts.groupBy("lang", "kind").applyInArrow(total, "lang string, kind int, n binary").collect()}
    languages = sorted({lang for lang, _ in sums})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages: a model of more than {MOST_LANGUAGES} is not sent to the workers")
    if not languages:
        return Model([], *(np.zeros((FEATURES, 0), np.float32),) * 2, np.zeros((N_SCRIPTS + 1, 0), bool))
    tables = []
    for kind in (0, 1):
        x = np.stack([sums[lang, kind] for lang in languages], 1) + SMOOTH
        p = np.log(x / x.sum(axis=0))
        tables.append((p - p.max(axis=1, keepdims=True)).astype(np.float32))  # features that none has met tell nothing
        tables[-1][x.sum(axis=1) < SMOOTH * len(languages) + 0.5] = 0
    s = np.stack([sums[lang, 2][: N_SCRIPTS + 1] for lang in languages], 1).astype(float)
    s[0] = 0
    allowed = s / np.maximum(s.sum(axis=0), 1) >= 0.005
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, *tables, allowed)


def word_scores(model: Model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by word and language, whether words have letters, and whether nothing is known of them: none of their
    features was met, and several languages are written in their script. Words without letters score 0 for all."""
    n = len(starts)
    out = np.zeros((n, len(model.languages)), np.float32)
    script = word_scripts(scripts_of(buf), starts, ends)
    tri, chunk, a = trigrams(buf), max(1 << 14, (1 << 20) // max(1, len(model.languages))), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + chunk, "right")))
        s, e = int(starts[a]), int(ends[b - 1])
        each = model.tri[tri[s:e]]
        each[SPACE[buf[s:e]]] = 0
        out[a:b] = np.add.reduceat(each, starts[a:b] - s, axis=0)
        a = b
    out += model.word[word_features(buf, starts, ends)]
    blank = ~out.any(axis=1) & (model.allowed.sum(axis=1)[script] > 1)
    out += np.where(model.allowed[script], 0, OUTSIDE).astype(np.float32)
    out[script == 0] = 0
    return out, script > 0, blank & (script > 0)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; row ``i`` has words ``at[i]:at[i + 1]``. All rows advance together, the longest first."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    n, languages = int(size.max(initial=0)), scores.shape[1]
    live = np.searchsorted(-size[order], -np.arange(n), "left")  # rows with more words than t
    first = at[:-1][order]
    best = np.zeros((len(size), languages))
    came, changed = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    for t in range(n):
        k = live[t]
        v, i = best[:k], first[:k] + t
        if t:
            top = v.argmax(axis=1)
            other = v[np.arange(k), top][:, None] - switch
            moves = other > v
            came[i], changed[i] = top, moves
            np.maximum(v, other, out=v)
        v += scores[i]
    label, out = best.argmax(axis=1), np.zeros(len(scores), np.int16)
    for t in range(n - 1, -1, -1):
        k = live[t]
        i, now = first[:k] + t, label[:k]
        out[i] = now
        label[:k] = np.where(changed[i, now], came[i], now)
    return out


def has_letter(text: Column) -> Column:
    """Whether the text has a letter of any script, as ``label`` tells it; false for null."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and any(c.isalpha() for c in t))

    return run(text)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and spans (first and end word, language) of the whole ``text``.

    lang_pred is the language of most bytes of words with letters and score their share, where words without any feature
    met in training count for all languages alike; ``und`` with score 0 if the
    text is null or has no letter, or nothing was learned. Every row stays, with all its columns; where ``docs`` has a
    column of one of the three names, the new one is the first free of name_2, name_3 ... An empty table gives no rows.
    """
    keep = docs.columns
    added = free_names(keep, "lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    made = T.StructType([*(docs.schema[c] for c in keep), T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [*m.languages, "und"]
        for batch in batches:
            for a, b, buf, off in slices(batch.column(keep.index("text")), max(1 << 18, (16 << 20) // max(4, len(m.languages)))):
                pred, score, lists = _label_slice(m, buf, off)
                size = [len(x) for x in lists]
                flat = [x for y in lists for x in y]
                values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([names[x[2]] for x in flat], pa.string())], ["first", "end", "lang"])
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array([names[k] for k in pred], pa.string()), pa.array(score), listed], [*keep, *added])

    return docs.mapInArrow(run, made)


def _label_slice(m: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    n, und = len(off) - 1, len(m.languages)
    starts, ends, at = spans(buf, off)
    row = row_of(at)
    if not und:
        return np.full(n, und), np.zeros(n), [[] for _ in range(n)]
    scores, lettered, blank = word_scores(m, buf, starts, ends)
    labels = viterbi(scores, at)
    weight = (ends - starts) * lettered
    # A word of which nothing is known speaks for all languages alike, whatever span it stands in.
    share = np.bincount(row * und + labels, weight * ~blank, n * und).reshape(n, und) + np.bincount(row, weight * blank, n)[:, None] / und
    total = share.sum(axis=1)
    pred = np.where(total > 0, share.argmax(axis=1), und)
    score = np.divide(share.max(axis=1), total, out=np.zeros(n), where=total > 0)
    ascii_letter = ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))
    sure = row_sums(ascii_letter.astype(np.int64), off) > 0
    for i in np.flatnonzero(~sure).tolist():
        has = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode())
        if not has:
            pred[i], score[i] = und, 0.0
        elif pred[i] == und:  # letters of no listed script: all languages are as likely
            pred[i], score[i] = 0, 1.0 / und
    cut = np.ones(len(labels), bool)
    cut[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
    lists: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    begin = np.flatnonzero(cut)
    for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(labels)], strict=True):
        r = int(row[s])
        if pred[r] != und:
            lists[r].append((s - int(at[r]), e - int(at[r]), int(labels[s])))
    return pred, score, lists
