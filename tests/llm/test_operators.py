"""The training-data operators against plain versions, on hand-made tables with nulls, ties, copies and long texts."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonespark.llm import bpe, chat, exact, imatch, kneser_ney, langid, ngram_join, packing, substring, warc
from tonespark.llm.scratch import new_path
from tonespark.llm.words import text_bytes

SCHEMA = "doc_id long, text string, lang string, bucket string, rest string, key string"
WORDS = [a + b for a in "ba ke li mo nu thé".split() for b in "n r s t ng ße".split()]


def corpus():
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, make(r.randint(1, 90))) for i in range(60)]
    base, passage = make(120), make(30)
    rows += [(100 + i, base) for i in range(5)] + [(110 + i, base.replace(base.split()[3 * i + 9], "x", 1)) for i in range(6)]
    rows += [(120 + i, make(25) + " " + passage + "\n" + make(9)) for i in range(4)]
    rows += [(200, None), (201, ""), (202, "  \t\n"), (203, "... 12"), (204, "a  b"), (205, "a\tb"), (206, "z " * 3000), (207, "日本 語"), (208, "é   x\x1c y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[i % 2], "b", "r", "k") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and a table of nulls."""
    return spark.createDataFrame([(None, "a b", None, "", "", ""), (None, "a b", None, "", "", ""), (7, "a b", None, "", "", ""), (7, "a b", None, "", "", ""), (7, None, None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, docs, odd):
    got, groups = by_id(exact.decide(docs)), collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in corpus():
        groups[norm(t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    made = exact.decide(odd).collect()
    assert sum(r.kept for r in made) == 2 and {r.keep_id for r in made} == {7}
    assert exact.deduplicate(odd).count() == 2 and exact.deduplicate(docs).count() == len(groups)
    assert exact.deduplicate(docs).columns == docs.columns and exact.decide(empty(spark)).count() == 0


def test_exact_history(spark, odd):
    before = spark.createDataFrame([(50, "a  b"), (60, "a b"), (1, "q"), (None, None)], "doc_id long, text string")
    now = spark.createDataFrame([(2, "a\tb"), (3, "new"), (50, "a  b"), (4, "new"), (None, "")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.decide(now, before).collect()}
    assert got == {(2, 50, 4, False), (50, 50, 4, False), (3, 3, 2, True), (4, 3, 2, False), (None, None, 2, False)}
    assert exact.decide(now, empty(spark)).where("kept").count() == 3 and exact.decide(empty(spark), before).count() == 0


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        _, slots = exact.displace(*rng.integers(0, 1 << 28, (3, n)))
        assert sorted(slots) == list(range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark, docs, odd):
    got, sets = by_id(ngram_join.near_duplicates(docs)), {i: shingles(t) for i, t in corpus()}
    kinds = set(sets.values())
    near = {a: [b for b in kinds if b != a and len(a & b) >= 0.8 * len(a | b)] for a in kinds}
    for i, s in sets.items():
        seen, todo = {s}, [s]
        while todo:
            todo += (new := [b for b in near[todo.pop()] if b not in seen])
            seen |= set(new)
        assert got[i].class_id == min(j for j, t in sets.items() if t in seen)
        assert (got[i].n_links, got[i].copy_id) == (len(near[s]), min(j for j, t in sets.items() if t == s))
    assert any(r.n_links for r in got.values())
    assert ngram_join.drop_near_duplicates(docs).count() == len({r.class_id for r in got.values()})
    assert ngram_join.drop_near_duplicates(odd).count() == 2 and ngram_join.near_duplicates(empty(spark)).count() == 0


def test_links_across_blocks(spark, docs, monkeypatch):
    want = {i: (r.class_id, r.n_links) for i, r in by_id(ngram_join.near_duplicates(docs)).items()}
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    assert {i: (r.class_id, r.n_links) for i, r in by_id(ngram_join.near_duplicates(docs)).items()} == want


def test_prefixes_are_shortened_by_what_is_found():
    share, least = ngram_join.found_share, ngram_join.least_depth()
    assert share(0.8, least) >= ngram_join.RECALL > share(0.8, least + 1)
    assert ngram_join.matched_depth([]) == least and ngram_join.matched_depth([(8, 0.99, 100), (7, 0.5, 10)]) == 8
    assert ngram_join.matched_depth([(8, 0.99, 10**6), (8, 0.82, 1)]) == least
    assert ngram_join.matched_depth([(8, 0.95, 100), (8, 0.85, 100), (5, 0.81, 1)]) == 7 and least < 7


def test_thresholds_beyond_the_recall_are_an_error(docs):
    assert ngram_join.least_depth(0.32) == 1
    with pytest.raises(ValueError, match="recall"):
        ngram_join.least_depth(0.3)
    with pytest.raises(ValueError, match="recall"):
        ngram_join.near_duplicates(docs, 0.1)


def test_trie_ties_are_those_of_the_nodes():
    r = np.random.default_rng(7)
    label = np.sort(r.integers(0, 3, (400, 8)).astype(np.uint64) @ (np.uint64(1) << np.arange(56, -8, -8, dtype=np.uint64)))
    shared = lambda a, b: next((k for k in range(8) if a >> (56 - 8 * k) != b >> (56 - 8 * k)), 8)
    ties = {(int(a), int(b)): (int(d), bool(w)) for u in ngram_join.trie_ties(label, 4) for a, b, d, w in zip(*u, strict=True)}
    assert all(d == shared(int(label[a]), int(label[b])) for (a, b), (d, w) in ties.items() if not w)
    for d in range(4, 9):
        nodes = collections.defaultdict(list)
        for i, x in enumerate(label.tolist()):
            nodes[x >> (64 - 8 * d)].append(i)
        root = list(range(len(label)))
        for _ in label:
            for (a, b), (k, _) in ties.items():
                if k >= d:
                    root[a] = root[b] = min(root[a], root[b])
        assert all(len({root[i] for i in own}) == 1 for own in nodes.values()) and len(set(root)) == len(nodes)
        assert all((a, b) in ties for own in nodes.values() if len(own) <= ngram_join.PAIRED for k, a in enumerate(own) for b in own[k + 1 :])


def sets_of(rows):
    return {i: shingles(t) for i, t in rows}


def test_recall_of_links_near_the_threshold(spark):
    """Over 1,000 planted links of Jaccard 0.8 to 0.9, each between two documents of their own."""
    r, rows = random.Random(11), []
    for k in range(1300):
        words = [f"w{r.randrange(40000)}" for _ in range(90 + k % 2 * (10 + k % 25))]
        other = [*words]
        for at in r.sample(range(6, 84, 7), 1 + k % 2):
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = sets_of(rows)
    links = [k for k in range(1300) if 0.8 <= len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) <= 0.9]
    got = by_id(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    found = [k for k in links if got[2 * k].class_id == got[2 * k + 1].class_id and got[2 * k].n_links]
    assert len(links) >= 1000 and len(found) >= 0.99 * len(links)


def test_a_chain_of_half_alike_texts_is_not_compared(spark):
    words = [f"w{k}" for k in range(40 * 10_001)]
    rows = [(k, " ".join(words[40 * k : 40 * k + 120])) for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ngram_join.near_duplicates(docs)
    assert got.where("n_links > 0 or class_id <> doc_id").count() == 0
    signed = ngram_join.signatures(docs)
    tied = ngram_join.components(ngram_join.forest_ties(signed.select("digest", "size", "labels")))
    assert sum(r["count"] ** 2 for r in tied.groupBy("root").count().collect()) < 1000


def test_substring(spark, docs, odd):
    got, seen = by_id(substring.remove_repeats(docs)), set()
    for i, t in sorted(corpus()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        assert got[i].text == b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode() and got[i].n_removed == sum(gone)
    assert any(r.n_removed for r in got.values()) and substring.remove_repeats(docs).columns[:6] == docs.columns
    assert substring.remove_repeats(odd).count() == 6 and substring.remove_repeats(empty(spark)).count() == 0


def test_imatch(spark, docs, odd):
    got, rows = by_id(imatch.with_edits(docs)), sorted(corpus(), reverse=True)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert len({got[100 + i].fingerprint for i in range(5)}) == 1 and got[103].near_next == 1.0
    assert imatch.with_edits(odd).count() == 6 and imatch.with_edits(empty(spark)).count() == 0


def test_imatch_equals_a_plain_version(spark, docs):
    """Likeness from the sets of terms themselves, over a lexicon counted by hand."""
    terms = lambda t: set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))))
    key = lambda w: int(imatch.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    rows = sorted(corpus(), reverse=True)
    n = collections.Counter(w for _, t in rows for w in terms(t))
    band = {w for w, k in n.items() if max(2, len(rows) / 1000) <= k <= max(2, len(rows) / 8)}
    assert set(imatch.lexicon(docs).tolist()) == {key(w) for w in band} and band

    def chosen(w, f):
        x = int(imatch.mix(np.array([key(w) ^ (0x5851F42D4C957F2D * (f + 1) % (1 << 64))], np.uint64))[0])
        return next((level - 1 for level in imatch.LEVELS if x >= 1 << (64 - level)), max(imatch.LEVELS))  # the last subset that has it

    levels = {w: [chosen(w, f) for f in range(imatch.FAMILIES)] for w in n}

    def likeness(a, b):
        both = [(x & band, x) for x in map(terms, (a, b))]
        enough = all(len(x) >= imatch.ENOUGH and len(x) >= imatch.SHARE * len(y) for x, y in both)
        a, b = (x[0] if enough else x[1] for x in both)
        parts = [([w for w in a if levels[w][f] >= k], [w for w in b if levels[w][f] >= k]) for f in range(imatch.FAMILIES) for k in imatch.LEVELS]
        code = lambda x: 2 ** (round(8 * math.log2(len(x))) / 8)
        weigh = [(1 / max(code(z) for z in (x, y) if z), set(x) == set(y)) for x, y in parts if x or y]
        weigh += [(1 / max(len(a), len(b)), a == b)] if a or b else []
        return sum(w for w, same in weigh if same) / sum(w for w, _ in weigh) if weigh else 1.0

    got = by_id(imatch.with_edits(docs))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        levels |= {w: [chosen(w, f) for f in range(imatch.FAMILIES)] for w in terms(edited) - set(levels)}
        assert math.isclose(got[i].near_edited, likeness(t, edited), abs_tol=1e-9) and math.isclose(got[i].near_next, likeness(t, after), abs_tol=1e-9)
    same = collections.defaultdict(set)
    for i, t in rows:
        same[got[i].fingerprint].add(frozenset(terms(t)))
    assert all(len(x) == 1 for x in same.values()) and len(same) == len({frozenset(terms(t)) for _, t in rows})


def test_imatch_tells_short_and_rare_texts_apart():
    terms_of = lambda t: imatch.distinct_terms(*text_bytes(pa.array([t])))[1]
    pairs = lambda f: imatch.likeness(tuple(x[:-1] for x in f), tuple(x[1:] for x in f))
    words = [f"w{i}" for i in range(300)]
    short = [" ".join(words[(i + k) % 300] for k in range(1 + i % 3)) for i in range(300)]
    for terms in (terms_of(" ".join(words)), np.zeros(0, np.uint64)):
        f = imatch.fingerprints(pa.array(short), terms)
        assert len(set(imatch.as_text(f))) == 300 and (pairs(f) < 1).all()
    rare = ["common shared " + " ".join(f"{c}{i}" for i in range(2000)) for c in "abcd"]
    f = imatch.fingerprints(pa.array([*rare, rare[-1], "", None, "a0"]), terms_of("common shared"))
    assert (pairs(f)[:3] < 0.1).all() and pairs(f)[3:].tolist() == [1.0, 0.0, 1.0, 0.0]


def test_language_id(spark, docs, odd):
    r = random.Random(2)
    say = {"xx": "wo wir der und nicht".split(), "yy": "le la que oui dans".split(), "ru": "это как они было".split()}
    text = lambda lang, n: " ".join(r.choice(say[lang]) for _ in range(n))
    rows = [(i, text(lang, 20), lang) for i in range(60) for lang in [list(say)[i % 3]]] + [(900, text("xx", 30) + " " + text("yy", 20), "xx"), (901, None, None), (902, "12 -", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.label(df, langid.fit(df, F.lit(True))))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert [(s.first, s.end, s.lang) for s in got[900].spans] == [(0, 30, "xx"), (30, 50, "yy")]
    assert (got[901].lang_pred, got[902].lang_pred, got[902].score) == ("und", "und", 0.0)
    assert langid.label(odd, langid.fit(odd, F.lit(True))).count() == 6 and langid.label(empty(spark), langid.fit(df, F.lit(True))).count() == 0


def test_scripts_are_told_by_code_points():
    names = ["", *langid.SCRIPTS]

    def script(word):
        buf = np.frombuffer(word.encode(), np.uint8)
        return names[langid.word_scripts(langid.scripts_of(buf), np.array([0]), np.array([len(buf)]))[0]]

    said = {"Việt": "Latin", "ẤẦ": "Latin", "नमस्ते": "Devanagari", "வணக்கம்": "Tamil", "สวัสดี": "Thai", "ລາວ": "Lao", "ქართ": "Georgian", "ሰላም": "Ethiopic", "ខ្មែរ": "Khmer", "ⲁⲃ": "Coptic", "ⴰⵣ": "Tifinagh", "αβγ": "Greek", "мир": "Cyrillic", "×÷": "", "🎉!": "", "한국": "Hangul", "日本語": "Han", "ひらが日": "Kana", "日本の": "Han", "aбв": "Cyrillic", "abв": "Latin", "aб": "Latin", "12": ""}
    assert {w: script(w) for w in said} == said
    ranges = sorted(r for own in langid.SCRIPTS.values() for r in own)
    assert all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:], strict=False))


def test_language_id_equals_a_plain_version(spark):
    r, say = random.Random(8), {"aa": "wo wir der und Nicht", "bb": "le la que oui dàns", "cc": "это как они было nyet"}
    text = lambda *langs: " ".join(r.choice(say[k].split()) for k in langs for _ in range(9))
    rows = [(i, text(*r.sample(list(say), 1 + i % 3)), None) for i in range(45)] + [(100 + 3 * i + j, text(k), k) for i in range(12) for j, k in enumerate(say)] + [(300, None, "aa"), (301, "", None), (302, "12 -", None), (303, "ქართ ღა", None), (304, text("aa") * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spans = lambda b: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    names = ["", *langid.SCRIPTS]
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def tri(b):
        x = b" " + re.sub(rb"[\x09-\x0D]", b" ", b.translate(lower)) + b" "
        return [((x[i] << 16 | x[i + 1] << 8 | x[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(len(b))]

    def word(b):
        return int(langid.hashes(np.frombuffer(b.translate(lower), np.uint8), np.array([0]), np.array([len(b)]))[0] >> np.uint64(48))

    def script(w):
        found = [next((k for k, own in enumerate(langid.SCRIPTS.values(), 1) if any(a <= ord(c) <= b for a, b in own)), 0) for c in w.decode()]
        n = collections.Counter(k for k in found if k)
        return min(n, key=lambda k: (-n[k], k)) if n else 0

    sums = {k: [collections.Counter() for _ in range(3)] for k in say}
    for _, t, k in rows:
        if k and t:
            b = t.encode()
            sums[k][0].update(f for f, c in zip(tri(b), b, strict=True) if c not in b" \t\n\v\f\r")
            sums[k][1].update(word(b[x:y]) for x, y in spans(b))
            sums[k][2].update(script(c.encode()) for c in t)
    langs = sorted(say)
    sizes = [[sum(sums[k][i].values()) + langid.SMOOTH * langid.FEATURES for k in langs] for i in (0, 1)]

    def logs(i, f):
        p = [math.log((sums[k][i][f] + langid.SMOOTH) / n) for k, n in zip(langs, sizes[i], strict=True)]
        return [x - max(p) if any(sums[k][i][f] for k in langs) else 0.0 for x in p]

    letters = {k: sum(n for s, n in sums[k][2].items() if s) for k in langs}
    allowed = [[s > 0 and sums[k][2][s] / letters[k] >= 0.005 for k in langs] for s in range(len(names))]

    def plain(t):
        b = (t or "").encode()
        best, weight, unknown = None, [], []
        feature = tri(b)
        for x, y in spans(b):
            s = script(b[x:y])
            score = [sum(logs(0, f)[k] for f in feature[x:y]) + logs(1, word(b[x:y]))[k] + (0 if allowed[s][k] or not any(allowed[s]) else langid.OUTSIDE) for k in range(3)] if s else [0.0] * 3
            weight.append((y - x) * (s > 0))
            met = any(logs(0, f)[k] for f in feature[x:y] for k in range(3)) or any(logs(1, word(b[x:y])))
            unknown.append(s > 0 and not met and sum(allowed[s]) != 1)  # speaks for all languages alike
            if best is None:
                best = [(v, [k]) for k, v in enumerate(score)]
            else:
                top = max(range(3), key=lambda k: best[k][0])
                best = [(max(best[k][0], best[top][0] - langid.SWITCH) + score[k], [*(best[k][1] if best[k][0] >= best[top][0] - langid.SWITCH else best[top][1]), k]) for k in range(3)]
        if not sum(weight):
            return "und", 0.0
        path = max(best, key=lambda x: x[0])[1]
        share = [sum(w / 3 if u else w * (p == k) for w, p, u in zip(weight, path, unknown, strict=True)) for k in range(3)]
        return langs[share.index(max(share))], max(share) / sum(weight)

    got = by_id(langid.label(df, langid.fit(df, F.lit(True))))
    for i, t, _ in rows[:-1]:
        pred, score = plain(t)
        assert got[i].lang_pred == pred and math.isclose(got[i].score, score, rel_tol=1e-9), (i, t)
    assert got[304].lang_pred == "aa" and got[304].score > 0.99


def test_viterbi_is_the_best_labelling():
    import itertools

    rng = np.random.default_rng(3)
    scores, at = rng.normal(size=(9, 3)).astype(np.float32), np.array([0, 4, 4, 9])
    got = langid.viterbi(scores, at, 0.7)
    for a, b in ((0, 4), (4, 9)):
        value = lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(value(got[a:b]), max(value(p) for p in itertools.product(range(3), repeat=b - a)), rel_tol=1e-5)


def plain_kneser_ney(texts, order):
    """Log10 probability of a text by an interpolated modified Kneser-Ney model of ``texts``, from its definition."""
    grams = [None, *(collections.Counter() for _ in range(order))]
    for t in texts:
        row = ["<s>"] * (order - 1) + t
        grams[order].update(tuple(row[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    d = [None, *(kneser_ney.discounts(np.array([sum(n == c for n in grams[k].values()) for c in range(1, 5)])) for k in range(1, order + 1))]
    after = collections.defaultdict(list)
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            after[g[:-1]].append(n)
    words = len({w for t in texts for w in t})

    def p(g):
        if not g:
            return 1 / (words + 1)
        k, own = len(g), after.get(g[:-1])
        lower = p(g[1:]) if k > 1 else p(())
        if not own:
            return lower
        n = grams[k][g]
        return max(n - d[k][min(n, 3)], 0) / sum(own) + sum(d[k][min(c, 3)] for c in own) / sum(own) * lower

    return lambda t: sum(math.log10(p(tuple((["<s>"] * (order - 1) + t)[i : i + order]))) for i in range(len(t)))


@pytest.mark.parametrize(("order", "small"), [(3, False), (2, True), (3, True), (4, True)])
def test_kneser_ney(spark, docs, odd, order, small):
    sizes = {"range_words": 40, "range_grams": 150, "fan": 3} if small else {}  # many ranges, two steps, spread contexts
    train = F.col("doc_id") % 5 != 1
    got, lower = by_id(kneser_ney.score(docs, kneser_ney.fit(docs, train, order, **sizes))), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = {i: [*(t or "").encode().translate(lower).split(), None] for i, t in corpus()}
    own = [t for i, t in toks.items() if i % 5 != 1]
    c, plain = collections.Counter(w for t in own for w in t), plain_kneser_ney(own, order)
    total = sum(c.values())
    for i, t in toks.items():
        assert math.isclose(got[i].score, plain(t), rel_tol=1e-6)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in t), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), total)
    assert math.isclose(sum(10 ** plain([w]) for w in c) + 10 ** plain(["never"]), 1, rel_tol=1e-9)
    assert kneser_ney.score(odd, kneser_ney.fit(empty(spark), F.lit(True))).count() == 6


def test_packing(spark, docs, odd):
    path = P.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(path), packing.pack_documents(docs, path, group_tokens=3000).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in corpus()}
    for i, x in ids.items():
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == len(x)
    used = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        s.sort()
        size = sum(n for _, n in s)
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and size <= 2048 and size & (size - 1) == 0
    assert packing.pack_documents(odd, path).count() >= 6 and packing.pack_documents(empty(spark), path).count() == 0


def test_bpe(spark, docs, odd):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.round_trip(docs, path, P.PATTERN))
    for i, t in corpus():
        ids = true.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].whole_utf8
    back = by_id(bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN))
    assert all(back[i].decoded == (t or "") for i, t in corpus())
    t, r = bpe.Transducer(ranks), random.Random(4)
    for _ in range(300):
        piece = bytes(r.choice(b"abethings \xc3\xa9") for _ in range(r.randint(1, 30)))
        assert t.encode(piece) == bpe.merge(piece, ranks)
    assert bpe.round_trip(odd, path, P.PATTERN).count() == 6 and bpe.round_trip(empty(spark), path, P.PATTERN).count() == 0


def test_decoder_holds_back_open_code_points():
    d = bpe.Decoder({bytes([b]): b for b in range(256)})
    raw = "aé日🎉".encode() + b"\xff"
    assert "".join(d.push([b]) for b in raw) + d.finish() == "aé日🎉�"


def test_warc(spark):
    pages = [(3, "u\r\nX: y", "same"), (1, "v", "same"), (2, None, None), (5, "w", ""), (6, "é", "é"), (None, "n", "same")]
    df, path = spark.createDataFrame(pages, "page_id long, url string, html string"), new_path(spark, "test")
    warc.write_archive(df, path)
    got = {r.page_id: r for r in warc.parse_records(warc.read_records(spark, path)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 6: ("response", None)}
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() and r.payload_bytes == len((h or "").encode()) for i, _, h in pages for r in [got[i]])
    warc.write_archive(df, path + "2", min_bytes=3)
    assert sum(r.record_type == "revisit" for r in warc.parse_records(warc.read_records(spark, path + "2")).collect()) == 2


def test_warc_urls_of_any_kind(spark):
    hostile = ["http://x/\u2028WARC-Payload-Digest: sha1:AAAA", "http://x/\u0085WARC-Refers-To: <urn:tonespark:page:9>", "a\r\nWARC-Type: revisit\r\n\r\nHTTP/1.1", "b%0D%0A", "b\r\n", "\u2029", "é\n", ""]
    pages = [(i, u, "same" if i % 2 else f"own {i}\r\n\r\n") for i, u in enumerate(hostile)] * 2
    df, path = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit("x")), new_path(spark, "test")
    warc.write_archive(df, path)
    records = warc.read_records(spark, path)
    got = warc.parse_records(records).collect()
    assert collections.Counter((r.page_id, r.url) for r in got) == collections.Counter((i, u) for i, u, _ in pages)
    assert all((r.record_type, r.refers_to) == ("revisit", 1) for r in got if r.page_id % 2 and r.page_id != 1)
    cut = records.where("revisited_bytes is null").withColumn("record", F.expr("cast(replace(cast(record as string), 'own 2', 'own 3') as binary)"))
    with pytest.raises(Exception, match="contradicts"):
        warc.parse_records(cut).collect()
    warc.write_archive(df.where("false"), path + "2")
    assert warc.parse_records(warc.read_records(spark, path + "2")).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "a\\[INST"), (1, 1, "assistant", "</s> <"), (1, 2, "tool", "</role>"), (2, 5, None, None), (2, 6, "assistant", None), (3, 0, "assistant", "x" * 200_000 + "</s>"), (None, 0, "user", " [/INST]")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, None):
        own = [(r or "", t or "") for i, _, r, t in turns if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_reads_turns_back_and_checks_chunks(spark):
    turns = [(1, k, r, t, "x") for k, (r, t) in enumerate([("user", "a\\" * 70_000), ("assistant", "[INST] \\" * 30_000), ("to\\ol", "</role><<SYS>>"), ("assistant", ""), ("user", "<" * 9 + "</s")])]
    df = spark.createDataFrame([*turns, (2, 0, "user", "hi", "x"), (3, 0, "assistant", "yes " * 40_000, "x")], "conv_id long, turn long, role string, text string, chunk string")
    made = chat.format_conversations(df).coalesce(1).cache()
    assert {(r.conv_id, r.turn, r.role, r.text) for r in chat.read_turns(made).collect()} == {(r.conv_id, r.turn, r.role, r.text) for r in df.collect()}
    assert made.where("conv_id = 1").count() > 3
    again = made.where("chunk = 1").withColumn("chunk", F.lit(2).cast("long"))
    for bad in (made.where("not (conv_id = 1 and chunk = 1)"), made.where("not last"), made.where("chunk > 0"), made.unionByName(made).coalesce(1).sortWithinPartitions("conv_id", "chunk"), made.where("conv_id = 1 and chunk < 2").unionByName(again).coalesce(1)):
        with pytest.raises(Exception, match="chunk"):
            chat.read_conversations(bad).collect()


def test_a_long_turn_is_read_in_linear_time():
    import time

    def seconds(n):
        reader, began = chat.Reader(), time.process_time()
        reader.push("<s>[INST] ", [])
        for _ in range(n):
            reader.push("x" * 65_536, [])
        reader.push(" [/INST]", [])
        assert reader.finish()[0] == 1
        return time.process_time() - began

    assert seconds(640) < 8 * max(seconds(160), 0.05)


def alike(k):
    """Two words of 2 ** k letters that polynomial hashes modulo 2 ** 64 don't tell apart."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_do_not_tell_apart(spark):
    import tiktoken
    from tokenizers import Tokenizer

    rows = []
    for k in (11, 12):
        a, b = alike(k)
        fill = " ".join(WORDS[:24])
        rows += [(len(rows) + i, t) for i, t in enumerate((a, b, f"{fill} {a} {fill}", f"{fill} {b} {fill}", f"{a} {a} {b} x" * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, near, near_to = by_id(bpe.round_trip(df, path, P.PATTERN)), by_id(ngram_join.near_duplicates(df)), by_id(imatch.with_edits(df))
    pieces, kept = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect(), by_id(substring.remove_repeats(df))
    scored, plain, seen = by_id(kneser_ney.score(df, kneser_ney.fit(df, F.lit(True)))), plain_kneser_ney([[*t.split(), None] for _, t in rows], 3), set()
    for i, t in rows:
        assert got[i].ids_sha256 == hashlib.sha256(np.array(true.encode_ordinary(t), "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces if r.doc_id == i)
        words = t.split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if (x := tuple(words[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        assert kept[i].n_removed == sum(gone) and math.isclose(scored[i].score, plain([*words, None]), rel_tol=1e-6)
        assert near[i].copy_id == i and len({r.fingerprint for r in near_to.values()}) == len(rows)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With hashes of two bits, as no real ones are, words, windows and n-grams still count as equal only if they are."""
    from tonespark.llm import wordids, words

    real = words.hashes
    few = lambda *a: real(*a) & np.uint64(3)
    for module in (words, substring):
        monkeypatch.setattr(module, "hashes", few)
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (60, 40, 0, 3)] + ["x " * 30]
    texts.append(" ".join(texts[0].split()[10:50]))
    buf, off = text_bytes(pa.array(texts))
    ids, at = wordids.slice_ids(buf, off, wordids.Memo(lambda made: [w.ljust(16)[:16] for w in made], 100))
    assert [ids[at[i] : at[i + 1]].tobytes() for i in range(len(texts))] == [b"".join(w.encode().ljust(16)[:16] for w in t.split()) for t in texts]
    row, h = ngram_join.shingles(buf, off)
    assert [int((row == i).sum()) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert len(set(h[row == 0].tolist()) & set(h[row == 5].tolist())) == len(shingles(texts[0]) & shingles(texts[5]))
    unit = substring.Unit(pa.table({"doc_id": pa.array(range(len(texts))), "key": pa.chunked_array([pa.array(range(len(texts)))]), "text": texts}))
    starts = np.flatnonzero(unit.left >= substring.WINDOW)
    first, which = unit.classes(starts)
    flat = [w for t in texts for w in t.split()]
    plain = [tuple(flat[s : s + 20]) for s in starts.tolist()]
    assert [plain[first[k]] for k in which.tolist()] == plain and len(first) == len(set(plain))
    one, two = unit.digests(starts)
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len(set(plain))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7), (5, 6), (6, 5)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    made = ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.root for x in made} == root and len(made) == len(root)
    assert ngram_join.components(spark.createDataFrame([], "u long, v long")).count() == 0


CLASHING = "_mark0 _id score lang_pred spans token_ids decoded n_words n_removed unit rest row digest key whole own_id mark kept text_hash keep_id of".split()


@pytest.mark.parametrize("ids", ["long", "string"])
def test_columns_of_any_name_stay(spark, ids):
    import corpus_pipeline

    some = [(i, t) for i, t in corpus() if i in (1, 2, 3, 100, 101, 110, 120, 121, 200, 204, 205)] + [(None, "a b"), (2, None)]
    rows = [(str(i) if ids == "string" and i is not None else i, t, "en", len(t or ""), *(f"{c} {k}" for c in CLASHING)) for k, (i, t) in enumerate(some)]
    df = spark.createDataFrame(rows, f"doc_id {ids}, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    want = {r[4]: r[4:] for r in rows}
    path, model = P.path("byte_bpe_multi_50k.tiktoken"), langid.fit(df, F.lit(True))
    coded = bpe.encode(df, path, P.PATTERN)
    made = [langid.label(df, model), coded, bpe.decode(coded, path, P.PATTERN, ids=coded.columns[-1]), substring.remove_repeats(df)]
    assert coded.columns[-1] == "token_ids_2"
    made += [exact.deduplicate(df), ngram_join.drop_near_duplicates(df), *(stage(spark, df, "") for _, stage in corpus_pipeline.STAGES[:-1])]
    for k, m in enumerate(made):
        assert m.columns[: len(df.columns)] == df.columns and (k > 3 or m.count() == len(rows))
        assert all(tuple(r[4 : 4 + len(CLASHING)]) == want[r[4]] for r in m.collect())
    digests = [exact.decide(df), ngram_join.near_duplicates(df), imatch.with_edits(df), kneser_ney.score(df, kneser_ney.fit(df, F.lit(True))), bpe.round_trip(df, path, P.PATTERN)]
    assert all(m.count() == len(rows) for m in digests) and packing.pack_documents(df, P.path("word_bpe_49k.json")).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_templates():
    render = chat.compile_template("{% if 1 + 1 == 2 %}yes{% else %}no{% endif %}{{ 'a' + 'b' | upper }}{% for m in messages %}{% if not loop.first and m.role != 'x' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endif %}{% endfor %}")
    assert list(render([{"role": "a", "text": "1"}, {"role": "b", "text": " 2 "}])) == [("yesaB", False), ("2", True)]
    folded = chat.fold(chat.parse("a{{ 1 + 2 }}{% if False %}x{% endif %}b"))
    assert [(n.kind, n.value) for n in folded.parts] == [("text", "a3b")]
    for bad in ("{% if x %}", "{{ f(1) }}", "{{ x | eval }}", "{% endfor %}", "{{ a.__class__ }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    for t in ("<s>", "\\<s>", "<\\s>", "[[INST]", "a</s</s>"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)


def plain_stages(rows):
    """What each stage but the last leaves of ``rows``: (doc_id, text) by name."""
    out = {"language_id": (rows := [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")])}
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    out["exact_dedup"] = rows = [(i, t) for i, t in rows if any(min(own) == i for own in first.values())]
    sets, root = sets_of(rows), {i: i for i, _ in rows}
    for _ in rows:  # the least of all that are tied
        for x, y in ((x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])):
            root[x] = root[y] = min(root[x], root[y])
        if all(root[root[i]] == root[i] for i in root):
            break
    out["ngram_join"] = rows = [(i, t) for i, t in rows if root[i] == i]
    seen, left = set(), []
    for i, t in sorted(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        left.append((i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out | {"substring_dedup": left}


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_stages(corpus())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == before.columns and {i: r.text for i, r in got.items()} == dict(want[name]), name
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert {200, 201, 202, 203} & set(got) == set() and 100 in got and not {101, 110, 115} & set(got)
    tok, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), collections.defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert pieces.keys() == got.keys()
    for i, own in pieces.items():
        ids, at = np.array([*tok.encode(got[i].text, add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc in sorted(own):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_pipeline_rejects_letterless_texts_alone(spark):
    import corpus_pipeline

    say = {"aa": "wo wir der und nicht", "bb": "le la que oui dans", "cc": "это как они было нет", "dd": "και το να είναι με", "ee": "דבר אני הוא לא כן"}
    rows = [(i, (say[k] + " ") * 4, k) for i, k in enumerate(list(say) * 8)]
    rows += [(100, " ".join((s + " ") * 4 for s in say.values()), None), (101, "ＡＢＣ ｄｅｆ", None), (102, "12 -", None), (103, None, None), (104, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert all(r.lang_pred != "und" and r.score < 0.3 for r in langid.label(df.where("doc_id in (100, 101)"), model).collect())
    for docs in (df, df.withColumn("lang", F.lit(None).cast("string"))):
        made = corpus_pipeline.language_id(spark, docs, "")
        assert made.columns == docs.columns and {r.doc_id for r in made.collect()} == {*range(40), 100, 101}


#: Pairs that an older hash of words by blocks of 8 bytes could not tell apart, and a word that met the end's value.
ALIKE = ("il5pj3jof8lh40ra", "idsqzqdldbgp6245", "a6rctfdt8za8tcm2")


@pytest.mark.parametrize("few", [False, True])
def test_words_made_to_collide_are_told_apart_by_models_and_fingerprints(spark, monkeypatch, few):
    """op3 and op6 tell words apart by digests; with hashes of two bits they still do."""
    from tonespark.llm import wordids, words

    if few:
        real = words.hashes
        monkeypatch.setattr(words, "hashes", lambda *a: real(*a) & np.uint64(3))
    a, b, c = ALIKE
    df = spark.createDataFrame([(0, f"{a} x"), (1, f"{b} x"), (2, f"{c} x"), (3, None)], "doc_id long, text string")
    model = kneser_ney.fit(df, F.col("doc_id") == 0, fan=1, range_words=1)
    got = by_id(kneser_ney.score(df, model))
    assert [got[i].n_known for i in range(4)] == [3, 2, 2, 1]
    for i, n in ((0, 1), (1, 0), (2, 0)):
        base = sum(math.log10((k + 0.5) / (3 + 0.5 * (3 + 1))) for k in (n, 1, 1))
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
    made = by_id(imatch.with_edits(df))
    assert len({made[i].fingerprint for i in range(4)}) == 4 and made[1].near_next < 1 and made[2].near_next < 1
    buf, off = text_bytes(pa.array([f"{a} {b} {c} {a}"]))
    starts, ends, _ = words.spans(buf, off)
    for make in (wordids.word_digests, wordids.word_keys):
        digests, which = make(buf, starts, ends)
        assert len(digests) == 3 and which[0] == which[3] and len({tuple(d) for d in digests.tolist()}) == 3


def test_keys_of_words_are_equal_for_equal_words_alone(monkeypatch):
    from tonespark.llm import wordids, words

    r = random.Random(8)
    made = [bytes(r.choice(b"ab\xc3") for _ in range(r.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 300)))) for _ in range(3000)]
    buf = np.frombuffer(b" ".join(made), np.uint8)
    starts, ends, _ = words.spans(buf, np.array([0, len(buf)]))
    for mix in (wordids.mix, lambda x: x & np.uint64(1)):  # spread, or with two first halves for all
        monkeypatch.setattr(wordids, "mix", mix)
        keys, which = wordids.word_keys(buf, starts, ends)
        assert len(keys) == len({tuple(k) for k in keys.tolist()}) and which.max() == len(keys) - 1
        if mix(np.full(1, 5, np.uint64))[0] != 1:
            assert len(keys) == len(set(made)) and {tuple(keys[k].tolist()): w for k, w in zip(which.tolist(), made, strict=True)} == {tuple(wordids.key_of(w)[0].tolist()): w for w in made}


def test_model_of_many_word_ranges(spark):
    """Words in two steps give the same scores."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    plain = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.fit(docs, F.lit(True))).collect()}
    for sizes in ({"range_words": 1, "fan": 3}, {"range_words": 2, "fan": 512}):
        got = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.fit(docs, F.lit(True), **sizes)).collect()}
        assert all(math.isclose(got[i], s, rel_tol=1e-9) for i, s in plain.items())


def test_texts_are_edited_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} " * (1 + 700 * (i % 3))) for i in range(20)] + [(20, None)], "doc_id long, text string")
    whole = sorted(map(tuple, imatch.with_edits(df).collect()))
    monkeypatch.setattr(imatch, "EDIT_BYTES", 3000)
    assert sorted(map(tuple, imatch.with_edits(df).collect())) == whole and len(whole) == 21


def test_texts_of_megabytes(spark):
    """One text of 5 MB among short ones: nothing is cut, and what can be counted plainly is."""
    import tiktoken
    import tokenizers

    r = random.Random(11)
    kinds = ["".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9))) for _ in range(9000)]
    words = [kinds[r.randrange(9000)] for _ in range(800_000)]
    words[700_000:700_040] = words[100:140]  # a passage that stands earlier
    text = " ".join(words)
    assert len(text) > 5_000_000
    df = spark.createDataFrame([(1, text, "aa"), (2, "kurz und gut", "bb"), (3, None, "bb"), (4, " ".join(words[:200]), "aa")], "doc_id long, text string, lang string").repartition(2)
    made = by_id(langid.label(df, langid.fit(df, F.lit(True))))
    assert made[1].lang_pred == "aa" and made[1].spans[-1].end == len(words)
    near = by_id(ngram_join.near_duplicates(df))
    assert near[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and near[1].n_links == 0
    prints = by_id(imatch.with_edits(df))
    assert prints[1].n_chars == len(text) and prints[1].near_edited > prints[1].near_next
    scored = by_id(kneser_ney.score(df, kneser_ney.fit(df, F.col("doc_id") == 1)))
    assert scored[1].n_tokens == scored[1].n_known == scored[1].train_tokens == len(words) + 1 and scored[1].score > scored[1].base_score
    kept = by_id(substring.remove_repeats(df))
    assert kept[1].n_words == len(words) and kept[1].n_removed == 40 and kept[4].n_removed == 200
    with open(P.path("byte_bpe_multi_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    ids = np.array(tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text), "<u4")
    coded = by_id(bpe.round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    assert coded[1].n_tokens == len(ids) and coded[1].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and coded[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    own = sorted((p for p in packing.pack_documents(df, P.path("word_bpe_49k.json")).collect() if p.doc_id == 1), key=lambda p: p.start)
    whole = np.array([*tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert own[0].doc_tokens == len(whole) == sum(p.length for p in own) and all(p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes()) for p in own)
