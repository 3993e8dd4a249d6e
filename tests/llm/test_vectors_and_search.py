"""Vector codes, SimHash and lexical search against plain versions, with nulls, ties, copies and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tonespark.llm import lexical, simhash, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMBEDDING = "vec_id long, embedding array<double>, label int, v string, at string, error string"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in e], l) for i, e, l in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    cut = [[r[1][w * p : w * p + w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((dist(x, y), e) for e, y in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, _, l), c in zip(kept, cut, strict=True):
        best = [near(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), l))
    total = Counter()
    for _, _, d, l in out:
        total[l] += d
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, d, total[l], sha) for i, c, d, l in out], books


def codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_vector_codes_equal_plain_lloyd(spark):
    r = random.Random(1)
    rows = [(i, [r.choice((-2, -1, 0, 1, 3)) / 64 + r.choice((0, 0.5)) for _ in range(32)], r.choice((None, 1, 2))) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(50)] + [(400, rows[5][1], None)] * 3
    rows += [(-5, None, 1), (-4, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-2, [0.0] * 31 + [float("inf")], 1)]
    rows += [(None, [0.25] * 32, 2), (2000, [-1e4] * 32, 3), (2001, [5e5] * 16 + [-5e5] * 16, 3)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], EMBEDDING)
    assert codes(vector_codes.compress(df.repartition(5))) == sorted(plain_codes(rows)[0], key=str)
    assert codes(vector_codes.compress(df, rounds=0)) == sorted(plain_codes(rows, rounds=0)[0], key=str)
    few = df.where("vec_id between 0 and 9")  # fewer vectors than entries
    assert codes(vector_codes.compress(few)) == sorted(plain_codes([x for x in rows if x[0] is not None and 0 <= x[0] <= 9])[0], key=str)


def test_vector_codes_of_odd_tables(spark):
    assert codes(vector_codes.compress(spark.createDataFrame([], EMBEDDING))) == []
    df = spark.createDataFrame([(1, [0.5] * 16, 1, "", "", ""), (2, [0.5] * 15, 1, "", "", ""), (3, [], None, "", "", "")], EMBEDDING)
    assert [(i, c, e, t) for i, c, e, t, _ in codes(vector_codes.compress(df))] == [(1, "00" * 16, 0, 0), (2, None, None, 0), (3, None, None, None)]
    with pytest.raises(ValueError, match="can't be cut"):
        vector_codes.compress(df.where("vec_id = 2"))
    blank = df.where("vec_id = 3")
    assert [(r.code, r.error) for r in vector_codes.compress(blank).collect()] == [("00" * 16, 0)]


def test_bounds_spare_most_scans_and_lose_nothing():
    r = np.random.default_rng(3)
    centres = r.integers(-400, 400, (2, 20, 4))
    x = np.stack([c[r.integers(0, 20, 3000)] for c in centres]) + r.integers(-9, 9, (2, 3000, 4))
    old = centres + r.integers(-3, 3, centres.shape)
    state = vector_codes.scan(x, old)
    for shift in (1, 2, 40, 0):
        new = old + r.integers(-shift, shift + 1, old.shape)
        state, n = vector_codes.assign(x, new, state, vector_codes.moves(old, new), vector_codes.half_ways(new))
        assert (state[0] == vector_codes.squared(x, new).argmin(axis=2)).all()
        assert n < x.shape[0] * x.shape[1] / (20 if shift < 40 else 1)
        d = np.sqrt(vector_codes.squared(x, new).astype(float))
        d.sort(axis=2)
        assert (state[1] >= d[:, :, 0]).all() and (state[2] <= d[:, :, 1]).all()
        old = new


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """By doc_id: the smallest id in reach."""
    keys = sorted(set(prints.values()))
    least = {k: min(i for i, p in prints.items() if p == k) for k in keys}
    while True:
        new = {k: min(least[o] for o in keys if (k ^ o).bit_count() <= 2) for k in keys}
        if new == least:
            return {i: least[p] for i, p in prints.items()}
        least = new


def test_simhash_equals_plain_version(spark):
    r = random.Random(2)
    words = [a + b for a in "ba KE li mo nu thé 日本".split() for b in "n r s t ng ße".split()]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(r.randint(0, 60)) for _ in range(60)] + [None, "", " \t\n", "one", "one two", "One  TWO\x0bthree", "one two three"]
    base = make(400)
    for _ in range(120):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(400)] = r.choice(words)
        texts.append(" ".join(w))
    texts += [base] * 5 + [make(20) + " " + make(300000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("print", "node", "component_id", "bits")})
    got = {x.doc_id: x for x in simhash.near_duplicates(df.repartition(3)).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    expected = plain_components(prints)
    assert {i: x.component_id for i, x in got.items()} == expected and len(set(expected.values())) < len(set(prints.values())) - 20


def test_trees_find_each_pair(monkeypatch):
    r = np.random.default_rng(7)
    centre = r.integers(0, 1 << 63, dtype=np.int64)
    near = [centre ^ np.bitwise_or.reduce(np.int64(1) << r.integers(0, 63, r.integers(1, 5))) for _ in range(900)]
    prints = np.unique(np.concatenate([near, r.integers(-(1 << 63), 1 << 63, 100, dtype=np.int64)]))
    r.shuffle(prints)
    tree = np.sort(r.integers(0, 4, len(prints)))
    nodes, keys = simhash.build(prints, tree)
    assert sorted(nodes) == sorted(prints) and (np.diff(keys) > 0).all() and (keys % 128 == simhash.distance(nodes, nodes[keys // 128])).all()
    d = simhash.distance(prints[:, None], prints[None, :])
    for front in (1 << 18, 64):
        monkeypatch.setattr(simhash, "FRONT", front)
        a, b, seen = simhash.search(nodes, keys, prints, np.searchsorted(tree, tree))
        found = set(zip(prints[a].tolist(), nodes[b].tolist(), strict=True))
        i, j = np.nonzero((d <= 2) & (tree[:, None] == tree[None, :]))
        assert found == set(zip(prints[i].tolist(), prints[j].tolist(), strict=True)) and len(found) == len(a)
    assert seen < len(prints) ** 2


@pytest.mark.parametrize("tree", [4, 1024])
def test_shards_of_many_trees_lose_no_tie(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "SENT_NODES", 0 if tree == 4 else 1 << 20)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)} | {r.getrandbits(64) for _ in range(30)} | {0, 1 << 63, (1 << 64) - 1}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in sorted(prints)], "print long")).collect()
    expected = plain_components({signed(p): p for p in prints})
    reach = {p: p for p in expected}

    def top(p):
        while reach[p] != p:
            p = reach[p]
        return p

    for x in found:
        a, b = top(x.u), top(x.v)
        reach[max(a, b)] = min(a, b)
    assert {p: top(p) for p in reach} == expected


def test_simhash_of_odd_tables(spark):
    kind = "doc_id string, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    df = spark.createDataFrame([("b", "x y z"), (None, "x y z"), ("b", "x y z"), (None, "q"), ("é", None), ("a", "")], kind)
    got = sorted((str(x.doc_id), x.fingerprint != "0" * 16, str(x.component_id)) for x in simhash.near_duplicates(df).collect())
    assert got == [("None", True, "None"), ("None", True, "b"), ("a", False, "a"), ("b", True, "b"), ("b", True, "b"), ("é", False, "a")]


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_search(docs, items, most=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_all // total
            s = sum(k * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(plain_terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    words = ["alpha", "Beta", "gamma", "ДА", "naïve", "x1", "日本", "the", "Of"]
    make = lambda n: r.choice((" ", "-", "\x00", "—")).join(r.choice(words) for _ in range(n))
    docs = [(i, make(r.randint(0, 40))) for i in range(80)] + [(100 + i, "beta gamma") for i in range(30)] + [(200, None), (201, ""), (202, "--- ..."), (203, "the " * 400000 + "rare")]
    return docs, [(1, "the beta BETA of gamma"), (2, None), (3, "…"), (4, "nothing here"), (5, "naïve 日本 x1 rare"), (6, "beta gamma"), (6, "ДА")]


@pytest.mark.parametrize(("shard", "block"), [(300, 20), (8 << 20, 8 << 20)])
def test_lexical_search_equals_plain_version(spark, shard, block):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("docs", "terms", "query", "rank")}).repartition(6)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("y"))
    got = lexical.search(lexical.build(df, shard), queries, query_bytes=block)
    assert sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in got.collect()), key=str) == plain_search(docs, items)


def test_lexical_search_of_odd_tables(spark):
    docs, items = spark.createDataFrame([("b", "x y"), (None, "x y"), ("b", "x y"), ("a", "y")], "doc_id string, text string"), spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(x.item_id, x.rank, x.doc_id) for x in lexical.ranked(docs, items).orderBy("rank").collect()] == [("q", 1, "b"), ("q", 2, "b"), ("q", 3, None)]
    assert lexical.ranked(docs.limit(0), items).collect() == [] and lexical.ranked(docs, items.limit(0)).collect() == []
    assert lexical.ranked(docs.withColumn("text", F.lit(None).cast("string")), items).collect() == []


def test_best_keeps_ties_with_the_last():
    scores, ids = np.array([5, 9, 5, 0, 5, 9, -1]), np.array([6, 5, 1, 0, 3, 2, 4])
    assert lexical.best(scores, ids, 3).tolist() == [5, 1, 2] and lexical.best(scores, ids, 9).tolist() == [5, 1, 2, 4, 0]
    assert lexical.lengths(np.array([3]), 1 << 58, 3).tolist() == [25 + 75 * (1 << 58)] if 75 << 58 < 1 << 63 else True
    assert pa.array(lexical.impacts(np.array([1]), np.array([100]))).to_pylist() == [1_000_000_000 // 1800]
