"""Codebooks against full search and a plain training loop."""

import itertools

import numpy as np
import pytest

from tonespark.operators import codebooks


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 6, (12, 5))[r.integers(0, 12, 400)] + r.normal(size=(400, 5)) / 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 5), (1003, [])]
    return spark.createDataFrame([*rows, *odd], "vec_id long, x array<double>").repartition(4), x


def test_training_equals_a_loop_and_errors_fall(vectors):
    df, x = vectors
    books, errors = codebooks.train(df, 8, 2, 5)
    left = x
    for book, told in zip(books, errors, strict=True):
        own, want = left[:8].copy(), []
        for _ in range(5):
            d = ((left[:, None] - own[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            want.append(d.min(axis=1).sum())
            own = np.stack([left[at == k].mean(axis=0) if (at == k).any() else own[k] for k in range(8)])
        assert np.allclose(book, own) and np.allclose(told, want) and all(b <= a + 1e-9 for a, b in zip(told, told[1:], strict=False))
        left = left - book[((left[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert errors[1][-1] < errors[0][-1]


def test_a_beam_of_all_is_a_full_search(vectors):
    df, x = vectors
    r = np.random.default_rng(1)
    books = [r.integers(0, 6, (6, 5)).astype(float), r.normal(size=(5, 5)), r.normal(size=(4, 5)) / 2]
    books[0][3] = books[0][1]  # equal entries: the lower word
    got = {r.vec_id: r for r in codebooks.encode(df, books, 1000).collect()}
    assert len(got) == len(x) + 4 and all(got[i].words is None and got[i].error is None for i in range(1000, 1004))
    choices = list(itertools.product(range(6), range(5), range(4)))
    for i, v in enumerate(x):
        d = [((v - books[0][a] - books[1][b] - books[2][c]) ** 2).sum() for a, b, c in choices]
        assert abs(got[i].error - min(d)) < 1e-9 and abs(d[choices.index(tuple(got[i].words))] - min(d)) < 1e-9 and got[i].words[0] != 3
    totals = [sum(r.error for r in codebooks.encode(df.where("vec_id < 1000"), books, k).collect()) for k in (1, 3, 1000)]
    assert totals == sorted(totals, reverse=True)


def test_size_and_empty_tables(vectors, monkeypatch):
    df, _ = vectors
    assert codebooks.train(df.where("false"), 4)[0][0].size == 0
    assert codebooks.encode(df.where("false"), [np.zeros((2, 5))]).count() == 0
    monkeypatch.setattr(codebooks, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="not sent"):
        codebooks.train(df, 8)
