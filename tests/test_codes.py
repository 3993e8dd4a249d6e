"""Code lengths against brute force, budgets against a sort of each group."""

import heapq
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonespark.operators import codes


def least_bits(counts, limit):
    """Over all multisets of lengths with a Kraft sum of 1."""
    n, best = len(counts), None
    for lengths in itertools.combinations_with_replacement(range(1, limit + 1), n):
        if sum(2.0**-x for x in lengths) == 1:
            bits = sum(a * b for a, b in zip(sorted(counts, reverse=True), lengths, strict=True))
            best = bits if best is None else min(best, bits)
    return best


def test_lengths_are_the_best_under_their_limit():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(2, 8)
        counts = sorted(r.choice((1, 1, 2, 3, 50, 10**12)) * r.randrange(1, 9) for _ in range(n))
        for limit in range(max(1, (n - 1).bit_length()), 7):
            lengths = codes.package_merge(np.array(counts), limit)
            assert sum(2.0**-x for x in lengths) == 1 and max(lengths) <= limit and list(lengths) == sorted(lengths, reverse=True)
            assert int((lengths * counts).sum()) == least_bits(counts, limit)


def test_lengths_of_a_large_alphabet_equal_a_heap():
    counts = np.sort(np.random.default_rng(2).integers(1, 10**6, 5000))
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert int((codes.package_merge(counts, 30) * counts).sum()) == total
    with pytest.raises(ValueError, match="no codes"):
        codes.package_merge(counts, 12)


def test_codes_by_group(spark):
    r = random.Random(4)
    rows = [(g, r.choice([1, 1, 1, 2, 2, 3, 4, 5, -6])) for g in "aab" for _ in range(200)] + [("c", 7)] * 3 + [("d", None), (None, 1), (None, 2)] + [("e", s) for s in (4, 3, 2, 1)]
    got = codes.code_lengths(spark.createDataFrame(rows, "g string, s int").repartition(4), ["g"], "s", 4).collect()
    by = {}
    for x in got:
        by.setdefault(x.g, []).append(x)
    assert by.keys() == {"a", "b", "c", "e", None}
    for g, own in by.items():
        counts = Counter(s for h, s in rows if h == g and s is not None)
        assert {x.s: x.n for x in own} == counts
        words = sorted(f"{x.code:0{x.length}b}" for x in own)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))
        if len(own) > 1:
            assert sum(x.n * x.length for x in own) == least_bits(list(counts.values()), 4)
    assert [(x.s, x.length, x.code) for x in sorted(by["e"], key=lambda x: x.s)] == [(1, 2, 0), (2, 2, 1), (3, 2, 2), (4, 2, 3)]
    assert [(x.length, x.code) for x in by["c"]] == [(1, 0)]


@pytest.mark.parametrize("block", [None, 7])
def test_budgets_equal_a_sort(spark, block):
    r = random.Random(7)
    rows = [(g, i, r.choice((0, 1, 5, 5, 5, 4096, 1 << 30, (1 << 48) - 1, r.randrange(1 << 48))), r.randrange(1, 4), "x") for g, n in ((1, 300), (2, 40), (3, 1), (4, 20), (6, 30)) for i in range(n)]
    budget = {1: 260, 2: 0, 3: 5, 4: 10**6, 5: 7, 6: 33}
    df = spark.createDataFrame([*rows, (1, None, 5, 1, "x"), (None, 1, 5, 1, "x")], "user_id long, frame long, slope long, bits long, more string").repartition(3)
    got = sorted((x.user_id, x.frame) for x in codes.within_budget(df, spark.createDataFrame(list(budget.items()), "user_id long, budget long"), block).collect())
    want = []
    for g in budget:
        spent = 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1])):
            spent += x[3]
            if spent > budget[g]:
                break
            want.append(x[:2])
    assert got == sorted(want) and {g for g, _ in got} == {1, 3, 4, 6}
    assert codes.within_budget(df.where("false"), spark.createDataFrame([(1, 5)], "user_id long, budget long"), block).count() == 0


def test_a_budget_takes_a_pass_a_digit(spark, tmp_path):
    """Cuts that are named twice would double the plan with each digit (65 scans of the rows)."""
    spark.range(10).selectExpr("id % 2 AS user_id", "id AS frame", "id AS slope", "1L AS bits").write.parquet(f"{tmp_path}/r")
    rows = spark.read.parquet(f"{tmp_path}/r")
    plan = codes.within_budget(rows, rows.groupBy("user_id").agg(F.sum("bits").alias("budget")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 13
