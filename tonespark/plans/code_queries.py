"""Queries of code lengths and bit budgets by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.functions.sample import magnitude_bits
from tonespark.operators import codebooks, codes
from tonespark.plans.catalogue import E, V, register
from tonespark.sources.signals import event_stream, vector_blocks

#: The least bits of a prefix code: the sum of all weights that are merged, the two smallest each time.
_HUFFMAN = """r AS (SELECT k, list_sort(list(n)) AS w, 0::bigint AS bits, count(*) AS symbols FROM c GROUP BY k
  UNION ALL SELECT k, list_sort(list_append(w[3:], w[1] + w[2])), bits + w[1] + w[2], symbols FROM r WHERE len(w) > 1)
SELECT k, symbols, cast(CASE WHEN symbols = 1 THEN w[1] ELSE bits END AS bigint) AS bits, CASE WHEN symbols = 1 THEN 0.5 ELSE 1.0 END::double AS kraft FROM r WHERE len(w) = 1"""


def _summed(found: DataFrame, key: str) -> DataFrame:
    n = F.sum(F.col("n") * F.col("length"))
    return found.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("symbols"), n.alias("bits"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"))


@register("huffman_magnitudes", f"{E.replace('WITH e', 'WITH RECURSIVE e', 1)}, c AS (SELECT user_id AS k, cast(CASE WHEN q = 0 THEN 0 ELSE floor(log2(abs(q))) + 1 END AS int) AS s, count(*) AS n FROM e GROUP BY ALL), {_HUFFMAN}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Codes of the magnitudes of each stream's samples."""
    symbols = event_stream(s, d).select("user_id", magnitude_bits(F.col("q")).cast("int").alias("s"))
    return _summed(codes.code_lengths(symbols, ["user_id"], "s", 15), "user_id")


@register("huffman_residues", f"{V.replace('WITH v', 'WITH RECURSIVE v', 1)}, c AS (SELECT label AS k, cast(round(x * 50) AS int) AS s, count(*) AS n FROM (SELECT label, unnest(e) AS x FROM v) GROUP BY ALL), {_HUFFMAN}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Codes of the quantised values of each label's vectors."""
    symbols = vector_blocks(s, d).select("label", F.explode("e").alias("x")).select("label", F.round(F.col("x") * 50).cast("int").alias("s"))
    return _summed(codes.code_lengths(symbols, ["label"], "s", 24), "label")


@register("band_bits", f"""{V}, p AS (SELECT label, vec_id, g, cast(floor(list_sum(list_transform(range(8), lambda i: pow(round(e[g * 8 + i + 1] * 1024), 2)))) AS bigint) AS energy FROM v, range(8) AS t(g)),
t AS (SELECT label, vec_id, g, k, energy >> (2 * k) AS slope FROM p, range(8) AS u(k)), b AS (SELECT label, cast(count(*) * 12 AS bigint) AS budget FROM v GROUP BY label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY slope DESC, vec_id * 64 + g * 8 + k) AS place FROM t JOIN b USING (label))
SELECT vec_id, cast(g AS int) AS band, count(CASE WHEN place <= budget THEN 1 END) AS bits FROM r GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Bits of each band of 8 values, 12 a vector on average by label: each bit takes three quarters of the error left, and
    goes to where that is most."""
    # All energies of a vector are the explode's own input: an expression beside an explode is made again for each row of it.
    energies = F.expr("transform(sequence(0, 7), g -> cast(floor(aggregate(slice(e, g * 8 + 1, 8), 0D, (a, x) -> a + pow(round(x * 1024), 2))) AS long))")
    band = vector_blocks(s, d).select("label", "vec_id", F.posexplode(energies).alias("band", "energy"))
    steps = band.select("label", "vec_id", "band", "energy", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    frame = (F.col("vec_id") * 64 + F.col("band") * 8 + F.col("k")).alias("frame")
    steps = steps.select(F.col("label").alias("user_id"), frame, F.expr("shiftright(energy, 2 * k)").alias("slope"), F.lit(1).cast("long").alias("bits"), "vec_id", "band")
    budget = vector_blocks(s, d).groupBy(F.col("label").alias("user_id")).agg((F.count("*") * 12).alias("budget"))
    paid = codes.within_budget(steps, budget).groupBy("vec_id", "band").agg(F.count("*").alias("n"))
    every = band.select("vec_id", "band")
    return every.join(paid, ["vec_id", "band"], "left").select("vec_id", "band", F.coalesce("n", F.lit(0).cast("long")).alias("bits"))


@register("beam_words", f"""{V}, a AS (SELECT vec_id AS k, e AS y FROM v WHERE vec_id < 8), b AS (SELECT vec_id - 8 AS k, list_transform(e, lambda x: x / 2) AS y FROM v WHERE vec_id BETWEEN 8 AND 15),
c AS (SELECT cast(a.k AS int) AS first, cast(b.k AS int) AS second, list_transform(range(64), lambda i: a.y[i + 1] + b.y[i + 1]) AS y FROM a, b),
d AS (SELECT vec_id, first, second, list_sum(list_transform(range(64), lambda i: pow(e[i + 1] - y[i + 1], 2))) AS error FROM v, c)
SELECT vec_id, first, second, round(error, 7) AS error FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY error, first, second) = 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Two stages, their entries taken from the first vectors; a beam of all choices is a full search."""
    v = vector_blocks(s, d).select("vec_id", F.col("e").alias("x"))
    first = {r.vec_id: np.array(r.x) for r in v.where("vec_id < 16").collect()}
    books = [np.stack([first[k] for k in range(8)]), np.stack([first[k] for k in range(8, 16)]) / 2]
    made = codebooks.encode(v, books, 64)
    return made.select("vec_id", F.get("words", F.lit(0)).alias("first"), F.get("words", F.lit(1)).alias("second"), F.round("error", 7).alias("error"))
