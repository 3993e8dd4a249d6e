"""Every signal query against its SQL, on the smallest tables, and the checksums against known values."""

import math
from pathlib import Path

import duckdb
import pytest

from tonespark.functions import checksums
from tonespark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "" if x is None else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = tables.execute(catalogue.SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_crc_check_values(spark):
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "b binary")
    made = df.select(*[checksums.crc(*k)("b").alias(n) for n, k in {"a": checksums.CRC8, "b": checksums.CRC16, "c": checksums.CRC16_SIDE, "d": checksums.CRC32_PAGE}.items()]).collect()
    assert tuple(made[0]) == (0xF4, 0xFEE8, 0xAEE7, 0x89A1897F)
    assert tuple(made[1]) == (None,) * 4 and tuple(made[2]) == (0, 0, 0xFFFF, 0)


def plain_crc(data, width, polynomial, start):
    c = start
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


KINDS = {"crc8": checksums.CRC8, "crc16": checksums.CRC16, "crc16_side": checksums.CRC16_SIDE, "crc32_page": checksums.CRC32_PAGE}


def test_crc_text_covers_the_documents(spark, tables):
    got = {r.doc_id: r for r in catalogue.QUERIES["crc_text"](spark, DATA).collect()}
    texts = tables.execute("select doc_id, text from documents order by doc_id").fetchall()
    assert len(got) == len(texts)
    for i, t in texts[::7]:
        assert all(got[i][n] == (None if t is None else plain_crc(t.encode(), *k)) for n, k in KINDS.items())


def test_crc_of_rows_of_any_length():
    rows = [bytes((7 * k + n) % 256 for k in range(n)) for n in (0, 1, 63, 64, 65, 128, 1000, 5000, 0, 4097)]
    for k in KINDS.values():
        assert checksums.crc_rows(rows, *k).tolist() == [plain_crc(x, *k) for x in rows] and len(checksums.crc_rows([], *k)) == 0
