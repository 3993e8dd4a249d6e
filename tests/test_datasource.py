"""The registered formats: what is written is read back, only the bytes that filters leave are read, growing files lose no frame."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespark.sources import datasource, files
from tonespark.sources.decode import decode, decode_float, encode


@pytest.fixture(scope="module")
def session(spark):
    datasource.register(spark)
    return spark


def rows_of(n_streams=3):
    return [(u, i, (i * 7919 * (u + 1)) % 65536 - 32768, (i * 31 * u) % 999 - 500) for u in range(1, n_streams + 1) for i in range(50 * u + 1)]


KINDS = [
    ("wave", 8, {}), ("wave", 16, {}), ("wave", 24, {}), ("wave", 32, {}), ("wave", 32, {"real": True}), ("wave", 64, {"real": True}),
    ("aiff", 16, {}), ("aiff", 24, {"little": False}), ("aiff", 32, {}), ("aiff", 32, {"real": True}), ("aiff", 64, {"real": True}), ("pcm", 24, {"little": False}), ("pcm", 16, {}),
]


@pytest.mark.parametrize(("form", "depth", "how"), KINDS)
def test_written_and_read(session, tmp_path, form, depth, how):
    rows, real, folder = rows_of(), how.get("real", False), f"{tmp_path}/out put"
    df = session.createDataFrame(rows, "user_id long, frame long, a long, b long").repartition(2, "user_id").sortWithinPartitions("user_id", "frame")
    scaled = df.select("user_id", "frame", *[(F.col(c) / 32768 if real else F.shiftright(c, 8) if depth == 8 else F.shiftleft(F.col(c), depth - 16)).alias(c) for c in "ab"])
    told = {"rate": 44_100, "depth": depth, **how}
    scaled.write.format(form).options(**told).mode("append").save(folder)
    reader = session.read.format(form).options(**({**told, "channels": 2} if form == "pcm" else {})).option("partitionBytes", 64)
    got = reader.load(folder).select(files.stream_of(F.col("path")).cast("long").alias("u"), "frame", "ch", "q", F.round(F.col("x") * 32768).alias("x")).collect()
    want = sorted((u, i, k, float(x >> 8 << 8 if depth == 8 else x)) for u, i, *both in rows for k, x in enumerate(both))
    assert sorted((r.u, r.frame, r.ch, r.x) for r in got) == want
    assert all((r.q is None) == real for r in got) and (real or {r.q * (1 << 16) / (1 << depth) for r in got} == {r.x for r in got})
    spread = reader.option("block", 16).load(folder)
    assert {r["first"] % 16 for r in spread.select("first").collect()} == {0}
    each = spread.selectExpr("path", "first", "ch", "posexplode(x) AS (i, x)").select(files.stream_of(F.col("path")).cast("long").alias("u"), (F.col("first") + F.col("i")).alias("frame"), "ch", F.round(F.col("x") * 32768).alias("x"))
    assert sorted(map(tuple, each.collect())) == want
    assert reader.schema("first long, x array<float>").load(folder).where("first >= 32 and first < 64").count() == 2 * (2 + 2 + 2)  # streams of 51, 101 and 151
    few = scaled.where("user_id = 2 and frame < 5")
    few.write.format(form).options(**told).mode("overwrite").save(folder)
    assert session.read.format(form).options(**({**told, "channels": 2} if form == "pcm" else {})).load(folder).count() == 10


class Counted:
    """A file system that counts what is read."""

    total = 0

    def __init__(self, system):
        self.system = system

    def open_input_file(self, path):
        self.f = self.system.open_input_file(path)
        return self

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        data = self.f.read(n)
        Counted.total += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.system, name)


def test_filters_leave_the_bytes_of_their_frames(session, tmp_path, monkeypatch):
    n = 100_000
    with open(tmp_path / "a.wav", "wb") as f:
        f.write(files.wave_head(n, 2, 48_000, 16, False) + (np.arange(2 * n) % 30_000).astype("<i2").tobytes())
    real = datasource._open
    monkeypatch.setattr(datasource, "_open", lambda path: (Counted(real(path)[0]), real(path)[1]))
    schema = T.StructType.fromDDL("frame long, x float")
    reader = datasource.Wave({"path": str(tmp_path), "partitionBytes": "40000", "pushFilters": "true"}).reader(schema)
    filters = [ds.GreaterThanOrEqual(("frame",), 50_000), ds.LessThan(("frame",), 50_100), ds.IsNotNull(("frame",)), ds.EqualTo(("x",), 0.5)]
    assert list(reader.pushFilters(filters)) == filters[3:]
    parts = reader.partitions()
    assert len(parts) == -(-(4 * n + 44) // 40_000)
    made = [b for p in parts for b in reader.read(p)]  # in one process, to count
    assert sum(b.num_rows for b in made) == 200 and made[0].schema.names == ["frame", "x"]
    assert Counted.total == 400 + 44 * len(parts)  # the frames, and the heads of chunks in each part
    none = datasource.Wave({"path": str(tmp_path), "pushFilters": "true"}).reader(schema)
    assert list(none.pushFilters([ds.GreaterThan(("frame",), 9), ds.LessThan(("frame",), 10)])) == [] and none.partitions() == []


def test_filters_by_plan(session, tmp_path):
    for k in range(3):
        with open(tmp_path / f"{k}.wav", "wb") as f:
            f.write(files.wave_head(1000, 2, 8000, 16, False) + (np.arange(2000) + 10_000 * k).astype("<i2").tobytes())
    (tmp_path / "notes.txt").write_text("no container")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.wav").write_bytes(b"RIFF")
    plain = session.read.format("wave").load(str(tmp_path))
    assert plain.count() == 6000 and plain.where("frame = 3 or ch = 1").count() == 3003 and plain.where("frame = 3").count() == 6 and plain.count() == 6000

    def where(*conditions):  # loaded anew by each query
        df = session.read.format("wave").option("pushFilters", True).load(str(tmp_path))
        for c in conditions:
            df = df.where(c)
        return df

    one = where((F.col("frame") > 10) & (F.col("frame") <= 12) & (F.col("ch") == 1) & (F.col("path") == f"{tmp_path}/1.wav"))
    assert sorted(r.q for r in one.collect()) == [10_023, 10_025]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert where("frame in (3, 5) and ch in (0, 7)").count() == 6 and where("frame = 3 or ch = 1").count() == 3003
    assert where("frame between 2 and 1").count() == 0 and where("frame > 999").count() == 0 and where().count() == 6000
    assert session.read.format("wave").option("firstFrame", 990).option("endFrame", 2000).load(str(tmp_path)).count() == 60
    assert session.read.format("aiff").load(str(tmp_path)).count() == 0
    with pytest.raises(PySparkException):
        session.read.format("wave").schema("frames long").load(str(tmp_path)).count()
    with pytest.raises(PySparkException):
        session.read.format("wave").load(f"{tmp_path}/none").count()


def test_writer_refuses_what_it_cannot_order(session, tmp_path):
    df = session.createDataFrame([(1, 0, 5), (1, 2, 6), (1, 1, 7)], "k long, frame long, v long").coalesce(1)
    for bad in (df, df.withColumn("k", F.lit(None).cast("long")), df.repartition(3, "frame")):
        with pytest.raises(PySparkException):
            bad.write.format("wave").mode("append").save(f"{tmp_path}/w")
    with pytest.raises(PySparkException):
        df.select("k", "v").write.format("wave").mode("append").save(f"{tmp_path}/w")
    assert not list(tmp_path.glob("w/*.wav"))
    df.where("false").write.format("wave").mode("append").save(f"{tmp_path}/w")
    assert not list(tmp_path.glob("w/*.wav"))


def run_once(session, folder, out, state, **options):
    q = session.readStream.format("wave").options(**options).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(state)).start(str(out))
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.mark.parametrize("told", ["sentinel", "whole"])
def test_growing_files_lose_and_repeat_nothing(session, tmp_path, told):
    """A file grows by parts that end within heads and frames; the query is stopped and goes on from its checkpoint."""
    n, folder = 500, tmp_path / "in"
    folder.mkdir()
    contents = {}
    for k in range(2):
        head = bytearray(files.wave_head(n, 2, 8000, 24, False))
        if told == "sentinel":
            head[40:44] = b"\xff" * 4
        contents[k] = bytes(head) + encode(np.arange(2 * n) * 7 + k, 3, True, False, False)
    cuts = {0: [20, 47, 48, 301, 301, len(contents[0])], 1: [0, 0, 50, 1000, 2000, len(contents[1])]}
    for step in range(6):
        for k, c in contents.items():
            if cuts[k][step]:
                (folder / f"{k}.wav").write_bytes(c[: cuts[k][step]])
        run_once(session, folder, tmp_path / "out", tmp_path / "state")
        got = session.read.schema(datasource.SAMPLES).parquet(str(tmp_path / "out"))
        assert got.count() == 2 * sum(max(0, cuts[k][step] - 44) // 6 for k in contents)
    rows = sorted((r.path[-5], r.frame, r.ch, r.q) for r in got.collect())
    assert rows == [(str(k), i, c, (2 * i + c) * 7 + k) for k in range(2) for i in range(n) for c in range(2)]


def test_growing_file_in_one_query(session, tmp_path):
    folder, head = tmp_path / "in", files.wave_head(1000, 1, 8000, 16, False)
    folder.mkdir()
    data = head + np.arange(1000).astype("<i2").tobytes()
    q = session.readStream.format("wave").option("block", 64).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).start(str(tmp_path / "o"))
    try:
        for cut in (100, 777, 778, len(data)):
            (folder / "a.wav").write_bytes(data[:cut])
            q.processAllAvailable()
    finally:
        q.stop()
    each = session.read.parquet(str(tmp_path / "o")).selectExpr("first", "posexplode(x) as (i, x)").selectExpr("first + i as frame", "x").collect()
    assert sorted((r.frame, round(r.x * 32768)) for r in each) == [(i, i) for i in range(1000)]


def test_single_precision_values_equal_the_others():
    raw = np.random.default_rng(1).integers(0, 256, 24 * 50, dtype=np.uint8).tobytes()
    for octets in (1, 2, 3, 4):
        for little in (True, False):
            for offset in (True, False):
                assert (decode_float(raw, octets, little, offset, False) == decode(raw, octets, little, offset, False)[1].astype(np.float32)).all()
    for octets in (4, 8):
        x = np.linspace(-1, 1, 50).astype(f">f{octets}").tobytes()
        assert (decode_float(x, octets, False, False, True) == decode(x, octets, False, False, True)[1].astype(np.float32)).all()


def many(folder, n):
    for k in range(n):
        (folder / f"{k:04}.wav").write_bytes(files.wave_head(3, 1, 8000, 16, False) + np.array([k, k + 1, k + 2], "<i2").tobytes())


def test_many_grown_files_are_few_tasks(tmp_path):
    """A piece a file would be as many tasks, each with a file of its own in the sink."""
    many(tmp_path, 2500)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("q", T.LongType())])
    for option in ({}, {"partitionBytes": "24000"}):
        reader = datasource.Wave({"path": str(tmp_path), **option}).streamReader(schema)
        end = reader.latestOffset()
        assert end["0007.wav"] == 50 and len(end) == 2500
        whole = {f"{tmp_path}/{p}": 47 for p in end}  # offsets of former versions have whole names; these end within frame 1
        for start, want in ((reader.initialOffset(), [0, 1, 2]), ({p: 47 for p in end}, [1, 2]), (whole, [1, 2])):
            parts = reader.partitions(start, end)
            assert 2 < len(parts) < 12
            batches = [b for p in parts for b in reader.read(p)]
            assert len(batches) == len(parts)
            got = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            assert got == [(f"{tmp_path}/{k:04}.wav", i, k + i) for k in range(2500) for i in want]


def test_a_file_that_grew_much_is_many_tasks(tmp_path):
    data = files.wave_head(1000, 1, 8000, 24, False) + encode(np.arange(1000), 3, True, False, False)
    (tmp_path / "a.wav").write_bytes(data)
    reader = datasource.Wave({"path": str(tmp_path), "partitionBytes": "500"}).streamReader(T.StructType([T.StructField("frame", T.LongType()), T.StructField("q", T.LongType())]))
    for old in (0, 20, 44, 45, 46, 47, 543, 544, 545, 2000, len(data) - 1):
        parts = reader.partitions({"a.wav": old}, reader.latestOffset())
        assert len(parts) == -(-(len(data) - old) // 500)
        got = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [(i, i) for i in range(max(0, old - 44) // 3, 1000)]


def test_many_small_files_are_read_by_several_tasks_in_few_batches(tmp_path):
    many(tmp_path, 2500)
    reader = datasource.Wave({"path": str(tmp_path)}).reader(T.StructType([T.StructField("path", T.StringType()), T.StructField("q", T.LongType())]))
    parts = reader.partitions()
    batches = [list(reader.read(p)) for p in parts]
    assert len(parts) == 3 and [len(b) for b in batches] == [1] * 3 and sum(b.num_rows for own in batches for b in own) == 7500
