"""Frames out of order, lost and late, over several micro-batches and a restart from the checkpoint."""

import os

from tonespark.streaming import jitter


def test_order_loss_and_lateness(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [
        [(1, 0, 0, 10), (1, 2, 1, 12), (2, 0, 0, 90), (2, 1, 1, 91)],  # 1's frame 1 is missing
        [(1, 1, 1, 11), (1, 3, 2, 13), (1, 6, 3, 16), (2, 3, 3, 93)],  # it comes; now 4 and 5 are, and 2's frame 2
        [(2, 4, 20, 94), (1, 7, 20, 17)],  # the watermark passes the wait
        [(1, 4, 21, 14), (1, 8, 21, 18), (2, 2, 21, 92), (1, 8, 21, 99), (None, 1, 21, 1), (1, None, 21, 1)],  # too late, and twice
        [(1, 9, 60, 19), (2, 5, 60, 95)],
    ]
    schema = "user_id long, frame long, second long, q long"
    got = []
    for k, rows in enumerate(batches):  # each a query of its own, from the checkpoint of the one before
        part = tmp_path / f"part{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        os.rename(file, folder / f"{k}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(folder)).selectExpr("user_id", "frame", "timestamp_seconds(second + 1000) as ts", "q")
        out = jitter.in_order(stream, "5 seconds")
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        got.append(sorted(map(tuple, spark.read.schema(jitter.OUT).parquet(str(tmp_path / "out")).collect())))
    new = [sorted(set(b) - set(a)) for a, b in zip([[], *got], got, strict=False)]
    assert new[0] == [(1, 0, 10, "ok"), (2, 0, 90, "ok"), (2, 1, 91, "ok")]
    assert new[1] == [(1, 1, 11, "ok"), (1, 2, 12, "ok"), (1, 3, 13, "ok")]
    assert new[2] == [(1, 4, 13, "held"), (1, 5, 13, "held"), (1, 6, 16, "ok"), (1, 7, 17, "ok"), (2, 2, 91, "held"), (2, 3, 93, "ok"), (2, 4, 94, "ok")]
    assert new[3] == [(1, 4, 14, "late"), (1, 8, 18, "ok"), (2, 2, 92, "late")]
    assert new[4] == [(1, 9, 19, "ok"), (2, 5, 95, "ok")]
    assert len(got[-1]) == len(set(got[-1]))
