"""Tables and files in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or, unset and in local mode (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tonespark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/tonespark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and nothing reads any more."""
    for df in kept:
        _delete(df.sparkSession, df.kept_at)


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with the first of _2, _3 ... that makes it new where ``taken`` has it (case doesn't matter)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        new, k = name, 2
        while new.lower() in used:
            new, k = f"{name}_{k}", k + 1
        used.add(new.lower())
        out.append(new)
    return out


def with_order(docs: DataFrame, name: str = "key") -> DataFrame:
    """``docs`` with a column of longs that sort as doc_id does, null for null: doc_id itself if it is an integer.

    Other ids are sorted once, by ranges; their numbers are written and joined back.
    """
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id")
    places = keep(ids.select(F.col("doc_id").alias("of"), F.monotonically_increasing_id().alias(name)), "order")
    return docs.join(places, docs["doc_id"] == places["of"], "left").drop("of")


def mapped_dir(spark: SparkSession, name: str) -> str:
    """A shared folder that workers can memory-map, as a plain path; the shared file system has to be mounted."""
    url = urlparse(new_path(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder; spark.checkpoint.dir is {url.scheme}:")
    return url.path


def clear(spark: SparkSession) -> None:
    """Delete what this application has kept; the results that read it end with it."""
    _delete(spark, f"{shared_dir(spark)}/tonespark/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
