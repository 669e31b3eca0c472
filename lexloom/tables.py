"""Table access and the few physical helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of files) of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side that is broadcast has at most so many bytes as it is written (compressed columns).
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast only after ``df``, evaluated once and written, has been found to have at most ``max_bytes``.

    Beyond the bound the written table is returned without a hint, and the join shuffles.
    """
    written, path = _written(df)
    fs, here = files(df.sparkSession, path)
    return F.broadcast(written) if fs.getContentSummary(here(path)).getLength() <= max_bytes else written


def files(spark: SparkSession, path: str):
    """(file system, path maker) for a path, wherever it is."""
    jvm = spark.sparkContext._jvm
    here = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return here(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), here


_reachable: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for Python workers, once per application.

    A small job asks the executors; only where one can't import the package it is sent to them
    with the application's files.
    """
    app = spark.sparkContext.applicationId
    if app in _reachable:
        return
    _reachable.add(app)

    def probe(batches):
        import importlib.util

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(importlib.util.find_spec("lexloom") is not None)], pa.int32())], ["found"])

    tasks = spark.sparkContext.defaultParallelism
    if spark.range(0, tasks, 1, tasks).mapInArrow(probe, "found int").where("found = 0").count():
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="lexloom-code-")  # code on the driver, served to the executors by Spark
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lexloom", "zip", os.path.dirname(package), os.path.basename(package)))


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: a table in fewer splits than there are cores is redistributed, a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_per_key(rows: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """One row per ``key``: of rows that share one the last by the columns ``newest``, then by all others.

    Only the rows of repeated keys are shuffled; the keys that repeat are found from the key column alone.
    """
    again = materialized(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key))
    others = [c for c in rows.columns if c != key]
    last = rows.join(again, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*newest, F.xxhash64(*others))).alias("__x"))
    return rows.join(again, key, "left_anti").select(*rows.columns).unionByName(last.select(key, *[F.col(f"__x.{c}").alias(c) for c in others]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_intermediate: list[tuple[SparkSession, str]] = []


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    _intermediate.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialized(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and survives lost executors. See release()."""
    return _written(df)[0]


def release() -> None:
    """Deletes all intermediate tables written so far; results that still read them must have been written before. Runs when the driver ends."""
    while _intermediate:
        spark, path = _intermediate.pop()
        try:
            fs, here = files(spark, path)
            fs.delete(here(path), True)
        except Exception:  # the session or its file system may be gone already  # noqa: BLE001
            shutil.rmtree(path, ignore_errors=True)


atexit.register(release)
