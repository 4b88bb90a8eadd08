"""Sinks of foreachBatch that a batch may run twice on, and a gate that puts late rows aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def write_once(rows: DataFrame, path: str, batch: int) -> None:
    """rows as the folder batch_id=<batch> of the table at path. A batch that is there already is left as it is.

    The folder is written beside the table and appears by one rename, so readers and a second run see a whole batch or none;
    what a run left behind half-written is replaced.
    """
    spark, target, staged = rows.sparkSession, f"{path}/batch_id={batch}", f"{path}/_staged/{batch}"
    if exists(spark, target):
        return
    rows.write.mode("overwrite").parquet(staged)
    store, source = _at(spark, staged)
    if not store.rename(source, _at(spark, target)[1]):
        raise OSError(f"{staged} could not be renamed to {target}")


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of the table at path; no rows before there is one."""
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*none.columns) if exists(spark, path) else none


def gate(path: str, late: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (ts) that are in time go to path/main, later ones to path/side, each batch once.

    A row is late if its ts isn't above the watermark of the batch before: the newest ts of all batches before, less `late`.
    That is the newest of the batch before and its own predecessor's, kept in path/marks, so one row is read a batch. Rows
    without a ts are late. A stateful query with the same lateness over path/main drops nothing: its watermark, made from
    these rows alone, never runs ahead of the gate's. main and side together are the input.
    """

    def batch(rows: DataFrame, k: int) -> None:
        spark = rows.sparkSession
        schema = "ts timestamp"
        before = spark.read.schema(schema).parquet(f"{path}/marks/batch_id={k - 1}") if exists(spark, f"{path}/marks/batch_id={k - 1}") else spark.createDataFrame([], schema)
        mark = before.agg(F.max("ts")).first()[0]
        limit = F.lit(mark).cast("timestamp") - F.expr(f"interval {late}")
        missed = F.coalesce(F.col("ts") <= limit, F.col("ts").isNull())
        write_once(rows.where(~missed), f"{path}/main", k)
        write_once(rows.where(missed), f"{path}/side", k)
        write_once(rows.select(F.col("ts").cast("timestamp").alias("ts")).union(before).agg(F.max("ts").alias("ts")), f"{path}/marks", k)

    return batch
