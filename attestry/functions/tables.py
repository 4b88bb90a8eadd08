"""Tables that jobs write between their steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to every task; slim rows, so some ten MB at most.
LOOKUP_ROWS = 100_000


def shared_dir(spark: SparkSession, name: str = "attestry") -> str:
    """A new folder below spark.checkpoint.dir. Only a local session without that setting (tests) gets a folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="attestry-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: computed once, read as often as needed."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", most: int = LOOKUP_ROWS) -> DataFrame:
    """rows joined with a table of one row a key, whatever the table's size and however hot a key of rows is.

    The table is counted up to `most` rows and broadcast if it has no more. A larger one is joined by a shuffle in which hot
    keys are split: a key of which rows has more than a quarter of a task's share (of these there are four times as many
    as tasks, at most) goes to as many tasks as there are, by the task that read the row, and its row of the table to all of them.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), on, how)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).count()
    hot = counts.where(F.col("count") > rows.count() / (4 * tasks)).select(*on, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(tasks))).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    copied = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")
