"""Cutting lineage between the turns of a loop, and spreading work over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context, or, only if there is neither, one in the warehouse."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    there = sc._jsc.sc().getCheckpointDir()
    if there.isEmpty():
        sc.setCheckpointDir(told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
        there = sc._jsc.sc().getCheckpointDir()
    return told or there.get()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, to go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> int:
    """Into how many tasks few rows of much work go: adaptive execution would put them into one."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)


def shares(rows: DataFrame, most: int = 500_000) -> int:
    """Into how many tasks rows go so that each has about `most`: adaptive execution goes by compressed bytes, which say little of what a sort or a table of groups then holds."""
    return max(spread(rows), rows.count() // most + 1)
