"""Placement of rows before row-local work, and results that later steps start from."""

from pyspark.sql import DataFrame

from rolefit.session import scratch_path


def spread_small_scan(frame: DataFrame, key: str) -> DataFrame:
    """Use all cores on a scan that has fewer splits than the cluster has cores.

    A file with one row group is read by one task, whatever the number of cores. Only such small
    inputs are shuffled; a scan that already has enough splits is returned as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, also after a lost task."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
