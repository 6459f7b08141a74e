"""Typed storage of the job, candidate and score tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.schemas import TABLES

PARTITIONED_BY_JOB = ("candidates", "scores")


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_table(frame: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Store a table as Parquet with its declared types; candidates and scores by job.

    Rows of a job are brought together to keep files few. The rebalance hint lets adaptive execution
    split a job that is larger than its neighbours over several tasks and files.
    """
    typed = frame.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[name].fields))
    if name in PARTITIONED_BY_JOB:
        typed.hint("rebalance", "job_id").write.mode(mode).partitionBy("job_id").parquet(
            _path(root, name)
        )
    else:
        typed.write.mode(mode).parquet(_path(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Load a stored table with its declared types; a filter on ``job_id`` prunes folders."""
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(_path(root, name)).select(*schema.fieldNames())
