"""Candidate counts per job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_job(jobs: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    return jobs.select("job_id").join(counted, "job_id", "left").select(
        "job_id", F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)
    )


def processed_counts(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Résumés of each job that could be read and scored."""
    counted = scores.groupBy("job_id").agg(F.count("score_id").alias("processed"))
    return _per_job(jobs, counted, "processed")


def candidate_counts(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates listed for each job, scored or not."""
    counted = candidates.groupBy("job_id").agg(F.count(F.lit(1)).alias("candidates"))
    return _per_job(jobs, counted, "candidates")
