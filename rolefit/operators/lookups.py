"""Lookups over the stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.plans.joins import sized_join

SCORE_FIELDS = (
    "score_id",
    "matching_score",
    "matched_skills",
    "missing_skills",
    "explanation",
)


def first_score(scores: DataFrame) -> DataFrame:
    """The score row of each candidate that was written first, combined before the shuffle.

    Earlier times come first, then lower ids; the other columns settle what is still equal.
    """
    row = F.struct(*(F.col(c) for c in SCORE_FIELDS))
    return (
        scores.groupBy("candidate_id")
        .agg(F.min_by(row, F.struct("created_at", "score_id", row)).alias("first"))
        .select("candidate_id", "first.*")
    )


def candidate_profiles(candidates: DataFrame, jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with the title of their job and, where there is one, their first score."""
    titled = sized_join(
        candidates,
        jobs.select("job_id", F.col("title").alias("job_title")),
        ["job_id"],
        spread="candidate_id",
    )
    return titled.join(first_score(scores), "candidate_id", "left")


def candidates_for_job(candidates: DataFrame, jobs: DataFrame, job_id: int) -> DataFrame:
    """Candidates of one job, none if the job does not exist. Prunes to the job's partition."""
    job = jobs.filter(F.col("job_id") == job_id).select("job_id").limit(1)
    return candidates.filter(F.col("job_id") == job_id).join(
        F.broadcast(job), "job_id", "left_semi"
    )
