"""Deletes with their dependants."""

from pyspark.sql import DataFrame

from rolefit.plans.joins import sized_join


def delete_jobs(
    ids: DataFrame, jobs: DataFrame, candidates: DataFrame, scores: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The jobs, candidates and scores that remain once the jobs in ``ids(job_id)`` are gone.

    A score goes with its job and with its candidate.
    """
    gone = ids.select("job_id").distinct()
    gone_candidates = sized_join(
        candidates.select("candidate_id", "job_id"), gone, ["job_id"], "left_semi", "candidate_id"
    ).select("candidate_id")
    remaining_scores = sized_join(scores, gone, ["job_id"], "left_anti", "score_id").join(
        gone_candidates, "candidate_id", "left_anti"
    )
    return (
        sized_join(jobs, gone, ["job_id"], "left_anti", "job_id"),
        sized_join(candidates, gone, ["job_id"], "left_anti", "candidate_id"),
        remaining_scores.select(*scores.columns),
    )


def delete_candidates(
    ids: DataFrame, candidates: DataFrame, scores: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The candidates and scores that remain once the candidates in ``ids(candidate_id)`` are gone."""
    gone = ids.select("candidate_id").distinct()
    return (
        sized_join(candidates, gone, ["candidate_id"], "left_anti"),
        sized_join(scores, gone, ["candidate_id"], "left_anti", "score_id"),
    )
