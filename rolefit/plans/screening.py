"""Screening in one pass: profile and score of every résumé without leaving its row."""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions.experience import experience_level
from rolefit.functions.text import is_blank
from rolefit.operators.profiles import profile_columns, resume_path
from rolefit.operators.scoring import features_bound, job_features, pair_columns, score_columns
from rolefit.operators.skills import vocabulary_size
from rolefit.plans.joins import sized_join


@dataclass(frozen=True)
class PreparedJobs:
    """Features and title of every job, and an upper bound of their size in bytes."""

    features: DataFrame
    bound: int


def prepare_jobs(
    jobs: DataFrame, vocabulary: DataFrame, stop_words: Iterable[str] | None = None
) -> PreparedJobs:
    """Everything screening needs from the jobs and the vocabulary."""
    size = vocabulary_size(vocabulary)
    titles = jobs.select("job_id", F.col("title").alias("job_title"))
    features = job_features(jobs, vocabulary, stop_words, size).join(titles, "job_id")
    return PreparedJobs(features, features_bound(jobs, size))


def screen_prepared(
    resumes: DataFrame,
    prepared: PreparedJobs,
    stop_words: Iterable[str] | None = None,
    limit: int | None = None,
    semantic: DataFrame | None = None,
    keep_unknown: bool = False,
) -> DataFrame:
    """``screen_resumes`` for jobs that have been prepared.

    With ``keep_unknown``, résumés of other jobs are returned too, as they are in ``waiting`` and with
    no score; ``waiting`` is NULL for the screened ones.
    """
    paired = sized_join(
        resumes,
        prepared.features.withColumn("known", F.lit(True)) if keep_unknown else prepared.features,
        ["job_id"],
        "left" if keep_unknown else "inner",
        spread="candidate_id",
        limit=limit,
        bound=prepared.bound,
    )
    profile = profile_columns(F.col("resume_text"), F.col("candidate_id"), F.col("filename"))
    parsed = paired.select(
        "candidate_id",
        "job_id",
        "job_title",
        "created_at",
        resume_path(F.col("filename")).alias("resume_path"),
        is_blank(F.col("resume_text")).alias("blank"),
        "job_skills",
        *([F.when(F.col("known").isNull(), F.struct(*resumes.columns)).alias("waiting")] if keep_unknown else []),
        *(column.alias(name) for name, column in profile.items()),
        *(column.alias(name) for name, column in pair_columns(stop_words).items()),
    )

    if semantic is None:
        parsed = parsed.withColumn("semantic", F.lit(None).cast("double"))
    else:
        parsed = parsed.join(semantic.select("candidate_id", "semantic"), "candidate_id", "left")

    def if_readable(column: Column) -> Column:
        readable = ~F.col("blank")
        return F.when(readable & F.col("waiting").isNull() if keep_unknown else readable, column)

    return score_columns(
        parsed,
        "candidate_id",
        "name",
        "email",
        "phone",
        "experience_years",
        experience_level(F.col("experience_years")).alias("experience_level"),
        "resume_path",
        "job_id",
        "created_at",
        "job_title",
        *(["waiting"] if keep_unknown else []),
        wrap=if_readable,
    )


def screen_resumes(
    resumes: DataFrame,
    jobs: DataFrame,
    vocabulary: DataFrame,
    stop_words: Iterable[str] | None = None,
    limit: int | None = None,
    semantic: DataFrame | None = None,
) -> DataFrame:
    """Candidate, job title and score of every résumé, as one row.

    The same rows as ``candidate_profiles`` over freshly parsed and scored tables, but each text is
    read once and, with jobs that fit, nothing is shuffled. The score is NULL for a résumé that could
    not be read. ``semantic(candidate_id, semantic)``, one row per candidate, adds embedding
    similarity; it meets the parsed rows, which carry no text.
    """
    prepared = prepare_jobs(jobs, vocabulary, stop_words)
    return screen_prepared(resumes, prepared, stop_words, limit, semantic)
