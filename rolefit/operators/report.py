"""The candidate report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.functions import scores as sc
from rolefit.functions.experience import format_experience

# Report columns, placeholder and date format.
REPORT_COLUMNS = (
    "Candidate Name",
    "Email",
    "Phone",
    "Applied Job",
    "Experience",
    "Match Score",
    "Status",
    "Matched Skills",
    "Missing Skills",
    "AI Explanation",
    "Applied Date",
)
NOT_AVAILABLE = "N/A"
DATE_FORMAT = "yyyy-MM-dd HH:mm"


def candidate_report(profiles: DataFrame, *extra: str) -> DataFrame:
    """The report columns of candidates joined with their job and score, plus ``extra`` ones.

    Columns are display strings. A candidate without a score shows 0.0% and N/A.
    """
    score = F.coalesce(F.col("matching_score"), F.lit(0.0))

    def of_score(column: str):
        return F.when(F.col("score_id").isNull(), F.lit(NOT_AVAILABLE)).otherwise(F.col(column))

    values = (
        F.col("name"),
        F.col("email"),
        F.col("phone"),
        F.coalesce(F.col("job_title"), F.lit(NOT_AVAILABLE)),
        format_experience(F.col("experience_level"), F.col("experience_years")),
        F.concat(score.cast("string"), F.lit("%")),
        sc.report_status(score),
        of_score("matched_skills"),
        of_score("missing_skills"),
        of_score("explanation"),
        F.coalesce(F.date_format("created_at", DATE_FORMAT), F.lit(NOT_AVAILABLE)),
    )
    return profiles.select(
        *(value.alias(name) for name, value in zip(REPORT_COLUMNS, values, strict=True)), *extra
    )
