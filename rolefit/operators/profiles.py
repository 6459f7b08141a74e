"""Candidate profiles from résumé texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import contact, experience, names
from rolefit.functions.text import is_blank

# Fixed value: folder of the stored résumé files.
RESUME_FOLDER = "resumes/"


def resume_path(filename: Column) -> Column:
    """Where the file of a résumé is kept."""
    return F.concat(F.lit(RESUME_FOLDER), filename)


def profile_columns(text: Column, candidate_id: Column, filename: Column) -> dict[str, Column]:
    """Profile fields as expressions over one row. A text that could not be read gives defaults."""
    blank = is_blank(text)
    years = F.when(blank, F.lit(0).cast("bigint")).otherwise(
        experience.extract_experience_years(text)
    )
    return {
        "name": names.resolve_name(
            F.when(~blank, names.extract_labelled_name(text)), names.name_from_filename(filename)
        ),
        "email": F.when(blank, F.lit("")).otherwise(
            contact.email_or_placeholder(contact.extract_email(text), candidate_id)
        ),
        "phone": F.when(blank, F.lit("")).otherwise(
            contact.phone_or_blank(contact.extract_phone(text))
        ),
        "experience_years": years,
    }


def parse_profiles(resumes: DataFrame) -> DataFrame:
    """One candidate row per résumé, extracted without leaving the row's task."""
    fields = profile_columns(F.col("resume_text"), F.col("candidate_id"), F.col("filename"))
    return resumes.select(
        "candidate_id",
        *(column.alias(name) for name, column in fields.items()),
        resume_path(F.col("filename")).alias("resume_path"),
        "job_id",
        "created_at",
    ).select(
        "candidate_id",
        "name",
        "email",
        "phone",
        "experience_years",
        experience.experience_level(F.col("experience_years")).alias("experience_level"),
        "resume_path",
        "job_id",
        "created_at",
    )
