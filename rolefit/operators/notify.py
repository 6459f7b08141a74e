"""Mails to candidates, as rows for a sender to pick up."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions.contact import PLACEHOLDER_PREFIX
from rolefit.functions.scores import MAIL_SHORTLIST, mail_status

# Subject and body of the mails, and the prompts for a text generator.
SUBJECT = "Application Update: {job_title} — {status}"
SHORTLISTED_BODY = (
    "Dear {name},\n\n"
    "Congratulations! You have been shortlisted for the {job_title} position "
    "with a match score of {score}%. Your skills in {matched_skills} "
    "align well with what we are looking for.\n\n"
    "Our team will reach out soon with the next steps.\n\n"
    "Best regards,\nHiring Team"
)
REJECTED_BODY = (
    "Dear {name},\n\n"
    "Thank you for applying for the {job_title} position. After careful review, "
    "we found a gap in the following skills required for this role: {missing_skills}.\n\n"
    "We encourage you to build on these skills and apply again in the future.\n\n"
    "Best regards,\nHiring Team"
)
SHORTLISTED_PROMPT = (
    "Write a warm, professional email to a job candidate named {name} "
    "informing them they have been SHORTLISTED for the '{job_title}' position. "
    "Their resume match score was {score}%. Their matching skills: {matched_skills}. "
    "Mention 2-3 of these matched skills naturally, congratulate them, and say the hiring team "
    "will reach out soon with next steps. Keep it under 130 words. "
    "Output ONLY the email body text, no subject line, no placeholders like [Your Name]."
)
REJECTED_PROMPT = (
    "Write a polite, respectful, encouraging rejection email to a job candidate named {name} "
    "for the '{job_title}' position. Their resume match score was {score}%. "
    "The specific skills they were missing: {missing_skills}. "
    "Mention the missing skills as the constructive reason, encourage them to develop these skills "
    "and apply again in the future. Keep it under 130 words, positive tone. "
    "Output ONLY the email body text, no subject line, no placeholders like [Your Name]."
)
BODY_WITHOUT_SKILLS = ("the required areas", "a few key areas")
PROMPT_WITHOUT_SKILLS = ("relevant skills", "some required skills")

# What a mail is known by in the ledger of mails sent.
MAIL_KEY = ("candidate_id", "job_id", "status")


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template as a concatenation of literals and columns."""
    parts = []
    rest = template
    while rest:
        text, opened, tail = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if not opened:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)


def _values(without_skills: tuple[str, str]) -> dict[str, Column]:
    matched, missing = without_skills

    def named(column: str, fallback: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(fallback)).otherwise(
            F.col(column)
        )

    return {
        "name": F.col("name"),
        "job_title": F.col("job_title"),
        "status": F.col("status"),
        "score": F.col("matching_score"),
        "matched_skills": named("matched_skills", matched),
        "missing_skills": named("missing_skills", missing),
    }


def notification_decisions(profiles: DataFrame, shortlist: float = MAIL_SHORTLIST) -> DataFrame:
    """Scored candidates with a real address, and what they are told."""
    email = F.coalesce(F.col("email"), F.lit(""))
    return profiles.filter(
        F.col("matching_score").isNotNull()
        & (email != "")
        & ~F.startswith(email, F.lit(PLACEHOLDER_PREFIX))
    ).withColumn("status", mail_status(F.col("matching_score"), shortlist))


def _by_status(shortlisted: str, rejected: str, values: dict[str, Column]) -> Column:
    return F.when(F.col("status") == "Shortlisted", fill(shortlisted, values)).otherwise(
        fill(rejected, values)
    )


def notification_outbox(profiles: DataFrame, shortlist: float = MAIL_SHORTLIST) -> DataFrame:
    """One mail per candidate to be told, with the fixed texts."""
    values = _values(BODY_WITHOUT_SKILLS)
    return notification_decisions(profiles, shortlist).select(
        "candidate_id",
        "job_id",
        "email",
        "status",
        fill(SUBJECT, values).alias("subject"),
        _by_status(SHORTLISTED_BODY, REJECTED_BODY, values).alias("body"),
    )


def email_prompts(profiles: DataFrame, shortlist: float = MAIL_SHORTLIST) -> DataFrame:
    """One prompt per candidate to be told, for a text generator that runs elsewhere."""
    values = _values(PROMPT_WITHOUT_SKILLS)
    return notification_decisions(profiles, shortlist).select(
        "candidate_id",
        "job_id",
        "email",
        "status",
        _by_status(SHORTLISTED_PROMPT, REJECTED_PROMPT, values).alias("prompt"),
    )


def unsent_mails(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    """Mails of an outbox that the ledger ``sent(candidate_id, job_id, status)`` does not hold.

    A candidate is told once per job and status: screening again mails nobody twice, and a changed status
    mails again. Repeated mails of one key in the outbox leave one, the least by address and text. Keys
    with a null are compared as values.
    """
    mail = F.struct(*(c for c in outbox.columns if c not in MAIL_KEY))
    once = outbox.groupBy(*MAIL_KEY).agg(F.min(mail).alias("_mail"))
    told = sent.select(*(F.col(c).alias(f"_{c}") for c in MAIL_KEY)).distinct()
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MAIL_KEY))
    return once.join(told, same, "left_anti").select(*MAIL_KEY, "_mail.*").select(*outbox.columns)
