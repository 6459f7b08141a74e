"""E-mail address and phone number of a candidate."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as an address or a number. The address pattern is
# anchored to the start of a run and reads it possessively, which finds the same first match but
# stays linear on long runs without an "@". The number pattern first looks at one character.
EMAIL_PATTERN = r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?U)(?=[+\d])(?:\+?\d{10,13}|\+?\d{2,4}[\s\x1C-\x1F\-]?\d{6,8})"

# The placeholder address of a candidate without one.
PLACEHOLDER_PREFIX = "noemail_"
PLACEHOLDER_DOMAIN = "@ats.local"


def extract_email(text: Column) -> Column:
    """First e-mail address in the text, else an empty string."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract(text, EMAIL_PATTERN, 0)).otherwise(
        F.lit("")
    )


def extract_phone(text: Column) -> Column:
    """First phone-like number in the text, else an empty string."""
    return F.coalesce(F.regexp_extract(text, PHONE_PATTERN, 0), F.lit(""))


def email_or_placeholder(email: Column, candidate_id: Column) -> Column:
    """A missing address becomes a placeholder that carries the candidate's id."""
    placeholder = F.concat(
        F.lit(PLACEHOLDER_PREFIX), candidate_id.cast("string"), F.lit(PLACEHOLDER_DOMAIN)
    )
    return F.when(F.coalesce(email, F.lit("")) == "", placeholder).otherwise(email)


def phone_or_blank(phone: Column) -> Column:
    """A missing number becomes an empty string."""
    return F.coalesce(phone, F.lit(""))
