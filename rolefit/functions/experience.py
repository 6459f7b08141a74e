"""Years of experience and the level derived from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.text import decimal_digits

# Phrases that state years, in order of preference. Digit runs are read whole and
# possessively, so that a long run of digits costs one pass.
EXPERIENCE_PATTERNS = (
    r"(?iU)(?<!\d)(\d++)\+?[\s\x1C-\x1F]*years?[\s\x1C-\x1F]*(?:of[\s\x1C-\x1F]*)?experience",
    r"(?iU)experience[\s\x1C-\x1F]*(?:of[\s\x1C-\x1F]*)?(\d++)\+?[\s\x1C-\x1F]*years?",
    r"(?iU)(?<!\d)(\d++)\+?[\s\x1C-\x1F]*yrs?[\s\x1C-\x1F]*(?:of[\s\x1C-\x1F]*)?experience",
)
NO_EXPERIENCE_WORD = r"(?iU)fresher"

# Highest number of years of each level.
FRESHER_YEARS = 1
JUNIOR_YEARS = 3


def _years_from(text: Column, pattern: str) -> Column:
    foreign, ascii_digits = decimal_digits()
    digits = F.translate(F.regexp_extract(text, pattern, 1), foreign, ascii_digits)
    return F.nullif(digits, F.lit(""))


def extract_experience_years(text: Column) -> Column:
    """Stated years: the first phrase that occurs decides, a fresher has none, default 0.

    If its number is too large to be one, the phrase still decides, and the years are 0.
    """
    stated = F.coalesce(*(_years_from(text, p) for p in EXPERIENCE_PATTERNS)).try_cast("bigint")
    return (
        F.when(~text.rlike(r"(?iU)experience"), F.lit(0))
        .when(text.rlike(NO_EXPERIENCE_WORD), F.lit(0))
        .otherwise(F.coalesce(stated, F.lit(0)))
        .cast("bigint")
    )


def experience_level(years: Column) -> Column:
    """Fresher, Junior or Senior; unknown years are a fresher's."""
    return (
        F.when(years.isNull() | (years <= FRESHER_YEARS), F.lit("Fresher"))
        .when(years <= JUNIOR_YEARS, F.lit("Junior"))
        .otherwise(F.lit("Senior"))
    )


def format_experience(level: Column, years: Column) -> Column:
    """``Senior (5 Yrs)``, or the level alone when no years are known."""
    return F.when(
        years > 0, F.concat(level, F.lit(" ("), years.cast("string"), F.lit(" Yrs)"))
    ).otherwise(level)
