"""Candidate names, from a label in the text or from the file name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.binding import let
from rolefit.functions.text import head_of_stripped

# Where a labelled name is looked for, what the label looks like, and how many words
# make a name.
LABEL_SEARCH_LENGTH = 600
LABELLED_NAME_PATTERN = (
    r"(?iU)(?:full[\s\x1C-\x1F]*name|name)[\s\x1C-\x1F]*[:\-][\s\x1C-\x1F]*"
    r"([A-Za-z][A-Za-z.'\-]*(?:[ \t]+[A-Za-z][A-Za-z.'\-]*){0,3})"
)
MIN_NAME_WORDS = 2
MAX_NAME_WORDS = 4

CASED_CHARACTER = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def title_case(value: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the others.

    ``initcap`` only looks at blanks; here any character without case starts a new word. Lower case is
    taken from the whole value, where a letter may depend on its place, unless that changes its length.
    """

    def from_chars(chars: Column, lowered: Column) -> Column:
        same = F.size(lowered) == F.size(chars)
        return F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(
                    (i > 0) & F.get(chars, i - 1).rlike(CASED_CHARACTER),
                    F.when(same, F.get(lowered, i)).otherwise(F.lower(c)),
                ).otherwise(F.initcap(c)),
            ),
            "",
        )

    return let(
        value,
        lambda whole: let(
            F.split(whole, ""),
            lambda chars: let(F.split(F.lower(whole), ""), lambda low: from_chars(chars, low)),
        ),
    )


def extract_labelled_name(text: Column) -> Column:
    """The name behind the first ``Name:`` label near the top, NULL unless it has 2-4 words."""

    def accept(found: Column) -> Column:
        words = F.size(F.split(found, "[ \t]+"))
        return F.when(
            (found != "") & words.between(MIN_NAME_WORDS, MAX_NAME_WORDS), title_case(found)
        )

    top = head_of_stripped(text, LABEL_SEARCH_LENGTH)
    return let(F.regexp_extract(top, LABELLED_NAME_PATTERN, 1), accept)


def name_from_filename(filename: Column) -> Column:
    """File name without its last extension, separators as blanks, in title case."""
    stem = F.regexp_replace(filename, r"\.[^.]*\z", "")
    return title_case(F.translate(stem, "_-", "  "))


def resolve_name(labelled: Column, from_file: Column) -> Column:
    """The labelled name where there is one."""
    return F.coalesce(labelled, from_file)
