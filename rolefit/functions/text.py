"""Tokens, term counts and whitespace handling."""

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.binding import let

TERM_COUNTS_TYPE = "array<struct<term:string,tf:bigint>>"

# Runs of at least two letters, digits or underscores in any script. Combining marks do not count,
# which is why \w (with the Unicode flag) is not used. ASCII is decided first, so that the blanks and
# marks between words cost no look at a character's category.
TERM_PATTERN = r"[a-z0-9_[\x{80}-\x{10FFFF}&&[\p{L}\p{N}]]]{2,}+"


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    """The public English stop list the similarity score is defined with, one word per line."""
    listing = resources.files("rolefit").joinpath("data/english_stop_words.txt")
    return tuple(listing.read_text(encoding="utf-8").split())


@lru_cache(maxsize=1)
def decimal_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit with its ASCII value, as two aligned strings."""
    chars = [
        chr(c)
        for c in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def is_blank(text: Column) -> Column:
    """No text at all. Whitespace alone counts as text."""
    return text.isNull() | (text == "")


def head_of_stripped(text: Column, length: int) -> Column:
    """The first ``length`` characters once leading whitespace is gone, in one anchored match."""
    return F.regexp_extract(text, rf"(?sU)^[\s\x1C-\x1F]*+(.{{0,{length}}})", 1)


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def terms(column: str, stop_words: Iterable[str] | None = None) -> Column:
    """Terms of a text column in order of appearance, repeats included, stop words left out.

    Written in SQL because a long word list is parsed there in one call.
    """
    stops = default_stop_words() if stop_words is None else tuple(stop_words)
    found = f"regexp_extract_all(lower(`{column}`), r'{TERM_PATTERN}', 0)"
    if stops:
        found = f"filter({found}, t -> t NOT IN ({', '.join(map(_quoted, stops))}))"
    return F.expr(found)


def term_counts(column: str, stop_words: Iterable[str] | None = None) -> Column:
    """``array<struct<term, tf>>`` sorted by term of a text column; empty if it has no terms.

    Counting happens inside the row: sort the terms, mark where a new one starts, and take the
    distance to the next mark. No row leaves its task, so counting a corpus needs no shuffle.
    """

    def from_sorted(run: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(run) - 1),
            lambda i: (i == 0) | (F.get(run, i) != F.get(run, i - 1)),
        )
        return let(
            starts,
            lambda marks: F.transform(
                marks,
                lambda start, k: F.struct(
                    F.get(run, start).alias("term"),
                    (F.coalesce(F.get(marks, k + 1), F.size(run)) - start)
                    .cast("bigint")
                    .alias("tf"),
                ),
            ),
        )

    return let(
        F.sort_array(F.coalesce(terms(column, stop_words), F.array().cast("array<string>"))),
        lambda run: F.when(F.size(run) > 0, from_sorted(run)).otherwise(
            F.array().cast(TERM_COUNTS_TYPE)
        ),
    )


def sum_of_squares(counts: Column) -> Column:
    """Sum of the squared counts, as an integer."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c["tf"] * c["tf"])


def word_tokens(lowered: Column) -> Column:
    """Distinct ``[a-z0-9]+`` runs of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))
