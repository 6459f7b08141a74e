"""Skills of a corpus against a vocabulary table, and stored skill lists as rows."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import skills as sk
from rolefit.functions.binding import explode_once
from rolefit.functions.text import word_tokens
from rolefit.plans.joins import fits_broadcast, salted_join


@dataclass(frozen=True)
class VocabularySize:
    """Measured rows and bytes of a vocabulary, and of its skills that need a pattern."""

    rows: int
    bytes: int
    other_rows: int
    other_bytes: int

    @property
    def index_bound(self) -> int:
        """Upper bound of the index: the skill, its token, its pattern and fixed parts per row."""
        return 4 * self.bytes + 160 * self.rows


def vocabulary_size(vocabulary: DataFrame) -> VocabularySize:
    """Measure a vocabulary once, in one scan."""
    skill = F.col("skill")
    length = F.octet_length(skill)
    other = ~sk.is_plain(skill)

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return VocabularySize(
        *vocabulary.agg(
            F.count(skill),
            total(length),
            F.count_if(other),
            total(F.when(other, length)),
        ).first()
    )


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary keyed by the first token of each skill, with the pattern to confirm it."""
    skill = F.col("skill")
    return (
        vocabulary.select("skill")
        .filter(F.coalesce(skill, F.lit("")) != "")
        .distinct()
        .select(
            sk.first_token(skill).alias("token"),
            "skill",
            F.when(~sk.is_plain(skill), sk.boundary_pattern(skill)).alias("pattern"),
        )
    )


def _tokens(texts: DataFrame, key: str, *carried) -> DataFrame:
    # The empty token stands for the text itself: skills without letters or digits are keyed by it,
    # and so is the row that keeps a text in the result which has no skill at all.
    tokens = F.array_union(
        word_tokens(F.col("lowered")), F.array(F.lit("")).cast("array<string>")
    )
    return texts.select(key, *carried, explode_once(tokens).alias("token"))


def skill_hits(
    texts: DataFrame,
    vocabulary: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int | None = None,
    size: VocabularySize | None = None,
) -> DataFrame:
    """``(key, skill)`` rows, plus one row with a NULL skill per text.

    Every text is tokenised once and met with the vocabulary by equality of tokens. Only a skill that
    is more than one run of letters and digits is confirmed by its pattern, and only in texts that
    contain its first token. With a vocabulary that fits, texts do not move. With one that does not,
    tokens are shuffled alone, and texts only where a pattern has to be confirmed.
    """
    texts = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("lowered"))
    # A byte search rules out most hits before a pattern is compiled for them.
    fits = F.contains("lowered", "skill") & F.rlike(F.col("lowered"), F.col("pattern"))
    index = vocabulary_index(vocabulary)
    every_text = texts.sparkSession.range(1).select(
        F.lit("").alias("token"),
        F.lit(None).cast("string").alias("skill"),
        F.lit(None).cast("string").alias("pattern"),
    )
    index = index.unionByName(every_text)
    size = size or vocabulary_size(vocabulary)
    if fits_broadcast(index, limit, size.index_bound):
        found = _tokens(texts, key, "lowered").join(F.broadcast(index), "token")
        return found.filter(F.col("pattern").isNull() | fits).select(key, "skill")
    found = salted_join(_tokens(texts, key), index, ["token"], spread=key)
    settled = found.filter(F.col("pattern").isNull()).select(key, "skill")
    confirmed = (
        found.filter(F.col("pattern").isNotNull())
        .join(texts, key)
        .filter(fits)
        .select(key, "skill")
    )
    return settled.unionByName(confirmed)


def extract_skills(
    texts: DataFrame,
    vocabulary: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int | None = None,
    size: VocabularySize | None = None,
) -> DataFrame:
    """One row per text with its sorted distinct skills; an empty array where there are none."""
    return (
        skill_hits(texts, vocabulary, key, text, limit, size)
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    )


def explode_skills(scores: DataFrame) -> DataFrame:
    """One row per candidate and skill, marked matched or missing."""

    def tagged(column: str, kind: str) -> Column:
        return F.transform(
            sk.split_skills(F.col(column)),
            lambda s: F.struct(s.alias("skill"), F.lit(kind).alias("kind")),
        )

    tags = F.concat(tagged("matched_skills", "matched"), tagged("missing_skills", "missing"))
    return (
        scores.select("candidate_id", "job_id", explode_once(tags).alias("tag"))
        .select("candidate_id", "job_id", "tag.skill", "tag.kind")
        .filter(F.col("skill").isNotNull())
    )
