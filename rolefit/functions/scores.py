"""Score arithmetic: coverage, two-document TF-IDF cosine, blending, thresholds."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit.functions.binding import let

# Smooth inverse document frequency over two documents: 1 for a term of both, this for a term of one.
IDF_OF_ONE = math.log(1.5) + 1.0
IDF_OF_ONE_SQUARED = IDF_OF_ONE * IDF_OF_ONE

# Weights of skill coverage, TF-IDF and embedding similarity.
WEIGHTS_WITH_EMBEDDING = (0.4, 0.3, 0.3)
WEIGHTS_WITHOUT_EMBEDDING = (0.5, 0.5)

# Thresholds of the report, of the display bands and of the mails.
REPORT_SHORTLIST, REPORT_REVIEW = 70.0, 40.0
BAND_HIGH, BAND_MID = 75.0, 50.0
MAIL_SHORTLIST = 80.0


def round2(value: Column) -> Column:
    """Two decimals, ties to even after scaling."""
    return F.rint(value * 100) / 100


def keyword_score(matched: Column, wanted: Column) -> Column:
    """Share of the wanted skills that matched, in percent; NULL if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(matched) / F.size(wanted) * 100)


def shared_sums(left: Column, right: Column) -> Column:
    """``struct<dot, sa, sb>`` over the terms two sorted count arrays share.

    Both arrays are merged by a sort inside the row; a shared term then sits next to itself.
    """

    def tagged(counts: Column, side: int) -> Column:
        return F.transform(
            counts,
            lambda c: F.struct(
                c["term"].alias("term"), F.lit(side).alias("side"), c["tf"].alias("tf")
            ),
        )

    def from_merged(merged: Column) -> Column:
        pairs = F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size(merged) - 1),
                lambda i: (i > 0)
                & (F.get(merged, i)["side"] == 1)
                & (F.get(merged, i)["term"] == F.get(merged, i - 1)["term"]),
            ),
            lambda i: F.struct(
                F.get(merged, i - 1)["tf"].alias("a"), F.get(merged, i)["tf"].alias("b")
            ),
        )

        def total(of: Column, x: str, y: str) -> Column:
            return F.aggregate(of, F.lit(0).cast("bigint"), lambda acc, p: acc + p[x] * p[y])

        return let(
            pairs,
            lambda p: F.struct(
                total(p, "a", "b").alias("dot"),
                total(p, "a", "a").alias("sa"),
                total(p, "b", "b").alias("sb"),
            ),
        )

    zero = F.lit(0).cast("bigint")
    nothing = F.struct(zero.alias("dot"), zero.alias("sa"), zero.alias("sb"))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), nothing).otherwise(
        let(F.sort_array(F.concat(tagged(left, 0), tagged(right, 1))), from_merged)
    )


def tfidf_score(dot: Column, sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """Cosine of two texts, 0-100, weighted as if the corpus were just these two.

    ``dot``, ``sa``, ``sb`` are the sums of tf products and squares over shared terms, ``na`` and
    ``nb`` the sums of squares over all terms of each text. All are integers, so the result does not
    depend on partitioning. NULL if neither text has a term, 0 if only one has.
    """
    k2, extra = F.lit(IDF_OF_ONE_SQUARED), F.lit(IDF_OF_ONE_SQUARED - 1.0)
    cosine = dot / F.sqrt((k2 * na - extra * sa) * (k2 * nb - extra * sb))
    return (
        F.when((na == 0) & (nb == 0), F.lit(None).cast("double"))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(round2(cosine * 100))
    )


def blend_scores(keyword: Column, tfidf: Column, semantic: Column) -> Column:
    """Weighted score of whatever is available; coverage alone if there is no TF-IDF value."""
    k3, t3, s3 = (F.lit(w) for w in WEIGHTS_WITH_EMBEDDING)
    k2, t2 = (F.lit(w) for w in WEIGHTS_WITHOUT_EMBEDDING)
    return round2(
        F.when(
            semantic.isNotNull() & tfidf.isNotNull(), keyword * k3 + tfidf * t3 + semantic * s3
        )
        .when(tfidf.isNotNull(), keyword * k2 + tfidf * t2)
        .otherwise(keyword)
    )


def cosine_score(left: Column, right: Column) -> Column:
    """Cosine of two vectors as 0-100, negative values as 0, NULL if either is missing."""
    a, b = left.cast("array<double>"), right.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v
        )

    def score(x: Column, y: Column) -> Column:
        return let(
            F.struct(
                dot(x, y).alias("xy"), F.sqrt(dot(x, x)).alias("x"), F.sqrt(dot(y, y)).alias("y")
            ),
            lambda s: F.when((s["x"] == 0) | (s["y"] == 0), F.lit(0.0)).otherwise(
                round2(F.greatest(F.lit(0.0), s["xy"] / (s["x"] * s["y"])) * 100)
            ),
        )

    return F.when(
        left.isNotNull() & right.isNotNull(), let(a, lambda x: let(b, lambda y: score(x, y)))
    )


def score_explanation(matched_count: Column, score: Column) -> Column:
    """One sentence that explains a score."""
    return F.concat(
        F.lit("Matched "),
        matched_count.cast("string"),
        F.lit(" skills ("),
        score.cast("string"),
        F.lit("%)."),
    )


def report_status(
    score: Column, shortlist: float = REPORT_SHORTLIST, review: float = REPORT_REVIEW
) -> Column:
    """Status shown in the report; a candidate without a score counts as 0."""
    value = F.coalesce(score, F.lit(0.0))
    return (
        F.when(value >= shortlist, F.lit("Shortlisted"))
        .when(value >= review, F.lit("Under Review"))
        .otherwise(F.lit("Not Recommended"))
    )


def score_band(score: Column, high: float = BAND_HIGH, mid: float = BAND_MID) -> Column:
    """Display band; NULL without a score."""
    return F.when(
        score.isNotNull(),
        F.when(score >= high, F.lit("high")).when(score >= mid, F.lit("mid")).otherwise("low"),
    )


def mail_status(score: Column, shortlist: float = MAIL_SHORTLIST) -> Column:
    """Outcome told to the candidate."""
    return F.when(score >= shortlist, F.lit("Shortlisted")).otherwise(F.lit("Rejected"))


def rank_badge(rank: Column, k: int = 3) -> Column:
    """``rank-1`` to ``rank-k`` for the first places, ``rank-other`` for the rest."""
    return F.when(rank <= k, F.concat(F.lit("rank-"), rank.cast("string"))).otherwise(
        F.lit("rank-other")
    )
