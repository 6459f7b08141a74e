"""Term frequencies, TF-IDF cosine and embedding cosine between résumés and jobs."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from rolefit.functions import scores as sc
from rolefit.functions.binding import explode_once, let
from rolefit.functions.text import sum_of_squares, term_counts
from rolefit.plans.joins import fits_broadcast, salted_join, sized_join, text_size
from rolefit.session import scratch_path


def term_frequencies(
    texts: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """``(key, term, tf)`` rows, counted inside each text's row."""
    return (
        texts.select(key, explode_once(term_counts(text, stop_words)).alias("c"))
        .select(key, "c.term", "c.tf")
        .filter(F.col("term").isNotNull())
    )


def job_terms(jobs: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Term counts of each job description and the sum of their squares, computed once per job."""
    return jobs.select(
        "job_id", term_counts("description", stop_words).alias("job_terms")
    ).select("job_id", "job_terms", sum_of_squares(F.col("job_terms")).alias("nb"))


def job_terms_bound(jobs: DataFrame) -> int:
    """Upper bound of ``job_terms`` in bytes, from the measured texts.

    A term takes at least three bytes of text (two and a separator) and at most 48 more than its own
    as a counted entry.
    """
    rows, text_bytes = text_size(jobs, "description")
    return 24 * text_bytes + 256 * rows


def tfidf_of_pair(
    text: str, job_terms_column: Column, nb: Column, stop_words: Iterable[str] | None = None
) -> Column:
    """TF-IDF score of a text column and the prepared terms of its job, inside the row."""
    return let(
        term_counts(text, stop_words),
        lambda counts: let(
            F.struct(
                sc.shared_sums(counts, job_terms_column).alias("s"),
                sum_of_squares(counts).alias("na"),
            ),
            lambda v: sc.tfidf_score(v["s"]["dot"], v["s"]["sa"], v["s"]["sb"], v["na"], nb),
        ),
    )


def tfidf_applied(
    resumes: DataFrame, jobs: DataFrame, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """TF-IDF score of every résumé with the job it was sent to."""
    paired = sized_join(
        resumes.select("candidate_id", "job_id", "resume_text"),
        job_terms(jobs, stop_words),
        ["job_id"],
        spread="candidate_id",
        bound=job_terms_bound(jobs),
    )
    return paired.select(
        "candidate_id",
        "job_id",
        tfidf_of_pair("resume_text", F.col("job_terms"), F.col("nb"), stop_words).alias(
            "tfidf"
        ),
    )


def resume_terms(resumes: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Term counts of each résumé and the sum of their squares, computed once per text."""
    return resumes.select(
        "candidate_id", term_counts("resume_text", stop_words).alias("counts")
    ).select("candidate_id", "counts", sum_of_squares(F.col("counts")).alias("na"))


def paired_only(resumes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The résumés that occur in ``pairs``, if those ids can be told to every task; else all."""
    ids = pairs.select("candidate_id").distinct()
    if fits_broadcast(ids):
        return resumes.join(F.broadcast(ids), "candidate_id", "left_semi")
    return resumes


def meet_pairs(
    pairs: DataFrame, of_resumes: DataFrame, of_jobs: DataFrame, bound: int
) -> DataFrame:
    """Every row of ``pairs(candidate_id, job_id)`` with the features of both its sides.

    Features move, texts do not. A candidate or a job may hold any share of the pairs: its rows are
    spread, by keys counted in ``pairs`` alone. A side that is unknown gives NULLs.
    """
    keys = pairs.select("candidate_id", "job_id")
    with_resume = salted_join(keys, of_resumes, ["candidate_id"], "left", "job_id")
    return sized_join(
        with_resume, of_jobs, ["job_id"], "left", "candidate_id", bound=bound, counted=keys
    )


def tfidf_of_counts(counts: Column, na: Column, terms_of_job: Column, nb: Column) -> Column:
    """TF-IDF score of two texts that have been counted; NULL where one is unknown."""
    return F.when(
        counts.isNotNull() & terms_of_job.isNotNull(),
        let(
            sc.shared_sums(counts, terms_of_job),
            lambda s: sc.tfidf_score(s["dot"], s["sa"], s["sb"], na, nb),
        ),
    )


def tfidf_pairs(
    pairs: DataFrame,
    resumes: DataFrame,
    jobs: DataFrame,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """TF-IDF score of exactly the given ``pairs(candidate_id, job_id)``, repeated rows included.

    NULL if neither text has a term, or if the candidate or the job is not in its table.
    """
    counted = resume_terms(paired_only(resumes, pairs), stop_words)
    met = meet_pairs(pairs, counted, job_terms(jobs, stop_words), job_terms_bound(jobs))
    value = tfidf_of_counts(F.col("counts"), F.col("na"), F.col("job_terms"), F.col("nb"))
    return met.select("candidate_id", "job_id", value.alias("tfidf"))


def _shared_terms(counted: DataFrame, jobs: DataFrame, stop_words: Iterable[str] | None) -> GroupedData:
    """``counted(candidate_id, term, …)`` with the jobs that have the term, by pair."""
    index = (
        job_terms(jobs, stop_words)
        .select("job_id", "nb", explode_once(F.col("job_terms")).alias("c"))
        .select("job_id", "nb", "c.term", F.col("c.tf").alias("job_tf"))
        .filter(F.col("term").isNotNull())
    )
    bound = 2 * job_terms_bound(jobs)
    return sized_join(counted, index, ["term"], spread="candidate_id", bound=bound).groupBy("candidate_id", "job_id")


def tfidf_all_pairs(
    resumes: DataFrame, jobs: DataFrame, stop_words: Iterable[str] | None = None
) -> DataFrame:
    """TF-IDF score of every résumé and job that share a term; for chosen pairs see ``tfidf_pairs``.

    An absent pair scores 0, or NULL if neither text has a term. Terms are counted where the text
    lies; the counts are placed by candidate once, and the sums per pair need no further shuffle.
    """
    counted = (
        resume_terms(resumes, stop_words)
        .repartition("candidate_id")
        .select("candidate_id", "na", explode_once(F.col("counts")).alias("c"))
        .select("candidate_id", "na", "c.term", "c.tf")
    )
    tf, job_tf = F.col("tf"), F.col("job_tf")
    return (
        _shared_terms(counted, jobs, stop_words)
        .agg(
            F.sum(tf * job_tf).alias("dot"),
            F.sum(tf * tf).alias("sa"),
            F.sum(job_tf * job_tf).alias("sb"),
            F.max("na").alias("na"),
            F.max("nb").alias("nb"),
        )
        .select(
            "candidate_id",
            "job_id",
            sc.tfidf_score(
                F.col("dot"), F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")
            ).alias("tfidf"),
        )
    )


def shared_part(least: float) -> float:
    """The part of a text's squared term counts that must be shared for a score of ``least``.

    With parts A and B shared, a score is at most 100 f(A) f(B), f(x) = sqrt(x / (k - (k - 1) x)), k the
    squared weight of a term that one text has; f grows to 1, so each side alone must reach ``least``.
    Scores are rounded to two decimals, so half a step less is enough.
    """
    square = max(0.0, (least - 0.0051) / 100) ** 2
    return square * sc.IDF_OF_ONE_SQUARED / (1 + square * (sc.IDF_OF_ONE_SQUARED - 1))


def tfidf_over(
    resumes: DataFrame,
    jobs: DataFrame,
    least: float,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """Every résumé and job whose TF-IDF score is ``least`` or more (above 0), and no other pair.

    The terms of the résumés meet those of the jobs where the texts lie, and only sums per pair are
    shuffled. They bound the score from above, which rules out all pairs but those that reach ``least``
    and, where ids repeat, some of the same ids; these are scored from both texts.
    """
    if least <= 0:
        raise ValueError("least has to be above 0")
    part = shared_part(least)
    counted = (
        resume_terms(resumes, stop_words)
        .select("candidate_id", "na", explode_once(F.col("counts")).alias("c"))
        .select("candidate_id", "na", "c.term", "c.tf")
        .filter(F.col("candidate_id").isNotNull() & F.col("term").isNotNull())
    )
    sums = _shared_terms(counted, jobs, stop_words).agg(
        F.sum(F.col("tf") * F.col("job_tf")).alias("dot"),
        F.sum(F.col("tf") * F.col("tf")).alias("sa"),
        F.sum(F.col("job_tf") * F.col("job_tf")).alias("sb"),
        F.min("na").alias("na"),
        F.min("nb").alias("nb"),
    )
    # Rows with equal ids only add to the sums, and what is left of a text is more than with all shared.
    shared_a, shared_b = F.least("sa", "na"), F.least("sb", "nb")
    most = sc.tfidf_score(F.col("dot"), shared_a, shared_b, F.col("na"), F.col("nb"))
    enough = (shared_a >= part * F.col("na")) & (shared_b >= part * F.col("nb"))
    pairs = sums.filter(enough).filter(most >= least).select("candidate_id", "job_id")
    pairs = pairs.transform(_written)
    return tfidf_pairs(pairs, resumes, jobs, stop_words).filter(F.col("tfidf") >= least)


def _written(frame: DataFrame) -> DataFrame:
    """The frame from files in the shared folder: it is read more than once."""
    path = scratch_path(frame.sparkSession, "pairs")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def semantic_similarity(resume_vectors: DataFrame, job_vectors: DataFrame) -> DataFrame:
    """Embedding cosine of every résumé with its job; NULL where either vector is missing.

    ``resume_vectors(candidate_id, job_id, embedding)``, ``job_vectors(job_id, embedding)``.
    """
    jobs = job_vectors.select("job_id", F.col("embedding").alias("job_embedding"))
    return sized_join(
        resume_vectors.select("candidate_id", "job_id", "embedding"),
        jobs,
        ["job_id"],
        "left",
        spread="candidate_id",
    ).select(
        "candidate_id",
        "job_id",
        sc.cosine_score(F.col("embedding"), F.col("job_embedding")).alias("semantic"),
    )
