"""Scores of résumés against jobs, for applications and for every pair."""

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import scores as sc
from rolefit.functions import skills as sk
from rolefit.functions.binding import explode_once, let
from rolefit.functions.text import is_blank, sum_of_squares, term_counts, word_tokens
from rolefit.operators.similarity import (
    job_terms,
    meet_pairs,
    paired_only,
    resume_terms,
    tfidf_of_counts,
    tfidf_of_pair,
)
from rolefit.operators.skills import (
    VocabularySize,
    extract_skills,
    skill_hits,
    vocabulary_size,
)
from rolefit.plans.joins import fits_broadcast, salted_join, sized_join, text_size
from rolefit.schemas import SCORES
from rolefit.session import ensure_checkpoint_dir

MASK_BITS = 62


def features_bound(jobs: DataFrame, size: VocabularySize) -> int:
    """Upper bound of ``job_features`` in bytes, from measured texts and vocabulary.

    Terms and plain skills are bounded by the text they are read from. Other skills may overlap in
    the text, so each job is charged with all of them.
    """
    rows, text_bytes = text_size(jobs, "description")
    return 64 * text_bytes + rows * (512 + 192 * size.other_rows + 8 * size.other_bytes)


def job_features(
    jobs: DataFrame,
    vocabulary: DataFrame,
    stop_words: Iterable[str] | None = None,
    size: VocabularySize | None = None,
) -> DataFrame:
    """Everything a score needs from a job, computed once per job.

    ``job_id, job_skills, plain_skills, other_skills, job_terms, nb``. ``other_skills`` are those that
    have to be confirmed by a pattern in the résumé.
    """
    found = extract_skills(jobs, vocabulary, "job_id", "description", size=size)
    skills = F.col("skills")
    return found.join(job_terms(jobs, stop_words), "job_id").select(
        "job_id",
        skills.alias("job_skills"),
        F.filter(skills, sk.is_plain).alias("plain_skills"),
        F.transform(
            F.filter(skills, lambda s: ~sk.is_plain(s)),
            lambda s: F.struct(
                s.alias("skill"),
                sk.first_token(s).alias("token"),
                sk.boundary_pattern(s).alias("pattern"),
            ),
        ).alias("other_skills"),
        "job_terms",
        "nb",
    )


def skills_of_job_in(text: Column, plain_skills: Column, other_skills: Column) -> Column:
    """Sorted skills of one job that occur in a text, inside the row."""

    def search(lowered: Column) -> Column:
        return let(
            word_tokens(lowered),
            lambda tokens: F.sort_array(
                F.concat(
                    F.array_intersect(plain_skills, tokens),
                    F.transform(
                        F.filter(
                            other_skills,
                            # A byte search rules out most before a pattern is compiled.
                            lambda o: (
                                (o["token"] == "") | F.array_contains(tokens, o["token"])
                            )
                            & F.contains(lowered, o["skill"])
                            & F.rlike(lowered, o["pattern"]),
                        ),
                        lambda o: o["skill"],
                    ),
                )
            ),
        )

    return let(F.lower(text), search)


def pair_components(
    resumes: DataFrame,
    jobs: DataFrame,
    vocabulary: DataFrame,
    stop_words: Iterable[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``resumes`` with the matched skills and the TF-IDF value of the job applied for.

    The vocabulary only ever meets the jobs; a résumé is searched for the skills of its own job. All
    work on a résumé happens in its own row, so with jobs that fit no résumé text is shuffled.
    """
    size = vocabulary_size(vocabulary)
    paired = sized_join(
        resumes,
        job_features(jobs, vocabulary, stop_words, size),
        ["job_id"],
        spread="candidate_id",
        limit=limit,
        bound=features_bound(jobs, size),
    )
    return paired.select(
        *resumes.columns,
        "job_skills",
        *(column.alias(name) for name, column in pair_columns(stop_words).items()),
    )


def pair_columns(stop_words: Iterable[str] | None = None) -> dict[str, Column]:
    """``matched`` and ``tfidf`` of a résumé that has been joined with the features of its job."""
    has_skills = F.size("job_skills") > 0
    found = skills_of_job_in(F.col("resume_text"), F.col("plain_skills"), F.col("other_skills"))
    return {
        "matched": F.when(has_skills, found).otherwise(F.array().cast("array<string>")),
        "tfidf": F.when(
            has_skills,
            tfidf_of_pair("resume_text", F.col("job_terms"), F.col("nb"), stop_words),
        ),
    }


def score_columns(
    parts: DataFrame, *columns: str | Column, wrap: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """``columns`` of ``parts(candidate_id, job_skills, matched, tfidf, semantic)`` and its score."""
    keyword = sc.keyword_score(F.col("matched"), F.col("job_skills"))
    score = sc.blend_scores(keyword, F.col("tfidf"), F.col("semantic"))
    missing = sk.missing_skills(F.col("job_skills"), F.col("matched"))
    values = {
        "score_id": F.col("candidate_id"),
        "matching_score": F.col("_score"),
        "matched_skills": sk.join_skills(F.col("matched")),
        "missing_skills": sk.join_skills(missing),
        "explanation": sc.score_explanation(F.size("matched"), F.col("_score")),
    }
    return parts.withColumn("_score", F.coalesce(score, F.lit(0.0))).select(
        *columns, *(wrap(value).alias(name) for name, value in values.items())
    )


def score_candidates(
    resumes: DataFrame,
    jobs: DataFrame,
    vocabulary: DataFrame,
    semantic: DataFrame | None = None,
    stop_words: Iterable[str] | None = None,
    scored_at: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One score row per résumé that has text, for the job it was sent to.

    A job without skills or description gives 0 and empty lists. ``semantic(candidate_id, semantic)``
    adds embedding similarity; it meets the narrow result, not the texts.
    """
    readable = resumes.filter(~is_blank(F.col("resume_text")))
    stamp = F.current_timestamp() if scored_at is None else scored_at
    parts = pair_components(readable, jobs, vocabulary, stop_words, limit).select(
        "candidate_id",
        "job_id",
        "job_skills",
        "matched",
        "tfidf",
        stamp.alias("created_at"),
    )
    if semantic is not None:
        parts = parts.join(semantic.select("candidate_id", "semantic"), "candidate_id", "left")
    else:
        parts = parts.withColumn("semantic", F.lit(None).cast("double"))
    return score_columns(parts, "candidate_id", "job_id", "created_at").select(
        *SCORES.fieldNames()
    )


def score_pairs(
    pairs: DataFrame,
    resumes: DataFrame,
    jobs: DataFrame,
    vocabulary: DataFrame,
    semantic: DataFrame | None = None,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """Score, matched and missing skills of exactly the given ``pairs(candidate_id, job_id)``.

    Terms and skills of a text are found once, however many pairs it has, and only they move. A blank
    résumé, and a job without skills, give 0 and empty lists; a candidate or job that is not in its
    table gives NULLs. Repeated pairs are repeated. ``semantic(candidate_id, job_id, semantic)``, one
    row per pair, adds embedding similarity.
    """
    size = vocabulary_size(vocabulary)
    texts = paired_only(resumes.select("candidate_id", "resume_text"), pairs)
    shown = extract_skills(texts, vocabulary, "candidate_id", "resume_text", size=size)
    blank = texts.select("candidate_id", is_blank(F.col("resume_text")).alias("blank"))
    of_resumes = (
        resume_terms(texts, stop_words)
        .join(shown.withColumnRenamed("skills", "shown"), "candidate_id")
        .join(blank, "candidate_id")
    )
    of_jobs = job_features(jobs, vocabulary, stop_words, size)
    met = meet_pairs(pairs, of_resumes, of_jobs, features_bound(jobs, size))
    nothing = F.array().cast("array<string>")
    wanted = F.when(F.col("blank"), nothing).otherwise(F.col("job_skills"))
    parts = met.select(
        "candidate_id",
        "job_id",
        F.when(F.col("counts").isNotNull(), wanted).alias("job_skills"),
        sk.matched_skills(wanted, F.col("shown")).alias("matched"),
        tfidf_of_counts(F.col("counts"), F.col("na"), F.col("job_terms"), F.col("nb")).alias(
            "tfidf"
        ),
    )
    if semantic is not None:
        keys = ["candidate_id", "job_id"]
        parts = parts.join(semantic.select(*keys, "semantic"), keys, "left")
    else:
        parts = parts.withColumn("semantic", F.lit(None).cast("double"))
    known = F.col("job_skills").isNotNull()
    return score_columns(
        parts, "candidate_id", "job_id", wrap=lambda value: F.when(known, value)
    ).select("candidate_id", "job_id", "matching_score", "matched_skills", "missing_skills")


def _job_term_index(features: DataFrame) -> DataFrame:
    return (
        features.select("job_id", explode_once(F.col("job_terms")).alias("c"))
        .filter(F.col("c").isNotNull())
        .select(
            F.lit("term").alias("kind"),
            F.col("c.term").alias("value"),
            "job_id",
            F.col("c.tf").alias("job_tf"),
            F.lit(None).cast("int").alias("position"),
            F.lit(None).cast("string").alias("pattern"),
        )
    )


def _job_skill_index(features: DataFrame) -> DataFrame:
    skill = F.col("skill")
    return features.select("job_id", F.posexplode("job_skills").alias("position", "skill")).select(
        F.lit("skill").alias("kind"),
        sk.first_token(skill).alias("value"),
        "job_id",
        F.lit(None).cast("bigint").alias("job_tf"),
        "position",
        F.when(~sk.is_plain(skill), sk.boundary_pattern(skill)).alias("pattern"),
    )


def _evidence_in_place(
    resumes: DataFrame, index: DataFrame, stop_words: Iterable[str] | None
) -> DataFrame:
    """Shared terms and skills with an index that fits: one pass over each résumé."""

    def clue(kind: str, value: Column, tf: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), tf.cast("bigint").alias("tf")
        )

    clues = F.concat(
        F.transform("counts", lambda c: clue("term", c["term"], c["tf"])),
        F.transform(
            F.array_union(word_tokens(F.col("lowered")), F.array(F.lit("")).cast("array<string>")),
            lambda t: clue("skill", t, F.lit(None)),
        ),
    )
    located = (
        resumes.select(
            "candidate_id",
            F.lower("resume_text").alias("lowered"),
            term_counts("resume_text", stop_words).alias("counts"),
        )
        .select(
            "candidate_id",
            "lowered",
            sum_of_squares(F.col("counts")).alias("na"),
            clues.alias("clues"),
        )
        .select("candidate_id", "lowered", "na", explode_once(F.col("clues")).alias("clue"))
        .select("candidate_id", "lowered", "na", "clue.kind", "clue.value", "clue.tf")
    )
    return (
        located.join(F.broadcast(index), ["kind", "value"])
        .filter(F.col("pattern").isNull() | F.rlike(F.col("lowered"), F.col("pattern")))
        .select("candidate_id", "na", "job_id", "tf", "job_tf", "position")
    )


def _evidence_shuffled(
    resumes: DataFrame, features: DataFrame, stop_words: Iterable[str] | None
) -> DataFrame:
    """The same rows with an index that does not fit: terms and skills are shuffled, texts are not."""
    counts = resumes.select(
        "candidate_id", term_counts("resume_text", stop_words).alias("counts")
    ).select("candidate_id", sum_of_squares(F.col("counts")).alias("na"), "counts")
    terms = (
        counts.select("candidate_id", "na", explode_once(F.col("counts")).alias("c"))
        .select("candidate_id", "na", F.col("c.term").alias("value"), "c.tf")
        .filter(F.col("value").isNotNull())
    )
    shared_terms = salted_join(
        terms,
        _job_term_index(features).select("value", "job_id", "job_tf", "position"),
        ["value"],
        spread="candidate_id",
    )
    wanted = features.select("job_id", F.posexplode("job_skills").alias("position", "skill"))
    hits = skill_hits(resumes, wanted.select("skill"), "candidate_id", "resume_text").filter(
        F.col("skill").isNotNull()
    )
    shared_skills = (
        salted_join(hits, wanted, ["skill"], spread="candidate_id")
        .join(counts.select("candidate_id", "na"), "candidate_id")
        .select(
            "candidate_id",
            "na",
            "job_id",
            F.lit(None).cast("bigint").alias("tf"),
            F.lit(None).cast("bigint").alias("job_tf"),
            "position",
        )
    )
    return shared_terms.select(*shared_skills.columns).unionByName(shared_skills)


def _listed_skills(features: DataFrame) -> DataFrame:
    """The skills of each job with the mask and the bit that tell whether a résumé has them.

    ``job_skills`` is sorted and without repeats, and so are the parts of it that a pair has or lacks.
    """

    def listed(skill: Column, position: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position % MASK_BITS)
        word = F.floor(position / MASK_BITS).cast("int")
        return F.struct(skill.alias("skill"), word.alias("word"), bit.alias("bit"))

    return features.select(
        "job_id",
        F.transform("job_skills", listed).alias("listed"),
        sk.join_skills(F.col("job_skills")).alias("all_skills"),
        "nb",
    )


def score_all_pairs(
    resumes: DataFrame,
    jobs: DataFrame,
    vocabulary: DataFrame,
    stop_words: Iterable[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Score, matched and missing skills of every résumé and job whose score is above 0.

    A pair can only score if it shares a term or a skill, so pairs are found by equality of these and
    never as a grid. What a pair shares is summed into integers (skills as bits of their position in
    the job's list), which keeps the aggregation in fixed-size buffers.
    """
    readable = resumes.filter(~is_blank(F.col("resume_text"))).select(
        "candidate_id", "resume_text"
    )
    size = vocabulary_size(vocabulary)
    bound = features_bound(jobs, size)
    ensure_checkpoint_dir(resumes.sparkSession)
    features = (
        job_features(jobs, vocabulary, stop_words, size)
        .filter(F.size("job_skills") > 0)
        .checkpoint()  # read by the index, by the length of the masks and by the result
    )
    index = _job_term_index(features).unionByName(_job_skill_index(features))
    if fits_broadcast(index, limit, 2 * bound):
        evidence = _evidence_in_place(readable, index, stop_words)
    else:
        evidence = _evidence_shuffled(readable, features, stop_words)

    longest = features.agg(F.max(F.size("job_skills"))).first()[0] or 1
    words = range((longest + MASK_BITS - 1) // MASK_BITS)
    tf, job_tf, position = F.col("tf"), F.col("job_tf"), F.col("position")
    zero = F.lit(0).cast("bigint")

    def mask(word: int) -> Column:
        inside = F.floor(position / MASK_BITS) == word
        bit = F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), (position % MASK_BITS).cast("int")
        )
        return F.coalesce(F.bit_or(F.when(inside, bit)), zero).alias(f"mask_{word}")

    pairs = evidence.groupBy("candidate_id", "job_id").agg(
        F.coalesce(F.sum(tf * job_tf), zero).alias("dot"),
        F.coalesce(F.sum(F.when(job_tf.isNotNull(), tf * tf)), zero).alias("sa"),
        F.coalesce(F.sum(job_tf * job_tf), zero).alias("sb"),
        F.max("na").alias("na"),
        *(mask(w) for w in words),
    )
    masks = [F.col(f"mask_{w}") for w in words]
    n_matched = reduce(Column.__add__, (F.bit_count(m) for m in masks))
    scored = sized_join(
        pairs,
        _listed_skills(features),
        ["job_id"],
        spread="candidate_id",
        limit=limit,
        bound=2 * bound,
    ).select(
        "candidate_id",
        "job_id",
        "listed",
        "all_skills",
        n_matched.alias("n_matched"),
        *masks,
        sc.tfidf_score(F.col("dot"), F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")).alias(
            "tfidf"
        ),
    )
    # The score needs the number of matched skills only; the lists are built for pairs that have one.
    keyword = F.col("n_matched") / F.size("listed") * 100
    score = sc.blend_scores(keyword, F.col("tfidf"), F.lit(None).cast("double"))

    def names(matched: bool) -> Column:
        def own(s: Column) -> Column:
            mask = masks[-1]
            for word in reversed(words[:-1]):
                mask = F.when(s["word"] == word, masks[word]).otherwise(mask)
            return (mask.bitwiseAND(s["bit"]) != 0) == F.lit(matched)

        return sk.join_skills(F.filter("listed", own)["skill"])

    none = F.col("n_matched") == 0
    return (
        scored.withColumn("matching_score", score)
        .filter(F.col("matching_score") > 0)
        .select(
            "candidate_id",
            "job_id",
            "matching_score",
            F.when(none, "").otherwise(names(True)).alias("matched_skills"),
            F.when(none, F.col("all_skills")).otherwise(names(False)).alias("missing_skills"),
        )
    )
