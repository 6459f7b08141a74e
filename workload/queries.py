"""One query per operator, over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions import contact, experience, names
from rolefit.functions import scores as sc
from rolefit.functions import skills as sk
from rolefit.operators import counts, lifecycle, lookups, notify, ranking, scoring, similarity
from rolefit.operators.profiles import parse_profiles as parse
from rolefit.operators.report import candidate_report as report
from rolefit.operators.skills import explode_skills as explode_tags
from rolefit.operators.skills import extract_skills as skills_of
from rolefit.plans.layout import stored as kept
from rolefit.plans.screening import screen_resumes
from rolefit.session import configure, scratch_path
from rolefit.sources import archives, candidate_index, exports, files, ingest, snapshots, tables
from rolefit.streaming.screen import read_screened
from rolefit.streaming.screen import screen_stream as start_screening
from workload import standins as st

MINUTE = "yyyy-MM-dd HH:mm"


def _minute(column: str):
    return F.date_format(column, MINUTE).alias(column)


def _with_minute(frame: DataFrame) -> DataFrame:
    return frame.withColumn("created_at", F.date_format("created_at", MINUTE))


# Sources and sinks


def classify_files(spark, d):
    return files.classify_files(st.upload_names(spark, d)).select("path", "name", "kind")


def expand_archives(spark, d):
    members = files.expand_archives(st.archives(spark, d))
    return members.select(
        "archive", "entry", "member", F.decode("content", "UTF-8").alias("content"), "error"
    )


def expand_stored_archives(spark, d):
    members = archives.expand_stored_archives(st.stored_archives(spark, d))
    return members.select(
        files.basename(F.col("archive")).alias("archive"),
        "entry",
        "member",
        F.decode("content", "UTF-8").alias("content"),
        "error",
    )


def ingest_resumes(spark, d):
    """Half of the uploads, then all, then all once more: the last adds nothing."""
    root = scratch_path(spark, "ingested")
    uploads, pages = st.uploads(spark, d), st.upload_pages(spark, d)
    # An index of the archives, which every round reads: they are opened once.
    members = kept(files.expand_archives(st.archives(spark, d)).drop("content"), "members")
    for part in (uploads.filter(F.col("job_id") % 2 == 0), uploads, uploads):
        taken = ingest.take_in(spark, part, members, pages, root)
    return _with_minute(taken.drop("candidate_id"))


def assemble_text(spark, d):
    return files.assemble_text(st.pages(spark, d))


def write_and_read_table(spark, d):
    root = scratch_path(spark, "tables")
    tables.write_table(st.scores(spark, d), root, "scores")
    return _with_minute(tables.read_table(spark, root, "scores"))


def export_csv(spark, d):
    path = scratch_path(spark, "export")
    ranked = ranking.rank_candidates(st.screened(spark, d))
    exports.export_csv(ranked, path)
    return exports.read_exported_csv(spark, path).drop("part")


# Fields of a profile


def extract_email(spark, d):
    return st.resumes(spark, d).select(
        "candidate_id", contact.extract_email(F.col("resume_text")).alias("email")
    )


def extract_phone(spark, d):
    return st.cards(spark, d).select(
        "doc_id", contact.extract_phone(F.col("text")).alias("phone")
    )


def extract_experience_years(spark, d):
    return st.cards(spark, d).select(
        "doc_id", experience.extract_experience_years(F.col("text")).alias("years")
    )


def experience_level(spark, d):
    years = F.col("p_size").cast("bigint")
    return st.table(spark, d, "part").select(
        "p_partkey", years.alias("years"), experience.experience_level(years).alias("level")
    )


def extract_labelled_name(spark, d):
    return st.cards(spark, d).select(
        "doc_id", names.extract_labelled_name(F.col("text")).alias("name")
    )


def title_case(spark, d):
    mixed = F.concat(F.lower("p_type"), F.lit(" o'"), "p_name", F.lit("-"), F.upper("p_brand"))
    return st.table(spark, d, "part").select("p_partkey", names.title_case(mixed).alias("titled"))


def name_from_filename(spark, d):
    return st.cards(spark, d).select(
        "doc_id", names.name_from_filename(F.col("filename")).alias("name")
    )


def resolve_name(spark, d):
    return st.cards(spark, d).select(
        "doc_id",
        names.resolve_name(
            names.extract_labelled_name(F.col("text")),
            names.name_from_filename(F.col("filename")),
        ).alias("name"),
    )


def fill_contact_defaults(spark, d):
    text = F.col("resume_text")
    return st.resumes(spark, d).select(
        "candidate_id",
        contact.email_or_placeholder(contact.extract_email(text), F.col("candidate_id")).alias(
            "email"
        ),
        contact.phone_or_blank(contact.extract_phone(text)).alias("phone"),
    )


def parse_profiles(spark, d):
    return _with_minute(parse(st.resumes(spark, d)))


def format_experience(spark, d):
    years = F.col("p_size").cast("bigint") - 10
    level = experience.experience_level(years)
    return st.table(spark, d, "part").select(
        "p_partkey", experience.format_experience(level, years).alias("experience")
    )


# Skills, similarity, scores


def extract_skills(spark, d):
    documents = st.spread_small_scan(
        st.table(spark, d, "documents").select("doc_id", "text"), "doc_id"
    )
    found = skills_of(documents, st.vocabulary(spark, d))
    return found.select("doc_id", sk.join_skills(F.col("skills")).alias("skills"))


def extract_default_skills(spark, d):
    return st.cards(spark, d).select(
        "doc_id", sk.join_skills(sk.skills_in(F.col("text"))).alias("skills")
    )


def extract_document_fields(spark, d):
    documents = st.spread_small_scan(
        st.table(spark, d, "documents").select("doc_id", "text"), "doc_id"
    )
    text = F.col("text")
    return documents.select(
        "doc_id",
        contact.extract_phone(text).alias("phone"),
        experience.extract_experience_years(text).alias("years"),
        names.extract_labelled_name(text).alias("name"),
        sk.join_skills(sk.skills_in(text)).alias("skills"),
    )


def extract_phrases(spark, d):
    documents = st.spread_small_scan(
        st.table(spark, d, "documents").select("doc_id", "text"), "doc_id"
    )
    found = skills_of(documents, st.phrases(spark, d))
    return found.select("doc_id", sk.join_skills(F.col("skills")).alias("skills"))


def match_skills(spark, d):
    parts = scoring.pair_components(
        st.resumes(spark, d), st.jobs(spark, d), st.vocabulary(spark, d)
    )
    return parts.select(
        "candidate_id",
        "job_id",
        sk.join_skills(F.col("matched")).alias("matched_skills"),
        sk.join_skills(sk.missing_skills(F.col("job_skills"), F.col("matched"))).alias(
            "missing_skills"
        ),
    )


def keyword_score(spark, d):
    parts = scoring.pair_components(
        st.resumes(spark, d), st.jobs(spark, d), st.vocabulary(spark, d)
    )
    return parts.select(
        "candidate_id",
        "job_id",
        sc.keyword_score(F.col("matched"), F.col("job_skills")).alias("keyword_score"),
    )


def term_frequencies(spark, d):
    documents = st.spread_small_scan(
        st.table(spark, d, "documents").select("doc_id", "text"), "doc_id"
    )
    return similarity.term_frequencies(documents)


def tfidf_applied(spark, d):
    return similarity.tfidf_applied(st.resumes(spark, d), st.jobs(spark, d))


def tfidf_all_pairs(spark, d):
    return similarity.tfidf_all_pairs(st.plain_resumes(spark, d), st.jobs(spark, d))


def tfidf_pairs(spark, d):
    return similarity.tfidf_pairs(st.pairs(spark, d), st.plain_resumes(spark, d), st.jobs(spark, d))


def tfidf_over(spark, d):
    return similarity.tfidf_over(st.plain_resumes(spark, d), st.jobs(spark, d), 30.0)


def semantic_similarity(spark, d):
    return similarity.semantic_similarity(st.resume_vectors(spark, d), st.job_vectors(spark, d))


def blend_scores(spark, d):
    keyword, tfidf, semantic = (
        (F.col("l_quantity") * 2).cast("double"),
        F.when(F.col("l_linenumber") != 3, F.rint(F.col("l_discount") * 1000) ),
        F.when(F.col("l_linenumber") < 3, F.rint(F.col("l_tax") * 1000)),
    )
    return st.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        sc.blend_scores(keyword, tfidf, semantic).alias("score"),
    )


def score_candidates(spark, d):
    return _with_minute(st.scores(spark, d))


def score_all_pairs(spark, d):
    return scoring.score_all_pairs(
        st.plain_resumes(spark, d), st.jobs(spark, d), st.vocabulary(spark, d)
    )


def score_pairs(spark, d):
    pairs = st.pairs(spark, d)
    return scoring.score_pairs(
        pairs,
        st.plain_resumes(spark, d),
        st.jobs(spark, d),
        st.vocabulary(spark, d),
        st.semantic(spark, d, pairs),
    )


def screen_with_embeddings(spark, d):
    resumes = st.resumes(spark, d)
    screened = screen_resumes(
        resumes,
        st.jobs(spark, d),
        st.vocabulary(spark, d),
        semantic=st.semantic(spark, d, resumes),
    )
    return screened.select(
        "candidate_id", "job_id", "matching_score", "matched_skills", "missing_skills"
    )


def split_skills(spark, d):
    array = sk.split_skills(F.col("missing_skills"))
    return st.scores(spark, d).select(
        "candidate_id",
        F.size(array).cast("bigint").alias("n_skills"),
        F.array_join(array, "|").alias("skills"),
    )


def explode_skills(spark, d):
    return explode_tags(st.scores(spark, d))


# Lookups, deletes, counts


def candidate_profiles(spark, d):
    return _with_minute(st.profiles(spark, d)).withColumn(
        "score_id", F.col("score_id").cast("string")
    )


def first_score(spark, d):
    scores = st.scores(spark, d)
    # A later run with lower ids and other scores.
    later = scores.withColumns(
        {
            "score_id": F.col("score_id") - 1_000_000_000,
            "created_at": F.col("created_at") + F.make_dt_interval(days=F.lit(1)),
            "matching_score": 100.0 - F.col("matching_score"),
        }
    )
    first = lookups.first_score(later.unionByName(scores))
    return (
        st.candidates(spark, d)
        .join(first, "candidate_id", "left")
        .select(
            "candidate_id",
            F.col("score_id").cast("string").alias("score_id"),
            F.coalesce("matching_score", F.lit(0.0)).alias("matching_score"),
        )
    )


def candidates_for_job(spark, d):
    return _with_minute(
        lookups.candidates_for_job(st.candidates(spark, d), st.jobs(spark, d), 7)
    )


def _jobs_to_delete(spark, d):
    return st.jobs(spark, d).filter(F.col("description").contains("and")).select("job_id")


def _survivors(frames: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    parts = [
        frame.select(F.lit(name).alias("table_name"), F.col(ids[name]).alias("id"))
        for name, frame in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def delete_jobs(spark, d):
    jobs, candidates, scores = lifecycle.delete_jobs(
        _jobs_to_delete(spark, d), st.jobs(spark, d), st.candidates(spark, d), st.scores(spark, d)
    )
    return _survivors(
        {"jobs": jobs, "candidates": candidates, "scores": scores},
        {"jobs": "job_id", "candidates": "candidate_id", "scores": "score_id"},
    )


def delete_candidates(spark, d):
    toxic = (
        st.table(spark, d, "labels")
        .filter(F.col("toxic") == 1)
        .select(F.col("doc_id").alias("candidate_id"))
    )
    candidates, scores = lifecycle.delete_candidates(
        toxic, st.candidates(spark, d), st.scores(spark, d)
    )
    return _survivors(
        {"candidates": candidates, "scores": scores},
        {"candidates": "candidate_id", "scores": "score_id"},
    )


def _toxic(spark, d):
    toxic = st.table(spark, d, "labels").filter(F.col("toxic") == 1)
    return toxic.select(F.col("doc_id").alias("candidate_id"))


def published_deletes(spark, d):
    """Published tables after deletes that are applied, jobs before a compaction, candidates after one."""
    root = scratch_path(spark, "published")
    for name, frame in (
        ("jobs", st.jobs(spark, d)), ("candidates", st.candidates(spark, d)), ("scores", st.scores(spark, d))
    ):
        snapshots.publish(frame, root, name)
    snapshots.delete_published_candidates(_toxic(spark, d), root)
    snapshots.compact(spark, root)
    snapshots.delete_published_jobs(_jobs_to_delete(spark, d), root)
    return _survivors(
        {name: snapshots.read_published(spark, root, name) for name in ("jobs", "candidates", "scores")},
        {"jobs": "job_id", "candidates": "candidate_id", "scores": "score_id"},
    )


def candidate_by_id(spark, d):
    """The candidate of the last document, by the index of the stored candidates."""
    root = scratch_path(spark, "tables")
    tables.write_table(st.candidates(spark, d), root, "candidates")
    stored = tables.read_table(spark, root, "candidates")
    index = scratch_path(spark, "index")
    candidate_index.write_candidate_index(stored, index)
    last = stored.agg(F.max("candidate_id")).first()[0]
    return _with_minute(candidate_index.candidate_by_id(spark, index, stored, last))


def processed_counts(spark, d):
    return counts.processed_counts(st.jobs(spark, d), st.scores(spark, d))


def candidate_counts(spark, d):
    return counts.candidate_counts(st.jobs(spark, d), st.candidates(spark, d))


# Ranking


def rank_candidates(spark, d):
    return ranking.rank_candidates(st.screened(spark, d)).select(
        "job_id", "candidate_id", "name", "matching_score", "matched_skills", "missing_skills",
        F.col("rank").cast("bigint").alias("rank"),
    )


def top_k_candidates(spark, d):
    top = ranking.top_k_candidates(st.screened(spark, d))
    return top.select(
        "job_id", "candidate_id", "matching_score", F.col("rank").cast("bigint").alias("rank"),
        sc.rank_badge(F.col("rank")).alias("badge"),
    )


def list_jobs(spark, d):
    return ranking.list_jobs(st.jobs(spark, d)).select("job_id", "title", _minute("created_at"))


def latest_job_candidates(spark, d):
    latest = ranking.latest_job_candidates(st.screened(spark, d), st.jobs(spark, d))
    return latest.select(
        "job_id", "candidate_id", "matching_score", F.col("rank").cast("bigint").alias("rank")
    )


# Report and mails


def report_status(spark, d):
    return st.scores(spark, d).select(
        "candidate_id", sc.report_status(F.col("matching_score")).alias("status")
    )


def score_band(spark, d):
    return st.screened(spark, d).select(
        "candidate_id", sc.score_band(F.col("matching_score")).alias("band")
    )


def candidate_report(spark, d):
    return report(st.screened(spark, d), "candidate_id")


def notification_decisions(spark, d):
    return notify.notification_decisions(st.screened(spark, d)).select(
        "candidate_id", "job_id", "email", "matching_score", "status"
    )


def notification_outbox(spark, d):
    return notify.notification_outbox(st.screened(spark, d))


def unsent_mails(spark, d):
    """The outbox after even jobs were mailed, and of those with odd candidates under another status."""
    outbox = notify.notification_outbox(st.screened(spark, d))
    other = F.when(F.col("candidate_id") % 2 == 1, F.lit("Pending")).otherwise(F.col("status"))
    sent = outbox.filter(F.col("job_id") % 2 == 0).withColumn("status", other)
    return notify.unsent_mails(outbox, sent)


def email_prompts(spark, d):
    return notify.email_prompts(st.screened(spark, d))


# Streaming


def _screened_tables(spark, target):
    """Candidates, scores and outbox of a stream, side by side."""
    key = ["candidate_id", "job_id"]
    candidates, scores, outbox = (read_screened(spark, target, t) for t in ("candidates", "scores", "outbox"))
    joined = _with_minute(candidates).join(scores.drop("created_at"), key, "left")
    joined = joined.join(outbox.drop("email"), key, "left")
    return joined.withColumn("score_id", F.col("score_id").cast("string"))


def screen_stream(spark, d):
    root = scratch_path(spark, "stream")
    st.resumes(spark, d).write.parquet(f"{root}/arrivals")
    start_screening(
        spark,
        f"{root}/arrivals",
        st.jobs(spark, d),
        st.vocabulary(spark, d),
        f"{root}/screened",
        f"{root}/progress",
        files_per_batch=4,
    ).awaitTermination()
    return _screened_tables(spark, f"{root}/screened")


def screen_stream_late_jobs(spark, d):
    """Half of the jobs come after the résumés; a last run with a fresh progress folder adds nothing."""
    root = scratch_path(spark, "late")
    jobs = st.jobs(spark, d)
    st.resumes(spark, d).write.parquet(f"{root}/arrivals")
    for half, progress in ((0, "progress"), (1, "progress"), (None, "fresh")):
        if half is not None:
            jobs.filter(F.col("job_id") % 2 == half).write.mode("append").parquet(f"{root}/jobs")
        start_screening(
            spark,
            f"{root}/arrivals",
            None,
            st.vocabulary(spark, d),
            f"{root}/screened",
            f"{root}/{progress}",
            jobs_source=f"{root}/jobs",
        ).awaitTermination()
    return _screened_tables(spark, f"{root}/screened")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    classify_files, expand_archives, expand_stored_archives, ingest_resumes, assemble_text, write_and_read_table, export_csv,
    extract_email, extract_phone, extract_experience_years, experience_level,
    extract_labelled_name, title_case, name_from_filename, resolve_name, fill_contact_defaults,
    parse_profiles, split_skills, explode_skills, format_experience, extract_skills,
    extract_default_skills, extract_document_fields, extract_phrases, tfidf_pairs, score_pairs,
    screen_with_embeddings, match_skills, keyword_score, term_frequencies, tfidf_applied,
    tfidf_all_pairs, tfidf_over, semantic_similarity, blend_scores, score_candidates, score_all_pairs,
    candidate_profiles, first_score, candidates_for_job, delete_jobs, delete_candidates, published_deletes,
    candidate_by_id, processed_counts, candidate_counts, rank_candidates, top_k_candidates, list_jobs,
    latest_job_candidates, report_status, score_band, candidate_report, notification_decisions,
    notification_outbox, unsent_mails, email_prompts, screen_stream, screen_stream_late_jobs,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def configured(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir)

        run.__name__ = query.__name__
        run.__doc__ = query.__doc__
        return run

    return {query.__name__: configured(query) for query in QUERIES}
