"""Runs, commits, late jobs and embeddings of the screening stream."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rolefit.operators.similarity import semantic_similarity
from rolefit.plans.screening import screen_resumes
from rolefit.schemas import JOBS, RESUMES
from rolefit.streaming.screen import COMMITS, PROFILES, Target, read_screened, screen_stream

TABLES = ("candidates", "scores", "outbox")


@pytest.fixture
def inputs(spark):
    rows = [(c, 1 + c % 3, f"f{c}.pdf", f"python linux u{c}@x.org" if c % 5 else "", None) for c in range(24)]
    jobs = [(1, "Dev", "python sql", None), (2, "Ops", "linux", None), (3, "Both", "linux python", None)]
    vocabulary = spark.createDataFrame([("python",), ("sql",), ("linux",)], "skill string")
    return spark.createDataFrame(rows, RESUMES), spark.createDataFrame(jobs, JOBS), vocabulary


def rows_of(spark, target):
    return {t: sorted(map(tuple, read_screened(spark, target, t).collect()), key=repr) for t in TABLES}


def expected(spark, resumes, jobs, vocabulary, tmp_path, semantic=None):
    """All at once."""
    from rolefit.operators.notify import notification_outbox
    from rolefit.schemas import CANDIDATES, SCORES

    done = screen_resumes(resumes, jobs, vocabulary, semantic=semantic)
    frames = (done.select(*CANDIDATES.fieldNames()), done.filter("score_id IS NOT NULL").select(*SCORES.fieldNames()), notification_outbox(done))
    return {t: sorted(map(tuple, f.collect()), key=repr) for t, f in zip(TABLES, frames, strict=True)}


def test_another_progress_folder_neither_loses_nor_doubles(spark, inputs, tmp_path):
    resumes, jobs, vocabulary = inputs
    arrivals, target = str(tmp_path / "in"), str(tmp_path / "out")

    def run(progress):
        screen_stream(spark, arrivals, jobs, vocabulary, target, str(tmp_path / progress), files_per_batch=2).awaitTermination()

    resumes.filter("candidate_id < 16").repartition(3).write.parquet(arrivals)
    run("first")
    before = rows_of(spark, target)
    run("second")
    assert rows_of(spark, target) == before
    resumes.filter("candidate_id >= 16").write.mode("append").parquet(arrivals)
    run("second")
    run("third")
    assert rows_of(spark, target) == expected(spark, resumes, jobs, vocabulary, tmp_path)
    assert len(glob.glob(f"{target}/{COMMITS}/run=*")) == 3


def test_only_committed_batches_are_read(spark, inputs, tmp_path):
    resumes, jobs, vocabulary = inputs
    arrivals, target = str(tmp_path / "in"), str(tmp_path / "out")
    resumes.write.parquet(arrivals)
    screen_stream(spark, arrivals, jobs, vocabulary, target, str(tmp_path / "p")).awaitTermination()
    before = rows_of(spark, target)
    stray = Target(spark, target).folder(PROFILES, "other", 0)
    spark.read.parquet(glob.glob(f"{target}/{PROFILES}/run=*/batch=0")[0]).write.parquet(stray)
    assert rows_of(spark, target) == before
    assert read_screened(spark, str(tmp_path / "nothing"), "scores").count() == 0


def test_jobs_that_arrive_later_release_what_waits(spark, inputs, tmp_path):
    resumes, jobs, vocabulary = inputs
    arrivals, postings, target, progress = (str(tmp_path / n) for n in ("in", "jobs", "out", "progress"))

    def run(folder=progress):
        screen_stream(spark, arrivals, None, vocabulary, target, folder, jobs_source=postings).awaitTermination()

    jobs.filter("job_id = 1").write.parquet(postings)
    resumes.filter("candidate_id < 16").repartition(2).write.parquet(arrivals)
    run()
    assert {r.job_id for r in read_screened(spark, target, "candidates").collect()} == {1}
    assert {r.job_id for r in read_screened(spark, target, "waiting").collect()} == {2, 3}
    jobs.filter("job_id < 3").write.mode("append").parquet(postings)
    resumes.filter("candidate_id >= 16").write.mode("append").parquet(arrivals)
    run()
    known = jobs.filter("job_id < 3")
    assert rows_of(spark, target) == expected(spark, resumes, known, vocabulary, tmp_path)
    jobs.filter("job_id = 3").write.mode("append").parquet(postings)
    run()
    whole = expected(spark, resumes, jobs, vocabulary, tmp_path)
    assert rows_of(spark, target) == whole
    assert read_screened(spark, target, "waiting").count() == 0

    last = max(glob.glob(f"{progress}/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    os.rename(last, f"{tmp_path}/lost")
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.rename(crc, f"{tmp_path}/lost-crc")
    run()
    assert rows_of(spark, target) == whole
    run(str(tmp_path / "fresh"))
    assert rows_of(spark, target) == whole


def test_embeddings_enter_the_score(spark, inputs, tmp_path):
    resumes, jobs, vocabulary = inputs
    arrivals, target = str(tmp_path / "in"), str(tmp_path / "out")
    resumes.write.parquet(arrivals)
    fields = "{} long, embedding array<float>"
    own = spark.createDataFrame([(c, [1.0, c / 10]) for c in range(0, 24, 2)], fields.format("candidate_id"))
    wanted = spark.createDataFrame([(j, [1.0, 1.0]) for j in (1, 2)], fields.format("job_id"))
    screen_stream(spark, arrivals, jobs, vocabulary, target, str(tmp_path / "p"), vectors=(own, wanted)).awaitTermination()
    semantic = semantic_similarity(resumes.select("candidate_id", "job_id").join(own, "candidate_id", "left"), wanted)
    assert rows_of(spark, target) == expected(spark, resumes, jobs, vocabulary, tmp_path, semantic)
    plain = expected(spark, resumes, jobs, vocabulary, tmp_path)
    assert rows_of(spark, target)["scores"] != plain["scores"]


def test_a_job_that_is_changed_counts_from_then_on(spark, inputs, tmp_path):
    resumes, jobs, vocabulary = inputs
    arrivals, postings, target, progress = (str(tmp_path / n) for n in ("in", "jobs", "out", "progress"))
    jobs.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(postings)
    resumes.filter("candidate_id < 12").write.parquet(arrivals)

    def run():
        screen_stream(spark, arrivals, None, vocabulary, target, progress, jobs_source=postings).awaitTermination()

    run()
    changed = jobs.filter("job_id = 1").withColumns({"description": F.lit("sql"), "created_at": F.lit("2024-02-01").cast("timestamp")})
    changed.write.mode("append").parquet(postings)
    resumes.filter("candidate_id >= 12").write.mode("append").parquet(arrivals)
    run()
    scores = {r.candidate_id: r.missing_skills for r in read_screened(spark, target, "scores").filter("job_id = 1").collect()}
    assert scores[3] == "sql" and scores[12] == "sql" and len(scores) == 6
    matched = {r.candidate_id: r.matched_skills for r in read_screened(spark, target, "scores").filter("job_id = 1").collect()}
    assert matched[3] == "python" and matched[12] == ""


def test_a_batch_of_one_file_is_given_to_all_cores(spark, inputs, tmp_path):
    """Also where its file was dealt by the hash of the ids into as many as there are cores."""
    _, jobs, vocabulary = inputs
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(400).select(F.col("id").alias("candidate_id"), F.lit(1).cast("long").alias("job_id"), F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("filename"), F.lit("python").alias("resume_text"), F.lit(None).cast("timestamp").alias("created_at"))
    resumes = many.filter(F.pmod(F.hash("candidate_id"), F.lit(cores)) == 0)
    arrivals, target = str(tmp_path / "in"), str(tmp_path / "out")
    resumes.coalesce(1).write.parquet(arrivals)
    screen_stream(spark, arrivals, jobs, vocabulary, target, str(tmp_path / "p"), files_per_batch=1).awaitTermination()
    assert len(glob.glob(f"{target}/{PROFILES}/run=*/batch=0/part-*")) == cores
    assert rows_of(spark, target) == expected(spark, resumes, jobs, vocabulary, tmp_path)
