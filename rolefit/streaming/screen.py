"""Incremental screening of newly arrived résumés and jobs."""

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolefit.operators.notify import notification_outbox
from rolefit.operators.similarity import semantic_similarity
from rolefit.plans.joins import sized_join
from rolefit.plans.screening import PreparedJobs, prepare_jobs, screen_prepared
from rolefit.schemas import CANDIDATES, JOBS, RESUMES, SCORES
from rolefit.session import ensure_checkpoint_dir

PROFILES, OUTBOX, ARRIVED_JOBS, COMMITS = "profiles", "outbox", "jobs", "commits"
COMMIT = "run string, batch long"


@dataclass(frozen=True)
class Target:
    """The tables a stream writes: one folder per run and batch, and a manifest of those that are whole.

    A batch counts from the moment its row is in the manifest, which is written last. Whatever a batch
    that failed has left is not read, and replaced when the batch is repeated.
    """

    spark: SparkSession
    path: str

    def folder(self, table: str, run: str, batch: int) -> str:
        return f"{self.path.rstrip('/')}/{table}/run={run}/batch={batch}"

    def commits(self) -> DataFrame:
        return self._read(COMMITS, COMMIT).select("run", "batch")

    def commit(self, run: str, batch: int) -> None:
        one = self.spark.range(1).select(F.lit(self.path).alias("target"))
        one.coalesce(1).write.mode("overwrite").parquet(self.folder(COMMITS, run, batch))

    def read(self, table: str, schema: str, without: tuple[str, int] | None = None) -> DataFrame:
        """Committed rows of ``table``, with ``run`` and ``batch``; ``without`` leaves one batch out."""
        commits = self.commits()
        if without:
            commits = commits.filter(~((F.col("run") == without[0]) & (F.col("batch") == without[1])))
        # One row of two values per batch.
        return self._read(table, f"{schema}, {COMMIT}").join(F.broadcast(commits), ["run", "batch"], "left_semi")

    def _read(self, table: str, schema: str) -> DataFrame:
        folder = f"{self.path.rstrip('/')}/{table}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


PROFILE_FIELDS = _ddl([*CANDIDATES, *SCORES[:1], *SCORES[3:7]]) + ", job_title string"
WAITING_FIELDS = f"waiting {RESUMES.simpleString()}"


@dataclass
class Screening:
    """What every batch needs; the jobs are prepared anew only when some have come."""

    target: Target
    jobs: DataFrame | None
    vocabulary: DataFrame
    stop_words: Iterable[str] | None
    vectors: tuple[DataFrame, DataFrame] | None
    prepared: PreparedJobs | None = None

    def prepare(self, known: DataFrame) -> None:
        ensure_checkpoint_dir(self.target.spark)
        prepared = prepare_jobs(known, self.vocabulary, self.stop_words)
        self.prepared = replace(prepared, features=prepared.features.checkpoint())

    def known_jobs(self, without: tuple[str, int]) -> DataFrame:
        """The jobs that have arrived in other batches."""
        return self.target.read(ARRIVED_JOBS, _ddl(JOBS), without).select(*JOBS.fieldNames())

    def batch(self, run: str, number: int, resumes: DataFrame, arrived: DataFrame | None) -> None:
        """Screen ``resumes`` and the waiting ones whose job is among ``arrived``, and commit both.

        Texts are read once: one pass writes the screened rows and, with their text, those that wait.
        """
        target, own = self.target, (run, number)
        fresh = []
        if arrived is not None:
            path = target.folder(ARRIVED_JOBS, run, number)
            arrived.write.mode("overwrite").parquet(path)
            fresh.append(target.spark.read.schema(JOBS).parquet(path))
            if fresh[0].isEmpty():
                fresh.clear()
        if fresh or self.prepared is None:
            known = self.known_jobs(own)
            if self.prepared is None and self.jobs is not None:
                fresh.append(_typed(self.jobs))
            for jobs in fresh:
                known = known.unionByName(jobs)
            self.prepare(_newest(known))

        before = target.read(PROFILES, f"candidate_id long, job_id long, {WAITING_FIELDS}", own)
        keys = ["candidate_id", "job_id"]
        # Only another run into the same target has seen a résumé of this one before.
        taken = before.filter(F.col("run") != run).select(*keys).distinct()
        # A batch has few files, and readers split them into parts of which most may be without rows: its
        # texts are dealt to all cores. A hash of a hash, as files may have been dealt by the hash of an id.
        parts = max(target.spark.sparkContext.defaultParallelism, resumes.rdd.getNumPartitions())
        rows = resumes.select(*RESUMES.fieldNames()).repartition(parts, F.xxhash64(*keys))
        # What was taken before is measured, and sent to the texts where it fits.
        rows = sized_join(rows, taken, keys, "left_anti")
        if fresh:
            waiting = before.filter("waiting IS NOT NULL").select("waiting.*")
            done = before.filter("waiting IS NULL").select(*keys)
            come = reduce(DataFrame.unionByName, (jobs.select("job_id") for jobs in fresh)).distinct()
            released = waiting.join(come, "job_id", "left_semi")
            released = released.join(done, keys, "left_anti").select(*RESUMES.fieldNames())
            rows = rows.unionByName(released)
        semantic = None
        if self.vectors is not None:
            known = rows.select(*keys).join(self.vectors[0], "candidate_id", "left")
            semantic = semantic_similarity(known, self.vectors[1])
        screened = screen_prepared(rows, self.prepared, self.stop_words, semantic=semantic, keep_unknown=True)
        path = target.folder(PROFILES, run, number)
        screened.write.mode("overwrite").parquet(path)
        written = target.spark.read.schema(screened.schema).parquet(path).filter("waiting IS NULL")
        notification_outbox(written).write.mode("overwrite").parquet(target.folder(OUTBOX, run, number))
        target.commit(run, number)


def _typed(jobs: DataFrame) -> DataFrame:
    if "created_at" not in jobs.columns:
        jobs = jobs.withColumn("created_at", F.lit(None))
    return jobs.select(*(F.col(f.name).cast(f.dataType) for f in JOBS))


def _newest(jobs: DataFrame) -> DataFrame:
    """One row per job id: the newest, of equally new ones the greatest."""
    newest = F.max_by(F.struct("title", "description", "created_at"), F.struct("created_at", "title", "description"))
    return jobs.groupBy("job_id").agg(newest.alias("_job")).select("job_id", "_job.*")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The identity of the stream whose progress is in ``checkpoint``: another folder is another run."""
    written = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()
    return json.loads(written.value)["id"]


def screen_stream(
    spark: SparkSession,
    source: str,
    jobs: DataFrame | None,
    vocabulary: DataFrame,
    target: str,
    checkpoint: str,
    stop_words: Iterable[str] | None = None,
    files_per_batch: int | None = None,
    available_now: bool = True,
    jobs_source: str | None = None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
) -> StreamingQuery:
    """Start screening the Parquet files that arrive in ``source``.

    Jobs are the static ``jobs``, or arrive as Parquet files in ``jobs_source``, or both. A résumé whose
    job is not known waits, with its text, in the target; the batch that brings the job screens it. A
    job that arrives again is used in its newest form from then on; nothing is screened twice.

    Every batch writes folders of its own, named by the run and the batch, and is committed by a row in
    a manifest; a replayed batch replaces them, so a restart neither loses nor doubles rows. A progress
    folder is a run: a stream with a fresh one into the same target leaves out the résumés that earlier
    runs have taken in. Runs into one target follow one another. ``vectors`` are the embeddings
    ``(candidate_id, embedding)`` and ``(job_id, embedding)`` for the embedding term of the score.
    """
    screening = Screening(Target(spark, target), jobs, vocabulary, stop_words, vectors)

    def screen(batch: DataFrame, number: int) -> None:
        run = run_of(spark, checkpoint)
        if jobs_source is None:
            screening.batch(run, number, batch, None)
        else:
            resumes, arrived = (batch.filter(f"{k} IS NOT NULL").select(f"{k}.*") for k in ("resume", "job"))
            screening.batch(run, number, resumes, arrived)

    def reader(schema):
        made = spark.readStream.schema(schema)
        return made.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else made

    stream = reader(RESUMES).parquet(source)
    if jobs_source is not None:
        job, resume = F.struct(*JOBS.fieldNames()).alias("job"), F.struct(*RESUMES.fieldNames()).alias("resume")
        come = reader(JOBS).parquet(jobs_source).select(F.lit(None).cast(RESUMES).alias("resume"), job)
        stream = stream.select(resume, F.lit(None).cast(JOBS).alias("job")).unionByName(come)
    writer = stream.writeStream.foreachBatch(screen).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def screen_waiting(
    spark: SparkSession,
    jobs: DataFrame,
    vocabulary: DataFrame,
    target: str,
    run: str,
    stop_words: Iterable[str] | None = None,
) -> None:
    """Screen the waiting résumés of static jobs that have come; a failed run is repeated under its name.

    A stream with ``jobs_source`` does this itself.
    """
    screening = Screening(Target(spark, target), None, vocabulary, stop_words, None)
    none = spark.createDataFrame([], RESUMES)
    screening.batch(f"waiting-{run}", 0, none, _typed(jobs))


def read_screened(spark: SparkSession, target: str, name: str) -> DataFrame:
    """What has been committed so far: profiles, outbox, candidates, scores or waiting."""
    tables = Target(spark, target)
    if name == OUTBOX:
        fields = "candidate_id long, job_id long, email string, status string, subject string, body string"
        return tables.read(OUTBOX, fields).drop("run", "batch")
    rows = tables.read(PROFILES, f"{PROFILE_FIELDS}, {WAITING_FIELDS}").drop("run", "batch")
    done = rows.filter("waiting IS NULL").drop("waiting")
    if name == "waiting":
        waiting = rows.filter("waiting IS NOT NULL").select("waiting.*")
        return waiting.join(done.select("candidate_id", "job_id"), ["candidate_id", "job_id"], "left_anti")
    if name == "candidates":
        return done.select(*CANDIDATES.fieldNames())
    if name == "scores":
        return done.filter(F.col("score_id").isNotNull()).select(*SCORES.fieldNames())
    return done
