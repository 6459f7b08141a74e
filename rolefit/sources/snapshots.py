"""Published states of the stored tables: snapshots behind a pointer, a ledger of deletes, compaction.

One writer at a time changes a root; any number may read. A reader sees the old or the new rows of a
table, since a snapshot counts only once its row is in the pointer table, which is written last.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.plans.joins import sized_join
from rolefit.session import scratch_path
from rolefit.sources.tables import PARTITIONED_BY_JOB, read_table, write_table

POINTER = T.StructType([T.StructField("number", T.LongType()), T.StructField("folder", T.StringType())])
DELETED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.LongType())])
LEDGER = "deleted"


def _root(root: str) -> str:
    return root.rstrip("/")


def _pointers(spark: SparkSession, root: str, name: str) -> str:
    """The pointer table of a table; an append without rows makes its folder where there is none."""
    path = f"{_root(root)}/{name}-published"
    spark.createDataFrame([], POINTER).write.mode("append").parquet(path)
    return path


def _last(spark: SparkSession, path: str) -> tuple[int, str | None]:
    row = spark.read.schema(POINTER).parquet(path).agg(F.max(F.struct("number", "folder"))).first()[0]
    return (row["number"], row["folder"]) if row else (0, None)


def _point(spark: SparkSession, root: str, name: str, folder: str) -> None:
    path = _pointers(spark, root, name)
    number, _ = _last(spark, path)
    row = spark.createDataFrame([(number + 1, folder)], POINTER).coalesce(1)
    row.write.mode("append").parquet(path)


def publish(frame: DataFrame, root: str, name: str) -> str:
    """Write a table to a folder of its own, then point readers to it; returns the folder.

    A run that fails before the end leaves the published rows as they were. Folders of earlier states
    stay for readers that have begun on them.
    """
    folder = f"{_root(root)}/{name}-{uuid.uuid4().hex}"
    write_table(frame, folder, name)
    _point(frame.sparkSession, root, name, folder)
    return folder


def published_folder(spark: SparkSession, root: str, name: str) -> str:
    """The folder that readers of a table use now; a table that was never published is an error."""
    folder = _last(spark, f"{_root(root)}/{name}-published")[1]
    if folder is None:
        raise ValueError(f"no published state of {name} below {root}")
    return folder


def _ledger_folder(spark: SparkSession, root: str) -> str:
    folder = _last(spark, _pointers(spark, root, LEDGER))[1]
    if folder is None:
        folder = _new_ledger(spark, root)
    return folder


def _new_ledger(spark: SparkSession, root: str) -> str:
    folder = f"{_root(root)}/{LEDGER}-{uuid.uuid4().hex}"
    spark.createDataFrame([], DELETED).write.parquet(folder)
    _point(spark, root, LEDGER, folder)
    return folder


def deleted(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``id`` of the deletes of ``kind`` (job or candidate) that no compaction has applied yet."""
    ledger = spark.read.schema(DELETED).parquet(_ledger_folder(spark, root))
    return ledger.filter(F.col("kind") == kind).select("id").distinct()


def _delete(ids: DataFrame, column: str, kind: str, root: str) -> None:
    rows = ids.select(F.lit(kind).alias("kind"), F.col(column).cast("bigint").alias("id"))
    folder = _ledger_folder(ids.sparkSession, root)
    rows.filter("id IS NOT NULL").distinct().write.mode("append").parquet(folder)


def delete_published_jobs(ids: DataFrame, root: str) -> None:
    """Delete the jobs in ``ids(job_id)`` with their candidates and scores, from the next read on.

    Only the ids are written. Candidates and scores go by the job they are stored under. Ids that are
    null or unknown delete nothing.
    """
    _delete(ids, "job_id", "job", root)


def delete_published_candidates(ids: DataFrame, root: str) -> None:
    """Delete the candidates in ``ids(candidate_id)`` with their scores, from the next read on."""
    _delete(ids, "candidate_id", "candidate", root)


def _without(frame: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return sized_join(frame, gone.withColumnRenamed("id", column), [column], "left_anti")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a published table that are not deleted, with the declared types.

    Ids that were deleted stay away, also from states published later, until ``compact`` is run.
    """
    frame = read_table(spark, published_folder(spark, root, name), name)
    rows = _without(frame, deleted(spark, root, "job"), "job_id")
    if name in PARTITIONED_BY_JOB:
        rows = _without(rows, deleted(spark, root, "candidate"), "candidate_id")
    return rows.select(*frame.columns)


def _job_folder(root: str, name: str, job_id: int | None) -> str:
    value = "__HIVE_DEFAULT_PARTITION__" if job_id is None else job_id
    return f"{root}/{name}/job_id={value}"


def _drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the store the session reads from; none there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def compact(spark: SparkSession, root: str) -> None:
    """Apply the deletes to the files and begin an empty ledger.

    Folders of deleted jobs are removed, and only jobs that lose single candidates are rewritten: their
    remaining rows go to the shared folder first and then replace those jobs by dynamic partition
    overwrite. The job table is published anew. The ledger is emptied last, so a run that fails can be
    repeated. Readers that are inside a rewritten job may have to read again.
    """
    jobs, people = deleted(spark, root, "job"), deleted(spark, root, "candidate")
    if not jobs.isEmpty():
        publish(read_published(spark, root, "jobs"), root, "jobs")
    for name in PARTITIONED_BY_JOB:
        folder = published_folder(spark, root, name)
        for row in jobs.toLocalIterator():
            _drop_folder(spark, _job_folder(folder, name, row["id"]))
        if people.isEmpty():
            continue
        stored = read_table(spark, folder, name)
        gone = people.withColumnRenamed("id", "candidate_id")
        hit = sized_join(stored.select("candidate_id", "job_id"), gone, ["candidate_id"], "left_semi", "job_id")
        hit = hit.select(F.col("job_id").alias("_job")).distinct()
        touched_path, kept_path = scratch_path(spark, "touched"), scratch_path(spark, "kept")
        hit.write.parquet(touched_path)
        touched = spark.read.schema("_job long").parquet(touched_path)
        of_touched = stored.join(touched, stored["job_id"].eqNullSafe(touched["_job"]), "left_semi")
        _without(of_touched, people, "candidate_id").select(*stored.columns).write.parquet(kept_path)
        kept = spark.read.schema(stored.schema).parquet(kept_path)
        target = f"{folder}/{name}"
        rewritten = kept.hint("rebalance", "job_id").write.mode("overwrite").partitionBy("job_id")
        rewritten.option("partitionOverwriteMode", "dynamic").parquet(target)
        left = kept.select(F.col("job_id").alias("_left")).distinct()
        emptied = touched.join(left, touched["_job"].eqNullSafe(left["_left"]), "left_anti")
        for row in emptied.toLocalIterator():
            _drop_folder(spark, _job_folder(folder, name, row["_job"]))
    _new_ledger(spark, root)
