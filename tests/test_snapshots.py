import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rolefit.schemas import CANDIDATES, JOBS, SCORES
from rolefit.session import scratch_path
from rolefit.sources import candidate_index, snapshots
from rolefit.sources.tables import read_table, write_table


def files_of(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


@pytest.fixture
def root(spark):
    root = scratch_path(spark, "published")
    jobs = [(j, f"Job {j}", "d", None) for j in range(5)]
    people = [(c, "A", "", "", 0, "Fresher", "p", c % 5 if c < 45 else None, None) for c in range(50)]
    scores = [(100 + p[0], p[0], p[7], 1.0, "", "", "", None) for p in people]
    for name, rows, schema in (("jobs", jobs, JOBS), ("candidates", people, CANDIDATES), ("scores", scores, SCORES)):
        snapshots.publish(spark.createDataFrame(rows, schema), root, name)
    return root


def ids(spark, root, name):
    column = {"jobs": "job_id", "candidates": "candidate_id", "scores": "candidate_id"}[name]
    return sorted(r[column] for r in snapshots.read_published(spark, root, name).collect())


def test_a_reader_sees_the_old_or_the_new_rows(spark, root, monkeypatch):
    for name in ("jobs", "candidates", "scores"):
        before = ids(spark, root, name)
        begun = snapshots.read_published(spark, root, name)
        half = begun.limit(3)
        # A writer that stops before its pointer changes nothing.
        with monkeypatch.context() as stopped:
            stopped.setattr(snapshots, "_point", lambda *_: None)
            snapshots.publish(half, root, name)
        assert ids(spark, root, name) == before
        snapshots.publish(half, root, name)
        assert len(ids(spark, root, name)) == 3
        assert begun.count() == len(before)


def test_unpublished_is_an_error(spark, root):
    with pytest.raises(ValueError):
        snapshots._pointers(spark, root, "other")
        snapshots.published_folder(spark, root, "other")


def test_deleting_a_job_touches_its_folder_only(spark, root):
    gone = spark.createDataFrame([(2,), (2,), (99,), (None,)], "job_id long")
    snapshots.delete_published_jobs(gone, root)
    left = [c for c in range(50) if c >= 45 or c % 5 != 2]
    folder = snapshots.published_folder(spark, root, "candidates")
    before = files_of(folder)
    for compacted in (False, True):
        if compacted:
            snapshots.compact(spark, root)
        assert ids(spark, root, "jobs") == [0, 1, 3, 4]
        assert ids(spark, root, "candidates") == ids(spark, root, "scores") == left
    after = files_of(folder)
    assert after and after == {f: t for f, t in before.items() if "job_id=2/" not in f}
    assert len(after) < len(before)
    assert snapshots.deleted(spark, root, "job").isEmpty()


def test_deleting_candidates_rewrites_their_jobs(spark, root):
    # One of job 3, all of job 4, one without a job.
    gone = [3, *range(4, 45, 5), 47]
    snapshots.delete_published_candidates(spark.createDataFrame([(c,) for c in gone], "candidate_id long"), root)
    left = [c for c in range(50) if c not in gone]
    folder = snapshots.published_folder(spark, root, "scores")
    before = files_of(folder)
    assert ids(spark, root, "candidates") == ids(spark, root, "scores") == left
    snapshots.compact(spark, root)
    assert ids(spark, root, "candidates") == ids(spark, root, "scores") == left
    kept = {f for f, t in before.items() if files_of(folder).get(f) == t}
    assert {f.split("job_id=")[1].split("/")[0] for f in kept} == {"0", "1", "2"}
    assert not any("job_id=4/" in f for f in files_of(folder))
    # What has been compacted may come again.
    again = read_table(spark, folder, "scores").limit(0)
    assert again.columns == SCORES.fieldNames() and ids(spark, root, "jobs") == [0, 1, 2, 3, 4]


def test_one_candidate_reads_one_row_group(spark):
    rows = spark.range(0, 60_000, 1, 3).select(
        F.col("id").alias("candidate_id"), (F.col("id") % 7).alias("job_id")
    )
    path = scratch_path(spark, "index")
    candidate_index.write_candidate_index(rows, path, 64 << 10)
    holding, groups = 0, 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            groups += 1
            holding += stats.min <= 41_234 <= stats.max
    assert holding == 1 and groups > 3
    root = scratch_path(spark, "tables")
    people = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATES))
    write_table(people, root, "candidates")
    stored = read_table(spark, root, "candidates")
    found = candidate_index.candidate_by_id(spark, path, stored, 41_234)
    assert [(r.candidate_id, r.job_id) for r in found.collect()] == [(41_234, 41_234 % 7)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(candidate_id,41234)" in plan
    assert candidate_index.candidate_by_id(spark, path, stored, -5).count() == 0
