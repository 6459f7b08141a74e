"""Archives read by place, and the way from uploads to résumés."""

import zipfile

import pytest
from pyspark.sql import functions as F

from rolefit.sources.archives import expand_stored_archives, index_archives, read_members
from rolefit.sources.files import expand_archives
from rolefit.sources.ingest import ingest_resumes, take_in, uploaded_documents

UPLOADS = "path string, job_id long, created_at timestamp"


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "good one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cv/a.pdf", "one " * 500)
        z.writestr("B.PDF", b"two", zipfile.ZIP_STORED)
        for name in ("__MACOSX/a.pdf", "dir/", "x.txt"):
            z.writestr(name, b"")
        z.writestr("other/ä.pdf", "three")
        z.writestr("empty.pdf", b"")
        z.writestr("packed.pdf", b"four" * 50, zipfile.ZIP_BZIP2)
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    good = (tmp_path / "good one.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(good[: len(good) // 2])
    broken = bytearray(good)
    broken[good.index(b"two")] ^= 1
    (tmp_path / "broken.zip").write_bytes(broken)
    return tmp_path


def listed(spark, folder):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(folder))


def rows_of(frame):
    return sorted((r.archive.rsplit("/", 1)[-1], r.entry or "", r.member or "", r.content and bytes(r.content), r.error is None) for r in frame.collect())


@pytest.mark.parametrize("task_bytes", [16, 64 << 20])
def test_members_by_place_equal_whole_archives(spark, folder, task_bytes):
    files = listed(spark, folder)
    want = [r for r in rows_of(expand_archives(files)) if r[1] != "packed.pdf"]
    got = rows_of(expand_stored_archives(files, task_bytes=task_bytes))
    assert [r for r in got if r[1] != "packed.pdf"] == want
    assert {r[4] for r in got if r[1] == "packed.pdf"} == {False}
    assert sum(not r[4] for r in want) == 3
    small = rows_of(expand_stored_archives(files, max_member_bytes=10).filter("entry = 'cv/a.pdf'"))
    assert {r[4] for r in small} == {False}


def test_index_needs_no_content(spark, folder):
    plan = index_archives(listed(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_archive_above_the_cell_limit(spark, tmp_path):
    """A file of 3 GB, most of it a hole, whose members lie at its end."""
    with open(tmp_path / "large.zip", "wb") as held:
        held.seek(3 << 30)
        with zipfile.ZipFile(held, "w") as z:
            for i in range(30):
                z.writestr(f"{i}.pdf", f"text {i}")
    files = listed(spark, tmp_path)
    got = expand_stored_archives(files, task_bytes=64).withColumn("_task", F.spark_partition_id())
    rows = got.collect()
    assert sorted((r.entry, bytes(r.content)) for r in rows) == sorted((f"{i}.pdf", f"text {i}".encode()) for i in range(30))
    assert all(r.error is None for r in rows)
    places = [r.place for r in index_archives(files).collect()]
    assert min(places) >= 3 << 30


def test_archive_of_many_members_is_dealt_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(100_000):
            z.writestr(f"{i}.pdf", f"{i}")
    got = expand_stored_archives(listed(spark, tmp_path), task_bytes=40_000)
    sizes = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == 100_000 and max(r["count"] for r in sizes) < 30_000 and len(sizes) > 6
    assert got.filter("CAST(content AS STRING) || '.pdf' <> entry").count() == 0


def test_the_index_is_checked(spark, folder):
    moved = index_archives(listed(spark, folder)).filter("entry = 'B.PDF'").withColumn("place", F.col("place") + 1)
    assert all(r.error and r.content is None for r in read_members(moved).collect())


def uploads(spark, rows):
    return spark.createDataFrame(rows, "path string, job_id long, t string").select("path", "job_id", F.col("t").cast("timestamp").alias("created_at"))


def test_every_document_is_taken_in_once(spark, tmp_path):
    members = spark.createDataFrame(
        [("in/a.ZIP", "x/cv.pdf", "cv.pdf", None), ("in/a.ZIP", "y/cv.pdf", "cv.pdf", None), ("in/a.ZIP", None, None, "broken"), ("other.zip", "z.pdf", "z.pdf", None)],
        "archive string, entry string, member string, error string",
    )
    pages = spark.createDataFrame(
        [("in/b.pdf", None, 2, "two"), ("in/b.pdf", "", 1, "one"), ("in/a.ZIP", "x/cv.pdf", 1, "ex"), ("gone.pdf", None, 1, "no")],
        "path string, entry string, page_no long, text string",
    )
    first = uploads(spark, [("in/b.pdf", 1, "2024-01-02"), ("in/b.pdf", 2, "2024-01-01"), ("in/c.txt", 1, "2024-01-01")])
    root = str(tmp_path / "root")
    got = take_in(spark, first, members, pages, root).collect()
    assert [(r.filename, r.job_id, r.resume_text) for r in got] == [("b.pdf", 2, "one\ntwo\n")]
    more = first.union(uploads(spark, [("in/a.ZIP", 3, "2024-01-03")]))
    for _ in range(2):
        got = take_in(spark, more, members, pages, root).collect()
        assert sorted((r.filename, r.job_id, r.resume_text) for r in got) == [("b.pdf", 2, "one\ntwo\n"), ("cv.pdf", 3, ""), ("cv.pdf", 3, "ex\n")]
        assert len({r.candidate_id for r in got}) == 3
    none = ingest_resumes(uploads(spark, []), members, pages)
    assert none.count() == 0
    ids = {r.candidate_id for r in uploaded_documents(more, members).collect()}
    assert ids == {r.candidate_id for r in got}


def test_uploads_and_members_are_read_once(spark, tmp_path):
    """A mark per row that was computed: the list of new documents is made once, its texts come later."""
    uploads = spark.createDataFrame([("a.pdf", 1, None), ("b.zip", 2, None)], UPLOADS)
    pages = spark.createDataFrame([("a.pdf", None, 0, "one"), ("b.zip", "x.pdf", 0, "two")], "path string, entry string, page_no int, text string")
    marks = str(tmp_path)

    def open_archives(batches):
        import uuid

        for batch in batches:
            for _ in range(len(batch)):
                open(f"{marks}/{uuid.uuid4().hex}", "w").close()
            yield batch

    members = spark.createDataFrame([("b.zip", "x.pdf", "x.pdf")], "archive string, entry string, member string")
    found = ingest_resumes(uploads, members.mapInPandas(open_archives, members.schema), pages)
    assert sorted((r.filename, r.job_id, r.resume_text) for r in found.collect()) == [("a.pdf", 1, "one\n"), ("x.pdf", 2, "two\n")]
    assert len(list(tmp_path.iterdir())) == 1
