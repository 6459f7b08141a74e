import csv
import glob
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rolefit.operators import lookups, ranking
from rolefit.operators.report import REPORT_COLUMNS
from rolefit.schemas import RESUMES, SCORES
from rolefit.sources import exports, files, tables
from rolefit.streaming.screen import read_screened, screen_stream
from tests.test_tables import stored  # noqa: F401


def zipped(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, content in entries:
            archive.writestr(name, content)
    return held.getvalue()


def test_classify(spark):
    names = ["up/A.PDF", "b.zip", "c.Zip", "x/d.txt", "e.pdf.bak", "pdf"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    got = sorted((r.path, r.name, r.kind) for r in files.classify_files(frame).collect())
    assert got == [("b.zip", "b.zip", "archive"), ("c.Zip", "c.Zip", "archive"), ("up/A.PDF", "A.PDF", "document")]


def test_archives_from_files(spark, tmp_path):
    good = zipped([
        ("cv/a.pdf", b"one"), ("B.PDF", b"two"), ("__MACOSX/a.pdf", b"no"), ("dir/", b""),
        ("x.txt", b"no"), ("other/a.pdf", b"three"), ("big.pdf", b"0123456789"),
    ])
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    (tmp_path / "cut.zip").write_bytes(good[: len(good) // 2])
    read = spark.read.format("binaryFile").load(str(tmp_path))
    rows = files.expand_archives(read, max_member_bytes=5).collect()
    kept = sorted((r.entry, r.member, bytes(r.content)) for r in rows if r.error is None)
    assert kept == [("B.PDF", "B.PDF", b"two"), ("cv/a.pdf", "a.pdf", b"one"), ("other/a.pdf", "a.pdf", b"three")]
    failed = sorted((r.archive.rsplit("/", 1)[-1], r.entry) for r in rows if r.error is not None)
    assert failed == [("bad.zip", None), ("cut.zip", None), ("good.zip", "big.pdf")]


def test_classifying_files_reads_no_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    frame = files.classify_files(spark.read.format("binaryFile").load(str(tmp_path)))
    plan = frame.select("name", "kind")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_file_id_is_stable(spark):
    frame = spark.createDataFrame([("a", "b"), ("a", "c")], "x string, y string")
    ids = [r.i for r in frame.select(files.file_id(F.col("x"), F.col("y")).alias("i")).collect()]
    again = frame.repartition(3).select(files.file_id(F.col("x"), F.col("y")).alias("i"))
    assert len(set(ids)) == 2 and set(ids) == {r.i for r in again.collect()}


def test_assemble(spark):
    rows = [(1, 10, "j"), (1, 2, "b"), (1, 1, "a"), (1, 3, ""), (1, 4, None), (2, 1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    everyone = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {r.doc_id: r.text for r in files.assemble_text(frame, everyone).collect()}
    assert got == {1: "a\nb\nj\n", 2: "", 3: ""}


def test_tables_round_trip(stored, spark, tmp_path):  # noqa: F811
    for name, frame in zip(("jobs", "candidates", "scores"), stored, strict=True):
        tables.write_table(frame, str(tmp_path), name)
        back = tables.read_table(spark, str(tmp_path), name)
        assert back.columns == frame.columns
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))
    pruned = tables.read_table(spark, str(tmp_path), "scores").filter("job_id = 2")
    assert "PartitionFilters: [isnotnull(job_id" in pruned._jdf.queryExecution().executedPlan().toString()
    assert [f.dataType for f in pruned.schema] == [f.dataType for f in SCORES]


def exported(path, job):
    rows = []
    for part in sorted(glob.glob(f"{path}/job_id={job}/part=*"), key=lambda p: int(p.rsplit("=", 1)[1])):
        (name,) = glob.glob(f"{part}/*.csv")
        rows.append(open(name, newline="", encoding="utf-8").read())
    return rows


def test_csv_is_the_python_one(stored, spark, tmp_path):  # noqa: F811
    jobs, candidates, scores = stored
    odd = candidates.withColumn(
        "name", F.when(F.col("candidate_id") == 10, ' Ann "A", Jr ').otherwise(F.col("name"))
    )
    ranked = ranking.rank_candidates(lookups.candidate_profiles(odd, jobs, scores))
    exports.export_csv(ranked, str(tmp_path / "one"))
    held = io.StringIO(newline="")
    writer = csv.writer(held)
    writer.writerow(REPORT_COLUMNS)
    from rolefit.operators.report import candidate_report

    for row in candidate_report(ranked, "job_id", "rank").orderBy("rank").collect():
        if row.job_id == 1:
            writer.writerow(tuple(row)[: len(REPORT_COLUMNS)])
    assert exported(tmp_path / "one", 1) == [held.getvalue()]
    assert len(exported(tmp_path / "one", 2)) == 1

    exports.export_csv(ranked, str(tmp_path / "many"), rows_per_file=3)
    parts = exported(tmp_path / "many", 1)
    assert len(parts) == 2 and "".join(parts) == held.getvalue()

    back = exports.read_exported_csv(spark, str(tmp_path / "one"))
    assert back.count() == 5 and back.filter("Phone = ''").count() == 4

    exports.export_csv(ranked.filter("false"), str(tmp_path / "none"))
    assert glob.glob(f"{tmp_path}/none/**/*.csv", recursive=True) == []


def test_stream_equals_batch_and_survives_a_replay(stored, spark, tmp_path):  # noqa: F811
    from rolefit.operators.scoring import score_candidates

    jobs = spark.createDataFrame([(1, "Dev", "python sql"), (2, "Ops", "linux")], "job_id long, title string, description string")
    vocabulary = spark.createDataFrame([("python",), ("sql",), ("linux",)], "skill string")
    rows = [(c, 1 + c % 2, f"f{c}.pdf", f"python linux u{c}@x.org" if c % 5 else "", None) for c in range(20)]
    resumes = spark.createDataFrame(rows, RESUMES)
    arrivals, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        screen_stream(spark, arrivals, jobs, vocabulary, target, progress, files_per_batch=1).awaitTermination()

    resumes.filter("candidate_id < 12").repartition(2).write.parquet(arrivals)
    run()
    resumes.filter("candidate_id >= 12").coalesce(1).write.mode("append").parquet(arrivals)
    run()
    expected = score_candidates(resumes, jobs, vocabulary, scored_at=F.col("created_at"))

    def same():
        got = read_screened(spark, target, "scores").select(*SCORES.fieldNames())
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
        assert read_screened(spark, target, "candidates").count() == 20
        assert read_screened(spark, target, "outbox").count() == 16

    same()
    last = max(glob.glob(f"{progress}/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    import os

    os.rename(last, f"{tmp_path}/lost-commit")
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.rename(crc, f"{tmp_path}/lost-crc")
    run()
    same()


def test_a_resume_waits_for_its_job(spark, tmp_path):
    from rolefit.streaming.screen import screen_waiting

    fields = "job_id long, title string, description string"
    jobs = spark.createDataFrame([(1, "Dev", "python sql")], fields)
    vocabulary = spark.createDataFrame([("python",), ("sql",), ("linux",)], "skill string")
    rows = [(c, 1 + c % 2, f"f{c}.pdf", f"python linux u{c}@x.org", None) for c in range(4)]
    arrivals, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame(rows, RESUMES).write.parquet(arrivals)
    screen_stream(spark, arrivals, jobs, vocabulary, target, progress).awaitTermination()
    assert read_screened(spark, target, "scores").count() == 2
    more = jobs.union(spark.createDataFrame([(2, "Ops", "linux")], fields))
    for run in ("a", "b", "b"):
        screen_waiting(spark, more, vocabulary, target, run)
        scores = read_screened(spark, target, "scores").collect()
        assert sorted(r.candidate_id for r in scores) == [0, 1, 2, 3]
    assert read_screened(spark, target, "outbox").count() == 4


def test_no_machine_local_scratch_on_a_cluster(spark):
    from types import SimpleNamespace

    from rolefit.session import shared_folder

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_the_first_phrase_decides_even_if_its_number_is_too_large(values):
    from rolefit.functions import experience

    text = "99999999999999999999 years experience, 2 yrs experience"
    assert values(experience.extract_experience_years(F.col("v")), [text]) == [0]
    assert values(experience.experience_level(F.col("v")), [None, 1, 2], "long") == ["Fresher", "Fresher", "Junior"]
