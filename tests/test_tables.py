import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rolefit.functions import scores as sc
from rolefit.operators import counts, lifecycle, lookups, notify, ranking
from rolefit.operators.report import REPORT_COLUMNS, candidate_report
from rolefit.schemas import CANDIDATES, JOBS, SCORES


def stamp(spark, frame):
    return frame.withColumn("created_at", F.lit("2024-03-05 06:07:08").cast("timestamp"))


@pytest.fixture(scope="module")
def stored(spark):
    jobs = spark.createDataFrame([(1, "Dev", "d", None), (2, "Ops", "d", None), (3, "None", "d", None)], JOBS)
    people = [
        (10, "Ann", "ann@x.org", "1", 5, "Senior", "resumes/a.pdf", 1, None),
        (11, "Bob", "noemail_11@ats.local", "", 0, "Fresher", "resumes/b.pdf", 1, None),
        (12, "Cid", "", "", 0, "Fresher", "resumes/c.pdf", 1, None),
        (13, "Dee", "dee@x.org", "", 2, "Junior", "resumes/d.pdf", 1, None),
        (20, "Eve", "eve@x.org", "", 1, "Fresher", "resumes/e.pdf", 2, None),
    ]
    scores = [
        (102, 10, 1, 80.0, "a, b", "", "Matched 2 skills (80.0%).", None),
        (101, 10, 1, 79.99, "a", "b", "Matched 1 skills (79.99%).", None),
        (103, 11, 1, 50.0, "", "a", "Matched 0 skills (50.0%).", None),
        (104, 13, 1, 50.0, "", "", "Matched 0 skills (50.0%).", None),
        (105, 20, 2, 80.0, "", "c", "Matched 0 skills (80.0%).", None),
    ]
    return (
        stamp(spark, jobs),
        stamp(spark, spark.createDataFrame(people, CANDIDATES)),
        stamp(spark, spark.createDataFrame(scores, SCORES)),
    )


def test_first_score_and_profiles(stored):
    jobs, candidates, scores = stored
    assert {r.candidate_id: r.score_id for r in lookups.first_score(scores).collect()} == {
        10: 101, 11: 103, 13: 104, 20: 105,
    }
    rows = {r.candidate_id: r for r in lookups.candidate_profiles(candidates, jobs, scores).collect()}
    assert len(rows) == 5
    assert rows[10].matching_score == 79.99 and rows[10].job_title == "Dev"
    assert rows[12].score_id is None


def test_candidates_for_job(stored):
    jobs, candidates, _ = stored
    found = lookups.candidates_for_job(candidates, jobs, 2)
    assert [r.candidate_id for r in found.collect()] == [20]
    assert lookups.candidates_for_job(candidates, jobs.filter("job_id <> 2"), 2).count() == 0


def test_deletes(stored, spark):
    jobs, candidates, scores = stored
    gone = spark.createDataFrame([(1,), (99,)], "job_id long")
    left = lifecycle.delete_jobs(gone, jobs, candidates, scores)
    assert [f.count() for f in left] == [2, 1, 1]
    assert left[2].columns == scores.columns
    people = spark.createDataFrame([(10,), (20,)], "candidate_id long")
    left = lifecycle.delete_candidates(people, candidates, scores)
    assert sorted(r.candidate_id for r in left[0].collect()) == [11, 12, 13]
    assert sorted(r.score_id for r in left[1].collect()) == [103, 104]


def test_score_of_a_deleted_candidate_goes_with_its_job(stored, spark):
    jobs, candidates, scores = stored
    astray = scores.withColumn("job_id", F.lit(2).cast("long"))
    left = lifecycle.delete_jobs(
        spark.createDataFrame([(1,)], "job_id long"), jobs, candidates, astray
    )
    assert [r.candidate_id for r in left[2].collect()] == [20]


def test_counts(stored):
    jobs, candidates, scores = stored
    single = scores.filter("score_id <> 102")
    assert sorted(map(tuple, counts.processed_counts(jobs, single).collect())) == [(1, 3), (2, 1), (3, 0)]
    assert sorted(map(tuple, counts.candidate_counts(jobs, candidates).collect())) == [(1, 4), (2, 1), (3, 0)]


def ranks(frame):
    return sorted((r.job_id, r["rank"], r.candidate_id) for r in frame.collect())


def test_ranking_order(stored):
    jobs, candidates, scores = stored
    ranked = ranking.rank_candidates(lookups.candidate_profiles(candidates, jobs, scores))
    assert ranks(ranked) == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (1, 4, 12), (2, 1, 20)]


def test_ranking_across_tasks_equals_the_window(spark):
    rng = random.Random(3)
    rows = [
        (c, 0 if rng.random() < 0.6 else rng.randrange(1, 9), rng.choice([None, 0.0, 0.0, 50.0, 99.5]))
        for c in rng.sample(range(100_000), 3000)
    ]
    frame = spark.createDataFrame(rows, "candidate_id long, job_id long, matching_score double").repartition(7)
    order = Window.partitionBy("job_id").orderBy(F.col("matching_score").desc_nulls_last(), "candidate_id")
    plain = ranks(frame.withColumn("rank", F.row_number().over(order)))
    assert ranks(ranking.rank_candidates(frame)) == plain
    assert ranks(ranking.rank_candidates(frame, cell_rows=40)) == plain
    for job in range(9):
        of_job = [r for j, r, _ in plain if j == job]
        assert of_job == list(range(1, len(of_job) + 1))
    top = ranking.top_k_candidates(frame, 3)
    assert ranks(top) == [r for r in plain if r[1] <= 3]


def test_ranking_keeps_doubles_and_nulls(spark):
    rows = [(1, 1, 9.0), (1, 1, 9.0), (None, 1, 9.0), (2, 1, None), (3, None, 1.0), (4, None, 2.0)]
    frame = spark.createDataFrame(rows, "candidate_id long, job_id long, matching_score double")
    for cell_rows in (1, 200_000):
        got = ranking.rank_candidates(frame, cell_rows).collect()
        assert sorted(((r.candidate_id, r.job_id, r["rank"]) for r in got), key=repr) == sorted(
            [(None, 1, 1), (1, 1, 2), (1, 1, 3), (2, 1, 4), (4, None, 1), (3, None, 2)], key=repr
        )


def test_a_crowded_score_is_cut(spark):
    rows = [(c * c - 5_000_000, 1, 0.0) for c in range(5000)] + [(c, 1, 33.335 + c / 10**6) for c in range(50)]
    frame = spark.createDataFrame(rows, "candidate_id long, job_id long, matching_score double")
    ranked = ranking.rank_candidates(frame, cell_rows=300)
    got = [r.candidate_id for r in ranked.orderBy("rank").collect()]
    assert got == [*reversed(range(50)), *(c * c - 5_000_000 for c in range(5000))]
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 5051))


def test_the_input_of_a_ranking_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    fields = "candidate_id long, job_id long, matching_score double"
    frame = spark.createDataFrame([(c, c % 2, float(c % 7)) for c in range(100)], fields)
    assert ranking.rank_candidates(frame.mapInPandas(counted, fields), cell_rows=5).count() == 100
    assert seen.value == 100


def test_the_score_written_first_counts(spark):
    fields = "candidate_id long, score_id long, matching_score double, matched_skills string, missing_skills string, explanation string, t string"
    rows = [(1, 1, 50.0, "", "", "", "2024-02-01"), (1, 1, 70.0, "", "", "", "2024-01-01")]
    scores = spark.createDataFrame(rows, fields).withColumn("created_at", F.col("t").cast("timestamp"))
    assert lookups.first_score(scores).first().matching_score == 70.0


def test_jobs_newest_first(spark):
    jobs = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-02-01")], "job_id long, t string")
    jobs = jobs.select("job_id", F.col("t").cast("timestamp").alias("created_at"))
    assert [r.job_id for r in ranking.list_jobs(jobs).collect()] == [3, 2, 1]
    scored = spark.createDataFrame([(1, 3, 1.0), (2, 3, 2.0), (3, 2, 3.0)], "candidate_id long, job_id long, matching_score double")
    assert ranks(ranking.latest_job_candidates(scored, jobs)) == [(3, 1, 2), (3, 2, 1)]


def test_thresholds(values):
    scores = [80.0, 79.99, 75.0, 74.99, 70.0, 69.99, 50.0, 49.99, 40.0, 39.99, None]
    column = F.col("v")
    assert values(sc.report_status(column), scores, "double") == (
        ["Shortlisted"] * 5 + ["Under Review"] * 4 + ["Not Recommended"] * 2
    )
    assert values(sc.score_band(column), scores, "double") == (
        ["high"] * 3 + ["mid"] * 4 + ["low"] * 3 + [None]
    )
    assert values(sc.mail_status(column), scores[:2], "double") == ["Shortlisted", "Rejected"]
    assert values(sc.rank_badge(column), [1, 3, 4], "int") == ["rank-1", "rank-3", "rank-other"]


def test_report(stored):
    jobs, candidates, scores = stored
    report = candidate_report(lookups.candidate_profiles(candidates, jobs, scores))
    assert tuple(report.columns) == REPORT_COLUMNS
    rows = {r["Candidate Name"]: tuple(r) for r in report.collect()}
    assert rows["Ann"] == (
        "Ann", "ann@x.org", "1", "Dev", "Senior (5 Yrs)", "79.99%", "Shortlisted", "a", "b",
        "Matched 1 skills (79.99%).", "2024-03-05 06:07",
    )
    assert rows["Cid"][5:10] == ("0.0%", "Not Recommended", "N/A", "N/A", "N/A")
    assert rows["Dee"][6:9] == ("Under Review", "", "")


def test_mails(stored):
    jobs, candidates, scores = stored
    profiles = lookups.candidate_profiles(candidates, jobs, scores)
    mails = {r.candidate_id: r for r in notify.notification_outbox(profiles).collect()}
    assert {c: m.status for c, m in mails.items()} == {10: "Rejected", 13: "Rejected", 20: "Shortlisted"}
    assert mails[20].subject == "Application Update: Ops — Shortlisted"
    assert mails[20].body == (
        "Dear Eve,\n\nCongratulations! You have been shortlisted for the Ops position with a match "
        "score of 80.0%. Your skills in the required areas align well with what we are looking for."
        "\n\nOur team will reach out soon with the next steps.\n\nBest regards,\nHiring Team"
    )
    assert "required for this role: b." in mails[10].body
    assert "required for this role: a few key areas." in mails[13].body
    prompts = {r.candidate_id: r.prompt for r in notify.email_prompts(profiles).collect()}
    assert "named Eve informing them they have been SHORTLISTED for the 'Ops' position" in prompts[20]
    assert "Their matching skills: relevant skills." in prompts[20]
    assert "The specific skills they were missing: b." in prompts[10]
    assert "{" not in "".join(prompts.values())
    lenient = notify.notification_decisions(profiles, shortlist=50.0)
    assert {r.status for r in lenient.collect()} == {"Shortlisted"}


def test_a_mail_is_sent_once_per_status(stored, spark):
    jobs, candidates, scores = stored
    outbox = notify.notification_outbox(lookups.candidate_profiles(candidates, jobs, scores))
    nothing = outbox.select(*notify.MAIL_KEY).limit(0)
    first = notify.unsent_mails(outbox.union(outbox), nothing)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, outbox.collect()))
    assert notify.unsent_mails(outbox, first).count() == 0
    changed = outbox.withColumn("status", F.when(F.col("candidate_id") == 10, "Other").otherwise(F.col("status")))
    assert [r.candidate_id for r in notify.unsent_mails(changed, first).collect()] == [10]
    astray = outbox.withColumn("job_id", F.lit(None).cast("long"))
    assert notify.unsent_mails(astray, first).count() == outbox.count()
    assert notify.unsent_mails(astray, astray).count() == 0
