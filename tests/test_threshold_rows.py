"""TF-IDF pairs over a threshold: few pairs are scored from texts, and repeated or null ids are rows."""

from collections import Counter

from rolefit.operators import similarity

JOBS = "job_id long, title string, description string"


def test_only_pairs_that_may_reach_the_threshold_are_scored(spark, monkeypatch):
    """Texts that share some words with every job, and most with one."""
    common = "alpha beta gamma delta"
    jobs = [(j, "t", f"{common} job{j} post{j} role{j} task{j} team{j}") for j in range(20)]
    resumes = [(c, jobs[c % 20][2] + " " + " ".join(f"own{c}x{k}" for k in range(4))) for c in range(100)]
    jobs = spark.createDataFrame(jobs, JOBS)
    resumes = spark.createDataFrame(resumes, "candidate_id long, resume_text string")
    met = []
    written = similarity._written

    def counted(frame):
        kept = written(frame)
        met.append(kept.count())
        return kept

    monkeypatch.setattr(similarity, "_written", counted)
    found = similarity.tfidf_over(resumes, jobs, 40.0).collect()
    assert sorted((r.candidate_id, r.job_id) for r in found) == [(c, c % 20) for c in range(100)]
    assert met == [100]


def test_repeated_and_null_ids(spark):
    """Every row of an id is a text of its own; rows without an id are in no pair."""
    jobs = [(1, "t", "alpha beta gamma"), (1, "t", "alpha beta gamma"), (2, "t", "delta beta"), (None, "t", "alpha beta")]
    resumes = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta zeta eta"), (2, None), (None, "alpha beta")]
    jobs = spark.createDataFrame(jobs, JOBS)
    resumes = spark.createDataFrame(resumes, "candidate_id long, resume_text string")
    found = similarity.tfidf_over(resumes, jobs, 25.0).collect()
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "candidate_id long, job_id long")
    wanted = similarity.tfidf_pairs(pairs, resumes, jobs).filter("tfidf >= 25").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, wanted)) and len(wanted) >= 5
